"""Texts built from chains and examples: summaries, examples, prompts, tool
observations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed_text
from ..operators import windows as W
from ..operators.pairs import distance
from ..operators.ranking import hash_below, hash_int, hash_piece, number_rows
from ..operators.runs import run_counts
from ..schema import KEY

# --- fixed values -------------------------------------------------------------
BAND = 80
LEGEND = "  Legend for pLDDT band: '#' >=90, '+' 70-89, '.' 50-69, '?' <50.\n"
# ------------------------------------------------------------------------------


def band_char(score: Column) -> Column:
    return F.when(score >= 90, "#").when(score >= 70, "+").when(score >= 50, ".").otherwise("?")


def bands(residues: DataFrame, width: int = BAND) -> DataFrame:
    """Score and label bands of every chain, at most ``width`` characters.

    Each chain asks for ``width`` evenly spaced positions and looks them up,
    so a long chain is never gathered.
    """
    chains = residues.where("i = 1").select(*KEY, "length")
    spots = chains.select(
        *KEY, "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("length"), F.lit(width)) - 1)).alias("k"),
    )
    even = F.floor(F.col("k") * ((F.col("length") - 1) / F.lit(float(width - 1))))
    last = F.when(F.col("k") == width - 1, F.col("length") - 1).otherwise(even)
    spots = spots.withColumn("i", F.when(F.col("length") > width, last).otherwise(F.col("k")) + 1)
    seen = spots.join(residues.select(*KEY, "i", "plddt", "ss"), [*KEY, "i"])
    return seen.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("k", band_char(F.col("plddt")).alias("c"), "ss"))).alias("_b"),
        F.min("plddt").alias("band_min"), F.max("plddt").alias("band_max"),
    ).select(
        *KEY, F.array_join(F.transform("_b", lambda b: b["c"]), "").alias("plddt_band"),
        F.array_join(F.transform("_b", lambda b: b["ss"]), "").alias("ss_band"), "band_min", "band_max",
    )


def chain_summaries(residues: DataFrame, width: int = BAND) -> DataFrame:
    whole = residues.groupBy(*KEY).agg(
        F.max("length").alias("length"), F.avg(F.col("plddt").cast("double")).alias("mean_plddt")
    )
    joined = whole.join(run_counts(residues, ["H", "E"]), KEY).join(bands(residues, width), KEY)
    text = F.format_string(
        "Protein: %s (%s)\n  Length: %d residues\n  Mean pLDDT: %s\n  Helix runs: %d, strand runs: %d\n"
        f"  pLDDT band ({width} bins, range %s-%s): %s\n  SS band:   %s\n" + LEGEND,
        "uniprot", "species", "length", fixed_text(F.col("mean_plddt"), 1), "n_H", "n_E",
        fixed_text(F.col("band_min"), 0), fixed_text(F.col("band_max"), 0), "plddt_band", "ss_band",
    )
    return joined.select(*KEY, text.alias("summary"))


def pick_exemplars(train: DataFrame, targets: DataFrame, n: int = 4, seed=0) -> DataFrame:
    """``n`` training examples per target: same template on another chain,
    then same family with another template, then any other family.

    The pool of a tier is numbered with the rows a target must not take (its
    own chain, template or family) side by side.  The rest is a circle with a
    gap; a target takes consecutive places from a random start and finds the
    rows by rank.  No target meets the pool.
    """
    tiers = [("template", "uniprot"), ("family", "template"), (None, "family")]
    pool0 = train.select("qid", "uniprot", "family", "template").withColumn("_all", F.lit(1))
    wants = targets.select(F.col("qid").alias("target"), "uniprot", "family", "template").withColumns(
        {"_all": F.lit(1), "_taken": F.lit(0).cast("long")}
    )
    picks = None
    for tier, (group, avoid) in enumerate(tiers, 1):
        g = group or "_all"
        he, hq = hash_int(F.lit(f"ex/{seed}"), F.col(avoid)), hash_int(F.lit(f"ex/{seed}"), F.col("qid"))
        tagged = pool0.withColumns({"_he": he, "_hq": hq})
        piece = F.struct(F.col("_he"), F.col(avoid).alias("a"), hash_piece(F.col("_hq")).alias("b"))
        ranked = number_rows(tagged, [g], ["_he", avoid, "_hq", "qid"], piece, "_rank", "_n")
        gaps = ranked.groupBy(g, avoid).agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("_gap"))
        sizes = pool0.groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
        asked = wants.join(sizes, g, "left").join(gaps, [g, avoid], "left").fillna(0, ["_n", "_from", "_gap"])
        free = F.col("_n") - F.col("_gap")
        take = F.greatest(F.least(F.lit(n) - F.col("_taken"), free), F.lit(0).cast("long"))
        asked = asked.withColumns({"_free": free, "_take": take})
        start = hash_below(F.greatest(F.col("_free"), F.lit(1)), F.lit(f"ex/{seed}/{tier}"), F.col("target"))
        spots = asked.where("_take > 0").withColumn("_start", start).select(
            "target", g, "_free", "_from", "_gap", "_start", "_taken",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1)).alias("_k"),
        )
        place = F.pmod(F.col("_start") + F.col("_k"), F.col("_free"))
        before = (F.col("_gap") == 0) | (place < F.col("_from") - 1)
        rank = F.when(before, place + 1).otherwise(place + 1 + F.col("_gap"))
        found = spots.withColumn("_rank", rank).join(ranked.select(g, "_rank", "qid"), [g, "_rank"]).select(
            "target", (F.col("_taken") + F.col("_k") + 1).alias("place"), F.col("qid").alias("exemplar"),
            F.lit(tier).alias("tier"),
        )
        picks = found if picks is None else picks.unionByName(found)
        wants = asked.withColumn("_taken", F.col("_taken") + F.col("_take")).select(*wants.columns)
    return picks


def pick_across_families(train: DataFrame, targets: DataFrame, n: int = 4, seed=0) -> DataFrame:
    """``n`` training examples per target, none of the target's template, from as many families as there are: families take
    turns in the order of their names, and one without further rows is passed over.  target, place, exemplar.

    Families are few: their sizes are one array, and each target works out its turns from it.  Rows of a family are numbered
    in a random order that keeps templates together, so those of the target's template are a gap; a target takes
    consecutive places of the rest from a random start.
    """
    pool = train.select("qid", "family", "template")
    he, hq = hash_int(F.lit(f"across/{seed}"), F.col("template")), hash_int(F.lit(f"across/{seed}"), F.col("qid"))
    tagged = pool.withColumns({"_he": he, "_hq": hq})
    piece = F.struct(F.col("_he"), F.col("template").alias("a"), hash_piece(F.col("_hq")).alias("b"))
    ranked = number_rows(tagged, ["family"], ["_he", "template", "_hq", "qid"], piece, "_rank", "_n")
    gaps = ranked.groupBy("family", "template").agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("_gap"))
    sizes = pool.groupBy("family").agg(F.count(F.lit(1)).alias("size")).agg(
        F.array_sort(F.collect_list(F.struct("family", "size"))).alias("_sizes")).withColumn("_all", F.lit(1))
    # A template can stand in several families; each has its own gap.
    own = gaps.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("family", F.struct("_from", "_gap")))).alias("_gaps"))
    asked = targets.select(F.col("qid").alias("target"), "template", F.lit(1).alias("_all")).join(sizes, "_all").join(own, "template", "left")
    def opened(s):
        gap = F.try_element_at(F.col("_gaps"), s["family"])
        size = F.coalesce(gap["_gap"], F.lit(0))
        return F.struct(s["family"].alias("family"), F.coalesce(gap["_from"], F.lit(0)).alias("_from"), size.alias("_gap"), (s["size"] - size).alias("_free"))

    def taken(k):
        return F.transform(F.filter("_open", lambda o: o["_free"] > k), lambda o: F.struct(k.alias("_k"), o.alias("_o")))

    # The turns of a target by round and family, the first n of them; nothing but those leaves its row.
    turns = F.slice(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), taken)), 1, n)
    spots = asked.withColumn("_open", F.transform("_sizes", opened)).select("target", F.posexplode(turns).alias("_at", "_t")).select(
        "target", (F.col("_at") + 1).cast("long").alias("place"), "_t._k", "_t._o.*")
    start = hash_below(F.col("_free"), F.lit(f"across/{seed}"), F.col("target"), F.col("family"))
    at = F.pmod(start + F.col("_k"), F.col("_free"))
    before = (F.col("_gap") == 0) | (at < F.col("_from") - 1)
    chosen = spots.withColumn("_rank", F.when(before, at + 1).otherwise(at + 1 + F.col("_gap")))
    return chosen.join(ranked.select("family", "_rank", F.col("qid").alias("exemplar")), ["family", "_rank"]).select("target", "place", "exemplar")


def few_shot_block(picks: DataFrame, train: DataFrame) -> DataFrame:
    """The chosen examples of each target as one text (``n`` of them)."""
    answer = F.when(
        F.col("answer_type").startswith("Float") & F.col("answer").try_cast("double").isNotNull(),
        fixed_text(F.col("answer").try_cast("double"), 3),
    ).otherwise(F.col("answer"))
    shown = picks.join(
        train.select(F.col("qid").alias("exemplar"), "question", "program", answer.alias("answer")), "exemplar"
    ).withColumn("text", F.format_string(
        "\nExample %d:\nQuestion: %s\nProgram: %s\nAnswer: %s", "place", "question", "program", "answer"
    ))
    return shown.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_t")
    ).select("target", F.concat(
        F.lit("Examples:\n"), F.array_join(F.transform("_t", lambda t: t["text"]), "\n")
    ).alias("examples"))


RULES = {
    "direct": "Answer with the value only.",
    "program": "Answer with one program of the query language and nothing else.",
    "agent": "Use one tool per turn and finish with <answer>...</answer>.",
}


def prompts(questions: DataFrame, summaries: DataFrame, examples: DataFrame, regime: str, budget: int | None = None) -> DataFrame:
    """qid, prompt, err; a prompt longer than ``budget`` characters is NULL and ``err`` says so."""
    joined = questions.join(summaries, KEY).join(examples.withColumnRenamed("target", "qid"), "qid", "left")
    text = F.concat_ws(
        "\n\n", F.lit(RULES[regime]), "summary", "examples", F.concat(F.lit("Question: "), "question"),
        F.concat(F.lit("Answer type: "), "answer_type"),
    )
    out = joined.select("qid", text.alias("prompt"))
    over = F.lit(False) if budget is None else F.length("prompt") > budget
    return out.select(
        "qid", F.when(~over, F.col("prompt")).alias("prompt"), F.when(over, F.lit("prompt exceeds the budget")).alias("err")
    )


# ---------------------------------------------------------------- tools ----

def inspect_residues(requests: DataFrame, residues: DataFrame) -> DataFrame:
    """requests: rid, KEY, i."""
    seen = requests.join(residues, [*KEY, "i"], "left")
    text = F.format_string(
        "residue %d: pLDDT=%s, SS=%s, rel_sasa=%s, aa=%s", "i",
        fixed_text(F.col("plddt"), 2), "ss", fixed_text(F.col("rel_sasa"), 3), "aa",
    )
    return seen.select("rid", F.when(F.col("ss").isNull(), "tool error: residue index out of range").otherwise(text).alias("observation"))


def measure_distances(requests: DataFrame, residues: DataFrame) -> DataFrame:
    """requests: rid, KEY, i, j."""
    at = residues.select(*KEY, "i", "x", "y", "z")
    a = requests.join(at, [*KEY, "i"], "left").alias("a")
    both = a.join(
        at.withColumnRenamed("i", "j").alias("b"),
        [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*KEY, "j")], "left",
    )
    d = distance("a", "b")
    text = F.format_string("CA-CA distance between residues %d and %d = %s A", "a.i", "a.j", fixed_text(d, 2))
    return both.select("a.rid", F.when(d.isNull(), "tool error: residue index out of range").otherwise(text).alias("observation"))


def region_observations(values: DataFrame) -> DataFrame:
    """From region values (see ``region_tool_metrics``) to text."""
    text = F.format_string(
        "region [%d,%d]: mean_plddt=%s, min_plddt=%s, max_plddt=%s, std_plddt=%s, mean_rel_sasa=%s, "
        "n_helix_residues=%d, n_strand_residues=%d, n_coil_residues=%d, length=%d, radius_of_gyration=%s",
        "start", "end", *[fixed_text(F.col(c), 2) for c in ("mean", "low", "high", "std")],
        fixed_text(F.col("exposed"), 3), "n_h", "n_e", "n_c",
        F.col("end") - F.col("start") + 1, fixed_text(F.col("rg"), 2),
    )
    return values.select("qid", F.when(F.col("err").isNotNull(), F.concat(F.lit("tool error: "), "err")).otherwise(text).alias("observation"))


def region_tool_metrics() -> dict:

    return {
        "mean": W.mean("plddt"), "low": W.lowest("plddt"), "high": W.highest("plddt"), "std": W.deviation("plddt"),
        "exposed": W.mean("rel_sasa"), "n_h": W.occurrences("ss", "H"), "n_e": W.occurrences("ss", "E"), "n_c": W.occurrences("ss", "C"), "rg": W.gyration(),
    }


def block_observation(values: DataFrame) -> DataFrame:
    text = F.format_string("mean PAE([%d,%d] vs [%d,%d]) = %s", "a_start", "a_end", "b_start", "b_end", fixed_text(F.col("mean_pae"), 2))
    return values.select("qid", F.when(F.col("err").isNotNull(), F.concat(F.lit("tool error: "), "err")).otherwise(text).alias("observation"))


def program_observation(answers: DataFrame) -> DataFrame:
    text = F.concat(F.lit("result = "), F.coalesce("answer", F.lit("None")))
    return answers.select("qid", F.when(F.col("err").isNotNull(), F.concat(F.lit("tool_dsl error: "), "err")).otherwise(text).alias("observation"))
