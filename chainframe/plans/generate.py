"""Building the question table: families and templates are drawn, parameters
sampled, duplicates dropped, texts rendered and answers computed, for all
chains at once.

Candidates per chain are bounded by construction (slots x attempts), so the
per-chain windows below work on at most a few hundred short rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import hash_int
from ..schema import KEY, literal_map
from ..session import cut_lineage
from .templates import (
    FAMILIES, SET_TYPES, SWAPPED_TERMINI, TEMPLATES, ChainSet, answer_template, drawn_params, fill, param, raw_draws,
)

# --- fixed values -------------------------------------------------------------
FAMILY_WEIGHTS = {"A": 0.18, "B": 0.18, "C": 0.13, "D": 0.18, "E": 0.13, "F": 0.13}
TRACKS = {"main": 30, "G": 3, "H": 3}
# Twelve tries per wanted question: four slots of three attempts.
SLOTS, ATTEMPTS = 4, 3
MAX_DRAWS = 5
# ------------------------------------------------------------------------------


def weighted_choice(weights: dict[str, float], draw: Column) -> Column:
    """A label drawn with the given weights from a 32-bit draw."""
    total, upto, out = sum(weights.values()), 0.0, None
    labels = list(weights)
    for label in labels[:-1]:
        upto += weights[label] / total
        out = (F.when if out is None else out.when)(draw < int(upto * 2**32), label)
    return out.otherwise(labels[-1]) if out is not None else F.lit(labels[-1])


def candidates(chains: DataFrame, tracks: dict[str, int], with_matrix: bool, seed=0) -> DataFrame:
    """Every (track, slot, attempt) with family, template and parameters.

    More slots than questions wanted leave room for slots whose attempts are
    all rejected.
    """
    def slots_of(name, n):
        numbers = F.sequence(F.lit(0), F.lit(SLOTS * n - 1))
        return F.transform(numbers, lambda s: F.struct(F.lit(name).alias("track"), s.alias("slot")))

    slots = F.explode(F.flatten(F.array(*[slots_of(name, n) for name, n in tracks.items()])))
    tries = chains.select(*KEY, "length", slots.alias("_s")).select(
        *KEY, "length", "_s.track", "_s.slot",
        F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))).alias("attempt"),
    )
    where = [F.lit(str(seed)), F.col("track"), F.col("slot").cast("string")]
    keys = [F.col(c) for c in KEY]
    draw = F.col("_f")
    drawn = tries.withColumns({
        "_f": hash_int(*keys, *where, F.lit("family")), "_t": hash_int(*keys, *where, F.lit("template")),
    }).withColumn("family", F.when(F.col("track") == "G", "G").when(
        F.col("track") == "H", weighted_choice({"Ha": 0.5, "Hb": 0.5}, draw)
    ).otherwise(weighted_choice(FAMILY_WEIGHTS, draw)))
    listed = F.element_at(literal_lists({f: [t.name for t in ts] for f, ts in FAMILIES.items()}), F.col("family"))
    drawn = drawn.withColumn(
        "template", F.element_at(listed, (F.pmod("_t", F.size(listed)) + 1).cast("int"))
    ).withColumns(raw_draws(MAX_DRAWS, F.col("template"), *where, F.col("attempt").cast("string")))
    usable = [t for t in TEMPLATES.values() if with_matrix or not t.needs_matrix]
    return with_drawn_params(drawn, usable).select(
        *KEY, "length", "track", "slot", "attempt", "family", "template", "params"
    )


def literal_lists(lists: dict[str, list[str]]) -> Column:
    return F.create_map(*[
        v for k, items in lists.items() for v in (F.lit(k), F.array(*[F.lit(i) for i in items]))
    ])


def with_drawn_params(drawn: DataFrame, templates) -> DataFrame:
    """Parameters from the raw draws of each row; rows whose chain does not
    suit the template, or whose template is not listed, are dropped."""
    # Computed once and stored: the filter would otherwise be pushed below the
    # projection and evaluate the whole expression a second time.
    stored = cut_lineage(drawn.withColumn("params", drawn_params(list(templates))))
    return stored.where("params is not null")


def params_key(params: Column) -> Column:
    """Canonical text of a parameter map: names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


# Surplus of one truth value over the other, at most (where a chain and template has both).
SURPLUS = 3


def balanced(rows: DataFrame, answer: Column, order: list, surplus: int = SURPLUS) -> DataFrame:
    """Of the questions of each chain and template, drop the last ones of the more frequent truth value until it has at
    most ``surplus`` more than the other.  Where only one truth value occurs, and where ``answer`` is NULL, all stay.

    Candidates of a chain are bounded by construction, see above.
    """
    group = Window.partitionBy(*KEY, "template")
    turn = F.row_number().over(Window.partitionBy(*KEY, "template", "_b").orderBy(*order))
    rarer = F.least(F.count_if(F.col("_b")).over(group), F.count_if(~F.col("_b")).over(group))
    marked = rows.withColumn("_b", answer).withColumns({"_turn": turn, "_rarer": rarer})
    stays = F.col("_b").isNull() | (F.col("_rarer") == 0) | (F.col("_turn") <= F.col("_rarer") + surplus)
    return marked.where(stays).drop("_b", "_turn", "_rarer")


def choose_balanced(rows: DataFrame, chains: ChainSet, per_track: dict[str, int] = TRACKS) -> DataFrame:
    """``choose`` after the candidates' truth values are known and balanced; spare slots make up for what is dropped."""
    named = cut_lineage(rows.withColumn("qid", F.concat_ws("/", *KEY, "track", F.col("slot").cast("string"), F.col("attempt").cast("string"))))
    kinds = [t.name for t in TEMPLATES.values() if t.answer_type == "Bool" and (chains.pae_rows is not None or not t.needs_matrix)]
    values = answer_all(named.where(F.col("template").isin(kinds)), chains, kinds).select(
        "qid", (F.col("answer") == "true").alias("_value"))
    known = named.join(values, "qid", "left")
    order = ["track", "slot", "attempt"]
    return choose(balanced(known, F.col("_value"), order).drop("qid", "_value"), per_track)


def choose(rows: DataFrame, per_track: dict[str, int] = TRACKS) -> DataFrame:
    """Per chain: no (template, parameters) twice, the first acceptable attempt
    of each slot, and at most the wanted number of slots per track."""
    order = [F.array_position(F.array(*[F.lit(t) for t in per_track]), F.col("track")), "slot", "attempt"]
    keyed = rows.withColumn("_key", params_key(F.col("params")))
    first_use = F.row_number().over(Window.partitionBy(*KEY, "template", "_key").orderBy(*order))
    first_try = F.row_number().over(Window.partitionBy(*KEY, "track", "slot").orderBy("attempt"))
    turn = F.row_number().over(Window.partitionBy(*KEY, "track").orderBy("slot"))
    wanted = F.element_at(F.create_map(*[F.lit(v) for kv in per_track.items() for v in kv]), F.col("track"))
    chosen = (
        keyed.withColumn("_use", first_use).where("_use = 1")
        .withColumn("_try", first_try).where("_try = 1")
        .withColumn("_turn", turn).where(F.col("_turn") <= wanted)
    )
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1
    return chosen.withColumn("_number", number).select(
        F.concat_ws("/", *KEY, "template", F.col("_number").cast("string")).alias("qid"),
        *KEY, "length", "family", "template", "params",
    )


def per_template(value) -> Column:
    """A template attribute looked up by the row's template."""
    return F.try_element_at(literal_map({t.name: value(t) for t in TEMPLATES.values()}), F.col("template"))


def wordings() -> Column:
    listed = literal_lists({t.name: t.wording for t in TEMPLATES.values()})
    return F.try_element_at(listed, F.col("template"))


def question_text(paraphrase: Column) -> Column:
    """The wording chosen by ``paraphrase`` modulo their number, filled in."""
    listed = wordings()
    return fill(F.element_at(listed, (F.pmod(paraphrase, F.size(listed)) + 1).cast("int")))


def program_text() -> Column:
    swapped = (F.col("template") == "A2") & (param("n_first") == 0)
    return fill(F.when(swapped, F.lit(SWAPPED_TERMINI)).otherwise(per_template(lambda t: t.program)))


def with_texts(q: DataFrame, seed=0) -> DataFrame:
    """program, answer_type, paraphrase_id and the question text."""
    turn = F.pmod(hash_int(F.lit(str(seed)), F.col("qid")), F.size(wordings()))
    return q.withColumns({
        "program": program_text(),
        "answer_type": per_template(lambda t: t.answer_type),
        "paraphrase_id": turn.cast("int"),
    }).withColumn("question", question_text(F.col("paraphrase_id")))


def rerender(q: DataFrame) -> DataFrame:
    """Write all question texts anew from the current wordings.  ``changed``
    tells which rows differ, ``err`` which name an unknown template."""
    known = F.col("template").isin(list(TEMPLATES))
    fresh = F.when(known, question_text(F.col("paraphrase_id")))
    return q.withColumn("_new", fresh).withColumns({
        "changed": known & ~F.col("_new").eqNullSafe(F.col("question")),
        "err": F.when(~known, F.lit("unknown template")),
        "question": F.coalesce("_new", "question"),
    }).drop("_new")


def answer_text(df: DataFrame) -> Column:
    """The JSON text of a plan's value columns."""
    return F.coalesce(
        F.col("s"), F.col("b").cast("string"), F.col("n").cast("string"), F.col("f").cast("string"),
        F.concat(F.lit("["), "r_start", F.lit(", "), "r_end", F.lit("]")),
    )


def set_text(members: DataFrame, pairs: bool) -> DataFrame:
    """Sorted JSON list per question.  A list is one answer cell, so it is as
    large as the answer itself; the member rows are the scalable form."""
    item = F.struct("i", "j") if pairs else F.struct("i")
    listed = members.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("_m"))
    if pairs:
        show = F.transform("_m", lambda m: F.concat(F.lit("["), m["i"], F.lit(", "), m["j"], F.lit("]")))
    else:
        show = F.transform("_m", lambda m: m["i"].cast("string"))
    return listed.select("qid", F.concat(F.lit("["), F.array_join(show, ", "), F.lit("]")).alias("answer"))


def answer_all(q: DataFrame, chains: ChainSet, templates: list[str], gold: bool = True) -> DataFrame:
    """qid, answer (JSON text) and err for questions of several templates: one
    plan per template, all of them over the same chain tables."""
    parts = []
    for name in templates:
        mine = q.where(F.col("template") == name)
        kind = TEMPLATES[name].answer_type
        if kind in SET_TYPES:
            found = set_text(answer_template(name, mine, chains, gold), kind == "PairSet")
            part = mine.select("qid").join(found, "qid", "left").select(
                "qid", F.coalesce("answer", F.lit("[]")).alias("answer"), F.lit(None).cast("string").alias("err")
            )
        else:
            got = answer_template(name, mine, chains, gold)
            part = got.select("qid", answer_text(got).alias("answer"), "err")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)
