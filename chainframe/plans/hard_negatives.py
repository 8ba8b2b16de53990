"""Hard negatives: the same question about the same chain with parameters that
change the answer by more than the scorer forgives.

``positives``: qid, KEY, length, family, template, params, answer, answer_type.
Every variant of every positive is answered in one batch per template; the
first variant (in draw order) whose answer differs is kept.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import answers_differ
from ..operators.ranking import hash_int, hash_rank
from ..schema import KEY
from ..session import cut_lineage
from .generate import answer_all, params_key, weighted_choice, with_drawn_params, with_texts
from .templates import TEMPLATES, ChainSet, raw_draws

# --- fixed values -------------------------------------------------------------
CLASS_WEIGHTS = {
    "A": (0.70, 0.15, 0.15), "B": (0.70, 0.15, 0.15), "C": (0.70, 0.15, 0.15),
    "D": (0.70, 0.15, 0.15), "E": (0.85, 0.05, 0.10), "F": (0.65, 0.15, 0.20),
    "G": (1.0, 0.0, 0.0), "Ha": (1.0, 0.0, 0.0), "Hb": (1.0, 0.0, 0.0),
}
CANDIDATES = {
    "threshold": [4, 5, 6, 8, 10, 12, 15, 20],
    "plddt_thr": [40, 50, 60, 70, 80, 90],
    "sasa_thr": [0.05, 0.10, 0.15, 0.20, 0.30, 0.50],
    "cd_thr": [0.10, 0.20, 0.30, 0.40, 0.50],
    "pae_max": [5, 10, 15, 20, 25, 30],
    "coverage_thr": [10, 20, 30, 40, 50, 60],
    "pae_thr": [5, 10, 15, 20, 25],
    "neighbor_threshold": [4, 8, 12, 16, 20],
}
MAX_ATTEMPTS = 30
RATIO = 0.10
# ------------------------------------------------------------------------------


def sample_fraction(positives: DataFrame, ratio: float = RATIO, seed=0) -> DataFrame:
    """Per chain max(1, round(n * ratio)) questions, without replacement."""
    ranked = hash_rank(positives, KEY, "qid", f"hn/{seed}", "_rank", total="_n")
    wanted = F.greatest(F.lit(1), F.rint(F.col("_n") * ratio))
    return ranked.where(F.col("_rank") <= wanted).drop("_rank", "_n")


def class_choice(seed=0) -> Column:
    """HN1 / HN2 / HN3 by the weights of the question's family."""
    draw = hash_int(F.lit(f"class/{seed}"), F.col("qid"))
    out = None
    for family, weights in CLASS_WEIGHTS.items():
        named = dict(zip(("HN1", "HN2", "HN3"), weights))
        choice = weighted_choice(named, draw)
        out = (F.when if out is None else out.when)(F.col("family") == family, choice)
    return out.otherwise("HN1")


def resampled(positives: DataFrame, templates: list[str], attempts: int = MAX_ATTEMPTS, seed=0) -> DataFrame:
    """HN1 variants: fresh parameter draws, numbered in ``order``."""
    tries = positives.withColumn("_old", params_key(F.col("params"))).drop("params").withColumn(
        "order", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))
    ).withColumns(
        raw_draws(5, F.col("template"), F.lit(f"hn1/{seed}"), F.col("qid"), F.col("order").cast("string"))
    )
    fresh = with_drawn_params(tries, [TEMPLATES[t] for t in templates])
    return fresh.where(params_key(F.col("params")) != F.col("_old")).drop("_old", *[f"_d{k}" for k in range(5)])


def threshold_flips(positives: DataFrame, seed=0) -> DataFrame:
    """HN2 variants: one threshold replaced by each other candidate value, in
    a random order."""
    present = F.array_intersect(
        F.map_keys("params"), F.array(*[F.lit(k) for k in CANDIDATES])
    )
    turn = F.pmod(hash_int(F.lit(f"hn2/{seed}"), F.col("qid")), F.greatest(F.size(present), F.lit(1)))
    chosen = F.get(F.array_sort(present), turn.cast("int"))
    keyed = positives.where(F.size(present) > 0).withColumn("_key", chosen)
    listed = F.create_map(*[
        v for k, values in CANDIDATES.items()
        for v in (F.lit(k), F.array(*[F.lit(float(x)) for x in values]))
    ])
    opened = keyed.select("*", F.explode(F.element_at(listed, F.col("_key"))).alias("_value")).where(
        F.element_at("params", F.col("_key")) != F.col("_value")
    )
    replaced = F.transform_values(
        "params", lambda k, v: F.when(k == F.col("_key"), F.col("_value")).otherwise(v)
    )
    order = hash_int(F.lit(f"hn2/{seed}"), F.col("qid"), F.col("_value"))
    return opened.withColumns({"order": order, "params": replaced}).drop("_key", "_value")


def first_differing(variants: DataFrame, chains: ChainSet, templates: list[str]) -> DataFrame:
    """Answer all variants and keep, per positive, the first whose answer
    differs: source qid, order, params, new_answer."""
    keyed = variants.withColumnsRenamed({"qid": "source_qid", "answer": "old_answer"}).withColumn(
        "qid", F.concat_ws("#", "source_qid", F.col("order").cast("string"))
    )
    # Every template's plan reads the variants, so they are computed once.
    keyed = cut_lineage(keyed)
    answered = answer_all(keyed, chains, templates).where("err is null and answer is not null")
    joined = keyed.join(answered.drop("err"), "qid")
    differ = answers_differ(F.col("answer"), F.col("old_answer"), F.col("answer_type"))
    best = joined.where(differ).groupBy("source_qid").agg(
        F.min_by(F.struct("order", "params", "answer"), F.col("order")).alias("b")
    )
    return best.select(
        F.col("source_qid").alias("qid"), F.col("b.order").alias("order"),
        F.col("b.params").alias("new_params"), F.col("b.answer").alias("new_answer"),
    )


def mine(positives: DataFrame, chains: ChainSet, templates: list[str], seed=0) -> DataFrame:
    """One hard negative per positive where one can be found.  HN3 is served
    by HN1, and so is HN2 when no threshold changes the answer."""
    # Both are read several times below; their answers are worked out once.
    positives = cut_lineage(positives)
    drawn = positives.withColumn("_class", class_choice(seed))
    flipped = cut_lineage(first_differing(threshold_flips(drawn.where("_class = 'HN2'"), seed), chains, templates))
    left = drawn.join(flipped.select("qid"), "qid", "left_anti")
    fresh = first_differing(resampled(left, templates, seed=seed), chains, templates)
    found = flipped.withColumn("hn_class", F.lit("HN2")).unionByName(
        fresh.withColumn("hn_class", F.lit("HN1")), allowMissingColumns=True
    )
    kept = positives.drop("answer", "params", "program", "question", "paraphrase_id").join(found, "qid")
    named = kept.withColumns({
        "hn_source_qid": F.col("qid"), "qid": F.concat_ws("/", "qid", "hn_class"),
        "params": F.col("new_params"), "answer": F.col("new_answer"),
        "is_hard_negative": F.lit(True),
    }).drop("new_params", "new_answer", "order")
    return with_texts(named, seed)


def templates_of(positives: DataFrame) -> list[str]:
    return sorted(r["template"] for r in positives.select("template").distinct().collect() if r["template"] in TEMPLATES)
