"""Consensus over sampled answers.

Input: one row per sample with ``qid``, ``idx`` (order of sampling) and a
value.  Votes are counted per distinct value first, so what is shuffled per
question is its distinct answers.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators.ranking import pick_rank
from ..schema import tile_of
from ..session import cut_lineage


def bool_vote(samples: DataFrame, value: str = "value") -> DataFrame:
    """Majority; a tie is true with agreement one half."""
    counted = samples.where(F.col(value).isNotNull()).groupBy("qid").agg(
        F.count_if(F.col(value)).alias("yes"), F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        "qid", (F.col("yes") * 2 >= F.col("n")).alias("answer"),
        (F.greatest(F.col("yes"), F.col("n") - F.col("yes")) / F.col("n")).alias("agreement"),
    )


def mode_vote(samples: DataFrame, value: str = "value") -> DataFrame:
    """Most frequent value (Int, SecStruct, or the text of any other type);
    the one sampled first wins ties."""
    counted = samples.where(F.col(value).isNotNull()).groupBy("qid", value).agg(
        F.count(F.lit(1)).alias("_c"), F.min("idx").alias("_first")
    )
    best = counted.groupBy("qid").agg(
        F.min(F.struct((-F.col("_c")).alias("k"), F.col("_first"), F.col(value).alias("v"))).alias("b"),
        F.sum("_c").alias("n"),
    )
    return best.select("qid", F.col("b.v").alias("answer"), (-F.col("b.k") / F.col("n")).alias("agreement"))


def float_vote(samples: DataFrame, value: str = "value") -> DataFrame:
    """Upper median; agreement is the share within 5 % (at least 0.001) of it."""
    valid = samples.where(F.col(value).isNotNull()).select("qid", F.col(value).alias("v"))
    middle = pick_rank(valid, ["qid"], "v", F.floor(F.col("n") / 2) + 1).select(
        "qid", F.col("v").alias("answer")
    )
    counted = valid.groupBy("qid", "v").agg(F.count(F.lit(1)).alias("_c"))
    slack = F.greatest(F.abs("answer") * 0.05, F.lit(1e-3))
    near = F.abs(F.col("v") - F.col("answer")) <= slack
    return counted.join(middle, "qid").groupBy("qid", "answer").agg(
        (F.sum(F.when(near, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("agreement")
    )


def _settled(score):
    """Sums of overlaps depend on the order of addition in the last bits; equal
    scores must compare equal for the first sample to win."""
    return F.floor(score * 1e12 + 0.5) / 1e12


def _medoid(values: DataFrame, overlaps: DataFrame, same_weight) -> DataFrame:
    """``values``: qid, vid, _c (how often sampled), _first; ``overlaps``: qid,
    a, b, iou between *different* distinct values.  A value also meets its own
    other copies, with overlap ``same_weight``."""
    met = overlaps.alias("o").join(
        values.select("qid", F.col("vid").alias("b"), F.col("_c").alias("_w")), ["qid", "b"]
    ).groupBy("qid", F.col("a").alias("vid")).agg(F.sum(F.col("iou") * F.col("_w")).alias("_others"))
    totals = values.groupBy("qid").agg(F.sum("_c").alias("n"))
    scored = (
        values.join(met, ["qid", "vid"], "left").join(totals, "qid")
        .withColumn(
            "score",
            (F.coalesce("_others", F.lit(0.0)) + (F.col("_c") - 1) * same_weight)
            / F.greatest(F.col("n") - 1, F.lit(1)),
        )
    )
    best = scored.groupBy("qid").agg(
        F.min(F.struct((-_settled(F.col("score"))).alias("k"), "_first", "vid")).alias("b")
    )
    return best.select("qid", F.col("b.vid").alias("vid"), (-F.col("b.k")).alias("agreement"))


def region_vote(samples: DataFrame) -> DataFrame:
    """The sampled (start, end) with the largest mean overlap with the others.

    Only regions that share a position can overlap, so distinct regions meet
    through the tiles they cover; a pair is kept at the tile where the later of
    the two begins.
    """
    values = samples.where("start is not null and end is not null").groupBy("qid", "start", "end").agg(
        F.count(F.lit(1)).alias("_c"), F.min("idx").alias("_first")
    ).withColumn("vid", F.concat_ws("-", "start", "end"))
    tiles = values.where("end >= start").select(
        "qid", "vid", "start", "end",
        F.explode(F.sequence(tile_of(F.col("start")), tile_of(F.col("end")))).alias("_tile"),
    )
    a, b = tiles.alias("a"), tiles.alias("b")
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1
    joint = (F.col("a.end") - F.col("a.start") + 1) + (F.col("b.end") - F.col("b.start") + 1) - shared
    meets = (
        (F.col("a.qid") == F.col("b.qid")) & (F.col("a._tile") == F.col("b._tile"))
        & (F.col("a.vid") != F.col("b.vid"))
        & (F.col("a._tile") == tile_of(F.greatest("a.start", "b.start"))) & (shared > 0)
    )
    overlaps = a.join(b, meets).select(
        F.col("a.qid").alias("qid"), F.col("a.vid").alias("a"), F.col("b.vid").alias("b"),
        (shared / joint).alias("iou"),
    )
    same = F.when(F.col("end") >= F.col("start"), 1.0).otherwise(0.0)
    best = _medoid(values, overlaps, same)
    return best.join(values.select("qid", "vid", "start", "end"), ["qid", "vid"]).drop("vid")


def set_vote(members: DataFrame, samples: DataFrame, columns=("i",)) -> DataFrame:
    """The sampled set with the largest mean Jaccard overlap with the others.

    ``samples`` lists every sample (qid, idx), also the empty ones; ``members``
    has one row per member.  Equal sets are merged first (by size and two
    64-bit sums over the members; a set with an unreadable member equals no
    other); distinct sets meet through their common members.
    """
    sized = members.select("qid", "idx", *columns).distinct()
    unreadable = F.lit(False)
    for c in columns:
        unreadable = unreadable | F.col(c).isNull()
    marks = sized.groupBy("qid", "idx").agg(
        F.count(F.lit(1)).alias("_size"), F.bit_xor(F.xxhash64(*columns)).alias("_x"),
        F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("_y"), F.bool_or(unreadable).alias("_own"),
    )
    sets = samples.select("qid", "idx").distinct().join(marks, ["qid", "idx"], "left").fillna(0, ["_size"])
    # Empty sets are equal, and agree with nothing else.
    values = sets.groupBy("qid", "_size", "_x", "_y", F.when(F.col("_own"), F.col("idx")).alias("_alone")).agg(
        F.min("idx").alias("vid"), F.count(F.lit(1)).alias("_c")
    ).select("qid", "vid", F.col("vid").alias("_first"), "_c", "_size")
    distinct = sized.join(values.select("qid", F.col("vid").alias("idx"), "_size"), ["qid", "idx"])
    a, b = distinct.alias("a"), distinct.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("qid", *columns)]
    overlaps = a.join(b, [*on, F.col("a.idx") != F.col("b.idx")]).groupBy(
        F.col("a.qid").alias("qid"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b")
    ).agg(
        F.count(F.lit(1)).alias("_both"), (F.max("a._size") + F.max("b._size")).alias("_sum")
    ).select("qid", "a", "b", (F.col("_both") / (F.col("_sum") - F.col("_both"))).alias("iou"))
    best = _medoid(values, overlaps, F.lit(1.0))
    return best.select("qid", F.col("vid").alias("idx"), "agreement")


def consensus(samples: DataFrame) -> DataFrame:
    """Dispatch on ``answer_type``; ``value`` is the JSON text of each sample
    (NULL for a failed one).  Returns qid, answer (text) and agreement."""
    # Every branch reads the samples, so they are computed once.
    samples = cut_lineage(samples.select("qid", "idx", "answer_type", "value"))
    ok = samples.where(scoring.type_gate(F.col("value"), F.col("answer_type")))
    kind = F.col("answer_type")

    def of(types):
        return ok.where(kind.isin(types))

    bools = bool_vote(of(["Bool"]).withColumn("value", text.parse_bool(F.col("value"))))
    floats = float_vote(of(["Float"]).withColumn("value", F.col("value").try_cast("double")))
    regions = region_vote(
        of(["Region"]).withColumn("_r", text.parse_region(F.col("value"))).select("qid", "idx", "_r.start", "_r.end")
    )
    modes = mode_vote(ok.where(~kind.isin("Bool", "Float", "Region", "ResidueSet", "PairSet")))
    sets = []
    for name, pairs in (("ResidueSet", False), ("PairSet", True)):
        some = of([name])
        parsed = some.withColumn("_m", F.explode(scoring.members(F.col("value"), pairs)))
        best = set_vote(parsed.withColumn("i", F.col("_m")), some)
        sets.append(best.join(some.select("qid", "idx", "value"), ["qid", "idx"]).select(
            "qid", F.col("value").alias("answer"), "agreement"))
    region_text = F.concat(F.lit("["), "start", F.lit(", "), "end", F.lit("]"))
    out = (
        bools.select("qid", F.col("answer").cast("string").alias("answer"), "agreement")
        .unionByName(floats.select("qid", F.col("answer").cast("string").alias("answer"), "agreement"))
        .unionByName(regions.select("qid", region_text.alias("answer"), "agreement"))
        .unionByName(modes)
    )
    for s in sets:
        out = out.unionByName(s)
    questions = samples.select("qid").distinct()
    return questions.join(out, "qid", "left").fillna(0.0, ["agreement"])


def keep_reflected(reflected: DataFrame, samples: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Second pass: questions whose agreement was below ``threshold`` take the
    reflected value, provided one of the samples had produced it too."""
    seen = samples.select("qid", "value").distinct()
    allowed = reflected.select("qid", F.col("value").alias("_new")).join(
        seen.withColumnRenamed("value", "_new"), ["qid", "_new"], "left_semi"
    )
    return first.join(allowed, "qid", "left").select(
        "qid",
        F.when(F.col("agreement") < threshold, F.coalesce("_new", "answer")).otherwise(F.col("answer")).alias("answer"),
        "agreement",
    )


def first_success(attempts: DataFrame) -> DataFrame:
    """Retry rounds: per question the first attempt without an error, and how
    many attempts were made up to it (all of them if none worked)."""
    ok = F.col("err").isNull()
    best = attempts.groupBy("qid").agg(
        F.min(F.when(ok, F.struct("attempt", "value"))).alias("b"), F.count(F.lit(1)).alias("_n")
    )
    return best.select(
        "qid", F.col("b.value").alias("value"),
        F.coalesce(F.col("b.attempt"), F.col("_n")).cast("long").alias("n_attempts"),
    )
