"""Dataset statistics and cross-checks of two independently derived tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matrix import upper_triangle
from ..operators.ranking import pick_ranks
from ..schema import KEY

# --- fixed values: agreement tolerances ---------------------------------------
TOLERANCE = {"score": 0.05, "distance": 0.01, "pae": 0.5, "sasa": 5.0}
# ------------------------------------------------------------------------------


def percentiles(rows: DataFrame, by: list[str], value: str, at: list[float], piece: Column) -> DataFrame:
    """Linearly interpolated percentiles of groups of any size.

    The two neighbouring ranks of all percentiles are looked up in one pass:
    values are counted, and only the pieces that hold a rank are opened.
    """
    spots = {f"p{int(q * 100)}": (F.col("n") - 1) * F.lit(q) for q in at}
    ranks = {}
    for name, spot in spots.items():
        ranks |= {f"{name}_lo": F.floor(spot) + 1, f"{name}_hi": F.ceil(spot) + 1}
    found = pick_ranks(rows, by, value, ranks, piece)
    low, high = (lambda name: F.col(f"{name}_lo")), (lambda name: F.col(f"{name}_hi"))
    return found.select(*by, *[
        (low(name) + (high(name) - low(name)) * (spot - F.floor(spot)).cast("double")).alias(name)
        for name, spot in spots.items()
    ])


def chain_statistics(residues: DataFrame) -> DataFrame:
    """Lengths and score bands per species."""
    score = F.col("plddt").cast("double")
    share = lambda cond: (F.count_if(cond) / F.count(F.lit(1)))
    bands = residues.groupBy("species").agg(
        F.count_if(F.col("i") == 1).alias("n_chains"),
        F.avg(F.when(F.col("i") == 1, F.col("length"))).alias("length_mean"),
        F.stddev_pop(F.when(F.col("i") == 1, F.col("length"))).alias("length_std"),
        F.min("length").alias("length_min"), F.max("length").alias("length_max"),
        F.avg(score).alias("plddt_mean"),
        share(score < 50).alias("frac_lt_50"), share((score >= 50) & (score < 70)).alias("frac_50_70"),
        share((score >= 70) & (score < 90)).alias("frac_70_90"), share(score >= 90).alias("frac_ge_90"),
    )
    return bands


def length_percentiles(chains: DataFrame, at=(0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """``chains`` has one row per chain."""
    lengths = chains.select("species", F.col("length").cast("double").alias("length"))
    return percentiles(lengths, ["species"], "length", list(at), F.floor(F.col("length") / 16))


def score_median(residues: DataFrame) -> DataFrame:
    scores = residues.select("species", F.col("plddt").cast("double").alias("plddt"))
    return percentiles(scores, ["species"], "plddt", [0.50], F.floor("plddt"))


def matrix_statistics(pae_rows: DataFrame) -> DataFrame:
    """Upper-triangle mean and shares below 5 and above 15: per chain first,
    then averaged over the chains of a species."""
    cells = upper_triangle(F.col("pae"), F.col("i"))
    rows = pae_rows.select(*KEY, cells.alias("c")).select(
        *KEY, F.size("c").alias("n"),
        F.aggregate("c", F.lit(0).cast("long"), lambda s, v: s + v).alias("s"),
        F.size(F.filter("c", lambda v: v < 5)).alias("lo"), F.size(F.filter("c", lambda v: v > 15)).alias("hi"),
    )
    per_chain = rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "s", "lo", "hi")]).where("n > 0")
    return per_chain.groupBy("species").agg(
        F.avg(F.col("s") / F.col("n")).alias("mean_upper"),
        F.avg(F.col("lo") / F.col("n")).alias("frac_high_conf"),
        F.avg(F.col("hi") / F.col("n")).alias("frac_low_conf"),
    )


def statistics_markdown(table: DataFrame) -> str:
    """A Markdown table with one line per species."""
    rows = sorted(table.collect(), key=lambda r: r["species"])
    names = table.columns
    show = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows])


def agreement(ours: DataFrame, theirs: DataFrame, on: list[str], value: str, tolerance: float, by: list[str]) -> DataFrame:
    """Compare a numeric column of two tables: matches, mean and largest
    difference, rows only one side has."""
    joined = ours.select(*on, F.col(value).cast("double").alias("_a")).join(
        theirs.select(*on, F.col(value).cast("double").alias("_b")), on, "full"
    )
    diff = F.abs(F.col("_a") - F.col("_b"))
    return joined.groupBy(*by).agg(
        F.count(diff).alias("n"), F.count_if(diff <= tolerance).alias("n_match"),
        F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"),
        F.count_if(diff.isNull()).alias("n_unpaired"),
    )


def label_agreement(ours: DataFrame, theirs: DataFrame, on: list[str], value: str, by: list[str]) -> DataFrame:
    joined = ours.select(*on, F.col(value).alias("_a")).join(theirs.select(*on, F.col(value).alias("_b")), on)
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("rate")
    )
