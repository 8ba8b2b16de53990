"""Positional windows along a chain.

Each block of a chain is one window partition.  A row that a window starting
in the previous block can reach is copied there (the *halo*), so a window
never crosses a partition and no partition grows with the chain.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK, KEY
from .prefix import SCALE, mean_of, running, variance_of

# Widths evaluated in one pass; more are done in several passes.
MAX_FRAMES = 32


def block_size(reach: int) -> int:
    """Positions per block: the usual size, or more for windows so wide that
    they would span several blocks."""
    return max(BLOCK, 2 * reach)


def with_halo(df: DataFrame, ahead: int = 0, behind: int = 0) -> DataFrame:
    """Add ``_block``; rows within ``ahead`` of a block start are also given
    to the block before, rows within ``behind`` of a block end to the one
    after.  ``_home`` tells the owner."""
    size = block_size(max(ahead, behind))
    own = F.floor((F.col("i") - 1) / F.lit(size))
    offset = F.col("i") - 1 - own * size
    places = [own]
    if ahead:
        places.append(F.when((offset < ahead) & (own > 0), own - 1))
    if behind:
        places.append(F.when(offset >= size - behind, own + 1))
    if len(places) == 1:
        return df.withColumn("_home", own).withColumn("_block", own)
    spread = F.array_compact(F.array(*places))
    return df.withColumn("_home", own).withColumn("_block", F.explode(spread))


def in_block() -> Window:
    return Window.partitionBy(*KEY, "_block").orderBy("i")


def neighbour_value(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """``{"prev_ss": ("ss", -1)}`` adds the value found that many positions away."""
    reach = [shift for _, shift in columns.values()]
    wide = with_halo(df, ahead=max(0, *reach, 0), behind=max(0, -min(reach)))
    for name, (column, shift) in columns.items():
        wide = wide.withColumn(name, F.lead(column, shift).over(in_block()))
    return wide.where("_block = _home").drop("_block", "_home")


class Metric:
    """An aggregate of one window or one region of positions.

    ``build`` forms it from Spark aggregates; ``finish`` forms it from exact sums, sums of squares and extremes (columns
    ``s_``, ``q_``, ``lo_``, ``hi_`` and the feature's name, for the features listed) and the number of positions.
    """

    def __init__(self, build, finish, sums=(), squares=(), extremes=()):
        self.build, self.finish = build, finish
        self.sums, self.squares, self.extremes = list(sums), list(squares), list(extremes)

    def over(self, frame) -> Column:
        return self.build(lambda agg: agg.over(frame))

    def grouped(self) -> Column:
        return self.build(lambda agg: agg)


def _variance(n: Column, column: str) -> Column:
    return variance_of(n, F.col(f"s_{column}"), F.col(f"q_{column}"))


def mean(column: str) -> Metric:
    return Metric(
        lambda ev: ev(F.avg(F.col(column).cast("double"))),
        lambda n: mean_of(n, F.col(f"s_{column}")), sums=[column],
    )


def lowest(column: str) -> Metric:
    return Metric(
        lambda ev: ev(F.min(F.col(column).cast("double"))), lambda n: F.col(f"lo_{column}"), extremes=[column]
    )


def highest(column: str) -> Metric:
    return Metric(
        lambda ev: ev(F.max(F.col(column).cast("double"))), lambda n: F.col(f"hi_{column}"), extremes=[column]
    )


def deviation(column: str) -> Metric:
    """Population standard deviation."""
    return Metric(
        lambda ev: ev(F.stddev_pop(F.col(column).cast("double"))),
        lambda n: F.sqrt(_variance(n, column)), sums=[column], squares=[column],
    )


def gyration() -> Metric:
    """Radius of gyration: root of the summed coordinate variances."""
    axes = ("x", "y", "z")

    def build(ev):
        parts = [ev(F.var_pop(F.col(c).cast("double"))) for c in axes]
        return F.sqrt(parts[0] + parts[1] + parts[2])

    return Metric(
        build, lambda n: F.sqrt(_variance(n, "x") + _variance(n, "y") + _variance(n, "z")), sums=axes, squares=axes
    )


def occurrences(column: str, label: str) -> Metric:
    """Positions with a label."""
    return Metric(
        lambda ev: ev(F.count_if(F.col(column) == label)),
        lambda n: (F.col(f"s_{column}={label}") / F.lit(SCALE)).cast("long"), sums=[f"{column}={label}"],
    )


def listed(metrics: dict[str, Metric], what: str) -> list[str]:
    return sorted({c for m in metrics.values() for c in getattr(m, what)})


def per_block(asked: DataFrame) -> DataFrame:
    """``asked`` (KEY, length, ...) once for each block of positions 0 to length of its chain."""
    last = F.floor(F.col("length") / BLOCK)
    return asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def asked_windows(residues: DataFrame, asked: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """Every full window of the widths that each chain asks for (``asked``: KEY, length, w): KEY, w, start, end, metrics.

    Widths are rows: a window is the difference of two running sums, so any number of widths shares one plan.  Widths
    below 1 or above the chain's length have no window.  Metrics of extremes are not sums and are not offered here.
    """
    if listed(metrics, "extremes"):
        raise ValueError("extremes of windows need sliding_windows")
    index = running(residues, listed(metrics, "sums"), listed(metrics, "squares"))
    names = [c for c in index.columns if c not in (*KEY, "length", "i")]
    widths = asked.where("w between 1 and length").select(*KEY, "length", F.col("w").cast("long").alias("w")).distinct()
    first = index.drop("length").withColumn("_block", F.floor(F.col("i") / BLOCK)).withColumnsRenamed({n: f"_{n}" for n in names})
    starts = per_block(widths).join(first, [*KEY, "_block"]).where("i + w <= length").select(
        *KEY, "w", (F.col("i") + F.col("w")).alias("i"), *[f"_{n}" for n in names])
    both = starts.join(index.drop("length"), [*KEY, "i"]).withColumns(
        {n: (F.col(n) - F.col(f"_{n}")).cast("decimal(38,0)") for n in names})
    return both.select(
        *KEY, "w", (F.col("i") - F.col("w") + 1).alias("start"), F.col("i").alias("end"),
        *[m.finish(F.col("w")).alias(name) for name, m in metrics.items()],
    )


def sliding_windows(
    residues: DataFrame,
    widths: list[int],
    metrics: dict[str, Metric],
    step: int = 1,
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per (chain, width, start) for every full window.

    All widths share one sort: each is another frame of the same window
    specification.  Output: KEY, w, start, end and the metrics.
    """
    if len(widths) > MAX_FRAMES:
        parts = [
            sliding_windows(residues, widths[k : k + MAX_FRAMES], metrics, step, extra)
            for k in range(0, len(widths), MAX_FRAMES)
        ]
        return reduce(DataFrame.unionByName, parts)
    wide = with_halo(residues, ahead=max(widths) - 1)
    frames = []
    for w in widths:
        frame = in_block().rowsBetween(0, w - 1)
        frames.append(
            F.struct(
                F.lit(w).cast("long").alias("w"),
                *[m.over(frame).alias(name) for name, m in metrics.items()],
            )
        )
    fits = (F.col("start") + F.col("_m.w") - 1) <= F.col("length")
    return (
        wide.select(
            *KEY, "_block", "_home", "length", *(extra or []),
            F.col("i").alias("start"),
            F.array(*frames).alias("_frames"),
        )
        .where("_block = _home")
        .select("*", F.explode("_frames").alias("_m"))
        .where(fits & (F.pmod(F.col("start") - 1, F.lit(step)) == 0))
        .select(
            *KEY, F.col("_m.w").alias("w"), "start",
            (F.col("start") + F.col("_m.w") - 1).alias("end"),
            *(extra or []), *[F.col(f"_m.{name}").alias(name) for name in metrics],
        )
    )
