"""Ranks and order statistics that do not put a whole group into one task.

``row_number() over (partition by key)`` sends every row of a key to one task.
Here each key is cut into *pieces* that are ordered among themselves (a minute
of time, a prefix of a hash, a bin of a value).  Rows are numbered inside
their piece and shifted by the number of rows in earlier pieces, which is a
running sum over already aggregated counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    key: list[str],
    order: list,
    piece: Column,
    name: str = "i",
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each key 1..n in ``order``.

    ``piece`` must be non-decreasing along ``order``.  With ``total`` the group
    size comes along for free.
    """
    tagged = df.withColumn("_piece", piece)
    by_piece = [*key, "_piece"]
    inside = Window.partitionBy(*by_piece).orderBy(*order)
    numbered = tagged.withColumn("_inside", F.row_number().over(inside))

    whole = Window.partitionBy(*key)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        tagged.groupBy(*by_piece)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole))
        .select(*by_piece, "_before", "_total")
    )
    # Pieces can be as many as rows; a size guessed from the file must not send them through the driver.
    out = numbered.join(shifts.hint("merge"), by_piece).withColumn(
        name, (F.col("_before") + F.col("_inside")).cast("long")
    )
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_piece", "_inside", "_before", "_total")


def hash_int(*parts) -> Column:
    """32 uniform bits from the text of ``parts``; identical on every engine
    that has md5, so draws can be checked outside Spark."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("/", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_below(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hash_int(*parts), n if isinstance(n, Column) else F.lit(n))


def hash_piece(draw: Column) -> Column:
    """4096 equal pieces of the 32-bit range, in the order of the draw."""
    return F.shiftright(draw, 20)


def hash_rank(
    df: DataFrame, key: list[str], identity: str, seed, name: str = "rank", total: str | None = None
) -> DataFrame:
    """Rank rows of each key in a reproducible random order."""
    drawn = df.withColumn("_draw", hash_int(F.lit(str(seed)), F.col(identity)))
    ranked = number_rows(
        drawn, key, [F.col("_draw"), F.col(identity)], hash_piece(F.col("_draw")), name, total
    )
    return ranked.drop("_draw")


def pick_rank(
    df: DataFrame, key: list[str], value: str, rank: Column, piece: Column | None = None
) -> DataFrame:
    """The value at ``rank`` (1-based, may use the column ``n``, the group
    size) of the sorted values of each key."""
    return pick_ranks(df, key, value, {"_at": rank}, piece).select(*key, F.col("_at").alias(value), "n")


def pick_ranks(
    df: DataFrame, key: list[str], value: str, ranks: dict[str, Column], piece: Column | None = None
) -> DataFrame:
    """key, n and a column per name: the values at several ranks at once.

    Values are first counted, then only the pieces that contain a wanted rank
    are looked at row by row.
    """
    cell = piece if piece is not None else F.floor(F.col(value))
    counted = df.groupBy(*key, F.col(value)).agg(F.count(F.lit(1)).alias("_c"))
    pieces = counted.groupBy(*key, cell.alias("_piece")).agg(F.sum("_c").alias("_c"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])

    def reached(listed):
        return F.filter(listed, lambda w: (w["rank"] <= F.col("_upto")) & (w["rank"] > F.col("_upto") - F.col("_c")))

    target = (
        pieces.withColumn("_upto", F.sum("_c").over(upto))
        .withColumn("n", F.sum("_c").over(whole))
        .withColumn("_wanted", reached(wanted)).where(F.size("_wanted") > 0)
        .select(*key, "_piece", "n", (F.col("_upto") - F.col("_c")).alias("_before"), "_wanted")
    )
    inside = Window.partitionBy(*key, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counted.withColumn("_piece", cell)
        .join(target, [*key, "_piece"])
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        .select(*key, "n", F.col(value).alias("_v"), F.explode(reached(F.col("_wanted"))).alias("_w"))
    )
    return found.groupBy(*key).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_w.name") == k, F.col("_v"))).alias(k) for k in ranks]
    )
