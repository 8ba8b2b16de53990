"""Pair domains.

A pair domain is never materialised.  A distance bound turns it into a grid
join: space is cut into cubes as wide as the bound, one side looks into the
surrounding cubes, and the equi-join on (chain, cube) spreads even one chain
over as many tasks as it has cubes.  It is a merge join by hint: the looking
side has 14 or 27 rows per position, but Spark sizes it from the file and would
send it through the driver.  Bounds that split into one condition per
end are answered from counts, and the plain size of the domain is a formula.
"""

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK, KEY, block_of
from ..session import cut_lineage
from .offline import counts_within
from .windows import block_size, per_block

CELL = ["_cx", "_cy", "_cz"]
ALL_CELLS = list(itertools.product((-1, 0, 1), repeat=3))
# One of each opposite pair of directions, and the own cube.
HALF_CELLS = [c for c in ALL_CELLS if c >= (0, 0, 0)]
# Questions of a chain up to which its pairs are told apart by those questions only.
FEW = 64


def squared_distance(a: str, b: str) -> Column:
    total = None
    for axis in ("x", "y", "z"):
        d = F.col(f"{a}.{axis}").cast("double") - F.col(f"{b}.{axis}").cast("double")
        total = d * d if total is None else total + d * d
    return total


def distance(a: str, b: str) -> Column:
    return F.sqrt(squared_distance(a, b))


def _width(radius: float | str) -> Column:
    """A radius for all chains, or the column that holds each chain's own."""
    return F.col(radius) if isinstance(radius, str) else F.lit(float(radius))


def _cells(width: float | str, shift=None) -> list[Column]:
    out = []
    for n, axis in enumerate(("x", "y", "z")):
        cell = F.floor(F.col(axis).cast("double") / _width(width))
        if shift is not None:
            cell = cell + F.col(f"_shift.d{n}")
        out.append(cell.alias(CELL[n]))
    return out


def _shifts(cells) -> Column:
    return F.array(
        *[F.struct(*[F.lit(v).alias(f"d{n}") for n, v in enumerate(cell)]) for cell in cells]
    )


def close_pairs(residues: DataFrame, radius: float | str, min_sep: int = 1, keep=()) -> DataFrame:
    """Pairs i < j with distance <= radius and j - i >= min_sep, each once.

    ``radius`` is a number or the name of a column of ``residues`` that is
    the same all along a chain.  Columns: KEY, i, j, d, and ``<c>_i`` /
    ``<c>_j`` for every column in ``keep``.  A strict bound is a filter on ``d``.
    """
    columns = ["i", "x", "y", "z", *([radius] if isinstance(radius, str) else []), *keep]
    reach = F.col(f"a.{radius}") if isinstance(radius, str) else F.lit(float(radius))
    seeing = residues.select(
        *KEY, *columns, F.explode(_shifts(HALF_CELLS)).alias("_shift")
    ).select(
        *KEY, *columns, *_cells(radius, shift=True),
        ((F.col("_shift.d0") == 0) & (F.col("_shift.d1") == 0) & (F.col("_shift.d2") == 0)).alias("_same"),
    )
    seen = residues.select(*KEY, *columns, *_cells(radius))
    near = seeing.alias("a").join(seen.hint("merge").alias("b"), [*KEY, *CELL])
    squared = squared_distance("a", "b")
    # Inside one cube the order of the positions tells the two copies apart;
    # across cubes only one of the two opposite directions is looked at.
    once = ~F.col("a._same") | (F.col("a.i") < F.col("b.i"))
    apart = F.abs(F.col("a.i") - F.col("b.i")) >= max(1, min_sep)
    first = F.col("a.i") < F.col("b.i")
    return near.where(once & apart & (F.sqrt(squared) <= reach)).select(
        *[F.col(k) for k in KEY],
        F.least("a.i", "b.i").alias("i"),
        F.greatest("a.i", "b.i").alias("j"),
        F.sqrt(squared).alias("d"),
        *[
            expr
            for c in keep
            for expr in (
                F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"{c}_i"),
                F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"{c}_j"),
            )
        ],
    )


def close_between(left: DataFrame, right: DataFrame, radius: float | str) -> DataFrame:
    """Pairs (r, s) of two subsets of the same chains within ``radius`` (as in ``close_pairs``)."""
    columns = ["i", "x", "y", "z", *([radius] if isinstance(radius, str) else [])]
    reach = F.col(f"a.{radius}") if isinstance(radius, str) else F.lit(float(radius))
    seeing = left.select(*KEY, *columns, F.explode(_shifts(ALL_CELLS)).alias("_shift")).select(
        *KEY, *columns, *_cells(radius, shift=True)
    )
    seen = right.select(*KEY, *columns, *_cells(radius))
    near = seeing.alias("a").join(seen.hint("merge").alias("b"), [*KEY, *CELL])
    d = distance("a", "b")
    return near.where(d <= reach).select(
        *[F.col(k) for k in KEY], F.col("a.i").alias("r"), F.col("b.i").alias("s"), d.alias("d")
    )


def neighbor_counts(residues: DataFrame, radius: float = 8.0, name: str = "n_neigh") -> DataFrame:
    """Per residue, how many others lie within ``radius``.

    At the stored radius of 8 every other residue counts; at other radii
    coincident residues (d = 0) do not.
    """
    stored = abs(radius - 8.0) < 1e-6
    pairs = close_pairs(residues, radius)
    if not stored:
        pairs = pairs.where("d > 0")
    ends = pairs.select(*KEY, F.explode(F.array("i", "j")).alias("i"))
    found = ends.groupBy(*KEY, "i").agg(F.count(F.lit(1)).alias("_found"))
    return (
        residues.drop(name)
        .join(found.hint("merge"), [*KEY, "i"], "left")
        .withColumn(name, F.coalesce(F.col("_found"), F.lit(0)).cast("long"))
        .drop("_found")
    )


def pair_domain_size(length: Column, min_sep: int | Column = 1) -> Column:
    """Number of pairs i < j with j - i >= min_sep."""
    least = min_sep if isinstance(min_sep, Column) else F.lit(max(1, min_sep))
    room = F.greatest(length - least, F.lit(0).cast("long"))
    return F.floor(room * (room + 1) / 2)


def count_split_pairs(residues: DataFrame, first: Column, second: Column, min_sep: int = 1):
    """count (i, j) in all_pairs where first(i) and second(j).

    For each i satisfying ``first`` the number of j >= i + min_sep satisfying
    ``second`` is the chain total minus a running count.  Running counts are
    kept per block with the block totals added, so no pair is produced.
    """
    sep = max(1, min_sep)
    flags = residues.select(
        *KEY, "i", first.cast("int").alias("_p"), second.cast("int").alias("_q")
    ).withColumn("_block", block_of(F.col("i")))

    whole = Window.partitionBy(*KEY)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        flags.groupBy(*KEY, "_block").agg(F.sum("_q").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(whole))
    )
    running = Window.partitionBy(*KEY, "_block").orderBy("i").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # _upto: second-condition hits strictly before this position.
    prefix = flags.withColumn("_local", F.coalesce(F.sum("_q").over(running), F.lit(0))).join(
        totals, [*KEY, "_block"]
    ).select(*KEY, "i", "_p", "_all", (F.col("_before") + F.col("_local")).alias("_upto"))
    starts = prefix.where("_p = 1").select(*KEY, (F.col("i") + sep).alias("i"))
    later = prefix.select(*KEY, "i", (F.col("_all") - F.col("_upto")).alias("_later"))
    return starts.join(later, [*KEY, "i"]).groupBy(*KEY).agg(F.sum("_later").alias("answer"))


def asked_reach(residues: DataFrame, asked: DataFrame, t: str) -> DataFrame:
    """The residues of the chains that ask (``asked``: KEY, ``t``), with ``reach``: the power of two at or above the
    largest distance that the chain asks for and that some pair of it can exceed; and ``span``, a bound on the distance
    of any two of its positions.  Chains that only ask for distances beyond ``span`` or for none are left out."""
    spans = chain_spans(residues)
    top = F.max(F.when(F.col(t) <= F.col("span"), F.col(t)))
    widest = asked.select(*KEY, t).join(spans, KEY).groupBy(*KEY).agg(top.alias("_top"), F.max("span").alias("span")).where("_top > 0")
    reach = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("_top", F.lit(1.0)))))
    return residues.join(widest.select(*KEY, "span", reach.alias("reach")), KEY)


def chain_spans(residues: DataFrame) -> DataFrame:
    """KEY and ``span`` as in ``asked_reach``."""
    sides = [F.max(c).cast("double") - F.min(c).cast("double") for c in ("x", "y", "z")]
    return residues.groupBy(*KEY).agg(F.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]).alias("span"))


def _asked_levels(asked: DataFrame) -> DataFrame:
    """KEY, ``seps`` and ``ts``: the literals of the chains with at most FEW questions; NULL for those with more."""
    lo, t = F.greatest("sep", F.lit(1)).cast("long"), F.col("t").cast("double")
    few = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= FEW).select(*KEY)
    return asked.join(few, KEY, "left_semi").groupBy(*KEY).agg(F.collect_set(lo).alias("seps"), F.collect_set(t).alias("ts"))


def _told_apart(close: DataFrame) -> DataFrame:
    """KEY, a, b, top and ``n`` pairs.  Of a chain with few questions, pairs that no question of it tells apart are one
    point: ``a`` is the largest separation asked for that they have, ``b`` the distance asked for that they are at, or
    one between the two asked for that they lie between; pairs too near in sequence or too far apart for all are left
    out.  So a task hands on as many points as there are questions, not pairs."""
    a, d = F.col("j") - F.col("i"), F.col("d")
    sep = F.array_max(F.filter("seps_i", lambda s: s <= F.col("a")))
    under = F.array_max(F.filter("ts_i", lambda t: t <= F.col("d")))
    over = F.array_min(F.filter("ts_i", lambda t: t >= F.col("d")))
    few = F.col("ts_i").isNotNull()
    points = close.select(*KEY, a.alias("a"), d.alias("d"), F.col("length_i").alias("top"), "seps_i", "ts_i").select(
        *KEY, F.when(few, sep).otherwise(F.col("a")).alias("a"),
        F.when(few, (F.coalesce(under, over - 1) + over) / 2).otherwise(F.col("d")).alias("b"), "top")
    return points.where("a is not null and b is not null").groupBy(*KEY, "a", "b", "top").agg(F.count(F.lit(1)).alias("n"))


def asked_contact_counts(residues: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked``: qid, KEY, length, sep, t.  Returns qid, below and upto: pairs with j - i >= sep and d < t (d <= t).

    Every question brings its own separation and distance.  Pairs are made once per chain, up to the largest distance it
    asks for, made one where no question tells them apart, and counted by dominance (separation from ``sep`` on, distance up to ``t``).  A distance beyond any in the
    chain is a formula of its length.
    """
    spans = chain_spans(residues)
    known = asked.join(spans, KEY, "left").withColumn("_far", F.col("t") > F.col("span"))
    near = known.where(~F.col("_far"))
    sites = asked_reach(residues, near, "t").join(_asked_levels(asked), KEY, "left")
    # Read twice below; the pairs are made once.
    points = cut_lineage(_told_apart(close_pairs(sites, "reach", keep=["length", "seps", "ts"])))
    wanted = near.select("qid", *KEY, F.greatest("sep", F.lit(1)).cast("long").alias("lo"), F.col("length").alias("hi"), "t", F.col("length").alias("top"))
    found = counts_within(points, wanted, cell=lambda v: F.floor(v * 4), times=F.col("n"))
    all_pairs = pair_domain_size(F.col("length"), F.greatest("sep", F.lit(1)))
    return known.join(found, "qid", "left").select(
        "qid", *[F.when(F.col("_far"), all_pairs).otherwise(F.coalesce(F.col(n), F.lit(0))).cast("long").alias(n) for n in ("below", "upto")])


def window_contacts(residues: DataFrame, contacts: DataFrame, widths: list[int] | DataFrame) -> DataFrame:
    """Contact density of every full window: KEY, w, start, end, density.

    ``widths`` is a list for all chains, or rows (KEY, length, w) of what each chain asks for.

    A contact (i, j) lies in the windows that start in [j - w + 1, i].  It adds
    +1 where that interval begins and -1 behind its end; a running sum over the
    starts gives the count.  The interval is cut at block borders so that the
    sum restarts in every block.
    """
    if isinstance(widths, DataFrame):
        size = F.greatest(F.lit(BLOCK), 2 * F.col("w"))
        own = per_block(widths.where("w between 1 and length").select(*KEY, "length", "w").distinct()).drop("length")

        def asked(rows):
            return rows.withColumn("_block", F.floor(F.col("i") / BLOCK)).join(own, [*KEY, "_block"]).drop("_block")
    else:
        size = F.lit(block_size(max(widths)))
        listed = F.explode(F.array(*[F.lit(v).cast("long") for v in widths]))

        def asked(rows):
            return rows.withColumn("w", listed)
    block = lambda i: F.floor((i - 1) / size)

    inside = asked(contacts.select(*KEY, "i", "j")).where("j - i < w").select(
        *KEY, "w",
        F.greatest(F.col("j") - F.col("w") + 1, F.lit(1)).alias("lo"),
        F.col("i").alias("hi"),
    )
    first, last = block(F.col("lo")), block(F.col("hi"))
    pieces = inside.select(
        *KEY, "w", "lo", "hi", F.explode(F.sequence(first, last)).alias("_block")
    ).select(
        *KEY, "w", "_block",
        F.greatest("lo", F.col("_block") * size + 1).alias("lo"),
        F.least("hi", (F.col("_block") + 1) * size).alias("hi"),
    )
    steps = pieces.select(
        *KEY, "w", "_block",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("start"), F.lit(1).alias("delta")),
                F.struct((F.col("hi") + 1).alias("start"), F.lit(-1).alias("delta")),
            )
        ).alias("_e"),
    ).select(*KEY, "w", "_block", "_e.start", "_e.delta").where(
        F.col("start") <= (F.col("_block") + 1) * size
    )
    starts = (
        asked(residues.select(*KEY, "length", "i")).withColumnRenamed("i", "start")
        .where("start + w - 1 <= length")
        .select(*KEY, "w", block(F.col("start")).alias("_block"), "start",
                F.lit(0).alias("delta"), F.lit(True).alias("is_start"))
    )
    changes = (
        starts.unionByName(steps.withColumn("is_start", F.lit(False)))
        .groupBy(*KEY, "w", "_block", "start")
        .agg(F.sum("delta").alias("delta"), F.bool_or("is_start").alias("is_start"))
    )
    running = Window.partitionBy(*KEY, "w", "_block").orderBy("start").rowsBetween(
        Window.unboundedPreceding, 0
    )
    pairs = F.col("w") * (F.col("w") - 1) / 2
    return (
        changes.withColumn("contacts", F.sum("delta").over(running))
        .where("is_start")
        .select(
            *KEY, "w", "start", (F.col("start") + F.col("w") - 1).alias("end"),
            F.when(F.col("w") < 2, F.lit(0.0)).otherwise(F.col("contacts") / pairs).alias("density"),
        )
    )
