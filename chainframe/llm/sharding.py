"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to ``BITS`` bits each; the index of a row's cell on the Hilbert curve orders
the rows, and the order is cut into runs of equal row counts.  Neighbours on the curve are close in every dimension, so
each shard's files cover narrow ranges of all of them and a filter on any one skips most files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 6
SHARDS = 16


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position of a cell (non-negative integers below 2**bits) on the Hilbert curve through their cube.

    Going down the bits, each axis either inverts or swaps with the first axis what lies below the bit; the Gray code of
    the result, bit by bit across the axes, is the position.
    """
    n = len(cells)
    rounds = [(1 << b) * n + i for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(axes: Column, code: Column) -> Column:
        bit, i = F.floor(code / n).cast("int"), (code % n).cast("int")
        below, own, first = bit - 1, F.get(axes, i), F.get(axes, F.lit(0))
        inverts = own.bitwiseAND(bit) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(below)
        return F.transform(axes, lambda v, j: F.when(j == 0, first.bitwiseXOR(F.when(inverts, below).otherwise(swap)))
                           .when((j == i) & ~inverts, v.bitwiseXOR(swap)).otherwise(v))

    empty = F.array().cast("array<int>")
    start = F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in cells])
    flip_bits = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>")
    places = F.array(*[F.lit(b * n + i) for b in range(bits - 1, -1, -1) for i in range(n)])

    # Gray code: running exclusive or over the axes, then the flips that the last axis asks for.
    def gray(turned: Column) -> Column:
        return F.aggregate(turned, empty, lambda done, v: F.concat(done, F.array(
            v.bitwiseXOR(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))))

    def flipped(code: Column) -> Column:
        flips = F.aggregate(flip_bits, F.lit(0), lambda t, bit: F.when(
            F.element_at(code, -1).bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t))
        return once(flips, lambda f: F.transform(code, lambda v: v.bitwiseXOR(f)))

    def packed(axes: Column) -> Column:
        def place(index: Column, code: Column) -> Column:
            v = F.get(axes, (code % n).cast("int"))
            bit = F.floor(v / F.pow(F.lit(2), F.floor(code / n))).cast("long") % 2
            return index * 2 + bit

        return F.aggregate(places, F.lit(0).cast("long"), place)

    turned = F.aggregate(F.array(*map(F.lit, rounds)), start, turn) if rounds else start
    return once(turned, lambda t: once(gray(t), lambda g: once(flipped(g), packed)))


def hashed_cell(value: Column, bits: int = BITS) -> Column:
    """A nominal value as a cell: the top bits of its crc32; null is cell 0."""
    return F.coalesce(F.shiftright(F.crc32(value.cast("string").cast("binary")), 32 - bits).cast("int"), F.lit(0))


def log_cell(value: Column, bits: int = BITS, per_octave: int = 2) -> Column:
    """A size as a cell on a logarithmic scale; null is cell 0."""
    level = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * per_octave)
    return F.coalesce(F.least(level, F.lit((1 << bits) - 1)).cast("int"), F.lit(0))


def shards(docs: DataFrame, dimensions: list[Column] | None = None, n_shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (``rows``: counts at most one apart), shard, slot (gapless from 0),
    grown_shard (null), hilbert.

    Rows are dealt into ranges of (index, text, doc_id), numbered inside their range and shifted by the rows of earlier
    ranges, so a cell or a text that most rows share is spread over many ranges.  Null texts count as empty ones, null
    metadata as cell 0; rows that are equal in all of this are exchangeable.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    axes = dimensions or [hashed_cell(F.col("lang")), hashed_cell(F.col("source")), log_cell(size)]
    order = ["_index", "text_crc32", "doc_id"]
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.array(*axes).alias("_axes"),
    ).select("doc_id", "size", "text_crc32", hilbert_index([F.get("_axes", F.lit(k)) for k in range(len(axes))]).alias("_index"))
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = ranged.withColumn("_inside", inside).join(shifts, "_part").withColumn("_rank", F.col("_before") + F.col("_inside"))
    shard = F.expr(f"_rank * {n_shards} div _all")
    first = F.expr(f"(_shard * _all + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_index").alias("hilbert"),
    )
