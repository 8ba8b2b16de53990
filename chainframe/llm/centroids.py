"""Centroid clustering of whole-number vectors with a rotated filter.

Vectors are quantised to whole numbers; all distances that decide anything are exact.  To compute few of them, each vector
is stored with its leading coordinates along the principal axes of all vectors and the norm of what they leave.  For a
vector x and a centroid c, |x - c|^2 is the squared distance of the leading parts plus that of the rests, and the rests
are at least as far apart as their norms differ.  So each task takes the centroid of the least bound, computes its distance
in whole numbers, and then computes only the centroids whose bound, less an allowance for rounding, does not exceed it.

The axes come from sums over all vectors, one 64 x 64 table per task; centroids, sums of a round and axes are the only
things that reach the driver, and their size does not depend on the number of vectors.

Rows: a vector that is null, of another length, or with a null or non-finite component is left out.  A null vec_id is kept
and hashed as an empty text.  Vectors with equal ids are separate rows; where they compete for a start they are ordered by
their components.  With fewer vectors than wanted centroids all vectors are starts.  Components of any size are computed
exactly; a distance, or a sum of distances, beyond 64 bits is null.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SIZE, SCALE, CENTROIDS, ROUNDS, LEADING = 64, 64, 16, 3, 12
#: Vectors of one NumPy step.
STEP = 4096
#: Whole numbers up to this bound are computed in 64 bits, others as Python numbers.
NARROW = 1 << 27
#: Sums travel as two decimals, above and below this power of ten.
SPLIT = 10**30


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit whole numbers, or as Python numbers if one is large."""
    q = np.floor(values * float(SCALE))
    if not q.size or np.abs(q).max() <= NARROW:
        return q.astype(np.int64)
    # A power of two times a finite double is exact unless it overflows, then the value is a whole number already.
    flat = [int(a) if np.isfinite(a) else int(b) * SCALE for a, b in zip(q.ravel().tolist(), values.ravel().tolist())]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(q.shape)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have SIZE values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), SIZE)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, STEP):
        yield batch.slice(low, STEP)


def kept(vectors: DataFrame, name: str) -> DataFrame:
    """vec_id and the components of the rows that count."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where((F.size("x") == SIZE) & finite)


def starts(rows: DataFrame, centroids: int) -> list[list[int]]:
    """The quantised vectors with the smallest hashes of their ids."""
    text = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(centroids).collect()
    return [quantised(np.array(r["x"], np.float64)).tolist() for r in chosen]


def axes(rows: DataFrame) -> np.ndarray:
    """Principal axes of all vectors as columns, the widest first.  They steer the filter only, so sums of doubles do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE + 1, SIZE + 1))
        for batch in batches:
            for part in pieces(batch):
                x = np.concatenate([matrix(part.column(0)) * SCALE, np.ones((part.num_rows, 1))], 1)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    sums = rows.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros((SIZE + 1) ** 2)
    for r in sums.collect():
        total[r["k"]] = r["v"]
    total = total.reshape(SIZE + 1, SIZE + 1)
    spread = total[:SIZE, :SIZE] - np.outer(total[SIZE, :SIZE], total[SIZE, :SIZE]) / max(total[SIZE, SIZE], 1.0)
    return np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(SIZE)


def rotated(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates along the axes and the norm of the others."""
    y = x.astype(np.float64) @ turn
    return y[:, :LEADING], np.sqrt((y[:, LEADING:] ** 2).sum(1))


def nearest(
    x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (of equals the smallest), the exact squared distance, and how many distances were
    computed."""

    def exact(a, b):
        return ((a - b) ** 2).sum(1)

    own_lead, own_rest = rotated(centroids, turn)
    bound = ((lead[:, None, :] - own_lead) ** 2).sum(2) + (rest[:, None] - own_rest) ** 2
    # Rounding is far below one part in 10**9 of the squared norms.
    bound -= 1e-9 * (((lead**2).sum(1) + rest**2)[:, None] + (own_lead**2).sum(1) + own_rest**2) + 1e-6
    cluster = np.nan_to_num(bound, nan=-np.inf).argmin(1)
    first, best, computed = cluster.copy(), exact(x, centroids[cluster]), len(x)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & ~(bound[:, c] > best).astype(bool))
        if len(at):
            computed += len(at)
            d = exact(x[at], centroids[c])
            better = ((d < best[at]) | ((d == best[at]) & (c < cluster[at]))).astype(bool)
            best[at[better]], cluster[at[better]] = d[better], c
    return cluster, best, computed


def assigned(batch: pa.RecordBatch, centroids: list[list[int]], turn: np.ndarray):
    """For each step of a batch of stored vectors: ids, whole numbers, cluster, distance and distances computed."""
    flat = [abs(v) for c in centroids for v in c]
    middle = np.array(centroids, np.int64 if max(flat) <= NARROW else object)
    for part in pieces(batch):
        x = quantised(matrix(part.column(1)))
        lead = np.asarray(part.column(2).flatten(), np.float64).reshape(-1, LEADING)
        rest = np.asarray(part.column(3), np.float64)
        wide = x.dtype == object or middle.dtype == object
        x, own = (x.astype(object), middle.astype(object)) if wide else (x, middle)
        yield (part.column(0), x, *nearest(x, lead, rest, own, turn))


def store(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """The vectors with their leading coordinates and the norm of the rest, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                lead, rest = rotated(quantised(matrix(part.column(1))), turn)
                offsets = pa.array(np.arange(0, LEADING * len(rest) + 1, LEADING), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    kind = T.StructType([*rows.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])
    return written(rows.mapInArrow(run, kind))


def moved(stored: DataFrame, centroids: list[list[int]], turn: np.ndarray) -> list[list[int]]:
    """The centroids after one round: floors of the exact means; a centroid without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), SIZE + 1), object)
        for batch in batches:
            for _, x, cluster, _, _ in assigned(batch, centroids, turn):
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    total[c, :SIZE] += own.sum(0).astype(object)
                    total[c, SIZE] += len(own)
        high, low = zip(*(divmod(int(v), SPLIT) for v in total.ravel()))
        c, k = np.divmod(np.arange(total.size), SIZE + 1)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(c, pa.int32()), "k": pa.array(k, pa.int32()),
            "high": pa.array(high, pa.decimal128(38, 0)), "low": pa.array(low, pa.decimal128(38, 0)),
        })

    partial = stored.mapInArrow(run, "c int, k int, high decimal(38,0), low decimal(38,0)")
    sums = partial.groupBy("c", "k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    total = {(r["c"], r["k"]): int(r["high"]) * SPLIT + int(r["low"]) for r in sums}
    return [
        [total[c, k] // total[c, SIZE] for k in range(SIZE)] if total.get((c, SIZE)) else old
        for c, old in enumerate(centroids)
    ]


def clusters(
    vectors: DataFrame, name: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) and n_computed (distances computed for a vector's step, on average) after
    ``rounds`` rounds, as a stored table; and the final centroids."""
    rows = kept(vectors, name)
    middle = starts(rows, centroids)
    turn = axes(rows) if middle else np.eye(SIZE)
    stored = store(rows, turn)
    for _ in range(rounds if middle else 0):
        middle = moved(stored, middle, turn)
    final = middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance, computed in assigned(batch, final, turn):
                short = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids, "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(short, pa.int64()),
                    "n_computed": pa.array([computed / len(short)] * len(short)),
                })

    return written(stored.mapInArrow(run, "vec_id long, cluster int, distance long, n_computed double")), final


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``clusters`` rows with the sums of distances of their cluster and of all, and the hash of their final centroid."""
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    every = None if None in own.values() else sum(own.values())

    def long(value):
        return F.lit(None if value is None or value >= 1 << 63 else int(value)).cast("long")

    of_cluster = F.array(*[long(own.get(c, 0)) for c in range(len(centroids))]).cast("array<long>")
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("array<string>")
    return found.select(
        "vec_id", "cluster", "distance", F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        long(every).alias("inertia"), F.get(digest, F.col("cluster")).alias("centroid_sha256"),
    )
