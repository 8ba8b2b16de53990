"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word extends.  Runs of
period 3t to 6t (t = 2, 4, 8, ...) are found at scale t: each position gets the hash of its next t words, and is chosen if
it or the position t words on holds the least hash of the t + 1 positions between them.  The choice depends on 2t words
only, so a run repeats its chosen positions one period on.  Chosen positions with equal contexts of 2t words, 3t to 6t
words apart, propose a period; the proposal is extended both ways by binary search over prefix hashes.  Windows that lie
in a run of period up to t/3 are never chosen (there a whole stretch would be), which bounds the partners of a position
by a constant; if every window of a run is such a window, the run itself has a period that small.  Those runs, found at
earlier scales and, for periods up to ``SMALL``, by comparing neighbours, are the separately detected regions.

Hashes only propose.  Equal words have equal hashes, so no run is lost; each run is compared word by word before it counts.
Words are numbered through a dictionary per step, so equal numbers are equal words.  A step takes some documents together,
with a number of its own between each two, so that nothing crosses documents.

Rows: a null text has no words.  Repeated rows and ids are separate rows; a null doc_id is kept and counts as an empty
text where ids are hashed; further columns are not carried.  An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hashes, span_hashes, steps, text_bytes

#: Periods that are found by comparing neighbours; the first scale begins above.
SMALL = 5
#: Least length of a reported run.
LEAST = 12
#: Bytes of text in a step; a longer text is a step of its own.
STEP = 1 << 20
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def small_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the maximal stretches of each period up to SMALL, at least two periods long."""
    found = []
    for p in range(1, min(SMALL, len(words) // 2) + 1):
        start, end = stretches(words[:-p] == words[p:])
        keep = end - start >= p
        found.append(np.stack([start[keep], end[keep] + p, np.full(keep.sum(), p)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def primitive(runs: np.ndarray) -> np.ndarray:
    """The smallest period of each stretch, in order of start and end."""
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[first]


def synchronising(windows: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The chosen positions: ``windows`` has the hash of each window of t words, ``periodic`` is true for windows that lie
    in a run of a small period."""
    ids = np.where(periodic, NEVER, np.minimum(windows, NEVER - np.uint64(1)))
    # The least of t + 1 neighbours, by doubling.
    least, width = ids, 1
    while 2 * width <= t + 1:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    least = np.minimum(least[: len(ids) - t], least[t + 1 - width : len(ids) - width + 1])
    n = len(ids) - t
    return np.flatnonzero(((least == ids[:n]) | (least == ids[t:])) & (least != NEVER))


def proposals(words: np.ndarray, prefix: np.ndarray, t: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of 3t to 6t words that equal contexts of chosen positions propose."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < 6 * t:
        return none, none
    at = np.arange(n - t + 1)
    windows = mix(span_hashes(prefix, at, at + t))
    inner = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, inner[:, 0], 1)
    np.add.at(depth, inner[:, 1] - t + 1, -1)
    chosen = synchronising(windows, t, np.cumsum(depth)[: len(windows)] > 0)
    context = mix(span_hashes(prefix, chosen, chosen + 2 * t))
    order = np.argsort(context, kind="stable")
    chosen, context = chosen[order], context[order]
    places, periods, lag = [], [], 1
    while lag < len(chosen):
        apart = chosen[lag:] - chosen[:-lag]
        near = (context[lag:] == context[:-lag]) & (apart < 6 * t)
        if not near.any():
            break
        near &= apart >= 3 * t
        places.append(chosen[:-lag][near])
        periods.append(apart[near])
        lag += 1
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def extended(prefix: np.ndarray, place: np.ndarray, period: np.ndarray, reach: int) -> np.ndarray:
    """Rows (start, end, period): how far the words one period apart agree around each place, by binary search over
    hashes in steps of powers of two up to ``reach``.  Never too short."""
    n = len(prefix) - 1
    right, left = place.copy(), place.copy()
    for k in range(max(reach, 1).bit_length(), -1, -1):
        size = 1 << k
        room = right + period + size <= n
        a = np.where(room, right, 0)
        b = np.where(room, right + period, 0)
        width = np.where(room, size, 0)
        same = room & (span_hashes(prefix, a, a + width) == span_hashes(prefix, b, b + width))
        right = np.where(same, right + size, right)
        room = left >= size
        a = np.where(room, left - size, 0)
        width = np.where(room, size, 0)
        same = room & (span_hashes(prefix, a, a + width) == span_hashes(prefix, a + period, a + period + width))
        left = np.where(same, left - size, left)
    return np.stack([left, right + period, period], 1)


def confirmed(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``found`` without stretches of less than two periods, compared word by word.  A stretch that hashes made too long
    gives the true ones inside it."""
    found = found[found[:, 1] - found[:, 0] >= 2 * found[:, 2]]
    found = np.unique(found, axis=0)
    out = []
    for start, end, p in found.tolist():
        if np.array_equal(words[start : end - p], words[start + p : end]):
            out.append((start, end, p))
        else:
            low, high = stretches(words[start : end - p] == words[start + p : end])
            out += [(start + a, start + b + p, p) for a, b in zip(low.tolist(), high.tolist()) if b - a >= p]
    return np.array(out, np.int64).reshape(-1, 3)


def all_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence in which no run is longer than ``longest``, by start and end."""
    runs = primitive(small_runs(words))
    if longest <= 2 * SMALL:
        return runs
    prefix = prefix_hashes(mix(words.astype(np.uint64)))
    t = (SMALL + 1) // 3
    while 6 * t <= longest:
        place, period = proposals(words, prefix, t, runs)
        if len(place):
            runs = primitive(np.concatenate([runs, confirmed(words, extended(prefix, place, period, longest))]))
        t *= 2
    return runs


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Numbers of the words that replace those of a document whose hashed id asks for a repeat, else None."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _step(doc_ids: list, texts: list[bytes], plant: bool) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    lists, own = [], []
    for doc_id, text in zip(doc_ids, texts):
        words = text.split()  # parts bytes at exactly space and \t to \r
        at = planted(len(words), doc_id) if plant else None
        lists.append(words if at is None else [words[i] for i in at.tolist()])
        own.append([numbers.setdefault(w, len(numbers)) for w in lists[-1]])
    sizes = np.array([len(x) for x in own])
    # Each document is followed by a number that stands nowhere else.
    begin = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    for b, part in zip(begin.tolist(), own):
        words[b : b + len(part)] = part
    words[begin + sizes] = len(numbers) + np.arange(len(sizes))
    runs = all_runs(words, int(sizes.max()))
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, 2 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    gone = np.cumsum(gone) > 0
    bounds = np.searchsorted(runs[:, 0], np.append(begin, len(words)))
    which = np.searchsorted(begin, runs[:, 0], "right") - 1
    structs = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - begin[which]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN)
    )
    collapsed = []
    for k, (b, part) in enumerate(zip(begin.tolist(), lists)):
        if bounds[k] < bounds[k + 1]:
            part = [w for w, g in zip(part, gone[b : b + len(part)].tolist()) if not g]
        collapsed.append(b" ".join(part))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
         pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without repeats, its words joined by one space.

    A word goes if a run of at least ``LEAST`` words and two periods holds it after the run's first period.  With
    ``plant``, some documents, chosen by the hash of their id, first get a repeat (the contract's test input).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in steps(text_bytes(batch.column(1))[1], STEP):
                part = batch.slice(low, high - low)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield _step(part.column(0).to_pylist(), texts, plant)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of ``periodic_runs``: counts, the longest run, and hashes of the runs and of the text left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("_best.length * 1000 div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
