"""Document fingerprints from content-defined chunks.

A text is normalised (lower case, white space as one blank).  A gear hash of the last ``WINDOW`` bytes marks possible
boundaries; as in normalised chunking, few of them count before a chunk has ``NORMAL`` bytes and more after it, so chunk
lengths are close together.  Boundaries depend on nearby bytes only, hence an insertion moves chunks without changing
them.  The fingerprint is the set of chunk digests, each with its chunk's length; the likeness of one to another is the
share of its length that the other contains.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, mix, prefix_hashes, span_hashes

WINDOW, LEAST, NORMAL, MOST = 16, 16, 32, 256
#: Bits that must be zero before and after the normal length.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
#: Bits of a chunk's length in its entry; the others are digest.
LENGTH_BITS = np.uint64(12)
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def normalised(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last WINDOW bytes, each shifted by its distance."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct entries (digest above, length in the low bits) of each text; an empty text has none."""
    coded = [normalised(t) for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = gear_hashes(data)
    places = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[places] & STRICT) == 0).tolist()
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    bounds = np.searchsorted(places, offsets).tolist()
    places, ends, counts, at = places.tolist(), [], [], offsets.tolist()
    for i in range(len(texts)):
        start, end, before = at[i], at[i + 1], len(ends)
        for k in range(bounds[i], bounds[i + 1]):
            place = places[k] + 1
            while place - start > MOST:
                start += MOST
                ends.append(start)
            # The first window of a text must lie inside it, so LEAST is not below WINDOW.
            size = place - start
            if size >= LEAST and (strict[k] or size >= NORMAL) and place < end:
                ends.append(place)
                start = place
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end > start:
            ends.append(end)
        counts.append(len(ends) - before)
    ends = np.array(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = (ends - starts).astype(np.uint64)
    digests = mix(span_hashes(prefix_hashes(data), starts, ends) ^ mix(sizes))
    entries = (digests >> LENGTH_BITS << LENGTH_BITS) | sizes
    cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [np.unique(entries[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``'s length that ``b`` contains; two empty ones are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = (np.uint64(1) << LENGTH_BITS) - np.uint64(1)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float((a[b[at] == a] & low).sum() / (a & low).sum())


def as_text(entries: np.ndarray) -> str:
    return base64.b64encode(entries.astype("<u8").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of ``text`` replaced by the first as many code points of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def lower_bound(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``: a binary search as one expression."""
    powers = [1 << k for k in range(max(1, len(bounds)).bit_length() - 1, -1, -1)]
    listed = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    return F.aggregate(
        F.array(*map(F.lit, powers)), F.lit(0),
        lambda low, step: F.when((low + step <= len(bounds)) & (F.get(listed, low + step - 1) < value), low + step).otherwise(low),
    ) if bounds else F.lit(0)


LOWEST = -(1 << 63)


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (part, halo, doc_id, text), sorted so that in each part every row stands before its follower by descending
    doc_id (null last; equal ids by hash of the text); the follower of a part's last row comes as its ``halo`` row.

    Ranges of doc_id are found from the ids alone, so the texts are shuffled once.  The start of each range is sent
    twice, to its own range and to the one that it follows; there is one such id per range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(q) for q in docs.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    part = -lower_bound(bounds, key)
    firsts = sorted((r["p"], r["k"]) for r in docs.groupBy(part.alias("p")).agg(F.max(key).alias("k")).collect())
    target = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    halo = F.broadcast(spark.createDataFrame(target or [(0, 0)], "_k long, _to int"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_k"), part.cast("int").alias("_own"))
    both = rows.join(halo, "_k", "left").select(
        F.explode(F.filter(F.array(
            F.struct(F.col("_own").alias("part"), F.lit(False).alias("halo")),
            F.struct(F.col("_to").alias("part"), F.lit(True).alias("halo"))), lambda x: x["part"].isNotNull())).alias("x"),
        "doc_id", "text",
    ).select("x.part", "x.halo", "doc_id", "text")
    order = ["part", "halo", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"]
    return both.repartition("part").sortWithinPartitions(*order)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows by descending doc_id, the first after the last; a lone row follows itself.  Null is an
    empty text.  A task holds two rows and one step of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (doc_id, text, next text)
        size = 0

        def flush() -> pa.RecordBatch:
            ids, texts, nexts = zip(*waiting)
            changed = [edited(t, n) for t, n in zip(texts, nexts)]
            # A row's follower is mostly the next row; only others are chunked anew.
            extra = [i for i in range(len(texts)) if i + 1 == len(texts) or nexts[i] is not texts[i + 1]]
            prints = fingerprints([*texts, *changed, *(nexts[i] for i in extra)])
            n = len(texts)
            follow = {i: prints[2 * n + k] for k, i in enumerate(extra)}
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                "fingerprint": pa.array(map(as_text, prints[:n]), pa.string()),
                "edited_fingerprint": pa.array(map(as_text, prints[n : 2 * n]), pa.string()),
                "near_edited": pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[n : 2 * n])], pa.float64()),
                "near_next": pa.array([likeness(prints[i], follow[i] if i in follow else prints[i + 1]) for i in range(n)], pa.float64()),
            })

        part = last = None
        for batch in batches:
            for p, halo, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != part:
                    part, last = p, None
                if last is not None:
                    waiting.append((*last, text))
                    size += len(last[1])
                last = None if halo else (doc_id, text)
                if size >= STEP_BYTES // 2:
                    yield flush()
                    waiting.clear()
                    size = 0
        if waiting:
            yield flush()

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_following(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)
