"""Exact substring dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed.

Suffixes are not sorted all at once.  A gram of ``GRAM`` bytes is an *anchor* if its hash is the smallest in some window
of LENGTH bytes; equal windows have equal anchors at equal places, so only suffixes at anchors whose gram occurs again
need be compared, and only against those with the same gram.

* Occurrences whose whole context (every window around the anchor) is equal are counted by hash.
* The other contexts of an anchor are sorted as suffixes: a merge sort whose comparisons find the common extension of
  two suffixes by binary search over prefix polynomial hashes, all groups of a batch merged in step.  That order, kept
  inside classes of equal bytes before the anchor, is the order of the suffixes that start so many bytes earlier, so
  neighbours in it tell for every window whether it is repeated; the bytes of the widest matches are compared before
  they count.
* An anchor with more than ``SORTED`` contexts is not gathered in one task; its windows are counted by 64-bit hash
  together with the anchor's, with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hashes, span_hashes, steps, text_bytes, written

LENGTH, GRAM = 200, 64
#: Contexts of an anchor that one task sorts, at most (of up to 336 bytes each).
SORTED = 20_000
#: Contexts that are sorted in one step.
STEP_CONTEXTS = 20_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: prefix and suffix minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, place in the row, gram hash and context hash of each anchor; texts shorter than ``length`` have none."""
    prefix = prefix_hashes(data)
    out = []
    reach = length - gram
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        grams = np.arange(a, b - gram + 1)
        h = mix(span_hashes(prefix, grams, grams + gram))
        low = sliding_min(h, reach + 1)
        # A gram is an anchor if it is the smallest of some window: its value equals the largest minimum around it.
        wide = np.concatenate([np.zeros(reach, h.dtype), low, np.zeros(reach, h.dtype)])
        most = ~sliding_min(~wide, reach + 1)
        at = np.flatnonzero(most == h)
        start, end = np.maximum(at - reach, 0), np.minimum(at + length, b - a)
        context = mix(span_hashes(prefix, a + start, a + end) ^ mix((at - start).astype(np.uint64) * np.uint64(4096) + (end - at).astype(np.uint64)))
        out.append((np.full(len(at), row), at, h[at], context))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Suffixes:
    """Byte strings laid end to end, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.size = data, start, end - start
        self.prefix, self.inverse = prefix_hashes(data), powers(len(data) + 1)[1]

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by binary search over their hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (self.prefix[a + middle] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + middle] - self.prefix[b]) * self.inverse[b]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (a prefix before what it begins)."""
        n = self.common(i, j)
        over = (n == self.size[i]) | (n == self.size[j])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, last)], self.data[np.minimum(self.start[j] + n, last)]
        return np.where(over, self.size[i] < self.size[j], x < y)


def sort_suffixes(suffixes: Suffixes, first: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside each group (groups are consecutive, ``first`` has their starts and the end): a
    bottom-up merge sort of all groups together.  Each suffix finds its rank in its sibling run by binary search."""
    n, sizes = int(first[-1]), np.diff(first)
    begin, inside = np.repeat(first[:-1], sizes), np.arange(n) - np.repeat(first[:-1], sizes)
    total, order, width = np.repeat(sizes, sizes), np.arange(n), 1
    while width < sizes.max(initial=1):
        run = inside // width
        left = run % 2 == 0
        other = begin + (run ^ 1) * width
        stop = np.minimum(other + width, begin + total)
        move = np.flatnonzero((total > width) & (other < stop))
        low, high = other[move].copy(), stop[move].copy()
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            mine, theirs = order[move[open_]], order[middle]
            # Equal suffixes keep the left run's first.
            before = np.where(left[move[open_]], suffixes.less(theirs, mine), ~suffixes.less(mine, theirs))
            low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
        to = np.arange(n)
        pair = begin[move] + (run[move] & ~1) * width
        to[move] = pair + inside[move] - run[move] * width + low - other[move]
        new = np.empty_like(order)
        new[to] = order
        order, width = new, 2 * width
    return order


def repeated(contexts: list[bytes], at: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes to the left and right of its anchor that repeated windows cover (0, 0: none)."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    right = Suffixes(data, begin + at, begin + sizes)
    order = sort_suffixes(right, first)
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))[order].astype(np.uint64)
    covered = np.zeros((2, len(contexts)), np.int64)
    partner = np.zeros((2, len(contexts)), np.int64)
    for v in range(int(at.max(initial=0)), -1, -1):
        # The suffixes that start v bytes before the anchors: those with equal bytes before it, by what follows.
        far = np.flatnonzero((at[order] >= v) & (right.size[order] >= length - v))
        own = order[far]
        before = mix(right.hashes(right.start[own] - v, v) ^ mix(group[far] + np.uint64(1)))
        sort = np.argsort(before, kind="stable")
        own, before = own[sort], before[sort]
        after = right.hashes(right.start[own], length - v)
        same = np.flatnonzero((before[1:] == before[:-1]) & (after[1:] == after[:-1]))
        for i, j in ((own[same], own[same + 1]), (own[same + 1], own[same])):
            fresh = covered[1, i] == 0
            partner[0, i[fresh]], covered[0, i[fresh]] = j[fresh], v
            partner[1, i], covered[1, i] = j, length - v
    return confirmed(contexts, at, first, covered, partner, length)


def confirmed(contexts, at, first, covered, partner, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same coverage after the bytes of the widest matches on both sides are compared; where hashes collided, the
    windows of the group are compared as bytes."""
    group = np.searchsorted(first, np.arange(len(contexts)), "right") - 1
    for x in np.flatnonzero(covered[1]).tolist():
        p = int(at[x])
        for side in (0, 1):
            y, start = int(partner[side, x]), int(covered[0, x]) if side == 0 else length - int(covered[1, x])
            q = int(at[y])
            if contexts[x][p - start : p - start + length] != contexts[y][q - start : q - start + length]:
                others = range(int(first[group[x]]), int(first[group[x] + 1]))
                found = [v for v in range(p + 1) if len(contexts[x]) - p >= length - v and any(
                    z != x and at[z] >= v and contexts[x][p - v : p - v + length] == contexts[z][int(at[z]) - v : int(at[z]) - v + length] for z in others)]
                covered[0, x], covered[1, x] = (max(found), length - min(found)) if found else (0, 0)
                break
    return covered[0], covered[1]


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sorted_: int = SORTED) -> DataFrame:
    """(key, start, end): spans of the text with hash ``key`` that repeated strings cover; they may overlap."""
    reach = length - gram
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select(F.xxhash64("text").alias("key"), "doc_id", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for low, high in steps(offsets):
                row, at, h, c = anchors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[low + row]), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
                    names=["key", "at", "h", "c"])

    found = written(keyed.select("key", "text").mapInArrow(find, "key long, at int, h long, c long"))
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1")
    hits = written(found.join(again.select("h", (F.col("c1") != F.col("c2")).alias("mixed")), "h"))
    counted = hits.where("mixed").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    whole = hits.where("NOT mixed").select("key", "at").union(
        hits.where("mixed").join(counted.where("n > 1").select("h", "c"), ["h", "c"]).select("key", "at")).distinct()
    spans = whole.select("key", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + length).alias("end"))
    # Contexts that occur once, and one place of each that occurs more often, to compare with.
    kinds = counted.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    lone = hits.where("mixed").groupBy("h", "c").agg(F.min(F.struct("key", "at")).alias("p"), F.count(F.lit(1)).alias("n"))
    border = lone.join(kinds, "h").select("h", "p.key", "p.at", (F.col("n") == 1).alias("lone"), "kinds")
    places = border.groupBy("key").agg(F.collect_list(F.struct("h", "at", "lone", "kinds")).alias("places"))
    named = keyed.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    where = places.join(named, "key").withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    sources = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(*(batch.column(k) for k in range(3))):
                raw = text.as_py().encode()
                got = own.as_py()
                starts = [max(0, p["at"] - reach) for p in got]
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array([p["h"] for p in got], pa.int64()), "key": pa.array([key.as_py()] * len(got), pa.int64()),
                    "at": pa.array([p["at"] for p in got], pa.int32()), "lone": pa.array([p["lone"] for p in got], pa.bool_()),
                    "kinds": pa.array([p["kinds"] for p in got], pa.int64()),
                    "left": pa.array([p["at"] - s for p, s in zip(got, starts)], pa.int32()),
                    "context": pa.array([raw[s : p["at"] + length] for p, s in zip(got, starts)], pa.binary()),
                })

    once = where.join(sources, ["doc_id", "key"]).select("key", "text", "places")
    contexts = written(once.mapInArrow(cut, "h long, key long, at int, lone boolean, kinds long, left int, context binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush(ready: list[tuple]) -> pa.RecordBatch:
            hs = np.array([r[0] for r in ready])
            first = np.concatenate([[0], np.flatnonzero(np.diff(hs)) + 1, [len(hs)]])
            left, right = repeated([r[5] for r in ready], np.array([r[4] for r in ready], np.int64), first, length)
            keep = np.flatnonzero((left + right >= length) & np.array([r[3] for r in ready]))
            at = np.array([r[2] for r in ready], np.int64)[keep]
            return pa.RecordBatch.from_arrays(
                [pa.array([ready[k][1] for k in keep.tolist()], pa.int64()), pa.array((at - left[keep]).astype(np.int32)), pa.array((at + right[keep]).astype(np.int32))],
                names=["key", "start", "end"])

        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in range(6)))
            if len(rows) >= STEP_CONTEXTS:
                # The last group may go on in the next batch.
                end = len(rows)
                while end and rows[end - 1][0] == rows[-1][0]:
                    end -= 1
                if end:
                    yield flush(rows[:end])
                    rows = rows[end:]
        if rows:
            yield flush(rows)

    few = contexts.where(F.col("kinds") <= sorted_).select("h", "key", "at", "lone", "left", "context")
    sorted_spans = few.repartition("h").sortWithinPartitions("h").mapInArrow(compare, "key long, start int, end int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(4))
            sizes = np.maximum(np.diff(offsets) - length + 1, 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = offsets[row] + inner
            hashes = mix(span_hashes(prefix_hashes(data), start, start + length)) if len(row) else np.zeros(0, np.uint64)
            h, key, at, left = (batch.column(k).to_numpy() for k in range(4))
            place = inner - left[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row]), pa.array(key[row]), pa.array((at[row] + place).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64))],
                names=["h", "key", "start", "place", "w"])

    many = contexts.where(F.col("kinds") > sorted_).select("h", "key", "at", "left", "context", "lone")
    single = many.select("h", "key", "at", "left", "context").mapInArrow(windows, "h long, key long, start int, place int, w long")
    twice = single.groupBy("h", "place", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "place", "w")
    counted_spans = single.join(twice, ["h", "place", "w"]).groupBy("h", "key").agg(F.collect_set("start").alias("s")).select(
        "key", F.explode("s").alias("start")).select("key", "start", (F.col("start") + length).alias("end"))
    return written(spans.union(sorted_spans).union(counted_spans))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sorted_: int = SORTED, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary).

    Null counts as an empty text; texts shorter than ``length`` keep everything; equal texts (at least ``length`` bytes)
    lose everything, in each copy.  A cut may split a character, hence bytes.
    """
    spans = removed_spans(docs, length, gram, sorted_).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.xxhash64("text"))
    marks = keyed.select("doc_id", "key").distinct().join(spans, "key").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "key", "spans")
    rows = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(marks.dropDuplicates(["_id", "key"]), ["_id", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, own in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                kept, at, n = [], 0, 0
                for x in sorted((x["start"], x["end"]) for x in own.as_py() or ()):
                    start, end = x[0], min(x[1], len(raw))
                    if start > at or not n:
                        kept.append(raw[at:start])
                        n += 1
                    at = max(at, end)
                kept.append(raw[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if with_text else None)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")
