"""Benchmark decontamination with a generalised suffix automaton over words.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters.  The automaton accepts
every run of words of every benchmark item.  A document streams through it word by word; the longest match that ends at
each word tells whether a window ends there.  Before that, one vectorised step finds runs of neighbouring words that
occur in the items at all, so that most text never reaches the Python loop.

The items are a stated set of test texts.  They are measured first: up to ``BLOCK_BYTES`` of text make one automaton;
more are dealt into as many blocks as needed, and the documents pass all blocks in turn, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, mix, prefix_hashes, span_hashes, steps, text_bytes, word_spans, written

WINDOW = 13
#: Text of the items that one automaton takes; about 100 bytes of memory per byte.
BLOCK_BYTES = 1 << 20
#: A document is contaminated when hit words are at least one in so many.
COVERAGE = 20


def words_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class SuffixAutomaton:
    """Of all items at once; ``step`` follows the longest match."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: For a state, the windows that end in it: their length and the items that have them.
        self.windows: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            wide, state, length = min(window, len(words)), 0, 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= wide:
                    self.windows.setdefault(self.holder(state, wide), {}).setdefault(wide, set()).add(name)
        self.shortest = min((min(window, len(w)) for _, w in items), default=0)

    def _extend(self, last: int, word: bytes) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p != -1:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        nexts = self.next
        while state and word not in nexts[state]:
            state = self.link[state]
            length = self.length[state]
        if word in nexts[state]:
            return nexts[state][word], length + 1
        return 0, 0

    def holder(self, state: int, length: int) -> int:
        """The state on the suffix path that stands for the last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words covered by windows, merged, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = length = 0
        for i, word in enumerate(words):
            state, length = self.step(state, length, word)
            at, widest = state, 0
            while at > 0:
                for wide, names in self.windows.get(at, {}).items():
                    if wide <= length:
                        widest = max(widest, wide)
                        found |= names
                at = self.link[at]
            if widest:
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


class Block:
    """The automaton of one block of items and its filter of neighbouring words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        listed = [(name, words_of(text)) for name, text in items]
        self.automaton = SuffixAutomaton(listed, window)
        self.pair = self.automaton.shortest >= 2
        codes: set[int] = set()
        for _, words in listed:
            own = self.hashes(b" ".join(words))
            codes.update(self.pairs(own).tolist() if self.pair else own.tolist())
        self.codes = np.array(sorted(codes), np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.codes >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def hashes(raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        return mix(span_hashes(prefix_hashes(data), starts, ends))

    @staticmethod
    def pairs(hashes: np.ndarray) -> np.ndarray:
        return mix(hashes[:-1] * np.uint64(3) + hashes[1:])

    def runs(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words, long enough for a window, whose neighbours all stand together in some item."""
        if not self.automaton.shortest:
            return []
        codes = self.pairs(hashes) if self.pair else hashes
        maybe = np.flatnonzero(self.seen[(codes >> np.uint64(48)).astype(np.int64)])
        if not len(maybe):
            return []
        at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
        maybe = maybe[self.codes[at] == codes[maybe]]
        if not len(maybe):
            return []
        breaks = np.flatnonzero(np.diff(maybe) > 1) + 1
        first, last = maybe[np.concatenate([[0], breaks])], maybe[np.concatenate([breaks - 1, [len(maybe) - 1]])]
        extra = 2 if self.pair else 1
        keep = last - first + extra >= self.automaton.shortest
        return list(zip(first[keep].tolist(), (last[keep] + extra).tolist()))


#: The last blocks that this Python worker has built.
_BUILT: dict[str, Block] = {}


def built(items: list[tuple[str, str]], window: int) -> Block:
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Block(items, window)
    return _BUILT[key]


FOUND = "text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int, cut: int | None) -> DataFrame:
    """One block over all rows; ``spans`` (in words) and ``items`` of earlier blocks are extended.  With ``cut``, texts lose
    their spans of so many or more words."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or built(shared.value, window)
            text, old_spans, old_items = batch["text"], batch["spans"].to_pylist(), batch["items"].to_pylist()
            data, offsets = text_bytes(text)
            n_words, spans, found = [], [], []
            for low, high in steps(offsets):
                part = LOWER[data[offsets[low] : offsets[high]]]
                starts, ends, first = word_spans(part, offsets[low : high + 1] - offsets[low])
                hashes = mix(span_hashes(prefix_hashes(part), starts, ends))
                rows: list[tuple[list, set]] = [([], set()) for _ in range(high - low)]
                raw, bounds = part.tobytes(), first.tolist()
                for a, b in block.runs(hashes):
                    row = int(np.searchsorted(first, a, "right")) - 1
                    while a < b:
                        to = min(b, bounds[row + 1])
                        words = [raw[s:e] for s, e in zip(starts[a:to].tolist(), ends[a:to].tolist())]
                        hit, names = block.automaton.scan(words)
                        rows[row][0].extend((s + a - bounds[row], e + a - bounds[row]) for s, e in hit)
                        rows[row][1].update(names)
                        a, row = to, row + 1
                n_words += np.diff(first).tolist()
                for i, (hit, names) in enumerate(rows, low):
                    merged: list[tuple[int, int]] = []
                    for s, e in sorted(hit + [(x["start"], x["end"]) for x in old_spans[i]]):
                        if merged and s <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                        else:
                            merged.append((s, e))
                    spans.append([{"start": s, "end": e} for s, e in merged])
                    found.append(sorted(names.union(old_items[i])))
            at = {name: k for k, name in enumerate(batch.schema.names)}
            columns = list(batch.columns)
            columns[at["n_words"]] = pa.array(n_words, pa.int64())
            columns[at["spans"]] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns[at["items"]] = pa.array(found, pa.list_(pa.string()))
            if cut is not None:
                columns[at["text"]] = _cut(text, spans, cut)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, cut: int | None = None) -> DataFrame:
    """``_row`` (the columns beside text), text, n_words, spans, items, and n_hit.  Of several blocks each reads what the
    one before has written, so that a worker holds one automaton."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*keep).alias("_row") if keep else F.lit(0).alias("_row"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        last = k == blocks - 1
        rows = _pass(rows, sorted((r["id"], r["text"]) for r in own.collect()), window, cut if last else None)
        rows = rows if last else written(rows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumn("n_hit", n_hit)


def _own(docs: DataFrame) -> list:
    """The columns of ``docs`` from those of ``_scanned``."""
    return [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with one more column ``_found``: n_words, spans of hit words (start, end exclusive, counted in words),
    n_hit, and items (ids as sorted strings) with windows that occur.

    Null and empty texts have no words; a null item has none and never occurs; a null item_id is called ``null``.
    Items with the same id count once.  Other columns, of whatever name, pass unchanged.
    """
    rows = _scanned(docs, benchmark, window, block_bytes)
    return rows.select(*_own(docs), F.struct("n_words", "n_hit", "spans", "items").alias("_found"))


def is_contaminated(n_hit, n_words, coverage: int = COVERAGE):
    return (n_hit > 0) & (coverage * n_hit >= n_words)


def cleaned_text(text: str, spans: list) -> str:
    """``text`` without the words of ``spans``: from the start of the first to the end of the last word of each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(LOWER[raw], np.array([0, len(raw)]))
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]].tobytes())
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:].tobytes()]).decode()


def _cut(texts: pa.Array, spans: list[list[dict]], least: int) -> pa.Array:
    """``texts`` without their spans of ``least`` or more words."""
    long_ = [[(x["start"], x["end"]) for x in own if x["end"] - x["start"] >= least] for own in spans]
    if not any(long_):
        return texts
    return pa.array([cleaned_text(t, own) if own else t for t, own in zip(texts.to_pylist(), long_)], texts.type)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, max_words: int = WINDOW, coverage: int = COVERAGE, window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Drop the contaminated documents; from others remove spans of ``max_words`` or more words.  Columns as given, of
    whatever name; a text without such a span (null included) stays as it is."""
    rows = _scanned(docs, benchmark, window, block_bytes, max_words)
    return rows.where(~is_contaminated(F.col("n_hit"), F.col("n_words"), coverage)).select(*_own(docs))
