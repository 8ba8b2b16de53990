"""Token ids in Simple-8b blocks.

A block holds the ids of some consecutive documents.  Ids are packed into 64-bit words: the top four bits are a
selector, the others hold as many ids of one width as fit.  Ids that need more than 60 bits do not exist here; ids of
more than ``ESCAPE_BITS`` bits are escaped: the word stream holds a marker and the id goes to a side list of the block.
Every block lists for each of its documents the word that holds its first id, the place of the id in that word, and the
number of ids, so that any document can be decoded alone (``decode_document``); all words of one selector are decoded in
one vectorised step.

File format: Parquet files in the chosen folder, one row per block (``file``, ``block``, ``first_id`` .. ``payload``),
written through Spark's commit protocol, so that a lost executor leaves no half file.  ``payload`` is little-endian:
magic ``S8B2``, counts (documents, ids, words, escapes) as uint32, ids per document as uint32, the word of each document's
first id as uint32 and its place there as uint8, documents' ids as int64 and whether they are known as uint8, words as
uint64, escapes as (uint32 position, uint32 id).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, mix, own_shuffles, prefix_hashes, shared_folder, span_hashes, steps, text_bytes

MAGIC = b"S8B2"
#: Fixed values of the format: ids per word by selector, and bits per id.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: The selector of each number of ids.
SELECTOR = np.zeros(61, np.int8)
SELECTOR[list(COUNTS)] = np.arange(len(COUNTS))
#: An id at or above 2**ESCAPE_BITS is escaped.  The largest value of that width is the marker.
ESCAPE_BITS = 20
#: Ids of a block, about; a block ends with the document that reaches it.
BLOCK_IDS = 1 << 16
END_ID = 2


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` and the escapes (position, id).  Greedy: each word takes the most ids that fit."""
    ids = np.asarray(ids, np.uint32)
    marker = np.uint32((1 << ESCAPE_BITS) - 1)
    out = np.flatnonzero(ids >= marker)
    escapes = np.stack([out.astype(np.uint32), ids[out]], 1) if len(out) else np.zeros((0, 2), np.uint32)
    small = np.where(ids >= marker, marker, ids).astype(np.uint64)
    n = len(small)
    if n == 0:
        return np.zeros(0, np.uint64), escapes
    width = np.frexp(np.maximum(small, np.uint64(1)).astype(np.float64))[1].astype(np.int8)
    # The selector of a word that starts at i, for every i: the smallest width whose run of ids fits.
    counts = np.ones(n, np.uint8)
    narrow = np.zeros(n + 1, np.int32)
    for bits, count in zip(reversed(BITS[:-1]), reversed(COUNTS[:-1])):
        wide = np.flatnonzero(width > bits)
        if max(np.diff(wide, prepend=-1, append=n).max() - 1 if len(wide) else n, 0) < count:
            break
        np.cumsum(width <= bits, dtype=np.int32, out=narrow[1:])
        fits = narrow[count:] - narrow[: n + 1 - count] == count
        np.putmask(counts[: n + 1 - count], fits, count)
    jump, starts, i = counts.tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts)
    chosen = SELECTOR[counts[starts]]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        at = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s]):
            words[at] |= small[starts[at] + k] << np.uint64(k * BITS[s])
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ids again; all words of one selector at a time."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen] if len(words) else np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint32)
    for s in np.unique(chosen):
        at = np.flatnonzero(chosen == s)
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        values = (words[at, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
        ids[starts[at, None] + np.arange(COUNTS[s])] = values.astype(np.uint32)
    ids = ids[:n]
    if len(escapes):
        ids[escapes[:, 0]] = escapes[:, 1]
    return ids


def encode_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    held = np.array(COUNTS)[(words >> np.uint64(60)).astype(np.int64)] if len(words) else np.zeros(0, np.int64)
    begin = np.cumsum(held) - held
    first = np.cumsum(counts) - counts
    word = np.maximum(np.searchsorted(begin, first, "right") - 1, 0)
    place = first - begin[word] if len(words) else first
    head = np.array([len(doc_ids), len(ids), len(words), len(escapes)], "<u4")
    return b"".join((
        MAGIC, head.tobytes(), np.asarray(counts, "<u4").tobytes(), word.astype("<u4").tobytes(), place.astype(np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
        words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes(),
    ))


def _parts(payload: bytes) -> list[np.ndarray]:
    """The arrays of a block, in the order of the file format, after its number of ids."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    docs, n, words, escapes = np.frombuffer(payload, "<u4", 4, 4).tolist()
    at, out = 20, [n]
    for kind, size in (("<u4", docs), ("<u4", docs), ("u1", docs), ("<i8", docs), ("u1", docs), ("<u8", words), ("<u4", 2 * escapes)):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return out


def decode_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a block."""
    n, counts, _, _, doc_ids, known, packed, rest = _parts(payload)
    names = [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist())]
    return names, counts, unpack(packed, rest.reshape(-1, 2), n)


def decode_document(payload: bytes, k: int) -> np.ndarray:
    """The ids of the ``k``-th document of a block, from its own words only."""
    _, counts, word, place, _, _, packed, rest = _parts(payload)
    first, skip, size = int(word[k]), int(place[k]), int(counts[k])
    upto = first
    held = -skip
    while held < size:
        held += COUNTS[int(packed[upto] >> np.uint64(60))]
        upto += 1
    begin = int(counts[:k].sum())
    own = rest.reshape(-1, 2).astype(np.int64) - [begin - skip, 0]
    inside = own[(own[:, 0] >= skip) & (own[:, 0] < skip + size)]
    return unpack(packed[first:upto], inside, skip + size)[skip:]


#: Classes of the characters below U+0100 as the tokenizer's splitting pattern sees them (fixed values of Unicode).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Contractions that are pieces of their own at the start of a run of marks (fixed values of the pattern).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Slots for remembered pieces in a Python worker, a power of two; ids and letters after which it starts anew; and bytes of
#: text that one step tokenizes.
SLOTS, REMEMBERED_IDS, REMEMBERED_LETTERS, STEP = 1 << 18, 1 << 20, 1 << 22, 1 << 18


def latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per Latin-1 byte: 0 space, 1 letter, 2 digit, 3 other; and its lower case."""
    kind = np.full(256, 3, np.uint8)
    for value, members in ((0, SPACES), (1, LETTERS), (2, DIGITS)):
        inside = re.compile(f"[{members}]")
        kind[[i for i in range(256) if inside.match(chr(i))]] = value
    return kind, np.frombuffer(bytes(range(256)).decode("latin-1").lower().encode("latin-1"), np.uint8)


KIND, LATIN_LOWER = latin_tables()


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of some lower-cased Latin-1 texts: runs of letters, single digits, runs of other
    marks, and contractions."""
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    change |= edge
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1].copy(), cuts[1:].copy()
    keep = kind[starts] != 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    marks = np.flatnonzero((data[starts] == 39) & (ends - starts == 1)) if len(starts) else starts
    drop = []
    for k in marks.tolist():
        if k + 1 < len(starts) and starts[k + 1] == ends[k] and kind[ends[k]] == 1 and not edge[ends[k]]:
            text = data[starts[k] : min(starts[k] + 3, ends[k + 1])].tobytes().decode("latin-1")
            found = next((c for c in CONTRACTIONS if text.startswith(c)), None)
            if found:
                ends[k] = starts[k + 1] = starts[k] + len(found)
                if starts[k + 1] == ends[k + 1]:
                    drop.append(k + 1)
    if drop:
        starts, ends = np.delete(starts, drop), np.delete(ends, drop)
    return starts, ends


def equal_spans(
    one: np.ndarray, start: np.ndarray, size: np.ndarray, two: np.ndarray, other: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Whether span by span the bytes of ``one`` from ``start`` and of ``two`` from ``other`` are equal.  Spans are not empty."""
    out = size == length
    at = np.flatnonzero(out)
    if len(at):
        size = size[at]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        differ = one[np.repeat(start[at] - begin, size) + step] != two[np.repeat(other[at] - begin, size) + step]
        out[at] = ~np.logical_or.reduceat(differ, begin)
    return out


class WordTokenizer:
    """The tokenizers library with a memory.

    The vocabulary's pattern cuts lower-cased text into pieces that are merged one by one, so a piece has the same ids
    wherever it stands: each distinct piece goes through the library's model once.  Texts with characters from U+0100
    on or with the text of a special token go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.library.model)
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_])
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Pieces are remembered by hash in one of two slots: where their ids begin in ``table`` and how many, and where
        their letters begin in ``letters`` and how many."""
        self.keys = np.zeros(SLOTS, np.uint64)
        self.begin, self.size, self.place, self.long = (np.zeros(SLOTS, np.int32) for _ in range(4))
        self.table, self.used = np.zeros(1 << 14, np.uint32), 0
        self.letters, self.written = np.zeros(1 << 16, np.uint8), 0

    def slots(self, key: np.ndarray) -> np.ndarray:
        """For each piece the slot that holds its hash, or -1."""
        last = np.uint64(SLOTS - 1)
        one, two = (key & last).astype(np.int32), ((key >> np.uint64(40)) & last).astype(np.int32)
        return np.where(self.keys[one] == key, one, np.where(self.keys[two] == key, two, -1))

    def added(self, flat: np.ndarray) -> int:
        """Append ids to ``table``; returns where they begin."""
        if self.used + len(flat) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros(max(len(flat), len(self.table)), np.uint32)])
        self.table[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def remember(self, key: np.ndarray, begin: np.ndarray, sizes: np.ndarray, text: np.ndarray, long: np.ndarray) -> None:
        """Keep pieces, given by hash, begin and number of ids, and their letters one after the other.  Of several pieces
        that meet in a slot the last stays, in all arrays."""
        if self.written + len(text) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(len(text), len(self.letters)), np.uint8)])
        self.letters[self.written : self.written + len(text)] = text
        last = np.uint64(SLOTS - 1)
        one, two = (key & last).astype(np.int32), ((key >> np.uint64(40)) & last).astype(np.int32)
        slot = np.where(self.keys[one] == 0, one, two)
        self.keys[slot] = key
        self.begin[slot], self.size[slot] = begin, sizes
        self.place[slot], self.long[slot] = self.written + np.cumsum(long) - long, long
        self.written += len(text)

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and how many each has.  A piece ends with the token that has the word-end mark."""
        flat = np.array(self.model.encode(" ".join(pieces), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(pieces):
            return flat, np.diff(ends, prepend=0)
        coded = [self.model.encode(p, add_special_tokens=False).ids for p in pieces]
        return np.array([i for c in coded for i in c], np.uint32), np.array([len(c) for c in coded])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain, raw = [], []
        for i, text in enumerate(texts):
            try:
                coded = text.encode("latin-1")
                if "<|" in text and any(s in text for s in self.special):
                    raise ValueError
                plain.append(i)
                raw.append(coded)
            except ValueError:
                out[i] = self.whole(text)
        if plain:
            lengths = np.array([len(r) for r in raw])
            for i, ids in zip(plain, self._plain(b"".join(raw), np.concatenate([[0], np.cumsum(lengths)]))):
                out[i] = ids
        return out

    @staticmethod
    def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(span_hashes(prefix_hashes(data), starts, ends) ^ mix((ends - starts).astype(np.uint64)))

    def _plain(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        data = LATIN_LOWER[np.frombuffer(raw, np.uint8)]
        starts, ends = pieces_of(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        long = ends - starts
        key = self.hashed(data, starts, ends)
        if self.used > REMEMBERED_IDS or self.written > REMEMBERED_LETTERS:
            self.forget()
        slot = self.slots(key)
        # A hash only finds a piece; its letters decide.
        known = np.flatnonzero(slot >= 0)
        known = known[equal_spans(data, starts[known], long[known], self.letters, self.place[slot[known]], self.long[slot[known]])]
        begin, own = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        begin[known], own[known] = self.begin[slot[known]], self.size[slot[known]]
        missing = np.ones(len(key), bool)
        missing[known] = False
        missing = np.flatnonzero(missing)
        while len(missing):
            new, first, which = np.unique(key[missing], return_index=True, return_inverse=True)
            first = missing[first]
            same = equal_spans(data, starts[missing], long[missing], data, starts[first][which], long[first][which])
            pieces = [data[s:e].tobytes().decode("latin-1") for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            flat, sizes = self.merged(pieces)
            at = self.added(flat) + np.cumsum(sizes) - sizes
            begin[missing[same]], own[missing[same]] = at[which[same]], sizes[which[same]]
            text = data[np.repeat(starts[first] - (np.cumsum(long[first]) - long[first]), long[first]) + np.arange(int(long[first].sum()))]
            self.remember(new, at, sizes, text, long[first])
            # Pieces of an equal hash but other letters are looked at again.
            missing = missing[~same]
        upto = np.cumsum(own)
        ids = self.table[np.repeat(begin - (upto - own), own) + np.arange(upto[-1])]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


BLOCKS = "part int, block int, n_docs long, n_ids long, payload binary"


def blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all documents in ascending doc_id order (null ids first, equal ids by text).

    A range repartition by doc_id orders the documents between tasks and a sort orders them inside; ``part`` is the
    number of the range.  A task keeps one block in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tok, end = TaskContext.get().partitionId(), tokenizer(tokenizer_path), np.array([end_id], np.uint32)
        number, ids, doc_ids, counts, total = 0, [], [], [], 0

        def flush():
            payload = encode_block(doc_ids, np.array(counts), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
                "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([total], pa.int64()),
                "payload": pa.array([payload], pa.binary()),
            })

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in steps(text_bytes(texts)[1], STEP):
                for doc_id, got in zip(keys[low:high], tok.encode([t or "" for t in texts[low:high].to_pylist()])):
                    doc_ids.append(doc_id)
                    ids += [got, end]
                    counts.append(len(got) + 1)
                    total += counts[-1]
                    if total >= block_ids:
                        yield flush()
                        number, ids, doc_ids, counts, total = number + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lean(run), BLOCKS)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> str:
    """Encode all documents into files below ``folder`` (by default in the shared folder) and return it."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    with own_shuffles(docs.sparkSession):
        blocks(docs, tokenizer_path, **options).write.parquet(folder)
    return folder


READ = "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long, ids binary"


def read_tokens(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids
    (little-endian uint32).

    Starts are sums of three levels: ids of earlier parts (one row per part), of earlier blocks of the part, and of
    earlier documents of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, block, payload in zip(parts, numbers, batch.column(2)):
                doc_ids, counts, ids = decode_block(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw, n = ids.astype("<u4").tobytes(), len(doc_ids)
                own = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()), "inner": pa.array(ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    "ids": pa.array(own if with_ids else [None] * n, pa.binary()),
                })

    stored = spark.read.parquet(folder)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.select("part", "block", "n_ids")
        .withColumn("_own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(before, "part")
        .select("part", "block", (F.col("_own") + F.col("_before")).alias("_start"))
    )
    decoded = stored.select("part", "block", "payload").mapInArrow(lean(run), READ)
    out = decoded.join(offsets, ["part", "block"]).select(
        "doc_id", (F.col("_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
    return out if with_ids else out.drop("ids")
