"""Encoding and decoding with a SentencePiece merge vocabulary.

The library merges, over and over, the two neighbouring pieces whose joined piece has the best score (the leftmost of
equals).  The same ids come from a walk that merges nothing: a sequence of pieces is the encoding of a text exactly if
each two neighbours are the encoding of their joined text.  So the walk takes, at each place, the longest piece that
begins there (one Aho-Corasick pass over the reversed text finds it for all places), goes on to the next shorter prefix
while the piece does not go with its left neighbour, and takes the last piece back where nothing fits.  The prefix of a
text has one encoding only, so a place from which nothing fitted never fits: a bit field remembers these places and the
walk is linear.

Where no piece of the vocabulary reaches from a character into a space mark, texts are cut before each run of space marks;
each task remembers the ids of short words (by the word itself, forgotten as a whole at a fixed size).

Rows: a null text is an empty text, which has only the begin and end ids and decodes to an empty text.  Repeated rows and
ids are separate rows, a null doc_id is kept, further columns are not carried.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_bytes

SPACE = "▁"
#: Longest word, in characters, that a task remembers, and bytes of remembered ids and number of remembered pairs after
#: which the memory starts anew.
WORD_CHARS, MEMORY_BYTES, MEMORY_PAIRS = 48, 1 << 25, 1 << 19
INFINITY = float("inf")
#: Bytes of text that one step turns into Python strings.
STEP = 1 << 20


class PieceEncoder:
    """Ids of texts under the merge vocabulary of a model file with byte pieces and no normalisation but space marks."""

    def __init__(self, path: str):
        import sentencepiece

        model = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  Å") != f"{SPACE}{SPACE}a{SPACE}{SPACE}Å":
            raise ValueError("the model changes texts before it cuts them")
        n = model.vocab_size()
        self.bytes = {}
        self.pieces, self.score, known = [""] * n, [0.0] * n, {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = np.uint32(i).tobytes()
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i], self.score[i], known[piece] = piece, model.get_score(i), i
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.raw = [np.uint32(i).tobytes() for i in range(n)]
        # A character that stands in pieces but is none itself takes part in merges and ends as bytes.
        self.alphabet = set("".join(known))
        for c in sorted(self.alphabet - known.keys()):
            known[c] = len(self.pieces)
            self.pieces.append(c)
            self.score.append(0.0)
            self.raw.append(self.fallback(c))
        self.known, self.size = known, [len(p) for p in self.pieces]
        # The next shorter prefix that is a piece, -1 if there is none.
        self.shorter = [-1] * len(self.pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, i in known.items():
            self.automaton.add_word(piece[::-1], i)
            self.shorter[i] = next((known[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in known), -1)
        self.automaton.make_automaton()
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in known)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.cuts else re.compile(r"(?s).+")
        self.begin, self.end = np.uint32(model.bos_id()).tobytes(), np.uint32(model.eos_id()).tobytes()
        self.origin: dict[int, tuple[list[float], list[int], list[int]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.used = 0

    def fallback(self, text: str) -> bytes:
        return b"".join(self.bytes[b] for b in text.encode())

    def merges(self, piece: int) -> tuple[list[float], list[int], list[int]] | None:
        """How a piece comes about when its text is encoded alone: the scores of the merges in their order, ended by minus
        infinity, and the first and the last part before each of them; None if the text is not encoded as this piece."""
        found = self.origin.get(piece, 0)
        if found == 0:
            known, parts = self.known, list(self.pieces[piece])
            scores, first, last = [], [known[parts[0]]], [known[parts[-1]]]
            while len(parts) > 1:
                best, place = -INFINITY, -1
                for k in range(len(parts) - 1):
                    i = known.get(parts[k] + parts[k + 1])
                    if i is not None and self.score[i] > best:
                        best, place = self.score[i], k
                if place < 0:
                    break
                parts[place : place + 2] = [parts[place] + parts[place + 1]]
                scores.append(best)
                first.append(known[parts[0]])
                last.append(known[parts[-1]])
            found = self.origin[piece] = (scores + [-INFINITY], first, last) if len(parts) == 1 else None
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined text of two pieces is encoded as these two.  Found by merging it again: the next merge is
        the best of the left piece's next, the one across the border and the right piece's next; of equals the leftmost."""
        one, two = self.merges(left), self.merges(right)
        if one is None or two is None:
            return False
        a, _, last = one
        b, first, _ = two
        i = j = 0
        while True:
            across = self.known.get(self.pieces[last[i]] + self.pieces[first[j]])
            if across is not None and self.score[across] > a[i] and self.score[across] >= b[j]:
                return False
            if a[i] >= b[j]:
                if a[i] == -INFINITY:
                    return True
                i += 1
            else:
                j += 1

    def walk(self, text: str) -> list[int]:
        """The encoding of a text whose characters are all in the alphabet."""
        n, size, shorter, pairs, wide = len(text), self.size, self.shorter, self.pairs, len(self.pieces)
        if len(pairs) > MEMORY_PAIRS:
            pairs.clear()
        # The longest piece at each place, counted from the end.  Matches of one place come longest first; the last entry
        # of a key stays.
        longest = dict([(-1, -1), *self.automaton.iter(text[::-1])][::-1])
        failed, any_failed = bytearray((n >> 3) + 1), False
        out: list[int] = []
        at, i, left = 0, longest[n - 1], -1
        while at < n:
            while i >= 0:
                to = at + size[i]
                if not any_failed or not failed[to >> 3] >> (to & 7) & 1:
                    key = left * wide + i
                    fit = pairs.get(key)
                    if fit is None:
                        fit = pairs[key] = self.fits(left, i) if left >= 0 else self.merges(i) is not None
                    if fit:
                        out.append(i)
                        left, at, i = i, to, longest[n - 1 - to]
                        break
                i = shorter[i]
            else:
                if left < 0:
                    raise ValueError("the scores of the vocabulary allow no encoding by neighbours")
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                i = out.pop()
                at -= size[i]
                i = shorter[i]
                left = out[-1] if out else -1
        return out

    def word(self, text: str) -> bytes:
        """The ids of a text that begins where no piece can reach over, as bytes; characters that no piece has are bytes
        and part their neighbours."""
        if self.alphabet.issuperset(text):
            return b"".join([self.raw[i] for i in self.walk(text)])
        out, at = [], 0
        for k, c in enumerate(text):
            if c not in self.alphabet:
                out += [self.raw[i] for i in self.walk(text[at:k])] if k > at else []
                out.append(self.fallback(c))
                at = k + 1
        out += [self.raw[i] for i in self.walk(text[at:])] if at < len(text) else []
        return b"".join(out)

    def recall(self, text: str) -> bytes:
        ids = self.memory.get(text)
        if ids is None:
            ids = self.word(text)
            if len(text) <= WORD_CHARS:
                if self.used > MEMORY_BYTES:
                    self.memory.clear()
                    self.used = 0
                self.memory[text] = ids
                self.used += len(ids) + 4 * len(text)
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text with the begin and the end id, as little-endian 32-bit numbers."""
        if not text:
            return self.begin + self.end
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        return b"".join([self.begin, *map(self.recall, words), self.end])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and ids (begin and end id included, little-endian 32-bit numbers) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            for low, high in steps(text_bytes(batch.column(1))[1], STEP):
                part = batch.slice(low, high - low)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` rows with their decoded text; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            for low, high in steps(text_bytes(batch.column(2))[1], STEP):
                part = batch.slice(low, high - low)
                texts = [own.decode(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    rows = tokens.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
