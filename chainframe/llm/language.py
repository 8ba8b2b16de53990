"""Language of a document as a mixture.

Each language is a smoothed distribution over hashed byte trigrams inside words, counted over all texts it may learn
from.  A document is a mixture: each word was drawn from one language, by proportions that expectation-maximisation
estimates from the words' trigram likelihoods.  Sets of languages are compared by likelihood less a penalty of
``PENALTY`` * log(words) for each further language; the set starts with the most likely and grows in the order of the
proportions.  The predicted language is the one with the largest proportion in the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, steps, text_bytes

#: Hash cells of trigrams per language; the model has one number for each, so its size is cells x languages.
CELLS = 1 << 15
SMOOTHING = 0.5
#: Cost of a further language, times log(words).
PENALTY = 1.0
#: Rounds of expectation-maximisation.
ROUNDS = 10
NONE = "und"

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each trigram around a letter; the first trigram of each word; the first word of each row."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    to = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    letters = np.where(LETTER[data], data, 32)
    if len(data) > 2:  # general punctuation is no letter
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] <= 0x81))
        letters[at] = letters[at + 1] = letters[at + 2] = 32
    padded[to] = letters
    middle = np.flatnonzero(padded != 32)
    wide = padded.astype(np.uint32)
    code = wide[middle - 1] * np.uint32(0x9E3779B1) + wide[middle] * np.uint32(0x85EBCA77) + wide[middle + 1] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    cells = (code >> np.uint32(17)).astype(np.int32) & (CELLS - 1)
    begins = np.flatnonzero(padded[middle - 1] == 32)
    rows = np.searchsorted(middle[begins], offsets + np.arange(n + 1))
    return cells, begins, rows


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in steps(offsets):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def train(docs: DataFrame, learn=None) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities per language and cell, from all rows with text and lang for which
    ``learn`` holds.  Each task adds up its own counts, so a language with most rows is spread like any other."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for low, high, data, offsets in _parts(batch.column(1)):
                cells, begins, words = _trigrams(data, offsets)
                bounds = np.append(begins, len(cells))[words]
                own, which = np.unique(langs[low:high], return_inverse=True)
                of = np.repeat(which, np.diff(bounds))
                found = np.bincount(of * CELLS + cells, minlength=len(own) * CELLS).reshape(len(own), CELLS)
                for lang, row in zip(own.tolist(), found):
                    counts[lang] = counts[lang] + row if lang in counts else row
        for lang, row in counts.items():
            cell = np.flatnonzero(row)
            # A language without trigrams is still known.
            cell = cell if len(cell) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(cell), pa.string()), "cell": pa.array(cell, pa.int32()),
                "n": pa.array(row[cell], pa.int64()),
            })

    summed = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(langs), CELLS))
    at = {lang: k for k, lang in enumerate(langs)}
    counts[[at[x] for x in got["lang"].to_pylist()], got["cell"].to_numpy()] = got["n"].to_numpy()
    return langs, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * CELLS))


def _mixture(like: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document (rows of ``allowed``) and the log-likelihood, by expectation-maximisation."""
    n = np.diff(np.append(first, len(like)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * share[row]
        share = np.add.reduceat(joint / joint.sum(1, keepdims=True), first) / n
    fit = np.log((like * share[row]).sum(1))
    return share, np.add.reduceat(fit, first)


def mixtures(log_p: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages for each row that has words, and those rows."""
    cells, begins, words = _trigrams(data, offsets)
    known = np.flatnonzero(np.diff(words))
    if not len(known) or not len(log_p):
        return np.zeros((0, len(log_p))), known[:0]
    # Per word: log-likelihood in each language, relative to the best (the constant cancels).
    score = np.stack([np.add.reduceat(p[cells], begins) for p in log_p], 1)
    # No word alone rules a language out: its likelihood ratio is bounded below.
    like = np.exp(np.maximum(score - score.max(1, keepdims=True), -30))
    first = words[known]
    row = np.repeat(np.arange(len(known)), np.diff(words)[known])
    width = len(log_p)
    full, fit = _mixture(like, first, row, np.ones((len(known), width)), ROUNDS)
    order = np.argsort(-full, 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    cost = PENALTY * np.log(np.diff(words)[known] + 1)
    best, best_value = full, np.full(len(known), -np.inf)
    for size in range(1, width + 1):
        # No likelihood is above that of each word's best language, 0; a penalty beyond it ends the search for good.
        if (-cost * (size - 1) <= best_value).all():
            break
        share, own = full, fit
        if size < width:
            share, own = _mixture(like, first, row, np.where(rank < size, full + 1e-9, 0), ROUNDS // 2 if size > 1 else 1)
        value = own - cost * (size - 1)
        best, best_value = np.where((value > best_value)[:, None], share, best), np.maximum(value, best_value)
    return best, known


def identify(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for each row; ``languages`` maps the chosen set to its proportions.

    A text that is null or has no letter is ``und`` with score 0 and an empty map; so is every text if nothing was
    learned.  Letters whose text has no words to weigh cannot occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            texts = batch.column(1)
            pred, value, maps = [NONE] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for low, high, data, offsets in _parts(texts):
                share, rows = mixtures(model, data, offsets)
                ascii_ = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])[offsets]
                for row, own in zip(rows.tolist(), share):
                    if ascii_[row + 1] == ascii_[row] and not any(c.isalpha() for c in texts[low + row].as_py()):
                        continue
                    k = int(own.argmax())
                    pred[low + row], value[low + row] = names[k], own[k]
                    maps[low + row] = [(names[j], float(own[j])) for j in np.flatnonzero(own > 1e-6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(np.clip(value, 0, 1)), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"))
    kinds = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("languages", T.MapType(T.StringType(), T.DoubleType())))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(*k) for k in kinds)]))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, languages.  The model never sees held-out documents."""
    langs, log_p = train(docs, ~held_out())
    found = identify(docs, langs, log_p)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
