"""Toxicity: a logistic classifier over hashed words and letter n-grams with a counterfactual penalty.

A document is the set of its words; a word adds the weight of its own bucket and those of its letter n-grams, so that
rare words of one family teach together and no word needs to be frequent.  There is no vocabulary: every word and n-gram
of the sample has a bucket.

For every labelled sentence that names a group, the same sentence with another group's name is formed.  Training adds
``balance`` times the mean squared difference of the two scores (log-odds) to the loss, so that a neutral mention of a
group does not move the score although toxic sentences often name one.

The model is fitted on the driver over at most ``SAMPLE`` labelled rows, the ones with the smallest hash of doc_id, by
limited-memory quasi-Newton steps over sparse rows.  Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, held_out, lean, mix, prefix_hashes, release, span_hashes, steps, text_bytes, trim, word_spans, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Buckets of the hashed features; lengths of the letter n-grams (at the start of a word they are features of their own),
#: and their value beside the 1 of a word.
WIDTH, GRAMS, GRAM_VALUE = 1 << 20, (3, 4, 5), 0.5
#: A document is toxic from this score on.
THRESHOLD = 0.3
#: Names of groups; a term is swapped with the others of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "hindous"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: Words of which the features are listed at once, and words of documents that are summed at once.
BLOCK, CHUNK = 50_000, 1 << 19
SENTENCE = re.compile(r"[.!?\n]+")


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of words; general punctuation (U+2000 to U+207F) separates words as ASCII marks do."""
    inside = WORD[data]
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] <= 0x81))
        inside[at] = inside[at + 1] = inside[at + 2] = False
    return inside


def words_in(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each step of rows: first and last row, their bytes, bounds and hash of each word, and the bounds of the rows' words."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for low, high in steps(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, first = word_spans(part, offsets[low : high + 1] - offsets[low], _inside(part))
        yield low, high, part, starts, ends, mix(span_hashes(prefix_hashes(part), starts, ends)), first


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (word, bucket, value) of the given words: each word's own bucket and those of its letter n-grams."""
    size = ends - starts
    begin = np.cumsum(size) - size
    own = data[np.repeat(starts - begin, size) + np.arange(int(size.sum()))]
    prefix = prefix_hashes(own)
    letter = np.flatnonzero((own & 0xC0) != 0x80)
    word = np.searchsorted(begin, letter, "right") - 1
    last = np.searchsorted(letter, begin + size)[word]
    to = np.append(letter, len(own))
    words, found = [np.arange(len(starts))], [mix(hashes + np.uint64(1))]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(letter)) + n <= last)
        salt = np.uint64(2 * n) + (letter[at] == begin[word[at]]).astype(np.uint64)
        words.append(word[at])
        found.append(mix(span_hashes(prefix, letter[at], to[at + n]) + salt))
    bucket = (np.concatenate(found) % np.uint64(WIDTH)).astype(np.int32)
    return np.concatenate(words).astype(np.int32), bucket, values(len(starts), len(bucket))


def values(own: int, n: int) -> np.ndarray:
    """Values of ``n`` features of which the first ``own`` are words."""
    return np.where(np.arange(n) < own, 1.0, GRAM_VALUE)


@dataclass
class Part:
    """The features of some consecutive words: first each word's own bucket, then its n-grams, one length after the other;
    ``counts`` has the number of n-grams of each length and word."""

    first: int
    counts: np.ndarray
    buckets: np.ndarray

    def words(self) -> np.ndarray:
        """The word of each feature, counted from ``first``."""
        at = np.arange(self.counts.shape[1], dtype=np.int32)
        return np.concatenate([at, *[np.repeat(at, c) for c in self.counts]])

    def worth(self, weights: np.ndarray) -> np.ndarray:
        """Of each word the weights of its buckets, by value."""
        own = self.counts.shape[1]
        return np.bincount(self.words(), values(own, len(self.buckets)) * weights[self.buckets], own)

    def back(self, by_word: np.ndarray) -> np.ndarray:
        """Of each bucket the sum over its words, by value."""
        own = self.counts.shape[1]
        mine = by_word[self.first : self.first + own]
        return np.bincount(self.buckets, values(own, len(self.buckets)) * mine[self.words()], WIDTH)


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for given words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.concatenate([x[5] for x in words_in(pa.array(words))])


def swaps(text: str | None, terms=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, sentence with a group's name replaced) for each name in each sentence and each other name."""
    others = {t: [o for o in line if o != t] for line in terms for t in line}
    out = []
    for sentence in SENTENCE.split((text or "").lower()):
        words = re.findall(r"[^\W_]+", sentence)
        for i, word in enumerate(words):
            for other in others.get(word, ()):
                out.append((" ".join(words), " ".join([*words[:i], other, *words[i + 1 :]])))
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for low, high, part, starts, ends, hashes, first in words_in(column):
            if not len(hashes):
                continue
            known, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            word, bucket, value = features(part, starts[at], ends[at], known)
            worth = np.bincount(word, value * self.weights[bucket], len(known))
            pairs = np.unique(np.repeat(np.arange(high - low), np.diff(first)) * len(known) + which)
            total[low:high] += np.bincount(pairs // len(known), worth[pairs % len(known)], high - low)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def minimise(loss, w: np.ndarray, enough: float, memory: int = 5, rounds: int = 300) -> np.ndarray:
    """L-BFGS; ``loss`` gives value and gradient.  Ends when a round gains less than ``enough``."""
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, back = -grad, []
        for s, y, r in reversed(pairs):
            back.append(r * (s @ step))
            step = step - back[-1] * y
        if pairs:
            step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        else:
            step /= max(1.0, float(np.linalg.norm(grad)))
        for (s, y, r), x in zip(pairs, reversed(back)):
            step += (x - r * (y @ step)) * s
        slope, scale = float(grad @ step), 1.0
        while True:
            new, new_grad = loss(w + scale * step)
            if new <= value + 1e-4 * scale * slope or scale < 1e-8:
                break
            scale /= 2
        if new >= value:
            break
        s, y = scale * step, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            # Halves are precise enough for a direction; the line search judges it.
            pairs = [*pairs[1 - memory :], (s.astype(np.float32), y.astype(np.float32), 1 / float(s @ y))]
        gain, w, value, grad = value - new, w + s, new, new_grad
        if gain < enough:
            break
    return w


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, parts: list[Part], words: int,
    changes: list[tuple[int, list[int], list[int]]], l2: float = 1.0, balance: float = 1.0,
) -> tuple[np.ndarray, float]:
    """Minimise the sum of log losses + l2/2 |w|^2 + balance/2 * (documents) * mean (w . change)^2.

    ``rows`` and ``columns`` list the words present in each document, ``parts`` the features of each of the ``words``; a
    change is how often a swap is seen, and the words that it adds and takes away.
    """
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    w = np.zeros(WIDTH + 1)
    w[WIDTH] = np.log(share / (1 - share))
    if not n or labels.min() == labels.max() or not len(columns):
        return w[:WIDTH], float(w[WIDTH])
    often = np.array([c for c, _, _ in changes], float)
    often *= balance * n / max(1.0, often.sum())
    moved = [(i, k, sign) for i, (_, more, less) in enumerate(changes) for sign, side in ((1.0, more), (-1.0, less)) for k in side]
    change, changed, sign = (np.array([m[k] for m in moved], kind) for k, kind in enumerate((int, int, float)))
    prior = np.append(np.full(WIDTH, l2), 1e-6)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        worth, grad = np.concatenate([np.zeros(0), *[part.worth(v) for part in parts]]), prior * v
        z = np.full(n, v[WIDTH])
        for at in range(0, len(rows), CHUNK):
            z += np.bincount(rows[at : at + CHUNK], worth[columns[at : at + CHUNK]], n)
        gap = np.bincount(change, sign * worth[changed], len(changes))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        # bincount of nothing counts, in whole numbers.
        by_word = np.bincount(changed, sign * (often * gap)[change], words).astype(float)
        for at in range(0, len(rows), CHUNK):
            by_word += np.bincount(columns[at : at + CHUNK], (p - labels)[rows[at : at + CHUNK]], words)
        for part in parts:
            grad[:WIDTH] += part.back(by_word)
        grad[WIDTH] += (p - labels).sum()
        return float(np.logaddexp(0, z).sum() - z[labels > 0].sum() + often @ (gap * gap) / 2 + v @ (prior * v) / 2), grad

    w = minimise(loss, w, 1e-5 * n)
    return w[:WIDTH], float(w[WIDTH])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, terms=IDENTITY_TERMS,
    balance: float = 1.0,
) -> ToxicityModel:
    """Learn from the labelled documents for which ``learn`` (over doc_id; all by default) holds.

    Rows with a null id, label or text teach nothing; a document labelled twice counts as toxic if any label says so;
    equal texts count once.  Without labelled rows, or with labels of one kind, every score is the share of toxic rows.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # At most ``sample`` rows of two numbers are broadcast.
    train = texts.join(F.broadcast(chosen), "doc_id").select("text", "_y").groupBy("text").agg(F.max("_y").alias("_y"))
    train = written(train)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, moved = [], []
            for *_, hashes, first in words_in(batch.column(0)):
                words += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            for text in batch.column(0).to_pylist():
                sides = [[set(hash_words([side]).view(np.int64).tolist()) for side in pair] for pair in swaps(text, terms)]
                moved.append([{"more": sorted(b - a), "less": sorted(a - b)} for a, b in sides if a != b])
            side = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "words": pa.array(words, side), "y": batch.column(1).cast(pa.int32()),
                "moved": pa.array(moved, pa.list_(pa.struct([("more", side), ("less", side)]))),
            })

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part, starts, ends, hashes, _ in words_in(batch.column(0)):
                known, at = np.unique(hashes, return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(known.view(np.int64)),
                    "letters": pa.array([part[s:e].tobytes().decode() for s, e in zip(starts[at], ends[at])], pa.string()),
                })

    feats = written(train.mapInArrow(lean(read), "words array<long>, y int, moved array<struct<more:array<long>,less:array<long>>>"))
    # The distinct words of at most ``sample`` rows, and of each row its words, reach the driver.
    vocabulary = train.select("text").mapInArrow(lean(listed), "word long, letters string").groupBy("word").agg(F.min("letters").alias("letters"))
    letters = pa.concat_arrays([
        vocabulary.select("letters").toArrow()["letters"].cast(pa.string()).combine_chunks(),
        pa.array([t for line in terms for t in line], pa.string())])
    hashes, parts = _table(letters)
    del letters
    order = np.argsort(hashes)
    words = hashes[order]
    del hashes
    trim()

    def places(own: np.ndarray) -> np.ndarray:
        """The places in ``parts`` of some words' hashes."""
        return order[np.searchsorted(words, own)].astype(np.int32)

    # Rows come batch by batch in a fixed order; only their numbers stay.
    rows, columns, y = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
    got = feats.select("words", "y").orderBy(F.xxhash64("words", "y"), "y").toArrow().to_batches(max_chunksize=500)[::-1]
    while got:
        batch = got.pop()
        lists = batch.column(0)
        rows.append(np.repeat(np.arange(len(y), len(y) + len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy()))
        columns.append(places(lists.flatten().to_numpy().view(np.uint64)))
        y += batch.column(1).to_pylist()
    batch = lists = None
    rows, columns, y = np.concatenate(rows), np.concatenate(columns), np.array(y, float)
    counts = feats.select(F.explode("moved").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).orderBy("m").collect()

    def index(hashes: list[int]) -> list[int]:
        return places(np.array(hashes, np.int64).view(np.uint64)).tolist()

    changes = [(r["n"], index(r["m"]["more"]), index(r["m"]["less"])) for r in counts]
    known = len(words)
    del counts, words, order
    # The rows have come through the JVM's heap, too.
    release(docs.sparkSession)
    weights, bias = fit_logistic(rows, columns, y, parts, known, changes, balance=balance)
    del rows, columns, parts
    trim()
    return ToxicityModel(weights, bias)


def _table(letters: pa.Array) -> tuple[np.ndarray, list[Part]]:
    """Hashes of the distinct words in some texts, and their features in the same order."""
    hashes, parts = np.zeros(0, np.uint64), []
    for at_ in range(0, len(letters), BLOCK):
        for _, _, part, starts, ends, own, _ in words_in(letters[at_ : at_ + BLOCK]):
            known, at = np.unique(own, return_index=True)
            new = ~np.isin(known, hashes)
            _, bucket, _ = features(part, starts[at[new]], ends[at[new]], known[new])
            # Features stand by length, and by word inside a length: each further length begins where words start anew.
            size = letters_of(part, starts[at[new]], ends[at[new]])
            counts = np.stack([np.maximum(size - g + 1, 0) for g in GRAMS]).astype(np.int32)
            parts.append(Part(len(hashes), counts, bucket))
            hashes = np.concatenate([hashes, known[new]])
    return hashes, parts


def letters_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Characters of each of the given words."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[ends] - before[starts]


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1 from the whole text.  Null and empty texts get the
    score of a text without known words.  Other columns, of whatever name, pass unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(batch["text"]))], names=["_row", "text", "_score"])

    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("_row"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))
    own = [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != name]
    return done.select(*own, F.col("_score").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  The model never sees held-out documents."""
    model = fit(docs, labels, ~held_out(), **options)
    scored = score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)
