"""SentencePiece ids, periodic runs and centroids against the library, brute force and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from chainframe.llm import centroids, periodic, pieces
from chainframe.llm.queries import PIECES

SCHEMA = "doc_id long, text string, ids string, runs long, n_words long, decoded long"
WIDE = "vec_id long, embedding array<float>, x string, lead long, cluster string, distance double"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_walk_equals_library(library):
    own, rng = pieces.PieceEncoder(PIECES), random.Random(1)
    known, alphabet = sorted(own.known), [*sorted(own.alphabet), "😀", "​", "\x00", " "]
    texts = [head + " " * n + tail for n in range(70) for head in ("", "x ", "\n") for tail in ("", "a", "the", "執", "zzq")]
    for _ in range(1500):
        texts.append("".join(rng.choice("abcdeinorst ") for _ in range(rng.randrange(60))))
        texts.append("".join(rng.choice(known) for _ in range(rng.randrange(6))).replace("▁", " "))
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(12))))
        texts.append(rng.choice("ab=-_.*#/") * rng.randrange(80) + "".join(rng.choice("=-_.*#/0a ") for _ in range(30)))
    texts += ["ab" * 30_000, "q" * 50_000 + " " + "=" * 3001, " " * 9999 + "x", "▁ ▁▁a▁", "<s>a</s><0x41><unk>"]
    for text in texts:
        want = [1, *library.encode(text), 2]
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text[:80]
        assert own.decode(got) == library.decode(want)


def test_walk_takes_back(library):
    """Words whose longest first piece is wrong; the number of steps back stays linear."""
    own = pieces.PieceEncoder(PIECES)
    greedy = 0
    for text in ("▁nonetheless", "▁unhappiness", "▁misunderstandings", "▁rearranging", "▁superintendent", "▁themost"):
        first = own.known[max((text[:k] for k in range(1, len(text) + 1) if text[:k] in own.known), key=len)]
        ids = own.walk(text)
        assert ids == library.encode(text.replace("▁", " ").strip())
        greedy += ids[0] != first
    assert greedy


def test_pair_check_equals_merging():
    own, rng = pieces.PieceEncoder(PIECES), random.Random(4)

    def merge(text):
        parts = list(text)
        while True:
            best = max(((own.score[own.known[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.known),
                       default=None)
            if best is None:
                return [own.known[p] for p in parts]
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    tokens = sorted(own.known.values())
    spaces = [i for p, i in own.known.items() if set(p) == {"▁"}]
    for _ in range(4000):
        pool = spaces if rng.random() < 0.1 else tokens
        a, b = rng.choice(pool), rng.choice(pool)
        assert own.fits(a, b) == (merge(own.pieces[a] + own.pieces[b]) == [a, b])


def test_memory_can_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 64)
    monkeypatch.setattr(pieces, "MEMORY_PAIRS", 8)
    own = pieces.PieceEncoder(PIECES)
    text = "Several different words are forgotten again and again"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == [1, *library.encode(text), 2]


def documents():
    rng = random.Random(7)
    long_ = " ".join(rng.choice("ab cd ef gh".split()) + str(rng.randrange(900)) for _ in range(30_000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", long_, "x " * 50, "x y " * 20, "one two three " * 9 + "one", "a b" * 40, "é é é " * 12,
             "Ein  Wort.\n\nNoch eins\t\x1c  ", "x y " * 20]
    out = [(i, t, "c", 1, 2, 3) for i, t in enumerate(texts)]
    block = " ".join(f"w{rng.randrange(6)}" for _ in range(90))
    out += [(100 + i, " ".join(f"w{rng.randrange(2 + i % 5)}" for _ in range(20 * i)) + " " + block * (i % 3), "c", 1, 2, 3) for i in range(40)]
    return [*out, (None, "a b c d e f g " * 3, "c", 1, 2, 3), (7, "one", "c", 1, 2, 3)]


def test_pieces_of_documents(spark, library):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pieces.decoded(pieces.encoded(docs, PIECES), PIECES).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = [1, *library.encode(text or ""), 2]
        want.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"])) for r in got)
    assert pieces.encoded(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def brute_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def sequences(rng):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for k in range(500):
        n = rng.randrange(1, 150)
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        yield [rng.randrange(2 + k % 3) for _ in range(n)]
        yield [rng.randrange(3) for _ in range(k % 20)] + (block * 12)[:n] + [rng.randrange(3) for _ in range(k % 17)]
        yield [ord(c) for c in fibonacci[-1][:n]]
        yield (([0] * rng.randrange(1, 50) + [1]) * 8)[: n + 20]
        yield [bin(i).count("1") % 2 for i in range(n)] * rng.randrange(1, 4)


def test_runs_equal_brute_force():
    for words in sequences(random.Random(2)):
        got = periodic.all_runs(np.array(words, np.int64), len(words))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words), words


def test_runs_when_hashes_collide(monkeypatch):
    """With 3 different hash values, too much is proposed and nothing wrong is reported."""
    monkeypatch.setattr(periodic, "mix", lambda x: x % np.uint64(3))
    rng = random.Random(9)
    for words in list(sequences(rng))[:600]:
        got = periodic.all_runs(np.array(words, np.int64), len(words))
        assert {tuple(r) for r in got.tolist()} <= set(brute_runs(words))
        assert [r[2] for r in got.tolist()].count(1) == [r[2] for r in brute_runs(words)].count(1)


def plain(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, p) for s, e, p in brute_runs(words) if e - s >= max(12, 2 * p)] if n < 5000 else None
    if runs is None:
        return None
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark):
    rows = [r for r in documents() if r[0] != 4]
    planted = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(5)
    rows += [(i, " ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))), "c", 1, 2, 3) for i in planted]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic.digests(periodic.periodic_runs(docs, plant=True)).collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(repr(plain(r[0], r[1])) for r in rows) == sorted(repr(tuple(r[c] for c in columns)) for r in got)
    assert sum(r["n_runs"] > 0 for r in got) > len(planted) // 2
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(v))) for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (sha("1:" + ("" if r[0] is None else str(r[0]))), r[1]))
    middle = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m)), c) for c, m in enumerate(middle)) for _, q in kept]

    for _ in range(rounds):
        members = {}
        for (_, q), (_, c) in zip(kept, assign()):
            members.setdefault(c, []).append(q)
        middle = [[sum(v) // len(members[c]) for v in zip(*members[c])] if c in members else m for c, m in enumerate(middle)]
    found = assign()
    total = {}
    for d, c in found:
        total[c] = total.get(c, 0) + d

    def long(v):
        return v if v < 1 << 63 else None

    return sorted(repr((i, c, long(d), long(total[c]), long(sum(total.values())), sha(",".join(map(str, middle[c])))))
                  for (i, _), (d, c) in zip(kept, found))


def vectors(huge=False):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 0.4, (9, 64))
    rows = [(i, [float(np.float32(v)) for v in middles[i % 9] + rng.normal(0, 0.1, 64)]) for i in range(240)]
    rows += [(500 + i, [0.5] * 64) for i in range(30)]
    rows += [(7, [0.25] * 64), (None, [0.125] * 64), (None, [0.25] * 64), (900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65),
             (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63), (906, [float("inf")] + [0.1] * 63)]
    if huge:
        big = float(np.float32(3e38))
        rows += [(1000, [big] * 64), (1001, [-big] + [0.0] * 63), (1002, [5e6] * 64), (1003, [5e6] * 63 + [5.1e6])]
    return rows


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_equal_plain_python(spark, huge):
    rows = vectors(huge)
    df = spark.createDataFrame([(i, x, "c", 1, "c", 0.5) for i, x in rows], WIDE).repartition(3)
    got = centroids.with_inertia(*centroids.clusters(df)).collect()
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == plain_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.5] * 64)], [(5, [0.25] * 64)] * 40, []):
        df = spark.createDataFrame([(i, x, "c", 1, "c", 0.5) for i, x in rows], WIDE)
        got = centroids.with_inertia(*centroids.clusters(df)).collect()
        columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == plain_clusters(rows)


def test_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = rng.integers(-200, 200, (500, 64))
    x[:100] = x[100:200] + rng.integers(-1, 2, (100, 64))
    middle = x[::40]
    cluster, distance, computed = centroids.nearest(x, *centroids.rotated(x, turn), middle, turn)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert len(x) <= computed < every.size


def test_the_filter_saves_distances(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 2.0, (16, 6)) @ rng.normal(size=(6, 64))
    rows = [(i, [float(v) for v in middles[i % 16] + rng.normal(0, 0.02, 64)]) for i in range(400)]
    found, _ = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.agg(F.avg("n_computed")).first()[0] < 4
