"""The text operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainframe.llm import (
    decontaminate, fingerprints, language, mixing, near_dedup, secrets, sharding, substrings, tokens, toxicity,
)
from chainframe.llm.queries import TOKENIZER, WEIGHTS, levels

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau über niño".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, score double, _row string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows():
    base, long_ = prose(1, 120), prose(2, 9000)
    changed = base.split()
    changed[60] = "changed"
    texts = [base, base, " ".join(changed), base + " tail", None, "", "word", "one two three four", long_, prose(3, 80) + base[:260],
             prose(4, 80) + base[:260], "a" * 450, prose(5, 60), "  \n ", "é" * 150]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 1, 2, 3, 0.5, "x") for i, t in enumerate(texts)]
    return [*out, (None, prose(6, 50), None, None, 1, 2, 3, 0.5, "x"), (12, prose(5, 60), "en", "s0", 1, 2, 3, 0.5, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in df.collect())


def test_substrings(docs, none):
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    windows = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if windows[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        want[doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    for limit in (20_000, 2):
        got = substrings.cut_repeats(docs, sorted_=limit)
        assert by_row(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert substrings.cut_repeats(none).count() == 0


def test_suffix_order():
    parts = [b"banana", b"ananas", b"an", b"", b"banana", b"nan", b"bandana"]
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    suffixes = substrings.Suffixes(np.frombuffer(b"".join(parts), np.uint8), start, start + size)
    order = substrings.sort_suffixes(suffixes, np.array([0, 4, 7]))
    assert [parts[i] for i in order] == sorted(parts[:4]) + sorted(parts[4:])


def test_near_duplicates(docs, none):
    def bag(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    named = [(r[0], bag(r[1])) for r in rows()]
    label = list(range(len(named)))
    for _ in named:
        for i, (_, a) in enumerate(named):
            for j, (_, b) in enumerate(named):
                if a and b and 10 * (a & b).total() >= 8 * (a | b).total():
                    label[i] = label[j] = min(label[i], label[j])
    ids = collections.defaultdict(list)
    for (doc_id, _), k in zip(named, label):
        ids[k].append(doc_id)
    want = collections.Counter((d, min((x for x in ids[k] if x is not None), default=None)) for (d, _), k in zip(named, label))
    assert by_row(near_dedup.near_duplicates(docs), "class_id") == want
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in want if d is None or d == c}
    assert near_dedup.near_duplicates(none).count() == 0


def test_short_texts_keep_their_order(spark):
    texts = ["dog bites man", "man bites dog", "Dog bites MAN!", "a b", "b a", "a b c d", "a c b d"]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_signatures_are_unbiased():
    rng, gaps = np.random.default_rng(3), []
    for _ in range(60):
        h, a, b = rng.integers(0, 2**62, 80).astype(np.uint64), rng.integers(0, 6, 80), rng.integers(0, 6, 80)
        b = np.where(rng.random(80) < 0.6, a, b)
        flat = [np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])]
        sig = near_dedup.bag_minhash(*flat, np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2)
        gaps.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02


def test_star_of_copies_edited_apart(spark):
    base = prose(9, 150).split()
    texts = []
    for k in range(60):
        own, rng = list(base), random.Random(k)
        for i in rng.sample(range(150), 1 + k % 5):
            own[i] = f"e{k}x{i}"
        texts.append((k, " ".join(own)))
    bags = {k: collections.Counter(zip(*(t.split()[i:] for i in range(5)))) for k, t in texts}
    label = {k: k for k in bags}
    for _ in range(4):
        for a in bags:
            for b in bags:
                if 10 * (bags[a] & bags[b]).total() >= 8 * (bags[a] | bags[b]).total():
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == label


def test_secrets(spark, docs, none):
    head, body = (base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "someone"}))
    hidden = base64.b64encode(b"password = hunter2hunter2").decode()
    cases = {
        "x token=token:abcdefghijklmnop é": "", "say PassWord = 'abcdefghijkl' ok": "assign:4:28", "AKIA0123456789ABCD": "access:0:18",
        "é deadbeefdeadbeef": "hex:2:18", f"see {head}.{body}.sig": f"token:4:{4 + len(head) + len(body) + 5}", f"b {hidden} c": f"encoded:2:{2 + len(hidden)}",
    }
    got = secrets.secrets(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r["doc_id"]]: r["spans"] for r in got} == cases
    assert secrets.secrets(docs).count() == len(rows()) and secrets.secrets(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, rows()[0][1]), (2, "one two THREE"), (3, None), (4, ""), (None, prose(5, 20)), (5, "word")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = decontaminate.words_of
    want = collections.Counter()
    for r in rows():
        w, hit, found = words(r[1]), set(), set()
        for item, t in items:
            b = words(t)
            k = min(13, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add("null" if item is None else str(item))
        want[r[0], len(w), len(hit), ",".join(sorted(found))] += 1
    for size in (1 << 20, 400):
        got = decontaminate.contamination(docs, benchmark, block_bytes=size).select(
            "doc_id", "_found.n_words", "_found.n_hit", F.concat_ws(",", "_found.items").alias("items"))
        assert by_row(got, "n_words", "n_hit", "items") == want
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.where("text = 'word'").count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("_found.n_hit > 0").count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(1, prose(21, 40)), (2, "one two three"), (3, None)]
    texts = [prose(22, 700) + ". " + items[0][1] + "! " + prose(23, 700), prose(24, 600) + " one two three " + prose(25, 600),
             items[0][1], prose(26, 300), prose(26, 300), None, "", prose(27, 500) + " " + " ".join(items[0][1].split()[5:25])]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items


def test_decontamination_stage(spark, corpus):
    folder, docs, items = corpus
    want = {}
    for doc_id, text, *_ in docs:
        words, hit = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")), set()
        low = [w[0].lower() for w in words]
        for _, item in items:
            own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
            k = min(13, len(own))
            grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(low) - k + 1):
                if tuple(low[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
        if hit and 20 * len(hit) >= len(words):
            continue
        for end in sorted((i for i in hit if i + 1 not in hit), reverse=True):
            start = end
            while start - 1 in hit:
                start -= 1
            if end - start + 1 >= 13:
                text = text[: words[start].start()] + text[words[end].end() :]
        want[doc_id] = (text, len(text or ""))
    given = spark.read.parquet(f"{folder}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)["decontamination"](spark, given, folder)
    assert got.columns == given.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == want
    assert len(want[0][0]) < docs[0][4] and 2 not in want and want[1][0] == docs[1][1]


def test_stages(spark, corpus):
    folder, docs, _ = corpus
    stages, given = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stages["toxicity"](spark, given, folder)) == list(range(8))
    assert ids(stages["near_duplicates"](spark, given, folder)) == [0, 1, 2, 3, 5, 6, 7]
    taken = mixing.mix(given, levels(), WEIGHTS, corpus_pipeline.SHARE, seed=corpus_pipeline.SEED).where("copies > 0")
    assert ids(stages["mixing"](spark, given, folder)) == ids(taken)
    library = tokens.tokenizer(TOKENIZER).library
    want = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs}
    assert {r["doc_id"]: bytes(r["ids"]) for r in stages["token_ids"](spark, given, folder).collect()} == want


def test_tokens(spark, docs, none, tmp_path):
    library = tokens.tokenizer(TOKENIZER).library
    got = tokens.read_tokens(spark, tokens.write_tokens(docs, TOKENIZER, str(tmp_path / "t"), block_ids=300)).collect()
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    want = collections.Counter((r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert tokens.read_tokens(spark, tokens.write_tokens(none, TOKENIZER, str(tmp_path / "n"))).count() == 0


@pytest.mark.parametrize("ids", [[], [1], [2**32 - 1] * 70, [0] * 61, [0] * 60 + [2**20 - 1] * 3, list(range(200)), [2**31, 5, 2**19]])
def test_simple8b_round_trip(ids):
    words, escapes = tokens.pack(np.array(ids, np.uint32))
    assert tokens.unpack(words, escapes, len(ids)).tolist() == ids


def test_language(spark, docs, none):
    en, fr = "the house that was with them and their other things", "les maisons qui sont dans leur pays avec une autre"
    many = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(80)]
    more = [(100, f"{en} {en} {fr}", None), (101, None, None), (102, "12 34 !", None), (103, "", "en")]
    got = {r["doc_id"]: r for r in language.languages(spark.createDataFrame(many + more, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in many)
    assert got[100]["lang_pred"] == "en" and set(got[100]["languages"]) == {"en", "fr"} and 0.5 < got[100]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (101, 102, 103)] == ["und"] * 3
    assert language.languages(docs).count() == len(rows()) and language.languages(none).count() == 0


def test_toxicity(spark, docs, none):
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append((i, f"{prose(i, 12)} {'women are vile' if bad else 'people are here'} {prose(i + 999, 5)}"))
        labels.append((i, int(bad)))
    texts += [(1000, "women are here"), (1001, None), (1002, "")]
    d, l = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, l).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert len(held) > 30 and all(got[i]["predicted"] == (i % 3 == 0) for i in held)
    assert got[1001]["score"] == got[1002]["score"]
    plain = toxicity.score(d, toxicity.fit(d, l, balance=0.0)).where("doc_id = 1000").first()["score"]
    fair = toxicity.score(d, toxicity.fit(d, l, balance=1.0)).where("doc_id = 1000").first()["score"]
    assert fair < plain
    assert toxicity.toxicity(docs, l).count() == len(rows()) and toxicity.toxicity(none, l.limit(0)).count() == 0


def test_rare_words_of_a_minority_language(spark):
    """No toxic word is in 0.2 % of the sample, the share that a word once needed."""
    texts, labels, tails = [], [], ("e", "es", "o")
    for i in range(8000):
        bad = i % 200 == 7
        mark = "boquement" + tails[i // 200 % 3] if bad else WORDS[i % 18]
        texts.append((i, f"{prose(i, 10)} {mark} {prose(i + 9999, 5)}"))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, l).where("held_out").collect()
    bad = [r for r in got if r["doc_id"] % 200 == 7]
    assert len(bad) >= 3 and all(r["predicted"] for r in bad)
    assert sum(r["predicted"] for r in got) == len(bad)


def test_budget_shares():
    assert mixing.shares(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.shares(10, [1, 1, 1], [100, 100, 100]) == [4, 3, 3]
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}
    # The sibling y takes what x lacks before b does.
    assert mixing.budgets(leaves, 100, {}, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets(leaves, 400, {}, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 290}


def test_mixing(docs, none):
    got = mixing.mix(docs, levels(), WEIGHTS, 0.7, max_epochs=3, seed=1).collect()
    assert len(got) == len(rows())
    taken, leaf = collections.Counter(), {}
    for r in got:
        k = (r["domain"], r["lang"], r["source"])
        leaf[k] = r["budget"]
        taken[k] += r["copies"] * r["n_tokens"]
        assert r["copies"] <= 3
    assert all(taken[k] <= b for k, b in leaf.items())
    assert mixing.mix(none, levels(), WEIGHTS, 0.7).count() == 0


def test_mix_fills_its_budget(spark):
    """A long document early in an order neither loses its leaf's share nor leaves tokens that any next document could use."""
    docs = [(i, "w " * (900 if i % 60 == 3 else 5 + i % 9), "en" if i % 2 else "de", f"s{i % 6}") for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    for share, most in ((0.2, 1), (0.3, 1), (0.3, 4)):
        got = mixing.mix(d, levels(), {}, share, max_epochs=most, seed=2).collect()
        amount = int(share * sum(r["n_tokens"] for r in got))
        taken, budget = collections.Counter(), {}
        for r in got:
            budget[r["domain"], r["lang"], r["source"]] = r["budget"]
            taken[r["domain"], r["lang"], r["source"]] += r["copies"] * r["n_tokens"]
        assert taken == budget and max(r["copies"] for r in got) <= most
        assert amount - 13 < sum(taken.values()) <= amount


def test_granted():
    left = {("a", "x"): 9, ("a", "y"): 1, ("b", "z"): 5}
    # The family serves x; what y would need comes from b only if it is enough.
    assert mixing.granted(left, {("a", "x"): 10, ("a", "y"): 8, ("b", "z"): 7}) == ({("a", "x")}, 5)
    assert mixing.granted(left, {("a", "x"): 10, ("a", "y"): 5, ("b", "z"): 7}) == ({("a", "x"), ("a", "y")}, 0)


def test_shards(docs, none):
    got = sharding.shards(docs, n_shards=4).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(4))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shards(none).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (2, 1)])
def test_hilbert_neighbours(spark, n, bits):
    cells = [F.floor(F.col("id") / (1 << bits * k)).cast("int") % (1 << bits) for k in range(n)]
    found = spark.range(1 << n * bits).select(sharding.hilbert_index(cells, bits).alias("h"), *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    points = sorted(tuple(r) for r in found.collect())
    assert [p[0] for p in points] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(points, points[1:]))


def test_fingerprints(spark, none):
    named = [(i, r[1]) for i, r in enumerate(rows())]
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(spark.createDataFrame(named, "doc_id long, text string")).collect()}
    for i, t in named:
        t, follow = t or "", named[i - 1][1] or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + follow[:k]
        a, b, c = fingerprints.fingerprints([t, changed, follow])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.as_text(a), fingerprints.as_text(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    a, b = fingerprints.fingerprints([prose(7, 900), "inserted words " + prose(7, 900)])
    assert fingerprints.likeness(a, b) > 0.95
    assert fingerprints.edit_likeness(none).count() == 0
