"""Texts that only weak hashes take as equal, benchmarks of several blocks, and bounds of Arrow batches."""

import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from chainframe.llm import common, decontaminate, near_dedup


def twins(bits=10):
    """A Thue-Morse word and its complement: equal under every odd base modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_two_moduli_tell_words_apart():
    data = np.frombuffer("".join(twins()).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    weak = common.span_hashes(common.prefix_hashes(data), starts, ends)
    assert weak[0] == weak[1]
    one, two = common.sound_hashes(data, starts, ends)
    assert one != two
    again = common.sound_hashes(np.concatenate([data[5:9], data]), starts + 4, ends + 4)
    assert again.tolist() == [one, two]


@given(st.lists(st.text("aB1 .é", max_size=12), min_size=1, max_size=6))
def test_spelled_rows(texts):
    raw = [t.encode() for t in texts]
    low = common.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.cumsum([0, *map(len, raw)])
    starts, ends, first = common.word_spans(low, offsets)
    own, bounds = near_dedup._spelled(low, starts, ends, first, offsets)
    want = [b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", r.lower())) for r in raw]
    assert [own[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] == want


def test_different_documents_of_equal_weak_hashes_stay(spark):
    one, two = twins()
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{one} is a long word of two letters"), (5, f"{two} is a long word of two letters")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicate(docs).collect()) == [1, 2, 4, 5]


def test_blocks_of_items_cut_alike(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(12)]
    filler = " ".join(f"plain{k}" for k in range(900))
    rows = [(i, f"{filler} {items[i][1]}. {filler}" if i % 3 else items[i][1], "x") for i in range(12)] + [(20, filler, None), (21, None, None), (22, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: t if i > 12 else f"{filler} . {filler}" for i, t, _ in rows if i > 12 or i % 3}
    for size in (1 << 20, 500):
        clean = decontaminate.decontaminate(docs, benchmark, block_bytes=size)
        assert clean.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in clean.collect()} == want


def test_batches_are_bounded(spark, tmp_path):
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, str(tmp_path), "documents")
    for name, most in common.BATCH.items():
        assert 0 < int(spark.conf.get(f"spark.sql.execution.arrow.{name}")) <= most
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "4096")
    common.bounded_batches(spark)
    assert spark.conf.get(name) == "4096"
    spark.conf.set(name, str(common.BATCH["maxBytesPerBatch"]))
    texts = [(i, "é" * 40_000) for i in range(200)]
    sizes = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).mapInArrow(
        lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long").count()
    assert sizes > 2
