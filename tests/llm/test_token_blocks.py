"""Token pieces whose hashes collide, and documents decoded alone."""

import numpy as np
import pytest
import tokenizers

from chainframe.llm import tokens
from chainframe.llm.queries import TOKENIZER


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER)


def same(own, library, texts):
    for text, got in zip(texts, own.encode(texts)):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_equal_hash(library):
    """A Thue-Morse word and its complement have one polynomial hash under every odd base modulo 2**64."""
    one, two = thue_morse(1024), thue_morse(1024, 1)
    data = np.frombuffer((one + two).encode(), np.uint8)
    keys = tokens.WordTokenizer.hashed(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert keys[0] == keys[1]
    own = tokens.WordTokenizer(TOKENIZER)
    same(own, library, [one, two, two + " " + one])
    for text in (two, one, f"{one} x {two}"):
        same(own, library, [text])


def test_all_hashes_collide(library, monkeypatch):
    monkeypatch.setattr(tokens.WordTokenizer, "hashed", staticmethod(lambda data, starts, ends: np.uint64(7) * (1 + (ends - starts).astype(np.uint64) % np.uint64(2))))
    own = tokens.WordTokenizer(TOKENIZER)
    same(own, library, ["Some words, some other words; can't 42 words.", "", "other words some", "Ünder größe"])


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", 3)
    monkeypatch.setattr(tokens, "SLOTS", 4)
    own = tokens.WordTokenizer(TOKENIZER)
    for _ in range(3):
        same(own, library, ["Every step starts anew and every slot is taken", "so pieces meet in slots"])


def test_a_document_is_decoded_alone():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 90, 60)
    ids = rng.integers(0, 50, counts.sum()).astype(np.uint32)
    wide = rng.random(len(ids)) < 0.2
    ids[wide] = rng.integers(0, 1 << 31, wide.sum())
    payload = tokens.encode_block(list(range(60)), counts, ids)
    at = np.cumsum(counts) - counts
    assert tokens.decode_block(payload)[2].tolist() == ids.tolist()
    for k in range(60):
        assert tokens.decode_document(payload, k).tolist() == ids[at[k] : at[k] + counts[k]].tolist()
