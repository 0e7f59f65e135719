"""Byte-level BPE over a shared trie (operator 12) against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopsight.llm import byte_codec
from tests.llm.helpers import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return byte_codec.Codec(PATH)


def ids_of(codec, text):
    return [i for part in codec.encode(text) for word in part for i in word[0]]


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "=", "-", "é", "日", "🙂", "1", "23", "'s", "'", "<|endoftext|>", "　",
             "\U0003d000", "՘", "aaaa", "Ġ", "x" * 70, " " * 130, "\x00", "\x7f", "ſ", "²", "́"]
    points = [(32, 127), (0x80, 0x800), (0x800, 0xD800), (0x10000, 0x110000)]
    for _ in range(n):
        yield "".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.randrange(*rng.choice(points)))
                      for _ in range(rng.randrange(30)))


def test_every_code_point_is_split_as_the_library_does(codec, library):
    for lo in range(0, 0x110000, 8192):
        s = "".join(f"\na{c}a1{c}1!{c}!\n" for c in map(chr, range(lo, lo + 8192)) if not "\ud800" <= c <= "\udfff")
        found = [w for part in codec.words(s) for w in part]
        assert found == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(lo)


def test_odd_texts_equal_the_library(codec, library):
    for s in odd_texts(1, 3000):
        ids = ids_of(codec, s)
        assert ids == library.encode(s, add_special_tokens=False).ids, repr(s)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_equal_the_library(codec, library):
    rng = random.Random(2)
    for s in ["a" * 3000, "ab" * 999 + "c", "=" * 5000, " " * 3000 + "x", "\n" * 777,
              "".join(rng.choice("etaoinshrdlu") for _ in range(20000)),
              "".join(rng.choice("日本語テキスト") for _ in range(3000))]:
        assert ids_of(codec, s) == library.encode(s, add_special_tokens=False).ids, s[:20]


def test_every_token_and_random_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(codec.size) for _ in range(rng.randrange(1, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([codec.size + 5, -1]) == ""


def test_shared_prefixes_are_walked_once(codec, monkeypatch):
    words = sorted(f"prefix{i:04d}".encode() for i in range(1000))
    steps = []
    real = byte_codec.array

    class Counting(real):
        def append(self, v):
            steps.append(v)
            super().append(v)

    monkeypatch.setattr(byte_codec, "array", Counting)
    list(codec._trie(words))
    nodes = len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert len(steps) == 2 * nodes                       # a state and a beginning a node


def test_slices_are_cut_where_the_pattern_cuts(codec, library, monkeypatch):
    text = " ".join(odd_texts(4, 300))
    want = library.encode(text, add_special_tokens=False).ids
    for size in (7, 50, 333):
        monkeypatch.setattr(byte_codec, "SLICE", size)
        assert ids_of(codec, text) == want


def test_kept_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_codec, "WORDS", 50)
    small = byte_codec.Codec(PATH)
    for s in odd_texts(5, 300):
        assert ids_of(small, s) == library.encode(s, add_special_tokens=False).ids


def test_documents(spark, library):
    rows = corpus() + [(500, "x <|endoftext|> y<|endoftext|>", "s"), (501, "word " * 600_000, "s"),
                       (501, "repeated id", "s")]
    docs = frame(spark, rows)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    found = byte_codec.digests(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    back = byte_codec.decode(byte_codec.encode(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert byte_codec.digests(docs.limit(0), PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        byte_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
