"""Token counts and the word BPE against the installed libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import odd
from lorewell.llm import bpe_codec, token_counts
from lorewell.llm.merges import Cache, merge_symbols

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "　", "a", "B", "é", "é", "Σ", "ς", "İ", "ß", "中", "文", "1", "٣", "²", "'s", "'LL",
         "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<s>", "</s>", "<0x0A>", "▁", "\U0001f600", "\x00", "\x1c", "﻿", "the", "ing", "ǅ", "_", "-", "ก็", "ª"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)


def texts(n=3000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_counts_equal_library(library):
    model, cache = token_counts.worker_cache(PIECE)
    for text in texts():
        assert model.count(text, cache) == len(library[0].encode(text)), repr(text)


def test_alone_strings_are_proved(library):
    model, _ = token_counts.worker_cache(PIECE)
    assert len(model.alone) > 30_000
    for piece in sorted(model.alone)[::500]:
        assert model.merged(piece) == 1


def test_codec_equals_library(library):
    codec = bpe_codec.load(WORD)
    for text in texts():
        ids = library[1].encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids, repr(text)
        assert codec.decode(ids) == library[1].decode(ids, skip_special_tokens=False)


def test_merge_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 5, ("x", "x"): 2}
    look = lambda a, b: ranks.get((a, b))
    assert merge_symbols(list("abc"), look) == ["abc"]
    assert merge_symbols(list("xxxxx"), look) == ["xx", "xx", "x"]
    assert merge_symbols([], look) == [] and merge_symbols(["a"], look) == ["a"]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("lorewell.llm.merges.CACHE_ENTRIES", 3)
    cache = Cache(len, {"z": 1})
    assert [cache["a" * n] for n in range(1, 9)] == list(range(1, 9))
    assert len(cache) <= 5 and cache["z"] == 1


def test_operators_on_odd_rows(spark, library):
    docs = odd.documents(spark)
    want = sorted((str(i), len((t or "").encode()), len(library[0].encode(t or ""))) for i, t in odd.pairs())
    got = token_counts.token_counts(docs, PIECE, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    expected = []
    for i, t in odd.pairs():
        ids = library[1].encode(t or "", add_special_tokens=False).ids
        decoded = library[1].decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe_codec.round_trip(docs, WORD).collect()) == sorted(expected)
    encoded = {r.doc_id: r.ids for r in bpe_codec.encode(docs, WORD).where("doc_id = 1").collect()}
    assert encoded[1] == library[1].encode(dict(odd.pairs()[:1])[1], add_special_tokens=False).ids


def test_empty_tables(spark):
    empty = odd.documents(spark).limit(0)
    assert token_counts.token_counts(empty, PIECE).count() == 0
    assert bpe_codec.round_trip(empty, WORD).count() == 0


def test_scanned_merges_equal_the_heap(monkeypatch):
    codec, rnd = bpe_codec.load(WORD), random.Random(12)
    letters = "abcdeinorst" * 4 + "xyzäéßøłı'9-"
    words = {"".join(rnd.choices(letters, k=rnd.randint(1, 30))) for _ in range(3000)} | {"aaaaaaaaaaaa", "lowering", "ſ", "\U0001f600"}
    few = [codec._merged(w) for w in words]
    monkeypatch.setattr(bpe_codec, "SHORT", 0)
    assert few == [codec._merged(w) for w in words]


def test_short_ids_equal_the_long_ones_with_a_full_memo(monkeypatch):
    codec = bpe_codec.load(WORD)
    monkeypatch.setattr(codec.short, "entries", 3)
    codec.short.clear()
    texts = ["", " \t", "İstanbul ȺBC ΑΣ e\u0301 <|endoftext|>x<|startoftext|>", "One two three four five one two", "naïve ÉCOLE \u1e9e \ua7cb don't 12"]
    for text in texts * 2:
        assert codec.encode_short(text) == codec.encode(text).astype("<u2").tobytes()
        assert len(codec.short) <= 3
