"""The backoff automaton against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import odd
from lorewell.llm import backoff
from lorewell.llm.queries import QUERIES
from conftest import SF_SMALL

DOCS = "doc_id long, text string"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(backoff, "BUCKET_BYTES", 9000)


def tokens(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def learned(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def counts(rows, order):
    grams, history = Counter(), Counter()
    for i, text in rows:
        if learned(i):
            t = ["<s>", *tokens(text)]
            for k in range(1, order + 1):
                for a in range(1 if k == 1 else 0, len(t) - k + 1):
                    grams[tuple(t[a : a + k])] += 1
                    history[tuple(t[a : a + k - 1])] += 1
    return grams, history, sum(1 for g in grams if len(g) == 1)


def log_p(word, before, model, order, pseudo):
    """log10 P(word | last order - 1 of ``before``), written as its definition."""
    grams, history, v = model
    n = history[()]
    p = (grams[(word,)] + 0.5) / (n + 0.5 * (v + 1))
    for k in range(1, min(order, len(before) + 1)):
        h = tuple(before[-k:])
        if history[h]:
            p = (grams[(*h, word)] + pseudo * p) / (history[h] + pseudo)
    return math.log10(p)


def want(rows, order, pseudo):
    model = counts(rows, order)
    grams, history, v = model
    n = history[()]
    out = []
    for i, text in rows:
        t = ["<s>", *tokens(text)]
        base = sum(math.log10((grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in t[1:])
        score = sum(log_p(t[a], t[:a], model, order, pseudo) for a in range(1, len(t)))
        out.append((i, not learned(i), len(t) - 1, sum(grams[(w,)] > 0 for w in t[1:]), n, base, score))
    return out


def close(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain_counting(spark, small_blocks, order):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice(["the", "The", "a", "cat", "dog", "ran", "é", "far\x0baway"]) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    rows += [(200 + i, odd.words(i, 30)) for i in range(20)]
    close(backoff.score(spark.createDataFrame(rows, DOCS), order=order, pseudo=7.0).collect(), want(rows, order, 7.0))


def test_odd_rows(spark):
    rows = odd.pairs()
    got = backoff.score(odd.documents(spark)).collect()
    close(got, want(rows, backoff.ORDER, backoff.PSEUDO))
    empty = odd.documents(spark).limit(0)
    assert backoff.score(empty).count() == 0
    lone = spark.createDataFrame([(i, "never learned") for i in range(300) if not learned(i)], DOCS)
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in backoff.score(lone).collect()} == {(0, 0, 0.0, 0.0)}


def test_query_against_plain_counting_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op13_backoff_automaton"](spark, SF_SMALL).collect()
    close(got, want(rows, backoff.ORDER, backoff.PSEUDO))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)  # histories help on texts that were not learned


def test_probabilities_of_a_history_add_up():
    model = counts([(0, "a b a c"), (2, "a b b"), (3, "c a b a")], 3)
    words = [g[0] for g in model[0] if len(g) == 1]
    for before in (["<s>"], ["<s>", "a"], ["a", "b"], ["zzz", "b"], ["b", "zzz"]):
        seen = sum(10 ** log_p(w, before, model, 3, 2.0) for w in words)
        assert abs(seen + 10 ** log_p("never", before, model, 3, 2.0) - 1) < 1e-12


def test_cut_texts_are_walked_as_whole_ones():
    text = [odd.words(5, 900).encode(), b"", b"one"]
    own = backoff.grams(text, np.array([True, True, False]), 3)
    machine = backoff.automaton(own, own.trained, 3, int(own.length[:2].sum()), 500, 20.0)
    whole = backoff.traverse(machine, own, 3, segment=10_000)
    for segment in (3, 7, 64):
        assert np.allclose(backoff.traverse(machine, own, 3, segment=segment), whole)


def test_hashes_do_not_depend_on_slices(monkeypatch):
    texts = [odd.words(1, 500).encode(), b"  A b\n", b"", b"x" * 5000 + b" y"]
    whole = backoff.word_hashes(texts)
    monkeypatch.setattr(backoff, "SLICE_BYTES", 64)
    parts = backoff.word_hashes(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].tolist() == [500, 2, 0, 2]


def test_packed_numbers_come_back():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 999, dtype=np.uint64))
    for v in (values, values[:1], np.array([2**63 + 5, 2**64 - 1], np.uint64)):
        assert (backoff.unpack_sorted(*backoff.pack_sorted(v)) == v).all()
    for c in ([0], [255, 0, 1], [70_000, 1], [2**40, 3]):
        assert backoff.unpack_counts(backoff.pack_counts(np.array(c))).tolist() == c
