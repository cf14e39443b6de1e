"""Spelling variants against plain counting and a search by deletion of letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import odd
from conftest import SF_SMALL
from lorewell.llm import spelling
from lorewell.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near_pairs(words):
    """Pairs one edit apart: both words, or one and a deletion of the other, or equal deletions at one place."""
    found, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)) if len(w) < 1000 else ():
            short = w[:k] + w[k + 1 :]
            gaps[(k, short)].add(w)
            if short in words:
                found[w].add(short)
                found[short].add(w)
    for group in gaps.values():
        for w in group:
            found[w] |= group - {w}
    return found


def expected(rows):
    n = counted(rows)
    found = near_pairs(n)
    form = {}
    for w in n:
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None)
    return out


def by_word(frame):
    rows = frame.collect()
    got = {r.word: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, documents=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 11))) for _ in range(60)] + ["information", "Ünïcödé÷×ÿ", "aaaaaaaaaa", "abababab"]
    rows = []
    for i in range(documents):
        words = []
        for _ in range(120):
            w = base[int(len(base) * rnd.random() ** 4)]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcé") + w[k:], w[:k] + rnd.choice("abcé") + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((i, rnd.choice([" ", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("limit", [spelling.SHARD_CHARS, 300, 30])
def test_against_counting(spark, limit):
    """Small limits refine groups several times."""
    rows = corpus(limit)
    assert by_word(spelling.variants(spark.createDataFrame(rows, DOCS), limit=limit)) == expected(rows)


def test_groups_are_refined_to_their_limit(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(7, 9))) for _ in range(3000)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    size = lambda limit: spelling._keyed(spelling.dealt(table, limit)).groupBy("key").agg(F.sum(F.length("word") + 1).alias("s"), F.max(F.expr("b - a")).alias("open")).where("s > 200 and open > 1").count()
    assert size(10**6) > 50 and size(200) == 0


def test_query_against_counting_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = by_word(QUERIES["op11_spelling_variants"](spark, SF_SMALL))
    assert got == expected(rows) and any(r[0] for r in got.values())


def test_odd_rows(spark):
    rows = odd.pairs()
    assert by_word(spelling.variants(odd.documents(spark))) == expected(rows)
    assert spelling.variants(odd.documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_search_finds_each_near_word_once(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(3, 6))).encode() for _ in range(rnd.randint(1, 60))})
    index = spelling.FmIndex(words)
    found = near_pairs([w.decode() for w in words])
    for m in {len(w) for w in words}:
        own = [i for i, w in enumerate(words) if len(w) == m]
        letters = index.code[index.begin[own][:, None] + np.arange(m)]
        row, near = spelling.search(index, letters, 0, m)
        pairs = [(own[r], int(w)) for r, w in zip(row, near)]
        assert len(pairs) == len(set(pairs))
        assert {(words[a].decode(), words[b].decode()) for a, b in pairs} == {(words[i].decode(), x) for i in own for x in found[words[i].decode()]}
