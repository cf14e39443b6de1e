"""Leaks against a search of every passage for every item."""

import random

import numpy as np
import odd
from conftest import SF_SMALL
from lorewell.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, source string, item_id int, begin int", "item_id long, text string, doc_id long"


def brute(docs, items):
    found = set()
    for i, text in docs:
        words = decontaminate.words_of((text or "").encode())
        for j, item in items:
            own, answer = decontaminate.words_of((item or "").encode()), decontaminate.answer_words((item or "").encode())
            if own and decontaminate.leaks(own, answer, words):
                found.add((i, j))
    return found


def test_planted_copies_and_paraphrases(spark):
    rnd = random.Random(5)
    items = [(j, odd.words(500 + j, rnd.randint(12, 40)) + ". " + odd.words(700 + j, rnd.randint(4, 9)) + ".") for j in range(40)]
    docs, planted = [], set()
    for i in range(160):
        words = odd.words(i, rnd.randint(30, 200)).split()
        if i % 4 < 2:
            j = rnd.randrange(40)
            leak = items[j][1].split()
            if i % 4 == 1:  # a paraphrase: one word in six replaced, some added
                for k in range(0, len(leak), 6):
                    leak[k] = odd.words(9000 + i * 50 + k, 1)
                leak.insert(len(leak) // 2, "indeed")
            at = rnd.randrange(len(words))
            words[at:at] = leak
            planted.add((i, j))
        docs.append((i, " ".join(words), "s", 1, 2))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()}
    assert got == planted == brute([d[:2] for d in docs], items)


def test_documents(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    exact = set()
    for r in docs.collect():
        text = b" " + b" ".join(decontaminate.words_of((r.text or "").encode())) + b" "
        exact |= {(r.doc_id, i.item_id) for i in items.collect() if b" " + b" ".join(decontaminate.words_of(i.text.encode())) + b" " in text}
    assert exact and exact <= got


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    items = [(j, odd.words(500 + j, 20)) for j in range(16)]
    docs = [(i, odd.words(i, 40) + " " + items[i][1], "s", 1, 2) for i in range(16)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()}
    assert got == {(i, i) for i in range(16)}


def test_odd_rows(spark):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, odd.words(1, 120)[:150], 5), (1, odd.words(1, 120)[:150], 5), (2, None, 5), (3, " .\n", 5), (None, odd.words(2, 20), 5), (4, odd.words(2, 30), 5), (5, "one", 5)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (10, 4)} | {p for p in got if p[0] in (13, 14, 15)}
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_leak_in_a_third_of_all_rows(spark):
    items = [(j, odd.words(500 + j, 16)) for j in range(6)]
    copied = odd.words(40, 90) + " " + items[0][1] + " " + odd.words(41, 90)
    docs = [(i, copied if i % 3 == 0 else odd.words(1000 + i, 150), "s", 1, 2) for i in range(300)]
    # the next item leaks in as many different documents, at other places
    docs += [(300 + i, " ".join([odd.words(2000 + i, 20 + i % 60), items[1][1], odd.words(3000 + i, 60)]), "s", 1, 2) for i in range(150)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()}
    assert got == {(i, 0) for i in range(0, 300, 3)} | {(300 + i, 1) for i in range(150)}


def test_short_verbatim_items_of_everyday_words(spark):
    everyday = odd.words(77, 12).split()
    items = [(0, " ".join(everyday[:6])), (1, " ".join(everyday[6:11]))]
    rnd = random.Random(3)
    docs = []
    for i in range(400):
        words = [odd.words(5000 + 40 * i + k, 2).replace(" ", "") for k in range(24)]
        for w in everyday:
            if rnd.random() < 0.3:
                words.insert(rnd.randrange(len(words)), w)
        if i % 8 == 0:
            words[12:12] = items[i // 8 % 2][1].split()
        docs.append((i, " ".join(words), "s", 1, 2))
    frame = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect()}
    assert got == brute([d[:2] for d in docs], items) >= {(i, i // 8 % 2) for i in range(0, 400, 8)}
    # counts of a corpus 32 times as large give the same weights, also to words outside the benchmark
    block = next(decontaminate._blocks(spark.createDataFrame([(*i, 1) for i in items], ITEMS)))
    rows = decontaminate._passages(frame.selectExpr("doc_id", "cast(text AS binary) AS text"), block)
    decontaminate._weigh(rows, block)
    weight, unknown = block.weight, block.unknown
    for _ in range(5):
        rows = rows.unionAll(rows)
    decontaminate._weigh(rows, block)
    assert abs(block.unknown - unknown) < 1e-9 and abs(block.weight - weight).max() < 1e-9


def fitted(spark, items, frame):
    block = next(decontaminate._blocks(spark.createDataFrame([(*i, 1) for i in items], ITEMS)))
    decontaminate._fit(frame.selectExpr("doc_id", "cast(text AS binary) AS text"), block)
    return block


def test_passages_are_multiplied_as_pairs_of_words(spark, monkeypatch):
    items = [(j, odd.words(500 + j, 20)) for j in range(8)]
    frame = spark.createDataFrame([(i, " ".join([odd.words(i % 50, 90), items[i % 8][1][: i % 70], items[i % 5][1]]), "s", 1, 2) for i in range(200)], DOCS)
    block = next(decontaminate._blocks(spark.createDataFrame([(*i, 1) for i in items], ITEMS)))
    rows = decontaminate._passages(frame.selectExpr("doc_id", "cast(text AS binary) AS text"), block)
    decontaminate._weigh(rows, block)
    a = np.zeros((rows.count(), len(block.vocabulary)))
    for i, r in enumerate(rows.collect()):
        assert r.terms == sorted(r.terms)
        terms, counts = np.unique(np.array(r.terms, int), return_counts=True)
        a[i, terms] = np.log1p(counts) * block.weight[terms]
    basis = np.random.default_rng(3).standard_normal((a.shape[1], 12))
    pairs = []
    add = decontaminate._Pairs.add
    monkeypatch.setattr(decontaminate._Pairs, "add", lambda self, *args: pairs.append(len(args[0])) or add(self, *args))
    one = decontaminate._Pairs(a.shape[1])
    column = rows.toArrow().column(0).combine_chunks()
    passage, terms, counts = decontaminate._counts(column)
    one.add(terms, np.log1p(counts) * block.weight[terms], np.bincount(passage, minlength=len(column)))
    assert pairs and np.allclose(one.times(basis.astype(np.float32)), a.T @ (a @ basis), rtol=1e-4, atol=1e-3)
    for most in (4096, 0):
        monkeypatch.setattr(decontaminate, "GRAM", most)
        assert np.allclose(decontaminate._times_itself(rows, block, basis), a.T @ (a @ basis), rtol=1e-4, atol=1e-3)


def test_groups_of_documents_are_searched_as_each_alone(spark, monkeypatch):
    rnd = random.Random(8)
    items = [(j, odd.words(500 + j, n)) for j, n in enumerate((1, 5, 16, 17, 40, 70))]
    common = " ".join(i[1] for i in items).split()
    docs = []
    for i in range(60):
        words = [rnd.choice(common) if rnd.random() < 0.5 else odd.words(9000 + k + 100 * i, 1) for k in range(rnd.choice((3, 16, 33, 150, 900)))]
        at = rnd.randrange(len(words))
        leak = items[i % 6][1].split()
        words[at:at] = leak if i % 3 else leak[: len(leak) * 2 // 3]
        docs.append((i, " ".join(words), "s", 1, 2))
    block = fitted(spark, items, spark.createDataFrame(docs, DOCS))
    pull = (block.space * block.weight[:, None]) @ (block.items / block.norms[:, None]).T
    search = decontaminate.Search(block, pull.astype(np.float32))
    group = [(i, *block.terms(text.encode())) for i, text, *_ in docs]
    places = {}
    leak = decontaminate._leak
    monkeypatch.setattr(decontaminate, "_leak", lambda b, i, p, d: places.update({(d[0], i): p}) or leak(b, i, p, d))
    together = sorted(search.hits(group))
    want = {}
    for doc, words, terms in group:
        for j, item in enumerate(block.words):
            held = set()
            length = -(-(len(item) - 1) // decontaminate.STRIDE) + 1
            for s in range(0, len(words), 16):
                found = set(words[s : s + 16 * length])
                if 10 * sum(w in found for w in item) >= 6 * len(item):
                    held |= {s + 16 * k for k in range(max(length - 1, 1))}
            for s in range(0, len(words), 16):
                own = terms[s : s + 32]
                if (own < 0).all():
                    continue
                mass = (block.weight[own[own >= 0]] ** 2).sum()
                norm = np.sqrt(mass + block.unknown**2 * (own < 0).sum())
                cosine = pull[own[own >= 0], j].sum() / norm
                if s in held or (cosine >= 0.3 and mass >= (0.3 * norm) ** 2):
                    want.setdefault((doc, j), []).append((s, cosine))
    assert want and {k: [s for s, _ in p] for k, p in places.items()} == {k: [s for s, _ in p] for k, p in want.items()}
    assert all(abs(x[1] - y[1]) < 1e-4 for k in want for x, y in zip(want[k], places[k]))
    assert {(i, i % 6) for i in range(60) if i % 3} <= {(h[0], h[1]) for h in together}
    for rows, piece in ((1, 32), (1 << 12, 2)):  # how much is counted at once changes nothing
        monkeypatch.setattr(decontaminate, "ROWS", rows)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert sorted(h for d in group for h in search.hits([d])) == together


def test_common_subsequence():
    assert decontaminate.common_subsequence([b"a", b"b", b"c", b"b"], [b"b", b"x", b"c", b"a", b"b"]) == 3
    assert decontaminate.common_subsequence([b"a"], []) == 0
    assert decontaminate.answer_words(b"What is it? It is red.") == [b"it", b"is", b"red"]
