"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lorewell.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, score double, list int, chunk int"


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            scored = sorted((-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def check(spark, docs, least):
    got = {}
    for r in multi_index.nearest(docs, docs.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(r.vec_id, r.embedding) for r in docs.select("vec_id", "embedding").distinct().collect()])
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1)) and q not in [r[1] for r in rows]
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hits += len({r[1] for r in rows} & {j for j, _ in want[q]})
    assert hits >= least * sum(map(len, want.values()))
    return got, want


def test_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    check(spark, docs, 0.9)


def test_many_equal_vectors(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [0.5, -0.25, 0.125, 1.0] if i % 3 else rnd.normal(size=4).tolist(), 0, 0.0, 1, 1) for i in range(400)]
    got, want = check(spark, spark.createDataFrame(rows, SCHEMA), 0.9)
    assert [r[1] for r in got[50]] == [j for j, _ in want[50]]  # ties by id


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0, 0.0, 1, 1), (1, [1.0, 1.0], 0, 0.0, 1, 1), (1, [1.0, 1.0], 0, 0.0, 1, 1), (2, None, 0, 0.0, 1, 1), (3, [], 0, 0.0, 1, 1), (4, [0.0, 0.0], 0, 0.0, 1, 1), (5, [nan, 1.0], 0, 0.0, 1, 1),
            (6, [inf, 1.0], 0, 0.0, 1, 1), (7, [None, 1.0], 0, 0.0, 1, 1), (8, [1.0, 2.0, 3.0], 0, 0.0, 1, 1), (None, [1.0, 0.5], 0, 0.0, 1, 1), (50, [1e-30, 1e-30], 0, 0.0, 1, 1), (100, None, 0, 0.0, 1, 1), (9, [3e38, 0.0], 0, 0.0, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r["rank"]): r.vec_id for r in multi_index.nearest(docs, docs.where("vec_id % 50 = 0")).collect()}
    want = brute([(r[0], r[1]) for r in docs.distinct().select("vec_id", "embedding").collect() if len(r[1] or ()) == 2])
    assert got == {(q, rank): j for q, rows in want.items() for rank, (j, _) in enumerate(rows, 1)} and len(got) == 6
    assert multi_index.nearest(docs.limit(0), docs.limit(0)).count() == 0
    alone = docs.where("vec_id = 0")
    assert multi_index.nearest(alone, alone).count() == 0


def test_squares_out_of_range(spark):
    rows = [(50, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 2.0]), (3, [1e-200, -1e-200])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in multi_index.nearest(docs, docs.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(2, round(3 / 10**0.5, 12)), (1, round(0.5**0.5, 12)), (3, 0.0)]


def test_walk_is_in_order_of_distance():
    rnd = np.random.default_rng(3)
    sample = rnd.normal(size=(500, 6))
    index = multi_index.fit(sample, 5, 0.95, 8)
    index.population = np.ones((8, 8), np.int64)
    unit = multi_index.unit_rows(sample)[0]
    far = ((index.first - unit[:3]) ** 2).sum(1)[:, None] + ((index.second - unit[3:]) ** 2).sum(1)[None, :]
    for wanted in (1, 7, 30, 64):
        chosen = {(i, j) for i, bits in enumerate(index.walk(unit, wanted)) for j in range(8) if bits >> j & 1}
        assert chosen == {divmod(int(c), 8) for c in np.argsort(far.ravel(), kind="stable")[:wanted]}
