"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
import odd
from conftest import SF_SMALL
from lorewell.llm import components, near_duplicates


def groups(spark, docs, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, percent).collect()}


def loose_copies(n, words=90, edits=(0, 6), seed=4):
    rnd = random.Random(seed)
    base = odd.words(seed, words).split()
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randint(*edits)):
            copy[rnd.randrange(words)] = odd.words(rnd.randrange(10**6), 1)
        out.append((i * 3 + 1, " ".join(copy)))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_small_tables(spark, percent):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert groups(spark, docs, percent) == brute.near_groups([(r.doc_id, r.text) for r in docs.collect()], percent)


def test_crowded_group_of_loose_copies(spark):
    rows = loose_copies(120) + [(1000 + i, odd.words(50 + i, 40)) for i in range(30)]
    got = groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert got == brute.near_groups(rows, 85)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = near_duplicates.near_duplicates(docs, 85).collect()
    assert len(out) == len(odd.rows())
    want = brute.near_groups([p for p in odd.pairs() if p[0] is not None], 85)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(2)
    one, two = rnd.integers(0, 2**63, (2, 400)).astype(np.uint64)
    both = np.unique(np.concatenate([one, two]))
    a, b, c = near_duplicates.registers([np.unique(one), np.unique(two), both])
    assert (near_duplicates.merge_registers(a, b) == c).all()
    shared = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    keep = {}
    for similarity in (0.5, 0.84, 0.86, 0.95):
        own = int(1000 * (1 - similarity) / (2 * similarity))
        x, y = (np.unique(np.concatenate([shared, rnd.integers(0, 2**63, own).astype(np.uint64)])) for _ in range(2))
        x_sketch, y_sketch = near_duplicates.registers([x, y])
        keep[similarity] = near_duplicates.keep_pair(x_sketch[None], y_sketch[None], np.array([float(len(x))]), np.array([float(len(y))]), 85)[0]
    assert not keep[0.5] and keep[0.84] and keep[0.86] and keep[0.95]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(20)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in got} and len(got) >= 60


def test_pairs_of_a_loose_group_do_not_grow_with_its_square(spark, monkeypatch):
    counts = []
    links = near_duplicates._links

    def counted(pairs, *args):
        counts[-1] += pairs.count()
        return links(pairs, *args)

    monkeypatch.setattr(near_duplicates, "_links", counted)
    for n in (200, 400, 800):
        counts.append(0)
        near_duplicates.near_duplicates(spark.createDataFrame(loose_copies(n), "doc_id long, text string"), 85).count()
    # fourfold classes: the square would give sixteenfold pairs
    assert counts[2] < 6 * counts[0], counts


def test_crowded_classes_bring_a_bounded_part_of_their_difference(spark):
    rnd = np.random.default_rng(7)
    sets = [rnd.choice(2**62, 100, replace=False).astype(np.uint64)]
    far = np.concatenate([sets[0][:60], rnd.choice(2**62, 40, replace=False).astype(np.uint64)])
    for i in range(150):  # most of the difference is shared by all
        own, edits = far.copy(), 2 + i % 7
        own[rnd.choice(100, edits, replace=False)] = rnd.choice(2**62, edits, replace=False).astype(np.uint64)
        sets.append(own)
    sets = [np.unique(s) for s in sets]
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "class_id long, items binary")
    crowded = spark.createDataFrame([(i, i, 0) for i in range(len(sets))], "class_id long, root long, large long")
    for percent in (80, 85):
        most = {i: len(s) * (100 - percent) // percent for i, s in enumerate(sets)}
        places = near_duplicates._places(crowded, held, percent).groupBy("class_id").count().collect()
        assert len(places) == 150 and all(r["count"] <= most[r.class_id] + 1 for r in places)
        got = {(r.a, r.b) for r in near_duplicates._rare_meet(crowded, held, percent).collect()}
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (s := len(np.intersect1d(sets[a], sets[b]))) >= percent * (len(sets[a]) + len(sets[b]) - s)]
        assert pairs and {(b, a) for a, b in pairs} <= got


def test_places_stay_with_their_class_until_its_bound_is_known(spark):
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.choice(2**62, 120, replace=False).astype(np.uint64))]
    for i in range(60):
        own = sets[0].copy()
        own[rnd.choice(120, 50 + i % 9, replace=False)] = 5 + i % 9 + np.arange(50 + i % 9, dtype=np.uint64)
        sets.append(np.unique(own))
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "class_id long, items binary")
    crowded = spark.createDataFrame([(i, i % 2 * i, 0) for i in range(len(sets))], "class_id long, root long, large long")
    rows = near_duplicates._places(crowded, held, 80).collect()
    assert sorted(r.class_id for r in rows) == list(range(1, 61))  # one row each
    base = set(sets[0].view(np.int64).tolist())
    for r in rows:
        own = set(sets[r.class_id].view(np.int64).tolist())
        apart = {*own - base, *(~i for i in base - own)}
        assert (r.n, r.d) == (len(own), len(apart)) and len(r["items"]) == len(set(r["items"])) == min(len(apart), r.n * 20 // 80 + 1) and set(r["items"]) <= apart


def test_sketches_are_taken_apart_a_few_rows_at_a_time(spark, monkeypatch):
    most = []
    sketch = near_duplicates.registers
    runs = []

    class Frame:
        """Keeps the function that a task would run."""

        def __init__(self, frame):
            self.frame = frame

        def mapInArrow(self, run, schema):
            runs.append(run)
            return self.frame

    docs = spark.createDataFrame([(i, odd.words(i, 12)) for i in range(900)], "doc_id long, text string")
    monkeypatch.setattr(near_duplicates, "_source", lambda frame: Frame(frame))
    near_duplicates.signatures(docs)
    monkeypatch.setattr(near_duplicates, "registers", lambda sets: most.append(len(sets)) or sketch(sets))
    batch = pa.record_batch([pa.array(range(900)), pa.array([odd.words(i, 12).encode() for i in range(900)], pa.binary())], names=["doc_id", "text"])
    out = pa.Table.from_batches(runs[0](iter([batch])))
    assert max(most) <= 256 and out.num_rows == 900 and out.column("doc_id").to_pylist() == list(range(900))
    assert out.column("sketch").to_pylist() == [s.tobytes() for s in sketch([near_duplicates.shingles(odd.words(i, 12).encode()) for i in range(900)])]
