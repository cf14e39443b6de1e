"""Substring and word-sequence removal against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
import odd
from conftest import SF_SMALL
from lorewell.llm import bwt_merge, repeats, suffix_trees
from lorewell.llm.repeats import Units

BYTES = Units(size=50, gram=16, words=False, across=True)
WORDS = Units(size=20, gram=8, words=True, across=False)


def in_process(kind, judge, finish, names, kinds, docs, blocks=4):
    """The plan of ``removed_repeats`` without Spark, so that its limits can be made small."""
    tables = {}
    for i, t in docs:
        tables.setdefault(i % blocks, []).append((i, t))
    block = {b: pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.binary())}) for b, rows in tables.items()}
    key = lambda v: (pa.scalar(v, pa.int32()),)
    groups = lambda t, c: {v: t.filter(pa.compute.equal(t[c], v)) for v in set(t[c].to_pylist())}
    census = pa.concat_tables([repeats.census_of(kind, 3)(key(b), t) for b, t in block.items()])
    flags = groups(pa.concat_tables([repeats.flag_bucket(key(b), t) for b, t in groups(census, "bucket").items()]), "block")
    none = pa.table({"bucket": pa.array([], pa.int32()), "repeated": pa.array([], pa.binary()), "crowded": pa.array([], pa.binary())})
    pieces = pa.concat_tables([repeats.pieces_of(kind, 3)(key(b), t, flags.get(b, none)) for b, t in block.items()])
    slot = pa.array(np.array(pieces["hash"].to_pylist(), np.int64) % 2)
    marks = pa.concat_tables([repeats.judged_of(kind, judge)(t) for t in groups(pieces.append_column("slot", slot), "slot").values()])
    by = groups(marks, "block")
    out = [repeats.final_of(kind, finish, names, kinds)(key(b), t, by.get(b, marks.slice(0, 0))) for b, t in block.items()]
    return {r["doc_id"]: tuple(r[n] for n in names) for r in pa.concat_tables(out).to_pylist()}


def texts(seed, spaces):
    rnd = random.Random(seed)
    pool = [odd.words(s, rnd.randint(5, 60)) for s in range(8)]
    docs = []
    for i in range(40):
        parts = [rnd.choice(pool) for _ in range(rnd.randint(0, 5))] + [odd.words(1000 + seed * 50 + i, rnd.randint(0, 30))]
        rnd.shuffle(parts)
        docs.append((i, rnd.choice(spaces).join(parts).encode()))
    return docs + [(41, b"the " * 90), (42, b"ab" * 400), (43, b""), (44, b"ab" * 300), (45, b"the the\tthe\n" * 40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tiny_limits(monkeypatch, seed):
    monkeypatch.setattr(repeats, "CROWDED", 3)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 400)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    monkeypatch.setattr(bwt_merge, "SHARD_BYTES", 90)
    docs = texts(seed, [" ", "\n", "  "])
    got = in_process(BYTES, bwt_merge.judge, bwt_merge._digest, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 3 + [pa.string()], docs)
    assert got == brute.substrings(docs)
    judge = lambda *a: suffix_trees.judge(*a, group=5)
    got = in_process(WORDS, judge, suffix_trees._digest, ["n_words", "n_removed", "kept_sha256"], [pa.int64()] * 2 + [pa.string()], docs)
    assert got == brute.sequences(docs)


def test_merged_order_and_common_prefixes():
    rnd = np.random.default_rng(0)
    shards = [rnd.integers(97, 100, n).astype(np.uint8) for n in (300, 1, 77, 500)]
    merged, common = bwt_merge.merge_transforms(shards, 50)
    rotations = [(np.resize(np.roll(s, -i), 50).tobytes()) for s in shards for i in range(len(s))]
    ordered = [rotations[i] for i in merged]
    assert ordered == sorted(rotations)
    for k in range(1, len(ordered)):
        shared = next((j for j in range(50) if ordered[k][j] != ordered[k - 1][j]), 50)
        assert common[k] == (50 if shared == 50 else shared // 4 * 4)


def test_prefix_groups_cover_and_fit():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 3, 600).astype(np.int32)
    groups = list(suffix_trees.prefix_groups(codes, np.arange(580), 20, 0, 16))
    assert sorted(np.concatenate([g for _, g in groups]).tolist()) == list(range(580))
    assert all(len(g) <= 16 or depth == 20 for depth, g in groups)
    for depth, g in groups:
        assert len({tuple(codes[s : s + depth]) for s in g}) == 1


@pytest.mark.parametrize("name", ["bytes", "words"])
def test_operator_on_documents(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    op, plain = (bwt_merge.remove_substrings, brute.substrings) if name == "bytes" else (suffix_trees.remove_sequences, brute.sequences)
    assert {r[0]: tuple(r)[1:] for r in op(docs, digest=True).collect()} == plain(rows)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    ids = [(i, (t or "").encode()) for i, t in odd.pairs()]
    known = dict(r for r in ids if r[0] is not None and r[0] != 12)  # a long text is compared by its size below
    plain, words = brute.substrings(list(known.items())), brute.sequences(list(known.items()))
    got = bwt_merge.remove_substrings(docs, digest=True).collect()
    assert len(got) == len(ids)
    assert all(tuple(r)[1:] == plain[r.doc_id] for r in got if r.doc_id in plain)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    got = suffix_trees.remove_sequences(docs, digest=True).collect()
    assert all(tuple(r)[1:] == words[r.doc_id] for r in got if r.doc_id in words)
    cleaned = {r.doc_id: r for r in bwt_merge.remove_substrings(docs).collect()}
    assert cleaned[2].kept == b"" and [tuple(s) for s in cleaned[2].spans] == [(0, len(known[1]))]
    assert suffix_trees.remove_sequences(docs.limit(0)).count() == 0 and bwt_merge.remove_substrings(docs.limit(0)).count() == 0


def test_chunks_are_cut_after_the_anchor_that_fills_them(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 100)
    hashes = np.repeat(np.arange(40), 2)
    chunks = [c.tolist() for c in repeats._chunks(hashes, [33] * 80)]  # no limit falls between two anchors
    assert sorted(i for c in chunks for i in c) == list(range(80))
    assert max(map(len, chunks)) <= 4
    assert all(len(set(hashes[a]) & set(hashes[b])) == 0 for a, b in zip(chunks, chunks[1:]))


def test_only_pieces_that_share_a_window_are_merged(monkeypatch):
    merged = []
    whole = bwt_merge.merge_transforms
    monkeypatch.setattr(bwt_merge, "merge_transforms", lambda shards, depth: merged.append(sum(map(len, shards))) or whole(shards, depth))
    rnd = random.Random(5)
    alone = [bytes(rnd.choices(range(97, 123), k=60)) for _ in range(200)]
    judge = lambda contents, docs: bwt_merge.judge(contents, np.array([len(c) - 49 for c in contents]), np.array(docs), np.zeros(len(contents), np.int64))
    assert not judge(alone, range(200)).any() and not merged
    part = alone[7][5:58]
    found = judge([*alone, part, alone[9][:55]], [*range(200), 300, 9])  # the last repeats its own document only
    assert np.flatnonzero(found).tolist() == [200 * 11, 200 * 11 + 1, 200 * 11 + 2, 200 * 11 + 3] and merged == [60 + 53]
