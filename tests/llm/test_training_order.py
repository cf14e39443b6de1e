"""The permutation, and shards read back."""

import hashlib

import numpy as np
import pytest

import odd
from conftest import SF_SMALL
from lorewell.llm import training_order
from lorewell.llm.queries import QUERIES, WORD_MODEL
from lorewell.llm.training_order import Permutation, materialise, read_from


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 1000, 4097])
def test_permutation_is_a_keyed_bijection(n):
    one = Permutation(n, 3)(np.arange(n))
    assert sorted(one.tolist()) == list(range(n))
    assert (Permutation(n, 3)(one, inverse=True) == np.arange(n)).all()
    if n >= 100:
        assert (one != Permutation(n, 4)(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.3


def restored(spark, index, folder, **sizes):
    """All id streams, from the shards, in the order of the corpus."""
    rows = {r.slot: bytes(r.ids) for r in read_from(spark, folder, **sizes).collect()}
    meta = {r.slot: r for r in index.collect()}
    assert sorted(rows) == sorted(meta) == list(range(len(rows)))
    assert all(hashlib.sha256(rows[s]).hexdigest() == meta[s].sha256 for s in rows)
    places = Permutation(len(rows), 20240501)(np.arange(len(rows)))
    return b"".join(rows[s][: meta[s].n_ids * sizes.get("width", 1)] for s in places.tolist()), meta


def test_round_trip_and_resume(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes = {"length": 100, "per_shard": 64}
    index, folder = materialise(docs, **sizes)
    stream, meta = restored(spark, index, folder, **sizes)
    want = sorted((r.text or "").encode() for r in docs.collect() if r.text)
    assert sorted(stream.split(b"\xff")[:-1]) == want
    late = read_from(spark, folder, 130, **sizes).collect()
    assert sorted(r.slot for r in late) == list(range(130, len(meta)))
    assert all(r.shard == r.slot // 64 and r.byte_offset == r.slot % 64 * 101 for r in meta.values())


def test_ids_of_two_bytes(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(50).select("doc_id", "text")
    path = training_order.shared_dir(spark, "fifty")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    sizes = {"length": 64, "per_shard": 16, "width": 2}
    index, folder = materialise(docs, encode=lambda t: np.frombuffer(t, np.uint8).astype("<u2").tobytes(), **sizes)
    stream, _ = restored(spark, index, folder, **sizes)
    ids = np.frombuffer(stream, "<u2")
    assert (ids == 0xFFFF).sum() == docs.where("text <> ''").count()


def test_registered_query_orders_token_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    index = QUERIES["op2_training_order"](spark, SF_SMALL).collect()
    assert sum(r.n_ids for r in index) == sum(n + 1 for n in counts if n)


def test_odd_rows_and_empty(spark):
    path = training_order.shared_dir(spark, "odd")
    odd.documents(spark).write.parquet(path)
    index, folder = materialise(spark.read.parquet(path), length=500, per_shard=8)
    stream, _ = restored(spark, index, folder, length=500, per_shard=8)
    assert sorted(stream.split(b"\xff")[:-1]) == sorted(t.encode() for _, t in odd.pairs() if t)
    path = training_order.shared_dir(spark, "none")
    odd.documents(spark).limit(0).write.parquet(path)
    index, _ = materialise(spark.read.parquet(path))
    assert index.count() == 0
