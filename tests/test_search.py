"""Similarity joins, retrieval, context and history against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.operators import context, encoding, retrieval, similarity

CHUNKS = "kb_id string, owner_id string, chunk_id long, doc_id long, embedding array<float>, language string, created_at timestamp"


def _data(spark, n=3000, dim=8, hot=0.6, seed=3):
    """One tenant holds most rows; vectors repeat so that scores tie."""
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(200, dim)).astype(np.float32)
    rows = []
    for i in range(n):
        kb = "hot" if rng.random() < hot else f"kb{i % 5}"
        v = pool[rng.integers(200)].tolist() if i % 50 else [0.0] * dim
        rows.append((kb, "o" if i % 7 else "other", i, i // 3, v if i % 97 else None, ["en", "fr", None][i % 3], None))
    q = [(kb, "o", f"{kb}-{j}", rng.normal(size=dim).astype(np.float32).tolist()) for kb in ["hot", "kb0", "kb4", "none"] for j in range(5)]
    chunks = spark.createDataFrame(rows, CHUNKS).withColumn("created_at", F.timestamp_seconds(F.col("doc_id")))
    return rows, q, chunks, spark.createDataFrame(q, "kb_id string, owner_id string, query_id string, qvec array<float>")


def _brute(rows, q, k, floor, allow=lambda qid, row: True):
    want = {}
    for kb, owner, qid, qv in q:
        a = np.array(qv, dtype=np.float64)
        found = []
        for row in rows:
            if row[0] == kb and row[1] == owner and row[4] is not None and allow(qid, row):
                b = np.array(row[4], dtype=np.float32).astype(np.float64)
                if np.linalg.norm(b):
                    s = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
                    if s >= floor:
                        found.append((-s, row[2]))
        for rank, (s, cid) in enumerate(sorted(found)[:k], 1):
            want[(qid, rank)] = (cid, -s)
    return want


def _got(df):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_top_k_equals_brute_force_on_both_routes(spark, limit, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64)
    rows, q, chunks, questions = _data(spark)
    got = _got(similarity.top_k_join(questions, chunks.repartition(6), retrieval.TENANT, 7, 0.2, broadcast_limit=limit))
    assert got == _brute(rows, q, 7, 0.2)


def test_salts_follow_the_chunks_of_a_tenant(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 200)
    rows, q, chunks, questions = _data(spark)
    assert _got(similarity.top_k_join(questions, chunks.repartition(6), retrieval.TENANT, 7, 0.2, broadcast_limit=-1)) == _brute(rows, q, 7, 0.2)
    salted, copies = similarity._dealt(chunks, questions, retrieval.TENANT)
    held = {r[:2]: 0 for r in rows}
    for r in rows:
        held[r[:2]] += 1
    used = {(r.kb_id, r.owner_id): r.n for r in salted.groupBy(*retrieval.TENANT).agg(F.countDistinct("_salt").alias("n")).collect()}
    assert used == {key: -(-n // 200) for key, n in held.items()} and max(used.values()) > 5 and min(used.values()) == 1
    sent = {(r.kb_id, r.owner_id): r.n for r in copies.groupBy(*retrieval.TENANT).agg(F.count("*").alias("n")).collect()}
    assert sent == {key: 5 * used.get(key, 1) for key in {row[:2] for row in q}}
    most = salted.groupBy(*retrieval.TENANT, "_salt").count().agg(F.max("count")).first()[0]
    assert most < 300 and salted.count() == len(rows)


def test_per_question_filters(spark):
    rows, q, chunks, questions = _data(spark, n=900)
    asked = questions.withColumns({
        "language": F.when(F.endswith("query_id", F.lit("0")), "fr").when(F.endswith("query_id", F.lit("4")), ""),
        "uploaded_after": F.when(F.endswith("query_id", F.lit("1")), F.timestamp_seconds(F.lit(100))),
        "uploaded_before": F.when(F.endswith("query_id", F.lit("1")), F.timestamp_seconds(F.lit(200))),
        "doc_ids": F.when(F.endswith("query_id", F.lit("2")), F.sequence(F.lit(5).cast("long"), F.lit(60).cast("long"))),
    })

    def allow(qid, row):
        return {"0": row[5] == "fr", "1": 100 <= row[3] <= 200, "2": 5 <= row[3] <= 60}.get(qid[-1], True)

    got = _got(similarity.top_k_join(asked, chunks, retrieval.TENANT, 5, 0.1, filtered=True))
    assert got == _brute(rows, q, 5, 0.1, allow)


def test_approximate_scores_are_exact_and_hits_a_subset(spark, tmp_path):
    rows, q, chunks, questions = _data(spark, n=1500)
    everything = _brute(rows, q, 10 ** 6, 0.3)
    scores = {(k[0], v[0]): v[1] for k, v in everything.items()}
    near = similarity.approximate_top_k(questions, chunks, retrieval.TENANT, similarity.Planes(8, 6, 2), 5, 0.3)
    found = near.collect()
    assert found and all(scores[(r["query_id"], r["chunk_id"])] == round(r["similarity"], 9) for r in found)
    planes = similarity.Planes(8, 6, 2)
    path = str(tmp_path / "index")
    similarity.build_index(chunks, retrieval.TENANT, planes).write.partitionBy("hash_table", "bucket").parquet(path)
    stored = spark.read.parquet(path)
    assert _got(similarity.search_index(questions, stored, retrieval.TENANT, planes, 5, 0.3)) == _got(near)
    assert _got(similarity.search_index(questions, stored, retrieval.TENANT, planes, 5, 0.3, broadcast_limit=-1)) == _got(near)
    exact = similarity.top_k_join(questions, chunks, retrieval.TENANT, 5, 0.3)
    assert similarity.recall_at_k(exact, near).agg(F.avg("recall")).first()[0] > 0.5


def test_dimension_mismatch_is_an_error(spark):
    _, _, chunks, questions = _data(spark, n=50)
    with pytest.raises(Exception, match="elements"):
        similarity.top_k_join(questions.withColumn("qvec", F.slice("qvec", 1, 4)), chunks, retrieval.TENANT, 3, 0.0).collect()


def _one_tenant(spark, contents, scores):
    """Chunks whose cosine with the question (1, 0) is given."""
    rows = [("k", "o", f"c{i}", f"d{i}", [float(s), float((1 - s * s) ** 0.5)], t, 4 if i == 0 else None, None) for i, (t, s) in enumerate(zip(contents, scores))]
    chunks = spark.createDataFrame(rows, "kb_id string, owner_id string, chunk_id string, doc_id string, embedding array<float>, content string, page_number int, section string")
    docs = chunks.select("doc_id", F.concat(F.lit("name-"), "doc_id").alias("name"))
    asked = spark.createDataFrame([("q", "k", "o", "What?", [1.0, 0.0]), ("r", "k", "x", "Other owner?", [1.0, 0.0])],
                                  "query_id string, kb_id string, owner_id string, question string, qvec array<float>")
    return asked, chunks, docs


def test_one_hit_answers_and_foreign_owner_gets_none(spark):
    asked, chunks, docs = _one_tenant(spark, ["The fact.", "Unrelated."], [0.89, 0.1])
    hits = retrieval.retrieve(asked, chunks, docs)
    assert [(r["query_id"], r["document_name"], r["page_number"], round(r["similarity"], 6)) for r in hits.collect()] == [("q", "name-d0", 4, 0.89)]
    kept = context.build_context(hits)
    out = {r["query_id"]: r for r in context.prompts(asked, kept).collect()}
    assert out["r"]["outcome"] == "no_answer" and out["r"]["confidence"] == 0.0 and out["r"]["messages"] is None
    assert round(out["q"]["confidence"], 6) == 0.89
    assert out["q"]["prompt"] == "<question>What?</question>\n<passages>\n[1] (name-d0, page 4):\nThe fact.\n</passages>"
    assert [m["role"] for m in out["q"]["messages"]] == ["system", "user"]
    cite = context.citations(kept).collect()
    assert len(cite) == 1 and cite[0]["page_number"] == 4 and cite[0]["document_name"] == "name-d0"
    said = {r["query_id"]: r["outcome"] for r in retrieval.outcomes(asked, hits).collect()}
    assert said == {"q": "answered", "r": "no_answer"}


def test_repeats_and_budget(spark):
    asked, chunks, docs = _one_tenant(spark, ["  Same Text\n", "same text", "x" * 40, "y" * 400, "z" * 4], [0.99, 0.98, 0.97, 0.96, 0.95])
    hits = retrieval.retrieve(asked, chunks, docs)
    keep = lambda n: [r["chunk_id"] for r in context.build_context(hits, n).orderBy("source_no").collect()]
    assert keep(3000) == ["c0", "c2", "c3", "c4"]
    assert keep(14) == ["c0", "c2"]  # the first overflow ends the list
    assert keep(1) == ["c0"]  # the first always stays


def test_history_before_equals_brute_force(spark):
    rows = [(f"s{i % 3}", t, 0, ["user", "assistant", "system"][(i + t) % 3], f"{i}-{t}") for i in range(3) for t in range(40) if (i * t) % 7 != 3]
    df = spark.createDataFrame(rows, "session_id string, created_at int, position int, role string, content string")
    got = {(r["session_id"], r["created_at"]): [(m["role"], m["content"]) for m in r["history"]]
           for r in context.history_before(df, F.floor(F.col("created_at") / 3), 5).collect()}
    for s, t, *_ in rows:
        before = sorted(r for r in rows if r[0] == s and r[1] < t)[-5:]
        assert got[(s, t)] == [(r[3], r[4]) for r in before if r[3] != "system"]
    last = {r["session_id"]: [m["content"] for m in r["history"]] for r in context.history_lists(df, 5).collect()}
    for s in last:
        assert last[s] == [r[4] for r in sorted(r for r in rows if r[0] == s)[-5:] if r[3] != "system"]


def test_encoder_contract(spark):
    df = spark.createDataFrame([(f"t{i} word",) for i in range(7)] + [(None,)], "t string")
    vec = encoding.encode_column(df, "t", encoding.FeatureHashEncoder(512)).select("t", "embedding").collect()
    assert all(len(r["embedding"]) == 512 for r in vec)
    assert sum(vec[-1]["embedding"]) == 0 and abs(sum(x * x for x in vec[0]["embedding"]) - 1) < 1e-6
    with pytest.raises(Exception, match="got 1 vectors"):
        encoding.encode_column(df, "t", lambda texts: np.zeros((1, 4)), batch=3).collect()


def test_markers(spark):
    df = spark.createDataFrame([("m", "see [1], [3] and [x] [02]", 2)], "message_id string, answer string, n_citations int")
    assert [(int(r["marker"]), r["valid"]) for r in context.marker_report(df).orderBy("position").collect()] == [(1, True), (3, False), (2, True)]


def test_blocks_are_scored_in_small_tiles_and_give_only_what_can_be_among_the_best():
    rng = np.random.default_rng(11)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    questions, blocks = unit(2048), [unit(2048) for _ in range(3)]
    blocks[1][:40] = blocks[0][:40]  # ties between blocks
    asked = [f"q{i}" for i in range(2048)]
    batches = [pa.RecordBatch.from_pydict({
        "q_ids": [asked], "q_mat": [questions.tobytes()], "c_ids": [list(range(2048 * b, 2048 * b + 2048))], "c_mat": [c.tobytes()]}) for b, c in enumerate(blocks)]
    tracemalloc.start()
    out = list(similarity._score_blocks(8, -1.0, False, True)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 1024 * 1024  # one matrix of all scores has 32
    assert [b.num_rows for b in out][0] == 8 * 2048 and sum(b.num_rows for b in out[1:]) < 1.4 * 8 * 2048
    scores = np.round(questions @ np.concatenate(blocks).T, similarity.SCORE_DIGITS)
    rows = pa.Table.from_batches(out).to_pylist()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((-r["similarity"], r["chunk_id"]))
    for i in range(0, 2048, 97):
        want = sorted(zip((-scores[i]).tolist(), range(len(scores[i]))))[:8]
        assert [c for _, c in sorted(found[asked[i]])[:8]] == [c for _, c in want]


def test_the_encoder_remembers_a_bounded_number_of_words():
    encoder = encoding.FeatureHashEncoder(16)
    text = " ".join(f"w{i}" for i in range(encoding.KNOWN_WORDS + 500))
    assert np.array_equal(encoder([text]), encoder([text]))
    assert len(encoder._slots) <= encoding.KNOWN_WORDS == 100_000


def test_open_blocks_leave_one_at_a_time(monkeypatch):
    """A task that runs into its limit of waiting bytes hands every block on by itself."""
    from pyspark.sql import types as T

    class Rows:
        schema = T.StructType([T.StructField("kb_id", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("embedding", encoding.VECTOR)])
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    run = similarity.pack_vectors(Rows(), ["kb_id"], "chunk_id", "embedding", [], "c")
    n = 1000
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"kb{i % 10}" for i in range(n)]), pa.array(range(n), pa.int64()), pa.array([[float(i), 1.0] if i % 9 else None for i in range(n)], pa.list_(pa.float32()))],
        names=["kb_id", "chunk_id", "embedding"])
    out = list(run(iter([batch])))
    assert [b.num_rows for b in out] == [1] * 10
    assert sorted(i for b in out for i in b.column("c_ids")[0].as_py()) == [i for i in range(n) if i % 9]
