"""The pipeline's stages against brute force on their own inputs."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from conftest import SF_SMALL
from lorewell.llm import decontaminate, toxicity
from lorewell.llm.common import stored, table


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF_SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "stage")
        out.append(docs)
    return out


def test_names_and_columns(spark, outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]
    assert all(o.columns == table(spark, SF_SMALL, "documents").columns for o in outputs[:-1])
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql() and "pipeline" in queries()


def test_toxic_documents_go(spark, outputs):
    docs = table(spark, SF_SMALL, "documents")
    model = toxicity.train(docs, table(spark, SF_SMALL, "labels"))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    assert {r.doc_id for r in outputs[0].collect()} == want and len(want) < docs.count()


def test_all_documents_keep_their_rows_in_line_dedup(outputs):
    before, after = ({r.doc_id: r for r in o.collect()} for o in outputs[:2])
    assert set(before) == set(after)
    for i, r in after.items():
        old, new = before[i].text.split("\n"), r.text.split("\n")
        rest = iter(old)
        assert all(line in rest for line in new) and (r.text == before[i].text or r.n_chars == len(r.text))


def test_one_document_of_each_group_stays(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[1].collect()]
    groups = brute.near_groups(rows, 80)
    assert {r.doc_id for r in outputs[2].collect()} == {i for i, (_, root) in groups.items() if i == root}


def test_no_leak_is_left(spark, outputs):
    items = [r.text.encode() for r in table(spark, SF_SMALL, "benchmark").collect()]
    plain = [b" " + b" ".join(decontaminate.words_of(t)) + b" " for t in items]
    holds = lambda r: any(p in b" " + b" ".join(decontaminate.words_of(r.text.encode())) + b" " for p in plain)
    before, after = outputs[2].collect(), {r.doc_id for r in outputs[3].collect()}
    assert {r.doc_id for r in before if not holds(r)} >= after
    assert any(holds(r) for r in before) and not any(holds(r) for r in outputs[3].collect())


def test_rows_without_id_and_repeated_rows(spark):
    item = table(spark, SF_SMALL, "benchmark").first().text
    docs = table(spark, SF_SMALL, "documents").limit(3).select("doc_id", "text")
    odd = spark.createDataFrame([(None, "before it " + item + " and after"), (None, "nothing leaks in this text"), (-1, "one row twice in the corpus"), (-1, "one row twice in the corpus")], "doc_id long, text string")
    both = stored(docs.unionAll(odd), "odd")
    clean = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, both, SF_SMALL).collect()]
    assert (None, "nothing leaks in this text") in clean and not any(item in t for _, t in clean)
    once = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, both, SF_SMALL).collect()]
    assert once.count((-1, "one row twice in the corpus")) == 1 and sum(i is None for i, _ in once) == 2


def test_token_ids(outputs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in outputs[3].collect()}
    rows = outputs[4].collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
