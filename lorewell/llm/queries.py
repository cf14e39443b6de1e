"""One query per operator over its whole table; each row comes from the operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import backoff, bpe_codec, bwt_merge, conversation_repair, decontaminate, line_spread, multi_index, near_duplicates, spelling, suffix_trees, token_counts, toxicity, training_order
from lorewell.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def op1_latent_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_training_order(spark, sf_dir):
    ids = stored(bpe_codec.encode_words(table(spark, sf_dir, "documents"), WORD_MODEL), "ids")  # texts are encoded once
    index, _ = training_order.materialise(ids, width=2)
    return index


@query()
def op3_bwt_merge_dedup(spark, sf_dir):
    return bwt_merge.remove_substrings(table(spark, sf_dir, "documents"), digest=True)


LINE_SPREAD_SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), h AS (SELECT doc_id, source, pos, line, CASE WHEN trim(line) <> '' THEN md5(line) END AS d FROM l),
w AS (SELECT d FROM h WHERE d IS NOT NULL AND doc_id IS NOT NULL GROUP BY d HAVING count(DISTINCT source) >= 10),
c AS (SELECT doc_id, coalesce(min(h.d) FILTER (w.d IS NULL), '') AS context FROM h LEFT JOIN w ON h.d = w.d WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT h.d, min(h.doc_id) AS first_doc FROM h JOIN w ON h.d = w.d JOIN c ON h.doc_id = c.doc_id
  GROUP BY h.d HAVING count(DISTINCT context) >= 10
), g AS (SELECT h.doc_id, h.pos, h.line, f.d IS NOT NULL AND h.doc_id <> f.first_doc AS gone FROM h LEFT JOIN f ON h.d = f.d)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""


@query(LINE_SPREAD_SQL)
def op4_line_site_spread(spark, sf_dir):
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op5_set_sketch_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query()
def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query()
def op7_toxicity_weak_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query()
def op8_bpe_round_trip(spark, sf_dir):
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), WORD_MODEL)


@query()
def op9_suffix_tree_dedup(spark, sf_dir):
    return suffix_trees.remove_sequences(table(spark, sf_dir, "documents"), digest=True)


@query()
def op10_multi_index_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query()
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query()
def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query()
def op13_backoff_automaton(spark, sf_dir):
    return backoff.score(table(spark, sf_dir, "documents"))
