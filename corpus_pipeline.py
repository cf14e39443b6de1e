"""A corpus from raw documents to token ids, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import bpe_codec, decontaminate, line_spread, near_duplicates, toxicity
from lorewell.llm.common import stored, table

# SQL expresses neither the classifier, nor the sketches, nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below one half."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are spread over many sites; ``n_chars`` follows the text."""
    cleaned = line_spread.remove_boilerplate(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (similarity 0.8, five words); a row repeated in full stays once."""
    dropped = near_duplicates.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns).dropDuplicates()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    # decisions go by a key of the row, stored so that it stays: ids may be null or repeated
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col("_row").alias("doc_id"), "text")
    leaking = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaking, "_row", "left_anti").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    encoded = bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_line_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored once, so that no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
