"""Routing of files to readers by type, open to further readers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.rules import EXTENSION_TYPES, MAX_UPLOAD_BYTES
from lorewell.sources import manifest, markup, plain, records
from lorewell.sources.decode import decode_documents

# A reader takes (doc_id, content BINARY) rows of one type and returns blocks.
Reader = Callable[[DataFrame], DataFrame]
_COLUMNS = ["doc_id", "seq", "kind", "text", "heading_level", "page_number", "section_title"]

# Types without a reader, and why.
UNSUPPORTED = {
    "doc": "legacy binary word files must be converted to docx first",
    "xls": "legacy binary spreadsheets are not readable",
    "zip": "archives are not unpacked",
}
NEEDS_DECODED_ROWS = "binary layout: supply decoded rows"


def _as_utf8(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


READERS: dict[str, Reader] = {
    "txt": lambda files: plain.text_blocks(_as_utf8(files)),
    "markdown": lambda files: plain.markdown_blocks(_as_utf8(files)),
    "html": lambda files: decode_documents(files, markup.html_decoder(), "content"),
    "xml": lambda files: markup.xml_blocks(files.select("doc_id", markup.xml_text(F.col("content").cast("binary")).alias("text"))),
    "csv": lambda files: records.csv_blocks(_as_utf8(files), sep=None),
    "json": lambda files: decode_documents(files, records.decode_json, "content"),
}


def register_reader(file_type: str, reader: Reader) -> None:
    """Read files of a type by ``reader`` from now on: ``(doc_id, content)`` to block columns, and ``error`` if it can fail."""
    READERS[file_type] = reader


def unregister_reader(file_type: str) -> None:
    READERS.pop(file_type, None)


def outcomes(files: DataFrame) -> DataFrame:
    """Blocks of every readable file of ``(doc_id, file_type, content)``; of any other one row with ``error``, ``fatal`` if no retry can help.

    Keep ``files`` partitioned by ``file_type`` on storage and each branch reads its own
    partitions only. Store the result once: blocks and failures are both taken from it.
    """
    parts = [_read(files.filter(F.col("file_type") == kind), reader) for kind, reader in READERS.items()]
    read = reduce(DataFrame.unionByName, parts)
    empty = [F.lit(None).cast(read.schema[c].dataType).alias(c) for c in _COLUMNS if c != "doc_id"]
    unread = unroutable(files).select("doc_id", *empty, F.col("reason").alias("error"), F.lit(True).alias("fatal"))
    failed = F.concat(F.lit("Extraction failed: "), F.col("error"))
    return read.withColumn("error", failed).withColumn("fatal", F.lit(False)).unionByName(unread)


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, file_type, content)`` to ``(blocks, failures(doc_id, reason))``; both are views of ``outcomes``."""
    both = outcomes(files)
    return both.filter(F.col("error").isNull()).select(*_COLUMNS), both.filter(F.col("error").isNotNull()).select("doc_id", F.col("error").alias("reason"))


def read_once(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``route``, from outcomes stored under ``path`` by whether reading failed, so that no file is decoded for both."""
    outcomes(files).withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("failed").parquet(path)
    schema = outcomes(files).withColumn("failed", F.lit(True)).schema
    both = files.sparkSession.read.schema(schema).parquet(path)
    return both.filter(~F.col("failed")).select(*_COLUMNS), both.filter("failed").select("doc_id", F.col("error").alias("reason"), "fatal")


def unroutable(files: DataFrame) -> DataFrame:
    why = F.lit(NEEDS_DECODED_ROWS)
    for kind, text in UNSUPPORTED.items():
        why = F.when(F.col("file_type") == kind, text).otherwise(why)
    why = F.when(F.col("file_type").isNull(), F.lit("unknown file type")).otherwise(why)
    known = F.coalesce(F.col("file_type").isin(list(READERS)), F.lit(False))
    return files.filter(~known).select("doc_id", why.alias("reason"))


def _read(files: DataFrame, reader: Reader) -> DataFrame:
    out = reader(files)
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.select(*_COLUMNS, "error")


def read_folder(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Blocks and failures of a folder of files.

    One scan per type with a file-name pattern, so every file is opened once;
    the size rule is applied to ``length``, before any content is loaded.
    """
    def scan(kind: str) -> DataFrame:
        names = ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext, t in EXTENSION_TYPES.items() if t == kind)
        return (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*.{{{names}}}").load(path)
            .filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
            .select(F.sha2(F.col("path"), 256).alias("doc_id"), "content")
        )

    both = reduce(DataFrame.unionByName, [_read(scan(kind), reader) for kind, reader in READERS.items()])
    listing = manifest.quality_gate(manifest.list_files(spark, path)).withColumn("doc_id", F.sha2(F.col("path"), 256))
    refused = listing.filter(F.col("reject_reason").isNotNull()).select("doc_id", F.col("reject_reason").alias("reason"))
    unread = unroutable(listing.filter(F.col("reject_reason").isNull()))
    failed = both.filter(F.col("error").isNotNull()).select("doc_id", F.concat(F.lit("Extraction failed: "), F.col("error")).alias("reason"))
    return both.filter(F.col("error").isNull()).select(*_COLUMNS), failed.unionByName(refused).unionByName(unread)
