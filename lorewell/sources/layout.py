"""Decoded office and page layouts to blocks: paragraphs, slides, page spans.

The binary formats themselves are decoded upstream; these jobs take the decoded
rows (styled paragraphs, slide shapes, font spans, recognition passes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.rules import heading_level_from_size, heading_level_from_style, is_list_style
from lorewell.functions.text import strip_text
from lorewell.operators.ordered import carry_forward

DEFAULT_BODY_SIZE = 10
PARAGRAPH_BUCKET = 4096
_COLUMNS = ["doc_id", "seq", "kind", "text", "heading_level", "page_number", "section_title"]
_TABLES_LAST = 1 << 40


def styled_paragraph_blocks(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """``paragraphs(doc_id, n, style, text)`` then ``tables(doc_id, n, rows)``.

    Tables follow all paragraphs of the document and take its last section.
    """
    level = heading_level_from_style("style")
    body = (
        paragraphs.withColumn("text", strip_text("text")).filter(F.col("text") != "")
        .withColumn("heading_level", level)
        .withColumn("kind", F.when(F.col("heading_level").isNotNull(), "heading")
                    .when(is_list_style("style"), "list_item").otherwise("paragraph"))
        .withColumn("seq", F.col("n").cast("long"))
    )
    heading_text = F.when(F.col("kind") == "heading", F.col("text"))
    body = carry_forward(body, ["doc_id"], F.floor(F.col("n") / PARAGRAPH_BUCKET), ["n"], heading_text, "section_title")
    last_section = body.groupBy("doc_id").agg(
        F.max_by("text", F.when(F.col("kind") == "heading", F.col("seq"))).alias("section_title")
    )
    rendered = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: strip_text(c)), " | ")), "\n")
    grids = (
        tables.select("doc_id", (F.col("n").cast("long") + _TABLES_LAST).alias("seq"), rendered.alias("text"))
        .filter(strip_text("text") != "")
        .join(last_section, "doc_id", "left")
        .withColumn("kind", F.lit("table")).withColumn("heading_level", F.lit(None).cast("int"))
    )
    no_page = F.lit(None).cast("int")
    return (
        body.withColumn("page_number", no_page).select(*_COLUMNS)
        .unionByName(grids.withColumn("page_number", no_page).select(*_COLUMNS))
    )


def slide_blocks(shapes: DataFrame) -> DataFrame:
    """``shapes(doc_id, slide, shape_no, para_no, role, text)`` with role title, body or notes."""
    position = F.when(F.col("role") == "title", 0).when(F.col("role") == "notes", 2).otherwise(1)
    spoken = F.when(F.col("role") == "notes", F.concat(F.lit("[Speaker notes] "), F.col("text"))).otherwise(F.col("text"))
    ordered = Window.partitionBy("doc_id", "slide").orderBy("_place", "shape_no", "para_no")
    slide = Window.partitionBy("doc_id", "slide")
    return (
        shapes.withColumn("text", strip_text("text")).filter(F.col("text") != "")
        .withColumn("_place", position)
        .withColumn("section_title", F.max(F.when(F.col("role") == "title", F.col("text"))).over(slide))
        .withColumn("seq", F.col("slide").cast("long") * (1 << 32) + F.row_number().over(ordered))
        .select(
            "doc_id", "seq", F.when(F.col("role") == "title", "heading").otherwise("paragraph").alias("kind"),
            spoken.alias("text"), F.when(F.col("role") == "title", 1).alias("heading_level"),
            F.col("slide").cast("int").alias("page_number"), "section_title",
        )
    )


def body_sizes(spans: DataFrame) -> DataFrame:
    """Most frequent rounded size per page, the smaller one on a tie."""
    counts = spans.groupBy("doc_id", "page", F.bround("size", 0).cast("int").alias("size")).count()
    return counts.groupBy("doc_id", "page").agg(
        F.max_by("size", F.struct(F.col("count"), -F.col("size"))).alias("body_size")
    )


def span_blocks(spans: DataFrame) -> DataFrame:
    """``spans(doc_id, page, block, line, span, size, text)``: one block per line.

    A line much larger than the page's usual size is a heading; the section runs
    on across pages, which are also the buckets of the fill.
    """
    lines = (
        spans.groupBy("doc_id", "page", "block", "line")
        .agg(
            F.sort_array(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("text")))).alias("_s"),
            F.max("size").alias("size"),
        )
        .withColumn("text", strip_text(F.array_join(F.transform("_s", lambda s: s["text"]), "")))
        .filter(F.col("text") != "")
        .join(body_sizes(spans), ["doc_id", "page"], "left")
        .withColumn("heading_level", heading_level_from_size(
            F.col("size"), F.coalesce(F.col("body_size"), F.lit(DEFAULT_BODY_SIZE))))
    )
    heading = F.when(F.col("heading_level").isNotNull(), F.col("text"))
    filled = carry_forward(lines, ["doc_id"], "page", ["page", "block", "line"], heading, "section_title")
    stride = 1 << 20
    return filled.select(
        "doc_id",
        ((F.col("page").cast("long") * stride + F.col("block")) * stride + F.col("line")).alias("seq"),
        F.when(F.col("heading_level").isNotNull(), "heading").otherwise("paragraph").alias("kind"),
        "text", "heading_level", F.col("page").cast("int").alias("page_number"), "section_title",
    )


def page_counts(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    return pages.groupBy(doc).agg(F.countDistinct(page).alias("page_count"), F.count("*").alias("n_blocks"))


def flatten_pages(nested: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``pages array<struct<page_number, blocks array>>`` to one row per block, in page then block order."""
    tagged = F.transform("pages", lambda p: F.transform(
        p["blocks"], lambda b: F.struct(p["page_number"].alias("page_number"), b.alias("block"))))
    return nested.select(doc, F.posexplode(F.flatten(tagged)).alias("seq", "_b")).select(
        doc, "_b.page_number", F.col("seq").cast("long").alias("seq"), "_b.block")


def language_votes(pages: DataFrame, keys: list[str], page: str = "page", lang: str = "lang") -> DataFrame:
    """Most frequent language over recognised pages; the earliest seen wins a tie.

    Pages read natively (language ``native``) do not vote; NULL when none does.
    """
    votes = pages.groupBy(*keys, F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"), F.min(page).alias("_first"))
    chosen = F.max_by("_lang", F.when(F.col("_lang") != "native", F.struct(F.col("_n"), -F.col("_first"))))
    return votes.groupBy(*keys).agg(chosen.alias("detected_language"))


def mean_confidence(words: DataFrame, keys: list[str], confidence: str = "conf") -> DataFrame:
    """Mean over recognised words; -1 marks non-words, 0.0 when there are none."""
    real = F.when(F.col(confidence) != -1, F.col(confidence))
    return words.groupBy(*keys).agg(F.coalesce(F.avg(real), F.lit(0.0)).alias("mean_confidence"))
