"""Plain text and Markdown: built-in expressions only, no shuffle, no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import LINE_BREAK, SPACE_CLASS, SPACES, strip_text

_NOT_SPACE = f"[^{SPACES}]"
_INLINE_SPACE = f"[{SPACES.replace(chr(10), '')}]"
_HEADING_MARK = f"#{{1,6}}{_INLINE_SPACE}+"
# A heading line: marks, white space, then something.
_HEADING_AHEAD = f"\n(?={_INLINE_SPACE}*{_HEADING_MARK}{_NOT_SPACE})"
_LIST_LINE = rf"(?s)^(?:[-*+]|\d+\.){SPACE_CLASS}+(.*)\z"

# Sections are numbered in the high bits and lines in the low bits of ``seq``.
SECTION_STRIDE = 1 << 32


def text_blocks(docs: DataFrame, content: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One paragraph per run of text between blank lines."""
    parts = F.split(F.col(content), f"\n{SPACE_CLASS}*\n")
    return (
        docs.select(*carry, F.posexplode(parts).alias("seq", "text"))
        .withColumn("text", strip_text("text"))
        .filter(F.col("text") != "")
        .select(
            *carry, F.col("seq").cast("long").alias("seq"), F.lit("paragraph").alias("kind"), "text",
            F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page_number"),
            F.lit(None).cast("string").alias("section_title"),
        )
    )


def markdown_blocks(docs: DataFrame, content: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One block per non-blank line; a heading names the section of what follows.

    The text is first cut in front of its heading lines, so the section title is
    a plain column of each piece before the lines are exploded. That gives the
    forward fill without sorting or moving a row.
    """
    unified = F.concat(F.lit("\n"), F.regexp_replace(F.col(content), LINE_BREAK, "\n"))
    pieces = docs.select(*carry, F.posexplode(F.split(unified, _HEADING_AHEAD)).alias("_sec", "_piece"))
    head = strip_text(F.substring_index("_piece", "\n", 1))
    sections = pieces.withColumn("_head", F.when(F.col("_sec") > 0, head)).withColumn(
        "section_title", strip_text(F.regexp_replace("_head", f"^#{{1,6}}{SPACE_CLASS}+", ""))
    )
    lines = sections.select(
        *carry, "_sec", "_head", "section_title", F.posexplode(F.split("_piece", "\n")).alias("_line", "_raw")
    ).withColumn("_raw", strip_text("_raw")).filter(F.col("_raw") != "")
    is_heading = (F.col("_sec") > 0) & (F.col("_line") == 0)
    item = F.regexp_extract("_raw", _LIST_LINE, 1)
    is_item = F.rlike(F.col("_raw"), F.lit(_LIST_LINE))
    return lines.select(
        *carry,
        (F.col("_sec").cast("long") * SECTION_STRIDE + F.col("_line")).alias("seq"),
        F.when(is_heading, "heading").when(is_item, "list_item").otherwise("paragraph").alias("kind"),
        F.when(is_heading, F.col("section_title")).when(is_item, strip_text(item)).otherwise(F.col("_raw")).alias("text"),
        F.when(is_heading, F.char_length(F.regexp_extract("_head", "^(#{1,6})", 1))).alias("heading_level"),
        F.lit(None).cast("int").alias("page_number"),
        "section_title",
    )
