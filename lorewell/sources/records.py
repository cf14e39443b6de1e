"""CSV and JSON files, and spreadsheet-like tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import _c, strip_text
from lorewell.sources.decode import DecodeError, as_text, decode_documents
from lorewell.sources.markup import LINES_PER_BLOCK, grouped

CELL_GLUE = " | "
SHEET_ROWS_PER_BLOCK = 1000
SEPARATORS = (",", ";", "\t", "|")

# Private characters that stand for separators and line ends inside quotes.
_SEP, _LF, _CR = "\ue001", "\ue002", "\ue003"


def _quoted(quote: str) -> str:
    """What a quote opens: up to its partner, or to the end of the text without one; a doubled quote is a quote."""
    q = re.escape(quote)
    return f"{q}((?:[^{q}]++|{q}{q})*+)(?:{q}|\\z)"


def csv_records(text: Column | str, sep: str = ",", quote: str = '"') -> Column:
    """Rows of cells of a CSV text, by expressions only.

    A quote opens only at the start of a cell; elsewhere it is a character. Separators and line ends
    inside quotes belong to the cell, and what follows the closing quote is added to it.
    """
    mark = re.escape(sep)
    cell = f"(?:{_quoted(quote)})?+[^{mark}\r\n]*+(?:{mark}|\r\n|\n|\r|\\z)"
    tokens = F.regexp_extract_all(F.regexp_replace(_c(text), "^\ufeff", ""), F.lit(cell), F.lit(0))

    def masked(t: Column) -> Column:
        inner = F.replace(F.regexp_extract(t, "^" + _quoted(quote), 1), F.lit(quote * 2), F.lit(quote))
        rest = F.regexp_replace(t, "^" + _quoted(quote), "")
        return F.when(t.startswith(quote), F.concat(F.translate(inner, f"{sep}\n\r", _SEP + _LF + _CR), rest)).otherwise(t)

    lines = F.split(F.array_join(F.transform(tokens, masked), ""), "\r\n|\n|\r", -1)
    plain = lambda c: F.translate(c, _SEP + _LF + _CR, f"{sep}\n\r")
    return F.transform(lines, lambda line: F.transform(F.split(line, mark, -1), plain))


def csv_separator(text: Column | str, quote: str = '"') -> Column:
    """The separator that cuts all rows of the text into equally many cells, a comma if there is none.

    Of several the one with most cells; a comma only if not all of them stand between two digits, as decimal commas do.
    """
    bare = F.regexp_replace(_c(text), "(?<![^,;\t|\r\n])" + _quoted(quote), "q")
    decimal = F.regexp_count(bare, F.lit(",")) == F.regexp_count(bare, F.lit(r"(?<=\d),(?=\d)"))

    def even(mark: str) -> Column:
        rows = F.filter(csv_records(text, mark, quote), lambda r: (F.size(r) > 1) | (strip_text(r[0]) != ""))
        cells = F.array(F.transform(rows, F.size))  # a lambda's argument is evaluated once
        return F.coalesce(F.transform(cells, lambda c: F.when(F.array_min(c) == F.array_max(c), F.array_min(c) - 1).otherwise(0))[0], F.lit(0))

    # equal counts: the earlier separator; none cuts anything: a comma
    rated = [F.struct((F.when(decimal, 0).otherwise(even(m)) if m == "," else even(m)).alias("n"), F.lit(-i).alias("i"), F.lit(m).alias("sep")) for i, m in enumerate(SEPARATORS)]
    return F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit(",").alias("sep")), *rated))["sep"]


def csv_blocks(docs: DataFrame, content: str = "text", carry: tuple[str, ...] = ("doc_id",), sep: str | None = ",", quote: str = '"') -> DataFrame:
    """One table block per document with all rows that are not blank; without ``sep`` each document's is found."""

    def shown(mark: str) -> Column:
        rows = F.filter(csv_records(content, mark, quote), lambda r: F.exists(r, lambda c: strip_text(c) != ""))
        return F.array_join(F.transform(rows, lambda r: F.array_join(r, CELL_GLUE)), "\n")

    def body(mark: Column) -> Column:
        out = shown(SEPARATORS[0])
        for known in SEPARATORS[1:]:
            out = F.when(mark == known, shown(known)).otherwise(out)
        return out

    # arrays of one element: a lambda evaluates its argument once, and no filter is copied below the reader
    texts = F.array(shown(sep)) if sep is not None else F.transform(F.array(csv_separator(content, quote)), body)
    return docs.select(*carry, F.explode(F.filter(texts, lambda t: t != "")).alias("text")).select(
        *carry, F.lit(0).cast("long").alias("seq"), F.lit("table").alias("kind"), "text", F.lit(None).cast("int").alias("heading_level"),
        F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("error"))


def _leaves(value, path):
    """(path, scalar) pairs depth first; an explicit stack, so depth is not limited by recursion."""
    stack = [(path, value)]
    while stack:
        here, item = stack.pop()
        if isinstance(item, dict):
            stack.extend((f"{here}.{k}" if here else str(k), v) for k, v in reversed(item.items()))
        elif isinstance(item, list):
            stack.extend((f"{here}[{i}]", item[i]) for i in range(len(item) - 1, -1, -1))
        else:
            yield here, item


def decode_json(content):
    """``a.b[0]: value`` lines, 50 per table block."""
    try:
        data = json.loads(as_text(content))
    except (ValueError, RecursionError) as fault:
        raise DecodeError(f"Could not parse JSON: {fault}") from fault
    return grouped([f"{path}: {value}" for path, value in _leaves(data, "")], "table")


def json_blocks(docs: DataFrame, content: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return decode_documents(docs, decode_json, content, carry)


def pipe_row(cells: Column | str) -> Column:
    """Cells joined by a pipe, NULL as empty text."""
    return F.array_join(F.transform(_c(cells), lambda c: F.coalesce(c, F.lit(""))), CELL_GLUE)


def sheet_blocks(rows: DataFrame, cap: int | None = None, keys: tuple[str, ...] = ("doc_id",), per_block: int = SHEET_ROWS_PER_BLOCK) -> DataFrame:
    """``(doc_id, sheet_no, sheet, row_no, cells)`` rows to a heading and table blocks per sheet.

    ``row_no`` is the physical row counted from 0. A table block holds ``per_block``
    physical rows, so no group grows with the sheet. With ``cap`` the rows from there
    on are left out and a marker line says so; without, every row is kept.
    """
    group = [*keys, "sheet_no"]
    blank = ~F.exists("cells", lambda c: strip_text(F.coalesce(c, F.lit(""))) != "")
    lines = rows.where(F.col("row_no").isNotNull() & ~blank)
    lines = lines.select(*group, "sheet", "row_no", pipe_row("cells").alias("line"))
    if cap is not None:
        marker = rows.where(F.col("row_no") == cap).select(*group, "sheet", "row_no", F.lit(f"... (truncated after {cap} rows)").alias("line"))
        lines = lines.where(F.col("row_no") < cap).unionByName(marker)
    number = F.col("sheet_no").cast("long")
    tables = (
        lines.groupBy(*group, F.floor(F.col("row_no") / per_block).alias("_part"))
        .agg(F.max("sheet").alias("sheet"), F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("_lines"))
        .select(*keys, (number * (1 << 32) + F.col("_part") + 1).alias("seq"), F.lit("table").alias("kind"),
                F.array_join(F.col("_lines.line"), "\n").alias("text"), F.lit(None).cast("int").alias("heading_level"), "sheet_no", "sheet")
    )
    heads = rows.groupBy(*group).agg(F.max("sheet").alias("sheet")).select(
        *keys, (number * (1 << 32)).alias("seq"), F.lit("heading").alias("kind"), F.col("sheet").alias("text"), F.lit(1).alias("heading_level"), "sheet_no", "sheet")
    return heads.unionByName(tables).select(
        *keys, "seq", "kind", "text", "heading_level", F.col("sheet_no").cast("int").alias("page_number"), F.col("sheet").alias("section_title"))


def line_groups(docs: DataFrame, lines: Column | str, size: int = LINES_PER_BLOCK, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fixed-size groups of the lines of each document, inside the row."""
    items = _c(lines)
    last = F.floor((F.size(items) - 1) / size).cast("int")
    groups = F.when(F.size(items) > 0, F.transform(
        F.sequence(F.lit(0), last), lambda g: F.array_join(F.slice(items, g * size + 1, size), "\n")
    ))
    return docs.select(*carry, F.posexplode(groups).alias("group_no", "text"))


def capped_lines(rows: DataFrame, number: str, line: str, cap: int, marker: str, at_cap: bool = False) -> DataFrame:
    """The first ``cap`` rows of a physical row numbering, then one marker row.

    ``at_cap`` marks already when exactly ``cap`` rows exist (counting formats
    that cannot look ahead); otherwise one more row is needed.
    """
    limit = cap - 1 if at_cap else cap
    kept = rows.filter(F.col(number) < cap)
    trigger = rows.filter(F.col(number) == limit).select(
        *[F.lit(cap).cast(rows.schema[c].dataType).alias(c) if c == number
          else F.lit(marker).alias(c) if c == line else F.col(c) for c in rows.columns]
    )
    return kept.unionByName(trigger)
