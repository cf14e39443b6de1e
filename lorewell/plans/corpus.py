"""Reading, measuring, chunking and de-duplicating the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import display, rules, text
from lorewell.operators import dedupe
from lorewell.operators.chunking import chunk_blocks
from lorewell.operators.encoding import batch_number
from lorewell.operators.ordered import ordered_join
from lorewell.plans import query, views
from lorewell.plans.views import SQL_CHUNKS, SQL_DOCS, sql_chunk_fold, sql_sentences, sql_text, sql_tokens, sql_trim
from lorewell.session import spread_small_scan, table
from lorewell.sources import layout, manifest, markup, plain, records
from lorewell.sources.decode import readable

_SPACE = text.SPACE_CLASS


def _texts(spark, sf_dir, *columns):
    """The documents, spread over the cores when they come as a single small file."""
    return spread_small_scan(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


# ------------------------------------------------------------------ measures

@query(f"""SELECT source, count(*) AS n_documents, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens
FROM documents GROUP BY source""")
def token_estimate_by_source(spark, sf_dir):
    return _texts(spark, sf_dir, "source").groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(text.estimate_tokens("text")).alias("tokens"))


@query(f"""SELECT doc_id, tokens FROM (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents)
ORDER BY tokens DESC, doc_id LIMIT 20""")
def longest_documents_topk(spark, sf_dir):
    return (
        _texts(spark, sf_dir).select("doc_id", text.estimate_tokens("text").alias("tokens"))
        .orderBy(F.desc("tokens"), "doc_id").limit(20)
    )


@query(f"""SELECT doc_id, pos, sentence FROM (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS sentence
  FROM (SELECT doc_id, {sql_sentences('text')} AS l FROM documents))""")
def sentence_split(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


@query(f"SELECT doc_id, len({sql_sentences('text')})::INTEGER AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


@query(f"""SELECT doc_id, sha256(text) AS checksum, substr(text, 1, 500) AS excerpt, lower({sql_trim('text')}) AS content_key,
  length({sql_trim('text')}) < 20 AS scanned FROM documents""")
def text_keys(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", text.checksum("text").alias("checksum"), text.excerpt("text").alias("excerpt"),
        text.content_key("text").alias("content_key"), text.is_scanned_page("text").alias("scanned"))


# ------------------------------------------------------------------ readers

# Inputs in which every rule fires, derived from the documents by expressions that both dialects know.
_SPACED = "replace(replace(text, '. ', concat('.', chr(10), ' ', chr(9), chr(10))), ', ', concat(',', chr(10), chr(10)))"
_MARKED = "concat(chr(10), text)"
for _first, _mark in {"E": "## ", "O": "  # ", "A": "- ", "T": "12. ", "I": "#", "L": "-", "H": "* "}.items():
    _MARKED = f"replace({_MARKED}, concat(chr(10), '{_first}'), concat(chr(10), '{_mark}{_first}'))"


@query(f"""SELECT doc_id, seq, kind, text FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS seq, 'paragraph' AS kind, {sql_trim('unnest(l)')} AS text
  FROM (SELECT doc_id, string_split_regex({_SPACED}, {sql_text(chr(10) + _SPACE + '*' + chr(10))}) AS l FROM documents))
WHERE text <> ''""")
def paragraph_blocks(spark, sf_dir):
    """The documents with a blank line, some with white space on it, behind every sentence."""
    spaced = _texts(spark, sf_dir).withColumn("text", F.expr(_SPACED))
    return plain.text_blocks(spaced).select("doc_id", "seq", "kind", "text")


_MD_HEAD = f"^#{{1,6}}{_SPACE}+"
_MD_ITEM = rf"^([-*+]|\d+\.){_SPACE}+"


@query(f"""WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, {sql_trim('unnest(p)')} AS line
  FROM (SELECT doc_id, string_split(regexp_replace({_MARKED}, {sql_text(text.LINE_BREAK)}, chr(10), 'g'), chr(10)) AS p FROM documents)),
k AS (SELECT doc_id, line_no, line,
  CASE WHEN regexp_matches(line, {sql_text(_MD_HEAD)}) THEN 'heading' WHEN regexp_matches(line, {sql_text(_MD_ITEM)}) THEN 'list_item' ELSE 'paragraph' END AS kind
  FROM l WHERE line <> ''),
t AS (SELECT *, CASE kind WHEN 'heading' THEN {sql_trim(f"regexp_replace(line, {sql_text(_MD_HEAD)}, '')")}
                          WHEN 'list_item' THEN {sql_trim(f"regexp_replace(line, {sql_text(_MD_ITEM)}, '')")} ELSE line END AS text FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS position, kind, text,
  last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title
FROM t""")
def markdown_blocks(spark, sf_dir):
    """The documents with their lines marked by first letter: headings of two levels, bullets, numbers, and marks that are none."""
    from pyspark.sql import Window

    marked = _texts(spark, sf_dir).withColumn("text", F.expr(_MARKED))
    blocks = plain.markdown_blocks(marked)
    # dense numbering for the report: a group is the lines of one stored text
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast("long")
    return blocks.select("doc_id", position.alias("position"), "kind", "text", "section_title")


# Inline form of the HTML rules, enough for the pages at hand: cut noise, find
# block starts, end each at the next block boundary, glue the text nodes.
_BLOCK_ENDS = "/?(?:h[1-6]|p|li|ul|ol|table|tr|td|th|div|article|section|header|main|body|html|form|hr|pre|blockquote|dl|figure)"


def _sql_unescape(expr: str) -> str:
    # fixed values: the entities that occur in the given pages; HTML lets these names end without a semicolon
    for entity, char in [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&copy;?", chr(0xA9)),
                         ("&nbsp;?", chr(0xA0)), ("&amp;?", "&")]:
        expr = f"regexp_replace({expr}, {sql_text(entity)}, {sql_text(char)}, 'g')"
    return expr


_NODE_GLUE = f"regexp_replace(inner_html, {sql_text(f'{_SPACE}*<[^>]*>{_SPACE}*')}, '', 'g')"


_SQL_HTML = f"""c AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '<!---->', 'g'),
    '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<footer\\b.*?</footer>|<noscript\\b.*?</noscript>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(h, '(?i)<({_BLOCK_ENDS})\\b', chr(2) || '<\\1', 'g') AS h FROM c),
s AS (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT page_id, string_split(h, chr(2)) AS p FROM m)),
b AS (SELECT page_id, i, lower(regexp_extract(piece, '(?i)^<(h[1-6]|p|li)\\b', 1)) AS tag,
        regexp_replace(piece, '^<[^>]*>', '') AS inner_html FROM s WHERE regexp_matches(piece, '(?i)^<(h[1-6]|p|li)\\b')),
t AS (SELECT page_id, i, tag, {sql_trim(_sql_unescape(sql_trim(_NODE_GLUE)))} AS text FROM b),
html AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq,
  CASE WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' ELSE 'heading' END AS kind, text,
  last_value(CASE WHEN tag LIKE 'h%' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title
  FROM t WHERE text <> '')"""


@query(f"WITH {_SQL_HTML} SELECT page_id, seq, kind, text, section_title FROM html")
def html_blocks(spark, sf_dir):
    pages = spread_small_scan(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return readable(markup.html_blocks(pages, "html", carry=("page_id",))).select("page_id", "seq", "kind", "text", "section_title")


@query(f"""WITH {_SQL_HTML}, page_blocks AS (SELECT page_id, seq AS i, kind, text AS txt, section_title AS sec FROM html),
{sql_chunk_fold('page_blocks', 'page_id', 'packed')} SELECT page_id, chunk_index, section, content, token_count FROM packed""")
def chunk_pages(spark, sf_dir):
    """Web pages chunked with their headings as sections."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    blocks = markup.html_blocks(spread_small_scan(pages, "doc_id"))
    chunks = chunk_blocks(readable(blocks), clustered=True)
    return chunks.select(F.col("doc_id").alias("page_id"), "chunk_index", F.coalesce("section", F.lit("")).alias("section"), "content", "token_count")


@query("""SELECT event_id, CAST(0 AS BIGINT) AS seq, 'table' AS kind, 'k: ' || json_extract_string(props, '$.k') AS text FROM events""")
def json_path_lines(spark, sf_dir):
    return records.json_blocks(table(spark, sf_dir, "events").select("event_id", "props"), "props", carry=("event_id",)).select(
        "event_id", "seq", "kind", "text")


@query("""SELECT doc_id, CAST((i - 1) // 50 AS INTEGER) AS group_no, string_agg(line, chr(10) ORDER BY i) AS text FROM (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
GROUP BY ALL""")
def line_groups_50(spark, sf_dir):
    return records.line_groups(table(spark, sf_dir, "documents"), F.split("text", "\n"))


_SHEETS = [
    ("region", 1, "r_regionkey", ["r_regionkey", "r_name"]),
    ("nation", 2, "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    ("supplier", 3, "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"]),
    ("part", 4, "p_partkey", ["p_partkey", "p_name", "p_brand", "p_size"]),
    ("orders", 5, "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
]


def _sheet_sql() -> str:
    parts = []
    for name, number, key, cells in _SHEETS:
        line = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cells)
        parts.append(f"""SELECT CAST({number << 32} AS BIGINT) AS seq, {number} AS page_number, 'heading' AS kind, '{name}' AS text
UNION ALL SELECT {number << 32} + 1 + {key} // 1000, {number}, 'table', string_agg({line}, chr(10) ORDER BY {key}) FROM {name} GROUP BY {key} // 1000""")
    return "\nUNION ALL ".join(parts)


@query(_sheet_sql())
def table_as_pipe_block(spark, sf_dir):
    """Five tables as the sheets of one workbook; the key numbers the physical rows from 0."""
    sheets = None
    for name, number, key, cells in _SHEETS:
        rows = table(spark, sf_dir, name).select(
            F.lit("workbook").alias("doc_id"), F.lit(number).alias("sheet_no"), F.lit(name).alias("sheet"),
            F.col(key).cast("long").alias("row_no"), F.array(*[F.col(c).cast("string") for c in cells]).alias("cells"))
        sheets = rows if sheets is None else sheets.unionByName(rows)
    return records.sheet_blocks(sheets).select("seq", "page_number", "kind", "text")


@query("""SELECT c_nationkey AS doc_id, string_agg(CAST(c_custkey AS VARCHAR) || ' | ' || c_name || ', "' || c_mktsegment || '"' || chr(10) || 'x | 5" pipe', chr(10) ORDER BY c_custkey) AS text
FROM customer GROUP BY c_nationkey""")
def csv_table_block(spark, sf_dir):
    """Customers of a nation as one CSV text of one of four dialects, with quotes, separators and line ends in cells, stray quotes, and blank rows."""
    sep = F.element_at(F.array(*map(F.lit, records.SEPARATORS)), F.col("c_nationkey").cast("int") % 4 + 1)
    row = F.concat(F.col("c_custkey").cast("string"), sep, F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""\nx"'), sep, F.lit('5" pipe\n'), sep, sep, F.lit("\n"))
    files = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda r: r["row"]), "").alias("text"))
    return records.csv_blocks(files, sep=None).select("doc_id", "text")


# What every fifth nation's text is wrapped in, and what a reader says to it.
_BROKEN_XML = {1: ("<a><b>", "</a></b>", "tags do not balance"), 2: ("<a x=1>", "</a>", "a tag is not well-formed"), 3: ("", "</r><r>", "more than one root"), 4: ("a & b", "", "an ampersand stands alone")}


@query(f"""WITH l AS (SELECT c_nationkey AS doc_id, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS BIGINT) AS seq, c_custkey,
  'name: ' || c_name || ' & ' || c_mktsegment AS line FROM customer WHERE c_nationkey % 5 = 0)
SELECT doc_id, seq, string_agg(line, chr(10) ORDER BY c_custkey) AS text, NULL AS error FROM l GROUP BY doc_id, seq
UNION ALL SELECT DISTINCT c_nationkey, 0, NULL, 'Could not parse XML: ' || CASE c_nationkey % 5 {" ".join(f"WHEN {k} THEN '{why}'" for k, (_, _, why) in _BROKEN_XML.items())} END
FROM customer WHERE c_nationkey % 5 > 0""")
def xml_line_blocks(spark, sf_dir):
    """Customers of a nation as one XML text with prefixes, comments, entities and empty elements; four of five are not well-formed."""
    item = F.concat(F.lit("<p:item k='1'><!-- <name>no</name> --><p:name> "), "c_name", F.lit(" &amp; "), "c_mktsegment", F.lit(" </p:name><none/></p:item>"))
    files = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", item.alias("item")))), lambda r: r["item"]), "").alias("items"))
    body = F.col("items")
    for k, (before, after, _) in _BROKEN_XML.items():
        body = F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(before), "items", F.lit(after))).otherwise(body)
    texts = files.select("doc_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><r xmlns:p="urn:x">'), body, F.lit("</r>")).alias("text"))
    return markup.xml_blocks(texts).select("doc_id", "seq", "text", "error")


@query("""SELECT o_orderkey AS row_no, o_orderpriority AS line FROM orders WHERE o_orderkey < 5000
UNION ALL SELECT CAST(5000 AS BIGINT), '... (truncated after 5000 rows)' FROM orders WHERE o_orderkey = 5000""")
def row_cap_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("line"))
    return records.capped_lines(rows, "row_no", "line", 5000, "... (truncated after 5000 rows)")


# Decoded layouts derived from the texts: every line of a document is a styled
# paragraph, a slide line or a page line.

def _lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))


_SQL_LINES = """lines AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS n, unnest(p) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"""


@query(f"""WITH {_SQL_LINES},
b AS (SELECT doc_id, n, {sql_trim('text')} AS text, length(text) % 7 AS m FROM lines WHERE {sql_trim('text')} <> ''),
k AS (SELECT *, CASE WHEN m = 0 THEN 'heading' WHEN m = 1 THEN 'list_item' ELSE 'paragraph' END AS kind,
  CASE WHEN m = 0 THEN 1 + n % 3 END AS heading_level FROM b),
f AS (SELECT doc_id, CAST(n AS BIGINT) AS seq, kind, text, CAST(coalesce(heading_level, 0) AS INTEGER) AS heading_level,
  last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM k)
SELECT * FROM f UNION ALL
SELECT d.doc_id, {1 << 40}, 'table', 'lang | ' || d.lang || chr(10) || 'source | ' || d.source, 0, h.section_title
FROM documents d LEFT JOIN (SELECT doc_id, arg_max(text, seq) AS section_title FROM f WHERE kind = 'heading' GROUP BY doc_id) h USING (doc_id)""")
def styled_paragraph_blocks(spark, sf_dir):
    m = F.char_length("text") % 7
    style = F.when(m == 0, F.concat(F.lit("Heading "), (1 + F.col("n") % 3).cast("string"))).when(m == 1, "List Bullet").otherwise("Normal")
    paragraphs = _lines(spark, sf_dir).withColumn("style", style)
    grids = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(0).alias("n"),
        F.array(F.array(F.lit("lang"), F.col("lang")), F.array(F.lit("source"), F.col("source"))).alias("rows"))
    blocks = layout.styled_paragraph_blocks(paragraphs, grids).drop("page_number")
    return blocks.withColumn("heading_level", F.coalesce("heading_level", F.lit(0)))


@query(f"""WITH {_SQL_LINES},
s AS (SELECT doc_id, n, CAST(n // 6 + 1 AS INTEGER) AS slide, n % 6 AS r, {sql_trim('text')} AS text FROM lines WHERE {sql_trim('text')} <> ''),
t AS (SELECT doc_id, slide, text AS title FROM s WHERE r = 0)
SELECT s.doc_id, s.slide AS page_number, CAST(row_number() OVER (PARTITION BY s.doc_id, s.slide ORDER BY s.r) AS INTEGER) AS position,
  CASE WHEN r = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN r = 5 THEN '[Speaker notes] ' ELSE '' END || text AS text, t.title AS section_title
FROM s LEFT JOIN t USING (doc_id, slide)""")
def slide_blocks(spark, sf_dir):
    place = F.col("n") % 6
    role = F.when(place == 0, "title").when(place == 5, "notes").otherwise("body")
    shapes = _lines(spark, sf_dir).select(
        "doc_id", (F.floor(F.col("n") / 6) + 1).cast("int").alias("slide"), place.alias("shape_no"), F.lit(0).alias("para_no"),
        role.alias("role"), "text")
    return layout.slide_blocks(shapes).select(
        "doc_id", "page_number", (F.col("seq") % (1 << 32)).cast("int").alias("position"), "kind", "text", "section_title")


_SIZE_SQL = "CASE WHEN length(text) % 9 = 0 THEN 18.0 WHEN length(text) % 9 = 1 THEN 14.0 WHEN length(text) % 2 = 0 THEN 10.2 ELSE 9.0 END"


@query(f"""WITH {_SQL_LINES},
p AS (SELECT doc_id, n // 40 + 1 AS page, n % 40 AS line, text, {_SIZE_SQL} AS size FROM lines),
c AS (SELECT doc_id, page, CAST(round(size) AS INTEGER) AS s, count(*) AS k FROM p GROUP BY ALL),
m AS (SELECT doc_id, page, s AS body FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY k DESC, s) = 1),
l AS (SELECT p.doc_id, p.page, p.line, {sql_trim('p.text')} AS text,
  CASE WHEN size >= body * 1.6 THEN 1 WHEN size >= body * 1.3 THEN 2 END AS heading_level FROM p JOIN m USING (doc_id, page) WHERE {sql_trim('p.text')} <> '')
SELECT doc_id, CAST(page AS INTEGER) AS page_number, CAST(line AS INTEGER) AS line, coalesce(heading_level, 0) AS heading_level, text,
  last_value(CASE WHEN heading_level IS NOT NULL THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title
FROM l""")
def span_blocks(spark, sf_dir):
    """Lines as font spans, 40 to a page; the size follows from the length."""
    n = F.char_length("text")
    size = F.when(n % 9 == 0, 18.0).when(n % 9 == 1, 14.0).when(n % 2 == 0, 10.2).otherwise(9.0)
    spans = _lines(spark, sf_dir).select(
        "doc_id", (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), F.lit(0).alias("block"),
        (F.col("n") % 40).alias("line"), F.lit(0).alias("span"), size.alias("size"), "text")
    return layout.span_blocks(spans).select(
        "doc_id", "page_number", (F.col("seq") % (1 << 20)).cast("int").alias("line"),
        F.coalesce("heading_level", F.lit(0)).alias("heading_level"), "text", "section_title")


@query(f"""WITH {_SQL_LINES} SELECT doc_id, count(DISTINCT n // 40) AS page_count, count(*) AS n_lines FROM lines GROUP BY doc_id""")
def page_counts(spark, sf_dir):
    pages = _lines(spark, sf_dir).withColumn("page", F.floor(F.col("n") / 40))
    return layout.page_counts(pages).withColumnRenamed("n_blocks", "n_lines")


@query(f"""WITH {_SQL_LINES} SELECT doc_id, n // 40 + 1 AS page_number, CAST(n AS BIGINT) AS seq, text FROM lines""")
def pages_flattened(spark, sf_dir):
    """Documents stored as nested pages of lines, flattened in page and line order."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int")), lambda p: F.struct(
        (p + 1).alias("page_number"), F.slice(lines, p * 40 + 1, 40).alias("blocks")))
    nested = table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"))
    return layout.flatten_pages(nested).withColumnRenamed("block", "text")


@query("""WITH v AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT source, lang AS detected_language FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1""")
def language_vote(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "lang")
    return layout.language_votes(pages, ["source"])


@query("""SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'view' THEN value END), 0.0), 6) AS mean_confidence FROM events GROUP BY user_id""")
def mean_confidence(spark, sf_dir):
    conf = F.when(F.col("event_type") == "view", F.lit(-1.0)).otherwise(F.col("value"))
    words = table(spark, sf_dir, "events").select("user_id", conf.alias("conf"))
    return layout.mean_confidence(words, ["user_id"]).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""WITH p AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 90.0 ELSE 30.0 END * length(text) AS en,
  CASE WHEN lang IN ('de', 'fr') THEN 80.0 ELSE 10.0 END * length(source) * 100 AS hi FROM documents)
SELECT doc_id, CASE WHEN en = 0 AND hi = 0 THEN 'en' WHEN en / (hi + 1e-9) > 0.4 AND en / (hi + 1e-9) < 2.5 THEN 'en+hi' WHEN en > hi THEN 'en' ELSE 'hi' END AS page_language FROM p""")
def page_language(spark, sf_dir):
    conf_en = F.when(F.col("lang").isin("en", "fr"), 90.0).otherwise(30.0)
    conf_hi = F.when(F.col("lang").isin("de", "fr"), 80.0).otherwise(10.0)
    return table(spark, sf_dir, "documents").select(
        "doc_id", rules.page_language(conf_en, F.col("text"), conf_hi, F.repeat("source", F.lit(100))).alias("page_language"))


# ------------------------------------------------------------------ ingest

_FILE_ENDS = [".pdf", ".MD", ".html", "", ".exe", ".tar.json"]
_SQL_NAME = "'doc-' || CAST(doc_id AS VARCHAR) || " + "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_FILE_ENDS)) + " END"


def _named_files(spark, sf_dir):
    ends = F.create_map(*[F.lit(x) for i, e in enumerate(_FILE_ENDS) for x in (i, e)])[(F.col("doc_id") % 6).cast("int")]
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), ends).alias("name"), F.col("n_chars").alias("length"), "text", "source")


@query(f"""WITH f AS (SELECT doc_id, {_SQL_NAME} AS name, n_chars FROM documents),
e AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) END AS ext FROM f)
SELECT doc_id, name, ext AS extension, CASE ext WHEN 'md' THEN 'markdown' WHEN 'exe' THEN NULL ELSE ext END AS file_type,
  CASE WHEN ext IS NULL THEN 'no extension' WHEN ext = 'exe' THEN 'extension not allowed: exe' WHEN n_chars <= 0 THEN 'file is empty'
       WHEN n_chars > 20000 THEN 'file too large' END AS reject_reason FROM e""")
def upload_quality_gate(spark, sf_dir):
    files = manifest.with_file_types(_named_files(spark, sf_dir))
    return files.withColumn("reject_reason", rules.upload_rejection("name", "length", 20_000)).select(
        "doc_id", "name", "extension", "file_type", "reject_reason")


@query(f"""WITH f AS (SELECT doc_id, source, {_SQL_NAME} AS name FROM documents)
SELECT doc_id, 'uploads/' || source || '/' || CAST(doc_id AS VARCHAR) || '/' || name AS storage_key FROM f""")
def storage_keys(spark, sf_dir):
    return _named_files(spark, sf_dir).select("doc_id", rules.storage_key("uploads", "source", "doc_id", "name").alias("storage_key"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'png' END AS sniffed,
  CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'txt' END AS declared,
  (doc_id % 3 = 0 AND doc_id % 4 IN (1, 2)) OR (doc_id % 3 = 1 AND doc_id % 4 IN (0, 2)) AS mismatch FROM documents""")
def signature_check(spark, sf_dir):
    """Texts with the leading bytes of a format in front, declared as one of three types."""
    lead = F.create_map(*[F.lit(x) for x in (0, "255044462D", 1, "504B0304", 2, "89504E470D")])[(F.col("doc_id") % 4).cast("int")]
    content = F.concat(F.unhex(F.coalesce(lead, F.lit(""))), F.col("text").cast("binary"))
    declared = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", rules.sniffed_type(content).alias("sniffed"), declared.alias("declared"),
        rules.signature_mismatch(declared, content).alias("mismatch"))


@query(f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, token_count, content, sha256(content) AS checksum FROM chunks")
def chunk_corpus(spark, sf_dir):
    return views.corpus_chunks(spark, sf_dir).select("doc_id", "chunk_index", "token_count", "content", "checksum")


@query(f"""WITH RECURSIVE lines AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, {sql_trim('unnest(p)')} AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, txt, {sql_tokens('txt')} AS tk FROM lines WHERE txt <> ''),
-- step(i): chunk number and running tokens after block i; blocks over the size stay whole here
walk AS (
  SELECT doc_id, i, tk, 0 AS chunk_no, tk AS run FROM b WHERE i = 1
  UNION ALL
  SELECT b.doc_id, b.i, b.tk, CASE WHEN w.run + b.tk > 512 THEN w.chunk_no + 1 ELSE w.chunk_no END,
         CASE WHEN w.run + b.tk > 512 THEN b.tk ELSE w.run + b.tk END
  FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
SELECT w.doc_id, CAST(w.chunk_no AS INTEGER) AS chunk_index, string_agg(b.txt, chr(10) || chr(10) ORDER BY b.i) AS content
FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i GROUP BY w.doc_id, w.chunk_no""")
def chunk_pack_paragraphs(spark, sf_dir):
    """Packing without overlap, over-long blocks kept whole as tables are."""
    docs = _texts(spark, sf_dir)
    blocks = plain.markdown_blocks(docs).withColumn("tk", text.estimate_tokens("text"))
    whole = blocks.withColumn("kind", F.when(F.col("tk") > 512, "table").otherwise(F.col("kind")))
    return chunk_blocks(whole, overlap=0, clustered=True).select("doc_id", "chunk_index", "content")


@query(f"""WITH {SQL_CHUNKS},
h AS (SELECT kb_id, chunk_id, sha256(content) AS checksum FROM chunks)
SELECT kb_id, checksum, min(chunk_id) AS keep_id, count(*) AS copies FROM h GROUP BY kb_id, checksum""")
def checksum_dedupe(spark, sf_dir):
    return dedupe.checksum_groups(views.corpus_chunks(spark, sf_dir), ["kb_id"], "chunk_id", "content")


@query("SELECT min(doc_id) AS doc_id, any_value(sha256(text)) AS checksum FROM documents GROUP BY sha256(text)")
def documents_without_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe.drop_copies(docs, [], "doc_id", "text").select("doc_id", text.checksum("text").alias("checksum"))


@query(f"""WITH {SQL_CHUNKS}, n AS (SELECT doc_id, count(*) AS total FROM chunks GROUP BY doc_id)
SELECT c.doc_id, c.chunk_index, CAST(c.chunk_index // 100 AS INTEGER) AS batch_no,
  CAST(least(60 + CAST(trunc(30.0::DOUBLE * least((c.chunk_index // 100 + 1) * 100, n.total) / n.total) AS INTEGER), 90) AS INTEGER) AS progress
FROM chunks c JOIN n USING (doc_id)""")
def progress_pct(spark, sf_dir):
    """Progress shown after the encoder call each chunk belongs to."""
    chunks = views.corpus_chunks(spark, sf_dir).select("doc_id", "chunk_index")
    totals = chunks.groupBy("doc_id").agg(F.count("*").alias("total"))
    batch = batch_number("chunk_index")
    done = F.least((batch + 1) * 100, F.col("total"))
    return chunks.join(totals, "doc_id").select(
        "doc_id", "chunk_index", batch.alias("batch_no"), rules.ingest_progress(done, "total").alias("progress"))


@query(f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, n AS (SELECT doc_id, count(*) AS chunk_count, sum(token_count) AS tokens FROM chunks GROUP BY doc_id)
SELECT d.doc_id, d.kb_id, coalesce(n.chunk_count, 0) AS chunk_count, CAST(coalesce(n.tokens, 0) AS BIGINT) AS tokens,
  CASE WHEN n.chunk_count IS NULL THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN n.chunk_count IS NULL THEN 'No extractable text content found' END AS status_detail
FROM docs d LEFT JOIN n USING (doc_id)""")
def ingest_documents(spark, sf_dir):
    """Extract, chunk, count: a document without chunks has failed, with the reason."""
    from lorewell.operators.ingest import finalise

    return finalise(views.documents(spark, sf_dir).select("doc_id", "kb_id"), views.corpus_chunks(spark, sf_dir)).select(
        "doc_id", "kb_id", "chunk_count", "tokens", "status", "status_detail")


@query(f"""WITH {SQL_CHUNKS}
SELECT kb_id, count(*) AS n_chunks, count(*) FILTER (WHERE length({sql_trim('content')}) = 0) AS blank,
  count(*) FILTER (WHERE chunk_index < 0) AS bad_index, count(DISTINCT doc_id) AS n_documents FROM chunks GROUP BY kb_id""")
def chunk_invariants(spark, sf_dir):
    """Per knowledge base: no blank chunk, dense numbering, stored equal to recomputed token counts."""
    chunks = views.corpus_chunks(spark, sf_dir)
    per_doc = chunks.groupBy("kb_id", "doc_id").agg(
        F.count("*").alias("n"), F.max("chunk_index").alias("last"),
        F.count_if(text.strip_text("content") == "").alias("blank"),
        F.count_if(F.col("token_count") != text.estimate_tokens("content")).alias("wrong"))
    return per_doc.groupBy("kb_id").agg(
        F.sum("n").alias("n_chunks"), F.sum("blank").alias("blank"),
        (F.count_if(F.col("last") + 1 != F.col("n")) + F.sum("wrong")).alias("bad_index"), F.count("*").alias("n_documents"))


@query("""SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS joined, count(*) AS n_blocks FROM (
  SELECT doc_id, generate_subscripts(p, 1) AS i, """ + sql_trim("unnest(p)") + """ AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
WHERE line <> '' GROUP BY doc_id""")
def blocks_joined(spark, sf_dir):
    """Blocks of a document glued back in order; a group is one stored text."""
    blocks = plain.markdown_blocks(_texts(spark, sf_dir))
    return blocks.groupBy("doc_id").agg(ordered_join("seq", "\n\n").alias("joined"), F.count("*").alias("n_blocks"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1024 THEN printf('%.1f', round(n_chars / 1024.0::DOUBLE * 10) / 10) || ' KB' ELSE CAST(n_chars AS VARCHAR) || ' B' END AS shown_size
FROM documents""")
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", display.human_bytes("n_chars").alias("shown_size"))


@query("""WITH m AS (SELECT event_id, ts, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 60000000 AS minutes FROM events)
SELECT event_id, CASE WHEN minutes < 1 THEN 'just now' WHEN minutes < 60 THEN CAST(minutes AS VARCHAR) || 'm ago'
  WHEN minutes // 60 < 24 THEN CAST(minutes // 60 AS VARCHAR) || 'h ago' WHEN minutes // 1440 < 30 THEN CAST(minutes // 1440 AS VARCHAR) || 'd ago'
  ELSE strftime(ts, '%Y-%m-%d') END AS age FROM m""")
def relative_age(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", display.relative_age("ts", views.last_event(spark, sf_dir)).alias("age"))
