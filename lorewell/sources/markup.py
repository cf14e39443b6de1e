"""HTML and XML decoders over the standard-library parsers."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import strip_text
from lorewell.sources.decode import as_text, decode_documents

# Elements dropped with everything inside them.
NOISE = frozenset(["script", "style", "nav", "footer", "noscript"])
HEADINGS = {f"h{n}": n for n in range(1, 7)}
WANTED = frozenset([*HEADINGS, "p", "li", "table"])
# Elements without content, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul li td th tr".split()
)
# Which open element a new one ends, and the element the search stops at.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
LINES_PER_BLOCK = 50


class _Tree(HTMLParser):
    """Element tree as ``[tag, children]``; text nodes are plain strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.open = [self.root]
        self.text_open = False

    def _close(self, targets, barriers=()):
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth][0]
            if tag in targets:
                del self.open[depth:]
                return
            if tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        self.text_open = False
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), ("td", "th", "li", "table"))
        if tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self.open.pop()
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.text_open = False
        self._close((tag,), ("table",) if tag not in ("table", "body", "html") else ())

    def handle_comment(self, data):
        self.text_open = False

    def handle_data(self, data):
        kids = self.open[-1][1]
        if self.text_open:
            kids[-1] += data
        else:
            kids.append(data)
            self.text_open = True


def _texts(node, out):
    stack = list(reversed(node[1]))
    while stack:
        kid = stack.pop()
        if isinstance(kid, str):
            kid = kid.strip()
            if kid:
                out.append(kid)
        elif kid[0] not in NOISE:
            stack.extend(reversed(kid[1]))
    return out


def _find(node, names, nested):
    """Matching elements in document order, without those inside noise."""
    stack = list(reversed(node[1]))
    while stack:
        kid = stack.pop()
        if isinstance(kid, str) or kid[0] in NOISE:
            continue
        hit = kid[0] in names
        if hit:
            yield kid
        if nested or not hit:
            stack.extend(reversed(kid[1]))


def html_decoder(compat: bool = True):
    """``compat`` joins the text nodes of an element without a separator and
    also emits matches nested in other matches; otherwise nodes are joined by a
    space and only the outermost match is emitted."""
    glue = "" if compat else " "

    def decode(content):
        tree = _Tree()
        tree.feed(as_text(content))
        tree.close()
        top = next(_find(tree.root, ("body",), False), tree.root)
        section = None
        for node in _find(top, WANTED, compat):
            tag = node[0]
            if tag == "table":
                rows = [
                    [glue.join(_texts(cell, [])) for cell in _find(row, ("td", "th"), compat)]
                    for row in _find(node, ("tr",), compat)
                ]
                text = "\n".join(" | ".join(cells) for cells in rows if any(cells))
            else:
                text = glue.join(_texts(node, []))
            if not text:
                continue
            if tag in HEADINGS:
                section = text
                yield "heading", text, HEADINGS[tag], None, section
            else:
                kind = {"li": "list_item", "table": "table"}.get(tag, "paragraph")
                yield kind, text, None, None, section

    return decode


def html_blocks(
    docs: DataFrame, content: str = "html", carry: tuple[str, ...] = ("doc_id",), compat: bool = True
) -> DataFrame:
    return decode_documents(docs, html_decoder(compat), content, carry)


def grouped(lines: list[str], kind: str):
    """Blocks of 50 lines."""
    for start in range(0, len(lines), LINES_PER_BLOCK):
        yield kind, "\n".join(lines[start:start + LINES_PER_BLOCK]), None, None, None


# An opening tag, its prefix left out, and the text up to the next tag.
_OPENING = r"<(?:[A-Za-z_][\w.\-]*:)?([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?(?<!/)>([^<]+)"
_UTF8_NAMES = ("", "utf-8", "utf8", "us-ascii", "ascii")


# Comments, raw character data, instructions, tags with their quoted values, text between them, a stray opening.
_TOKEN = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<"
# Private characters that stand for markup characters which are text.
_MASKS = "\ue005\ue006\ue007"


def _masked(raw: Column) -> Column:
    """The text without comments, and with markup characters of raw data and attribute values masked."""

    def token(t: Column) -> Column:
        inner = F.translate(F.substring(t, F.lit(2), F.length(t) - 2), "<>", _MASKS[1:])
        return (
            F.when(t.startswith("<!--") & t.endswith("-->"), "<!---->")
            .when(t.startswith("<![CDATA[") & t.endswith("]]>"), F.translate(F.substring(t, F.lit(10), F.length(t) - 12), "&<>", _MASKS))
            .when(t.startswith("<") & t.endswith(">"), F.concat(F.lit("<"), inner, F.lit(">")))
            .otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0)), token), "")


def _numeric(text: Column) -> Column:
    """Numeric entities as characters, an ampersand masked; what names no character stays."""

    def one(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^&#x0*([0-9A-Fa-f]{1,6});$", 1)
        decimal = F.regexp_extract(t, r"^&#0*([0-9]{1,7});$", 1)
        code = F.conv(F.when(digits != "", digits).otherwise(F.conv(decimal, 10, 16)), 16, 10).cast("int")
        valid = (code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid & (code == 38), _MASKS[0]).when(valid, char).otherwise(t)

    found = F.transform(F.regexp_extract_all(text, F.lit(r"&#[^;&]*;|[^&]+|&"), F.lit(0)), lambda t: F.when(t.startswith("&#"), one(t)).otherwise(t))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(found, "")).otherwise(text)


def xml_text(content: Column) -> Column:
    """The text of an XML file: Latin-1 where it is stated, without the declaration then; UTF-8 otherwise."""
    latin = F.decode(content, "ISO-8859-1")
    stated = F.lower(F.regexp_extract(latin, r"^\s*<\?xml[^>]*encoding=[\"']([^\"']*)", 1))
    return F.when(stated.isin("iso-8859-1", "latin-1", "latin1"), F.regexp_replace(latin, r"^\s*<\?xml[^>]*>", "")).otherwise(F.make_valid_utf8(content.cast("string")))


def _resolved(text: Column) -> Column:
    text = _numeric(text)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.translate(text, _MASKS, "&<>")


_NAME = r"[A-Za-z_:][\w:.\-]*+"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+')"
# Instructions and declarations; closing tags; opening and empty ones with well-formed attributes.
_WELL_FORMED = rf"^(?:<[?!].*|</{_NAME}\s*+>|<{_NAME}(?:\s++{_NAME}\s*+=\s*+{_VALUE})*+\s*+/?>)$"
_LOOSE_AMPERSAND = r"&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"


def _nesting_fault(flat: Column) -> Column:
    """Why the tags of a masked text are no XML document, or null: the open tags are folded as one path."""
    tokens = F.regexp_extract_all(flat, F.lit(r"<[^<>]*>|[^<]+|<"), F.lit(0))
    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("roots"), F.lit(None).cast("string").alias("fault"))

    def step(at: Column, token: Column) -> Column:
        name = F.concat(F.lit("/"), F.regexp_extract(token, rf"^</?({_NAME})", 1), F.lit(">"))
        opens = F.rlike(token, F.lit("^<[A-Za-z_:]"))
        empty = opens & token.endswith("/>")
        closes = token.startswith("</")
        outside = at["path"] == ""
        fault = (
            F.when(token.startswith("<") & ~F.rlike(token, F.lit("(?s)" + _WELL_FORMED)), "a tag is not well-formed")
            .when(closes & ~at["path"].endswith(name), "tags do not balance")
            .when(opens & outside & (at["roots"] > 0), "more than one root")
            .when(~token.startswith("<") & outside & (strip_text(token) != ""), F.when(at["roots"] > 0, "text outside the root").otherwise("tags do not balance")))
        path = (
            F.when(opens & ~empty, F.concat(at["path"], name))
            .when(closes, F.substring(at["path"], F.lit(1), F.length(at["path"]) - F.length(name))).otherwise(at["path"]))
        return F.when(at["fault"].isNotNull(), at).otherwise(F.struct(
            path.alias("path"), (at["roots"] + F.when(opens & outside, 1).otherwise(0)).alias("roots"), fault.alias("fault")))

    def verdict(at: Column) -> Column:
        return F.coalesce(at["fault"], F.when(at["path"] != "", "tags do not balance").when(at["roots"] == 0, "no root"))

    return F.aggregate(tokens, start, step, verdict)


def xml_blocks(docs: DataFrame, content: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``tag: text`` for every element with own text, 50 per block, by expressions only.

    Prefixes are left out, the five named and numeric entities are resolved, and sections of raw
    character data are read as text. A document that is not well-formed (nesting, attributes, one
    root, loose ampersands), or that states another encoding than UTF-8, gives one row with ``error`` set.
    """
    raw = F.col(content).cast("string")
    docs = docs.withColumn("_flat", _masked(raw))
    flat = F.col("_flat")
    tag, text = (F.regexp_extract_all(flat, F.lit(_OPENING), F.lit(g)) for g in (1, 2))
    pairs = F.filter(F.arrays_zip(tag.alias("tag"), F.transform(text, lambda t: strip_text(_resolved(t))).alias("text")), lambda p: p["text"] != "")
    lines = F.transform(pairs, lambda p: F.concat(p["tag"], F.lit(": "), p["text"]))
    encoding = F.lower(F.regexp_extract(raw, r"^\s*<\?xml[^>]*encoding=[\"']([^\"']*)", 1))
    fault = F.when(F.rlike(flat, F.lit(_LOOSE_AMPERSAND)), "an ampersand stands alone").otherwise(_nesting_fault(flat))
    error = F.concat(F.lit("Could not parse XML: "), F.when(~encoding.isin(*_UTF8_NAMES), F.concat(F.lit("encoding "), encoding)).otherwise(fault))
    found = docs.where(raw.isNotNull()).select(*carry, error.alias("error"), lines.alias("_lines"))
    groups = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("string"))).when(F.size("_lines") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / LINES_PER_BLOCK).cast("int")),
        lambda g: F.array_join(F.slice("_lines", g * LINES_PER_BLOCK + 1, LINES_PER_BLOCK), "\n")))
    return found.select(*carry, "error", F.posexplode(groups).alias("seq", "text")).select(
        *carry, F.col("seq").cast("long").alias("seq"), F.when(F.col("error").isNull(), "paragraph").alias("kind"), "text",
        F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("section_title"), "error")
