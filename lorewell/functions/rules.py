"""Acceptance rules, file typing and layout rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import _c

MAX_UPLOAD_BYTES = 200 * 1024 * 1024

# File extension -> file type.
EXTENSION_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "txt": "txt", "csv": "csv", "xlsx": "xlsx", "xls": "xls",
    "pptx": "pptx", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xml": "xml",
    "json": "json", "rtf": "rtf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image",
    "bmp": "image", "zip": "zip",
}
# Leading bytes (hex) -> detected format.
SIGNATURES = [
    ("25504446", "pdf"), ("504B0304", "zip"), ("89504E47", "png"), ("FFD8FF", "jpg"), ("47494638", "gif"),
    ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"),
]
# Formats whose detected type may appear under each declared type.
DETECTED_ALLOWED = {
    "pdf": ["pdf"], "docx": ["docx", "zip"], "pptx": ["pptx", "zip"], "xlsx": ["xlsx", "zip"], "zip": ["zip"],
    "image": ["png", "jpg", "jpeg", "tiff", "bmp", "gif", "webp"],
}
# Languages and the score band in which both count as present.
OCR_BALANCED = (0.4, 2.5)
# Size over body size -> heading level.
HEADING_RATIOS = ((1.6, 1), (1.3, 2))


def extension(name: Column | str) -> Column:
    """Lower-cased text after the last dot; NULL without a dot."""
    found = F.regexp_extract(_c(name), r"(?s)^.*\.([^.]*)\z", 1)
    return F.when(F.contains(_c(name), F.lit(".")), F.lower(found))


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[key]


def file_type(name: Column | str) -> Column:
    return _lookup(EXTENSION_TYPES, extension(name))


def upload_rejection(name: Column | str, size: Column | str, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """Reason why an upload is refused; NULL when it is accepted."""
    ext, n = extension(name), _c(size)
    return (
        F.when(ext.isNull(), F.lit("no extension"))
        .when(~ext.isin(list(EXTENSION_TYPES)), F.concat(F.lit("extension not allowed: "), ext))
        .when(n <= 0, F.lit("file is empty"))
        .when(n > max_bytes, F.lit("file too large"))
    )


def sniffed_type(content: Column | str) -> Column:
    """Format shown by the leading bytes; NULL for text formats, which have none."""
    head = F.hex(F.substring(_c(content), 1, 12))
    out = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    for prefix, kind in SIGNATURES:
        out = out.when(F.startswith(head, F.lit(prefix)), F.lit(kind))
    return out


def signature_mismatch(declared_type: Column | str, content: Column | str) -> Column:
    """True when detectable content contradicts the declared type."""
    kind, found = _c(declared_type), sniffed_type(content)
    bad = F.lit(False)
    for declared, allowed in DETECTED_ALLOWED.items():
        bad = F.when(kind == declared, found.isNotNull() & ~found.isin(allowed)).otherwise(bad)
    return F.coalesce(bad, F.lit(False))


def storage_key(prefix: str, owner: Column | str, doc: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", F.lit(prefix), _c(owner), _c(doc), F.regexp_replace(_c(name), r"[/\\]", "_"))


def page_language(conf_en: Column | str, text_en: Column | str, conf_hi: Column | str, text_hi: Column | str) -> Column:
    """Two recognition passes scored by confidence times length."""
    en = _c(conf_en) * F.char_length(_c(text_en))
    hi = _c(conf_hi) * F.char_length(_c(text_hi))
    ratio = en / (hi + F.lit(1e-9))
    low, high = OCR_BALANCED
    return (
        F.when((en == 0) & (hi == 0), F.lit("en"))
        .when((ratio > low) & (ratio < high), F.lit("en+hi"))
        .when(en > hi, F.lit("en"))
        .otherwise("hi")
    )


def heading_level_from_size(size: Column | str, body: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for ratio, level in reversed(HEADING_RATIOS):
        out = F.when(_c(size) >= _c(body) * F.lit(ratio), F.lit(level)).otherwise(out)
    return out


def heading_level_from_style(style: Column | str) -> Column:
    """``Heading N`` gives N (1 without a number), ``Title`` gives 1, else NULL."""
    name = F.lower(_c(style))
    digits = F.regexp_replace(name, r"\D", "")
    return (
        F.when(F.startswith(name, F.lit("heading")), F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(1)))
        .when(name == "title", F.lit(1))
    )


def is_list_style(style: Column | str) -> Column:
    name = F.lower(F.coalesce(_c(style), F.lit("")))
    return F.startswith(name, F.lit("list")) | F.startswith(name, F.lit("bullet"))


def ingest_progress(done: Column | str, total: Column | str) -> Column:
    """60..90 while vectors are written."""
    return F.least(F.lit(60) + (F.lit(30) * _c(done) / _c(total)).cast("int"), F.lit(90))


def is_still_processing(status: Column | str) -> Column:
    return ~_c(status).isin("completed", "failed")


def is_blocked(suspended: Column | str, active: Column | str) -> Column:
    return _c(suspended) | ~_c(active)
