"""Presentation values shown next to results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import _c

# Size units, each 1024 times the one before.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


# Our own wording for the stored statuses.
STATUS_LABELS = {
    "pending": "waiting", "virus_scanning": "checking", "extracting": "reading", "ocr_processing": "recognising text",
    "chunking": "splitting", "embedding": "encoding", "completed": "ready", "failed": "failed",
}


def status_label(status: Column | str) -> Column:
    """Shown status; an unknown one is shown as stored."""
    known = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(known[_c(status)], _c(status))


def human_bytes(col: Column | str) -> Column:
    n = _c(col)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        size = F.lit(float(1024 ** power))
        # decimal keeps the exact quotient, so a tie rounds up as in the UI
        shown = F.round((n / size).cast("decimal(30,12)"), 1).cast("decimal(20,1)").cast("string")
        out = F.when(n >= size, F.concat(shown, F.lit(" " + unit))).otherwise(out)
    return out


def relative_age(ts: Column | str, as_of: Column | str) -> Column:
    """just now / Nm / Nh / Nd ago, and the date from 30 days on."""
    when, now = _c(ts), _c(as_of)
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))
    minutes = F.floor(micros / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    ago = lambda value, unit: F.concat(value.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .when(days < 30, ago(days, "d"))
        .otherwise(F.date_format(when, "yyyy-MM-dd"))
    )


def match_dots(similarity: Column | str) -> Column:
    return F.round(_c(similarity) * 10).cast("int")


def match_percent(similarity: Column | str) -> Column:
    return F.round(_c(similarity) * 100).cast("int")


def shown_similarity(similarity: Column | str) -> Column:
    return F.round(_c(similarity), 4)
