"""Stored answer streams: event frames, and the answer they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import strip_text

CITATION = (
    "struct<document_id:string,document_name:string,page_number:int,section:string,"
    "similarity_score:double,excerpt:string>"
)
EVENT = f"type string, delta string, message_id string, citations array<{CITATION}>, confidence double, error string"
DEFAULT_ERROR = "The answer could not be completed."


def event_rows(transcripts: DataFrame, body: str = "body", key: str = "turn_id") -> DataFrame:
    """One row per well-formed ``data:`` frame; an unfinished last frame is ignored."""
    pieces = F.split(F.col(body), "\n\n")
    frames = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), strip_text)
    return (
        transcripts.select(key, F.posexplode(frames).alias("seq", "_frame"))
        .filter(F.startswith("_frame", F.lit("data:")))
        .select(key, "seq", F.from_json(F.expr("substring(_frame, 6)"), EVENT, {"mode": "PERMISSIVE"}).alias("e"))
        .filter(F.col("e.type").isNotNull())
        .select(key, "seq", "e.*")
    )


def assemble_answers(events: DataFrame, key: str = "turn_id") -> DataFrame:
    """Text, citations and error of each turn.

    A ``no_answer`` event replaces what came before it; the last ``done`` event
    supplies the citations. One group is one answer.
    """
    is_type = lambda name: F.col("type") == name
    pieces = F.when(is_type("delta") | is_type("no_answer"),
                    F.struct("seq", "type", F.coalesce("delta", F.lit("")).alias("delta")))
    turns = events.groupBy(key).agg(
        F.sort_array(F.collect_list(pieces)).alias("_p"),
        F.coalesce(F.max(F.when(is_type("no_answer"), F.col("seq"))), F.lit(-1)).alias("_reset"),
        F.max_by("citations", F.when(is_type("done"), F.col("seq"))).alias("citations"),
        F.max_by("confidence", F.when(is_type("done") | is_type("no_answer"), F.col("seq"))).alias("confidence"),
        F.max_by(F.coalesce(F.nullif("error", F.lit("")), F.lit(DEFAULT_ERROR)), F.when(is_type("error"), F.col("seq"))).alias("error"),
    )
    current = F.filter("_p", lambda p: p["seq"] >= F.col("_reset"))
    return turns.select(
        key,
        F.array_join(F.transform(current, lambda p: p["delta"]), "").alias("answer"),
        F.when(F.col("error").isNotNull(), "error").when(F.col("_reset") >= 0, "no_answer").otherwise("answered").alias("outcome"),
        F.coalesce("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"),
        "confidence", "error",
    )
