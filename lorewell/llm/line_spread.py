"""Removal of boilerplate lines by the number of distinct sites they are spread over.

Only DataFrame functions. Every non-blank line is keyed by its digest. HyperLogLog sketches
of the sites, merged map-side by aggregation, tell which lines are on at least ``min_sites``
distinct sites; lines whose estimates lie near that limit are counted exactly.

Copies of one document on many sites would lose all their lines that way, though they are work
for the near-duplicate stage. So every document with such *widespread* lines has a context: the
smallest digest among its other lines, none if all its lines are widespread. A widespread line
is boilerplate if it stands in at least ``min_sites`` different contexts, counted in the same way.
Boilerplate never makes a context, so lines that come together do not vouch for each other, and a
group of copies, however large, is one context and outvotes nothing. Boilerplate stays in the
document with the smallest ``doc_id`` that has it and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import clean_text, stored

LG_K = 10  # 1024 registers: a standard error of about 3.3 %, the margins below are 15 of them
MIN_SITES = 10
SALTS = 32
CONTEXT_DIGITS = 16  # a context is told by the first 64 bits of its digest


def _lines(text: str) -> Column:
    return F.split(clean_text(text), "\n", -1)


def _digests(docs: DataFrame, text: str, site: str) -> DataFrame:
    """The digests of the lines of every document with an id, null for a blank line: doc_id, site, digests."""
    digests = F.transform(_lines(text), lambda s: F.when(F.trim(s) != "", F.md5(s)))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(site).alias("site"), digests.alias("digests"))


def _occurrences(docs: DataFrame, text: str, site: str) -> DataFrame:
    """One row per non-blank line: doc_id, site, pos, line (digest)."""
    return _digests(docs, text, site).select("doc_id", "site", F.posexplode("digests").alias("pos", "line")).where(F.col("line").isNotNull())


def _reaching(rows: DataFrame, counted: str, least: int) -> DataFrame:
    """Lines of ``rows(doc_id, line, ...)`` with at least ``least`` distinct values of ``counted``, and their first document."""
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg(counted, LG_K)).alias("n"), F.min("doc_id").alias("first_doc"))
    # no line below half of the limit can pass the exact test, none above twice the limit can fail it
    possible, sure = spread.where(2 * F.col("n") >= least), F.col("n") >= 2 * least
    # dealt by line and salt, so that a line of a third of all documents is counted by many tasks
    salted = possible.where(~sure).select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    exact = (
        rows.select("doc_id", "line", counted, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["line", "salt"], "left_semi").groupBy("line")
        .agg(F.countDistinct(counted).alias("n"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n") >= least)
    )
    return possible.where(sure).select("line", "first_doc").unionByName(exact.select("line", "first_doc"))


def widespread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Every occurrence of a line that is on ``min_sites`` distinct sites or more: ``doc_id, pos, line``."""
    rows = _occurrences(docs, text, site)
    return rows.select("doc_id", "pos", "line").join(_reaching(rows, "site", min_sites).select("line"), "line").select("doc_id", "pos", "line")


def boilerplate_lines(docs: DataFrame, held: DataFrame, text: str = "text", site: str = "source", min_contexts: int = MIN_SITES) -> DataFrame:
    """Of the lines of ``held``, as ``widespread_lines`` gives them, the boilerplate and the first document of each: ``line, first_doc``."""
    short = lambda d: F.substring(d, 1, CONTEXT_DIGITS)
    # what is gathered for a document is no longer than its own list of lines
    wide = held.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    own = _digests(docs, text, site).select("doc_id", F.transform("digests", short).alias("digests"))
    least = F.array_min(F.array_except("digests", F.transform("lines", short)))
    contexts = own.join(wide, "doc_id").groupBy("doc_id").agg(F.coalesce(F.min(least), F.lit("")).alias("context"), F.first("lines").alias("lines"))
    return _reaching(contexts.select("doc_id", "context", F.explode("lines").alias("line")), "context", min_contexts)


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Columns of the input keep their names; ``n_lines``/``n_removed`` of the input are
    replaced. A null text is empty; a null site counts as no site; a row with a null
    ``doc_id`` is neither counted nor changed. Rows that share a ``doc_id`` count as one
    document and lose the same lines. Line breaks are ``\\n``; an empty text has one
    blank line. Empty tables give empty results. Work per document is linear in its lines.
    """
    held = stored(widespread_lines(docs, text, site, min_sites), "widespread")
    gone = (
        held.join(boilerplate_lines(docs, held, text, site, min_sites), "line").where(F.col("doc_id") != F.col("first_doc"))
        .groupBy(F.col("doc_id").alias("_gone_doc")).agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    )
    named = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # columns of the input travel in one struct, so that none can clash
    row = docs.select(F.col("doc_id").alias("_doc"), _lines(text).alias("_lines"), F.struct(*[F.col(f"`{c}`") for c in named]).alias("_row"))
    joined = row.join(gone, F.col("_doc") == F.col("_gone_doc"), "left")
    # the stretches between removed lines, so that the work is linear in the lines
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("_gone", i - 1) + 1)
    end = lambda i: F.coalesce(F.get("_gone", i), F.size("_lines"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda i: F.slice("_lines", begin(i) + 1, F.greatest(end(i) - begin(i), F.lit(0))))
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.flatten(stretches))
    value = lambda c: F.col("_row").getField(c)
    return joined.withColumn("_kept", kept).select(
        *[F.when(F.col("_gone").isNull(), value(c)).otherwise(F.array_join("_kept", "\n")).alias(c) if c == text else value(c).alias(c) for c in named],
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
    )
