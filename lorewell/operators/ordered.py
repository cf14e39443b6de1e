"""Order-dependent columns that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import _c


def carry_forward(
    df: DataFrame,
    keys: list[str],
    bucket: Column | str,
    order: list[str],
    value: Column | str,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Nearest non-NULL ``value`` at or before each row (before it when not ``include_current``).

    ``bucket`` must not decrease along ``order``. Rows are sorted per (keys,
    bucket), so a hot key is spread over its buckets; what a bucket inherits
    comes from one summary row per bucket.
    """
    staged = df.withColumn("_bucket", _c(bucket)).withColumn("_value", _c(value))
    part = [*keys, "_bucket"]
    last_of_bucket = staged.groupBy(*part).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last_of_bucket.withColumn("_inherited", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    end = 0 if include_current else -1
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return (
        staged.join(inherited, part, "left")
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_inherited")))
        .select(*df.columns, out)
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each map partition to ``k`` rows
    per key before the shuffle, so a hot key sends at most ``k`` rows per task."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def ordered_join(items: Column | str, glue: str, order: str = "seq", text: str = "text") -> Column:
    """Text of ``(order, text)`` structs of one small group, in order (for use in ``agg``)."""
    gathered = F.sort_array(F.collect_list(_c(items) if not isinstance(items, str) else F.struct(order, text)))
    return F.array_join(F.transform(gathered, lambda s: s[text]), glue)
