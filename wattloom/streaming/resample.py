"""The row-local operators on streams: duplicates and hourly buckets under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_in_stream(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """A22 on a stream: one row of each series and time within the watermark (the one that comes first)."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def bucket_stream(rows: DataFrame, keys: list[str], rules: dict[str, tuple[str, str]], every: str = "1 hour", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """A1, A2 on a stream: means and sums of the buckets that have rows (a stream has no last bucket,
    so empty ones are left to the batch grid)."""
    how = {"mean": F.avg, "sum": F.sum}
    grouped = rows.withWatermark(ts, late).groupBy(*keys, F.window(ts, every).alias("_w"))
    out = grouped.agg(*(how[r](c).alias(n) for n, (c, r) in rules.items()))
    return out.select(*keys, F.col("_w.start").alias(ts), *rules)
