"""Aggregates of one day or month looked up from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_daily(df: DataFrame, keys: list[str], daily: DataFrame, day_offsets: dict[int, dict[str, str]], day: Column | None = None, ts: str = "ts") -> DataFrame:
    """Columns of the daily table (keys, day, ...) of some days before: {offset: {column: name}}.

    The daily table's key is moved, not the big table's; Spark broadcasts it where it is small."""
    return attach_days(df, [(keys, daily, day_offsets)], day, ts)


def attach_days(df: DataFrame, tables: list[tuple[list[str], DataFrame, dict[int, dict[str, str]]]], day: Column | None = None, ts: str = "ts") -> DataFrame:
    """attach_daily of several tables (keys, table, offsets): all meet the rows on one day column, so that
    those with the same keys share one exchange of the rows."""
    out = df.withColumn("_day", F.to_date(ts) if day is None else day)
    for keys, daily, day_offsets in tables:
        for offset, columns in day_offsets.items():
            moved = daily.select(*keys, F.date_add("day", offset).alias("_day"), *(F.col(c).alias(n) for c, n in columns.items()))
            out = out.join(moved, [*keys, "_day"], "left")
    return out.drop("_day")


def monthly_percentile(daily: DataFrame, keys: list[str], column: str, q: float = 0.95, fit_before: str | None = None) -> DataFrame:
    """(keys, month, p): exact linear percentile of the daily values of each calendar month.
    fit_before: only days before that date (the default takes all, test period too)."""
    rows = daily if fit_before is None else daily.where(F.col("day") < F.lit(fit_before).cast("date"))
    return rows.groupBy(*keys, F.month("day").alias("month")).agg(F.percentile(column, F.lit(q)).alias("p"))


def attach_monthly(df: DataFrame, keys: list[str], monthly: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """The month's value.  The table has 12 rows a series."""
    table = monthly.select(*keys, F.col("month").alias("_month"), F.col("p").alias(name))
    return df.withColumn("_month", F.month(ts)).join(table, [*keys, "_month"], "left").drop("_month")


def day_total(df: DataFrame, keys: list[str], column: str, name: str, ts: str = "ts") -> DataFrame:
    """The day's sum on each of its rows; 0 for a day of nulls."""
    w = Window.partitionBy(*keys, F.to_date(ts))
    return df.withColumn(name, F.coalesce(F.sum(column).over(w), F.lit(0.0)))
