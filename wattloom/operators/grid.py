"""Regular grids, buckets, duplicates and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def trunc(unit: str, ts: str | Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _rules(rules: dict[str, tuple[str, str]]) -> list[Column]:
    how = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    return [how[rule](c).alias(name) for name, (c, rule) in rules.items()]


def resample(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, str]], unit: str = "hour", ts: str = "ts") -> DataFrame:
    """A1-A4: {name: (column, mean|sum|...)} on every step between a series' first and last bucket.

    A step without rows has null means and zero sums.  Each bucket brings the missing steps up to the
    next one, so that the rows are read once and, after a map-side aggregate, nothing is joined."""
    buckets = df.groupBy(*keys, trunc(unit, ts).alias("_at")).agg(*_rules(rules)).where("_at is not null")
    step = F.expr(STEP[unit])
    until = F.coalesce(F.lead("_at").over(by_time(keys, "_at")) - step, F.col("_at"))
    steps = buckets.withColumn("_until", until).withColumn("_step", F.explode(F.sequence("_at", "_until", step)))
    here = F.col("_step") == F.col("_at")
    value = lambda n, rule: F.when(here, F.coalesce(F.col(n), F.lit(0.0))).otherwise(0.0) if rule == "sum" else F.when(here, F.col(n))
    return steps.select(*keys, F.col("_step").alias(ts), *(value(n, rule).alias(n) for n, (_, rule) in rules.items()))


def bucket_mean(df: DataFrame, keys: list[str], columns: list[str], unit: str, ts: str = "ts") -> DataFrame:
    """Means of the day, week (from Monday) or month buckets that have rows."""
    return df.groupBy(*keys, trunc(unit, ts).alias(ts)).agg(*(F.avg(c).alias(c) for c in columns))


def first_of_duplicates(df: DataFrame, keys: list[str], seq: str, ts: str = "ts", count: str | None = None) -> DataFrame:
    """Of the rows of one series and time, the one with the least seq; `count` names a column for
    how many there were.

    An aggregate (not row_number), so that hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    best = df.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), seq).alias("_row"), *([F.count("*").alias(count)] if count else []))
    return best.select(*(F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in df.columns), *([count] if count else []))


def by_time(keys: list[str], ts: str = "ts"):
    return Window.partitionBy(*keys).orderBy(ts)


def gaps(df: DataFrame, keys: list[str], expected: str, ts: str = "ts") -> DataFrame:
    """Steps longer than expected ('INTERVAL 1 HOUR'): previous and current time, seconds."""
    before = df.select(*keys, ts, F.lag(ts).over(by_time(keys, ts)).alias("previous"))
    seconds = F.timestamp_diff("SECOND", F.col("previous"), F.col(ts))
    return before.where(F.col(ts) > F.col("previous") + F.expr(expected)).select(*keys, "previous", F.col(ts).alias("current"), seconds.alias("gap_s"))


def first_gaps(df: DataFrame, keys: list[str], expected: str, n: int = 10, ts: str = "ts") -> DataFrame:
    """TK3: the first n gaps by time."""
    return gaps(df, keys, expected, ts).orderBy("current", *keys).limit(n)


def empty_runs(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Runs of rows in which all columns are null: start, the first good time after (or the last time),
    and whether a run holds the first or the last row of its series."""
    w = by_time(keys, ts)
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(c).isNull()
    rows = df.select(*keys, ts, empty.alias("_empty"), F.lead(ts).over(w).alias("_next"), F.lag(empty).over(w).alias("_before"))
    rows = rows.withColumn("_new", (F.col("_empty") & ~F.coalesce("_before", F.lit(False))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w)).where("_empty")
    runs = rows.groupBy(*keys, "_island").agg(
        F.min(ts).alias("start"), F.max(F.coalesce("_next", ts)).alias("end"), F.bool_or(F.col("_before").isNull()).alias("_from_first"), F.bool_or(F.col("_next").isNull()).alias("_to_last"),
    )
    return runs.drop("_island")


def empty_stretches(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Runs of rows in which all columns are null: start, and the first good time after (the last
    time of the series if it never ends)."""
    return empty_runs(df, keys, columns, ts).select(*keys, "start", "end")
