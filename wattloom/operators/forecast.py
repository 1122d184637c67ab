"""Forecast runs and long observations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import occurrence


def summarize_runs(df: DataFrame, keys: list[str], variable: str = "variable", lead: str = "lead_time", value: str = "value", ts: str = "ts") -> DataFrame:
    """A6 on long rows: best (value of the least lead that has one), its lead, sample deviation over
    the leads (0 below two), number of values; one row for each target time and variable."""
    has = F.col(value).isNotNull()
    return df.groupBy(*keys, ts, variable).agg(
        F.min_by(value, F.when(has, F.col(lead))).alias("best"),
        F.min(F.when(has, F.col(lead))).alias("lead_time"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"),
        F.count(value).cast("int").alias("n_runs"),
    )


def lead_columns(columns: list[str], prefix: str) -> dict[int, str]:
    """SC8: {lead time: column} of the columns `<prefix>_lt<lead>`, by lead."""
    found = {int(m[1]): c for c in columns if (m := re.fullmatch(re.escape(prefix) + r"_lt(\d+)", c))}
    return dict(sorted(found.items()))


def wide_summary(columns: list[str], prefix: str, short: str) -> dict[str, Column]:
    """A6 on a wide row, as expressions without a shuffle: <short>_best, _spread, _n_runs, _lead_time."""
    leads = lead_columns(columns, prefix)
    if not leads:
        return {}
    values = F.array_compact(F.array(*(F.col(c) for c in leads.values())))
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n))
    return {
        f"{short}_best": F.coalesce(*(F.col(c) for c in leads.values())),
        f"{short}_spread": F.when(n >= 2, F.sqrt(square / (n - 1))).otherwise(0.0),
        f"{short}_n_runs": n,
        f"{short}_lead_time": F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in leads.items())),
    }


def melt_leads(df: DataFrame, keys: list[str], prefixes: list[str], ts: str = "ts") -> DataFrame:
    """SC8: the wide matrix as (keys, ts, variable, lead_time, value)."""
    columns = [c for p in prefixes for c in lead_columns(df.columns, p).values()]
    long = df.unpivot([*keys, ts], columns, "name", "value")
    return long.select(*keys, ts, F.regexp_extract("name", r"^(.*)_lt\d+$", 1).alias("variable"), F.regexp_extract("name", r"_lt(\d+)$", 1).cast("int").alias("lead_time"), "value")


def pivot_observations(df: DataFrame, keys: list[str], names: dict[str, str], seq: str = "ingest_seq", ts: str = "ts") -> DataFrame:
    """A5: one column for each measurement, from its first record of a time.

    Records without a value are numbered like others; times without any value are left out.  The
    measurements are a fixed list, so no job looks for them."""
    first = occurrence(df.where(F.col("measurement").isin(list(names))), [*keys, ts, "measurement"], seq).where("dup = 0 and value is not null")
    wide = first.groupBy(*keys, ts).pivot("measurement", list(names)).agg(F.avg("value"))
    return wide.select(*keys, ts, *(F.col(f"`{m}`").alias(n) for m, n in names.items()))


def mean_of_columns(columns: list[str]) -> Column:
    """Mean of the columns that are not null."""
    n = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns)) / F.nullif(n, F.lit(0))
