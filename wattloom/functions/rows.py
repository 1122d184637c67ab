"""Row-wise rules as column expressions.  Null stays null unless a rule says otherwise."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.sources.schemas import SENTINEL

NIGHT_FROM, NIGHT_TO = 21, 5  # UTC hours, both inside the night


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def sentinel_to_null(c: str | Column, sentinel: float = SENTINEL) -> Column:
    """PR1."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(sentinel))


def clip_negative(c: str) -> Column:
    """PR3."""
    return F.when(F.col(c) < 0, 0.0).otherwise(F.col(c))


def is_night(ts: str = "ts") -> Column:
    """PR4."""
    return (F.hour(ts) >= NIGHT_FROM) | (F.hour(ts) <= NIGHT_TO)


def within(c: str, lo: float, hi: float) -> Column:
    """PR6: the value if lo <= value <= hi."""
    return F.when(F.col(c).between(lo, hi), F.col(c))


def no_sun_without_radiation(radiation: str, sunshine: str) -> Column:
    """PR7."""
    return F.when((F.col(radiation) == 0) & (F.col(sunshine) > 1), 0.0).otherwise(F.col(sunshine))


def null_skipping_sum(columns: list[str]) -> Column:
    """PR10: 0 where all are null."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns))


def at_most(c: str | Column, hi: float) -> Column:
    """PR15, upper; a null stays null, unlike with least()."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > hi, F.lit(float(hi))).otherwise(c)


def at_least(c: str | Column, lo: float) -> Column:
    """PR15, lower; a null stays null, unlike with greatest()."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < lo, F.lit(float(lo))).otherwise(c)


def season(ts: str = "ts") -> Column:
    """PR16."""
    m = F.month(ts)
    return F.when(m.isin(6, 7, 8), "summer").when(m.isin(12, 1, 2), "winter").otherwise("mid_season")


def guarded_ratio(num: str, den: str, above: float = 1.0) -> Column:
    """PR17: null unless the denominator is above the limit."""
    return F.when(F.col(den) > above, F.col(num) / F.col(den))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """PR11: the columns asked for, or ValueError."""
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def split_at(cut: str, ts: str = "ts", gap: str = "INTERVAL 0 HOURS") -> Column:
    """PR13: 'train' before the cut less the gap, 'test' from the cut on, null in between."""
    at = F.lit(cut).cast("timestamp_ntz")
    return F.when(F.col(ts) >= at, "test").when(F.col(ts) < at - F.expr(gap), "train")


def days_between(first: str, last: str, ts: str = "ts") -> Column:
    """PR14: both days included."""
    return F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def half_open(start: str, stop: str, ts: str = "ts") -> Column:
    """PR14: [start, stop)."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz"))
