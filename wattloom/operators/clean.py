"""Cleaning rules that look beyond the row, and the count of what the rules touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.rows import is_night

from .grid import by_time
from .scale import attach


def _with_facts(df: DataFrame, keys: list[str], facts: dict[str, Column], ts: str, apart: bool) -> DataFrame:
    """Rows with aggregates of their whole series.  They are taken over the window that the other rules
    of a job use, so that they cost no exchange of their own; `apart`, or without keys, they are joined
    from an aggregate, for series that no task should hold whole."""
    if keys and not apart:
        whole = by_time(keys, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({n: f.over(whole) for n, f in facts.items()})
    return attach(df, df.groupBy(*keys).agg(*(f.alias(n) for n, f in facts.items())), keys)


def night_facts(columns: list[str], ts: str = "ts") -> dict[str, Column]:
    """What PR5 asks of a series, as aggregates that merge by bool_or: is there a positive night value?"""
    night = F.coalesce(is_night(ts), F.lit(False))
    return {f"_gate_{c}": F.bool_or(F.coalesce(night & (F.col(c) > 0), F.lit(False))) for c in columns}


def zero_at_night(df: DataFrame, keys: list[str], columns: list[str], mode: str = "reference", ts: str = "ts", apart: bool = False, known: DataFrame | None = None) -> DataFrame:
    """PR5: night values become 0.  mode 'reference': only in series and columns with a positive night
    value, and there for all night rows, nulls too; 'always': everywhere.  `known` has night_facts of
    the series, where df is a part of them."""
    night = F.coalesce(is_night(ts), F.lit(False))
    if mode == "always":
        return df.withColumns({c: F.when(night, 0.0).otherwise(F.col(c)) for c in columns})
    gates = night_facts(columns, ts)
    gated = _with_facts(df, keys, gates, ts, apart) if known is None else attach(df, known.select(*keys, *gates), keys, "left")
    return gated.withColumns({c: F.when(night & F.coalesce(f"_gate_{c}", F.lit(False)), 0.0).otherwise(F.col(c)) for c in columns}).drop(*gates)


def median_facts(columns: list[str], above: float = 10_000.0) -> dict[str, Column]:
    """What PR8 asks of a series: values, values above the limit, and those next to it on either side;
    they merge by sum, sum, max and min."""
    facts = {}
    for c in columns:
        over = F.col(c) > above
        facts |= {f"_n_{c}": F.count(c), f"_over_{c}": F.count_if(over), f"_lo_{c}": F.max(F.when(~over, F.col(c))), f"_hi_{c}": F.min(F.when(over, F.col(c)))}
    return facts


def median_is_above(c: str, above: float = 10_000.0) -> Column:
    """Whether the median is above the limit, from median_facts, without a sort: more than half of the values
    above put it above, fewer below, and where just half are, it is the mean of the two next to the limit."""
    more = 2 * F.col(f"_over_{c}") - F.col(f"_n_{c}")
    middle = (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2 > above
    return F.coalesce((more > 0) | (more == 0) & F.coalesce(middle, F.lit(False)), F.lit(False))


def scale_by_median(
    df: DataFrame, keys: list[str], columns: list[str], above: float = 10_000.0, by: float = 100.0, ts: str = "ts", apart: bool = False, known: DataFrame | None = None,
) -> DataFrame:
    """PR8: divided by `by` in series whose median is above the limit (Pa to hPa).  `known` has, where
    df is a part of the series, a column _above_<column> of each."""
    facts = median_facts(columns, above)
    if known is None:
        rows, big = _with_facts(df, keys, facts, ts, apart), {c: median_is_above(c, above) for c in columns}
    else:
        rows, big = attach(df, known.select(*keys, *(f"_above_{c}" for c in columns)), keys, "left"), {c: F.coalesce(f"_above_{c}", F.lit(False)) for c in columns}
    return rows.withColumns({c: F.when(big[c], F.col(c) / by).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def report(df: DataFrame, masks: dict[tuple[str, str], Column]) -> DataFrame:
    """(rule, column, n): rows that each mask marks, in one pass.  Window masks are taken as
    columns first."""
    names = {f"_m{i}": k for i, k in enumerate(masks)}
    marked = df.select(*(masks[k].alias(n) for n, k in names.items()))
    counts = marked.agg(*(F.count_if(F.col(n)).alias(n) for n in names))
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(n).alias("n")) for n, (rule, c) in names.items()))
    return counts.select(F.inline(rows))
