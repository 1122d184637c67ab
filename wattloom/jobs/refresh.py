"""E1 to E3 kept up to date: after a late delivery only the months that it can change are cleaned again.

What a feed's rules ask of whole series (the night gate, the pressure's unit, numbers of rows) is kept
by month and merged, so a refresh reads it anew for the touched months only.  A change spreads by rows
(the z-score's frame) and by gaps (interpolation reaches the next value, however far).  So the range to
write again grows from the touched months until, in every series and column, a month with values lies
between the change and the range's ends, farther away than the frame; and the range to read grows until
the same holds between its ends and the range to write.  A change of a gate or unit writes all months.

Tables are Parquet by month (yyyy-MM) under one folder; rows without a time are left out.  The driver
holds months, never series or rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.operators import clean as rules
from wattloom.operators.scale import attach
from wattloom.sources import files

from . import clean


class Feed(NamedTuple):
    """A feed's rules in three parts (jobs.clean), what they ask of whole series, and how many rows away a
    value can change whether another is kept."""

    name: str
    prepared: Callable[[DataFrame], DataFrame]
    facts: Callable[[DataFrame], dict[str, Column]]
    decided: Callable[[list[str]], dict[str, Column]]
    judged: Callable[[DataFrame, DataFrame], DataFrame]
    finished: Callable[[DataFrame], DataFrame]
    values: Callable[[DataFrame], list[str]]
    reach: int


def _decided(facts: list[str]) -> dict[str, Column]:
    gates = {n: F.bool_or(n) for n in facts if n.startswith("_gate_")}
    return gates | {f"_above_{n[3:]}": rules.median_is_above(n[3:]) for n in facts if n.startswith("_n_")}


def load_feed(keys: list[str], bounds: dict | None = None, seq: str = "ingest_seq") -> Feed:
    return Feed(
        "load", lambda r: clean.prepared_load(r, keys, seq), lambda r: rules.night_facts(clean.load_columns(r.columns)[1]), _decided,
        lambda r, known: clean.judged_load(r, keys, bounds, known=known), lambda r: clean.finished_load(r, keys), lambda r: [c for part in clean.load_columns(r.columns) for c in part], 336,
    )


def forecast_feed(keys: list[str], seq: str = "ingest_seq") -> Feed:
    def facts(rows: DataFrame) -> dict[str, Column]:
        solar, _, pressure = clean.forecast_groups(clean.forecast_values(rows, keys))
        return rules.night_facts(solar) | rules.median_facts(pressure)

    return Feed(
        "forecast", lambda r: clean.prepared_forecast(r, keys, seq), facts, _decided, lambda r, known: clean.judged_forecast(r, keys, known=known),
        lambda r: clean.finished_forecast(r, keys), lambda r: clean.forecast_values(r, keys), 85,
    )


_MERGE = {"_gate_": F.bool_or, "_n_": F.sum, "_over_": F.sum, "_lo_": F.max, "_hi_": F.min}


def _decisions(by_month: DataFrame, keys: list[str], feed: Feed) -> DataFrame:
    """(keys, gates and units) of whole series."""
    names = [c for c in by_month.columns if c.startswith(tuple(_MERGE))]
    merged = by_month.groupBy(*keys).agg(*(next(f for p, f in _MERGE.items() if n.startswith(p))(n).alias(n) for n in names))
    units = {n: e for n, e in feed.decided(names).items() if n not in names}
    return merged.withColumns(units).select(*keys, *(n for n in names if n.startswith("_gate_")), *units)


def _month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("ts", "yyyy-MM"))


def _write(rows: DataFrame, path: str, keys: list[str]) -> None:
    by = rows.repartition("month", F.pmod(F.xxhash64(*keys), F.lit(files.SPREAD)))
    by.sortWithinPartitions(*keys, *(["ts"] if "ts" in rows.columns else [])).write.option("partitionOverwriteMode", "dynamic").partitionBy("month").mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))


def _settled(sizes: DataFrame, keys: list[str], written: tuple[str, str], read: tuple[str, str], touched: tuple[str, str], reach: int) -> tuple[bool, bool, bool, bool]:
    """Of months (keys, month, n, ok; ok: all columns have values there): does the range to write, and the
    range to read, go far enough to the left, and to the right, in every series?"""
    m, n = F.col("month"), F.col("n")
    series = Window.partitionBy(*keys)
    upto = F.sum("n").over(series.orderBy("month"))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)).over(series), F.lit(0))
    rows = sizes.select(
        *keys, "month", "n", "ok", (upto - n).alias("before"), total(m < touched[0]).alias("to_change"), total(m < read[0]).alias("to_read"),
        (F.sum("n").over(series) - upto).alias("after"), total(m > touched[1]).alias("from_change"), total(m > read[1]).alias("from_read"),
    )
    ok = F.coalesce("ok", F.lit(False))
    tests = [
        (m < written[0], (m >= written[0]) & (m < touched[0]) & ok & (F.col("to_change") - F.col("before") - n >= reach)),
        (m < read[0], (m >= read[0]) & (m < written[0]) & ok & (F.col("before") - F.col("to_read") >= reach)),
        (m > written[1], (m <= written[1]) & (m > touched[1]) & ok & (F.col("from_change") - F.col("after") - n >= reach)),
        (m > read[1], (m <= read[1]) & (m > written[1]) & ok & (F.col("after") - F.col("from_read") >= reach)),
    ]
    each = rows.groupBy(*keys).agg(*((~F.bool_or(beyond) | F.bool_or(barrier)).alias(f"t{i}") for i, (beyond, barrier) in enumerate(tests)))
    got = each.agg(*(F.coalesce(F.bool_and(f"t{i}"), F.lit(True)) for i in range(4))).first()
    return tuple(got)


def refresh_feed(raw: DataFrame, feed: Feed, path: str, keys: list[str], touched: list[str] | None = None) -> tuple[str, str] | None:
    """Bring `path`/<feed> up to date with `raw` (keys, ts, ..., month), of which the months `touched` have
    new rows (None: all, as for the first run).  Returns the first and last month written anew."""
    spark = raw.sparkSession
    months = [r.month for r in raw.select("month").distinct().orderBy("month").collect() if r.month is not None]
    full = touched is None
    touched = months if full else sorted(set(touched) & set(months))
    if not touched:
        return None
    kept, out = f"{path}/facts-{feed.name}", f"{path}/{feed.name}"
    if not full:
        before = _decisions(_read(spark, kept), keys, feed)
        stored = files.scratch(spark, "decisions")
        before.write.parquet(stored)
        before = spark.read.schema(before.schema).parquet(stored)
    of = lambda lo, hi: feed.prepared(raw.where(F.col("month").between(lo, hi)).drop("month"))
    fresh = feed.prepared(raw.where(F.col("month").isin(touched)).drop("month"))
    facts = _month(fresh).groupBy(*keys, "month").agg(F.count("*").alias("n"), *(f.alias(c) for c, f in feed.facts(fresh).items()))
    _write(facts, kept, keys)
    by_month = _read(spark, kept)
    now = _decisions(by_month, keys, feed)
    if not full:
        decided = [c for c in now.columns if c not in keys]
        was = before.withColumnsRenamed({c: f"_was{c}" for c in decided})
        other = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_was{c}")) for c in decided), F.lit(False))
        full = bool(attach(now, was, keys).where(other).take(1))
    last = len(months) - 1
    change = (0, last) if full else (months.index(touched[0]), months.index(touched[-1]))
    write = [max(change[0] - 1, 0), min(change[1] + 1, last)]
    read = [max(write[0] - 1, 0), min(write[1] + 1, last)]
    while True:
        lo, hi = months[read[0]], months[read[1]]
        judged = feed.judged(of(lo, hi), now)
        at = files.scratch(spark, f"judged-{feed.name}")
        judged.write.parquet(at)
        judged = spark.read.schema(judged.schema).parquet(at)
        if write == [0, last]:
            break
        has = reduce(lambda a, b: a & b, (F.count(c) > 0 for c in feed.values(judged)), F.lit(True))
        ok = _month(judged).groupBy(*keys, "month").agg(has.alias("ok"))
        sizes = attach(by_month.select(*keys, "month", "n"), ok, [*keys, "month"], "left")
        ends = lambda r: (months[r[0]], months[r[1]])
        left_write, left_read, right_write, right_read = _settled(sizes, keys, ends(write), ends(read), ends(change), feed.reach)
        if left_write and left_read and right_write and right_read:
            break
        write = [write[0] - (not left_write), write[1] + (not right_write)]
        read = [max(min(read[0] - (not left_read), write[0] - 1), 0), min(max(read[1] + (not right_read), write[1] + 1), last)]
    done = _month(feed.finished(judged)).where(F.col("month").between(months[write[0]], months[write[1]]))
    _write(done, out, keys)
    return months[write[0]], months[write[1]]


def refresh(load: DataFrame, predicted: DataFrame, path: str, keys: list[str], load_months: list[str] | None = None, forecast_months: list[str] | None = None, bounds: dict | None = None) -> tuple[str, str] | None:
    """E3 kept up to date: `path`/load, `path`/forecast and `path`/merged, by month, after new rows in
    the given months of the raw feeds (keys, ts, ingest_seq, ..., month; None: all).  Returns the first
    and last month of the merged table that were written anew."""
    spark = load.sparkSession
    spans = [s for s in (refresh_feed(load, load_feed(keys, bounds), path, keys, load_months), refresh_feed(predicted, forecast_feed(keys), path, keys, forecast_months)) if s]
    if not spans:
        return None
    lo, hi = min(s[0] for s in spans), max(s[1] for s in spans)
    a, b = (_read(spark, f"{path}/{n}").where(F.col("month").between(lo, hi)).drop("month") for n in ("load", "forecast"))
    _write(_month(clean.merge(a, b, keys)), f"{path}/merged", keys)
    return lo, hi
