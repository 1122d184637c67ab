"""Load feed, forecast feed, their merge, and the observations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.rows import clip_negative, no_sun_without_radiation, null_skipping_sum, sentinel_to_null, within
from wattloom.operators import clean, forecast, grid, metrics, scale, windows
from wattloom.sources import files, schemas


def _observed(observation: Observation) -> dict:
    """What was observed; nothing where Spark found a branch empty and left its counters out of the plan."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}


class Counts:
    """A24 from the run itself: what each rule of a job changes and how many repeated times went, counted
    by `observe` while the job's own rows pass.  `report()` gives (rule, column, n) once an action has
    run on them; it starts no job on the data.

    A rule's step is taken with the values before it kept beside, and a flag a row and column says
    whether they differ.  All flags are added up in one place."""

    SEEN = "_seen"

    def __init__(self):
        self.flags: dict[str, tuple[str, str]] = {}
        self.observation = Observation(f"rules_{uuid.uuid4().hex}")

    def step(self, rows: DataFrame, rule: str, columns: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if not columns:
            return rows
        rows = change(rows.withColumns({f"_was_{c}": F.col(c) for c in columns}))
        flags = {f"_flag{len(self.flags) + i}": c for i, c in enumerate(columns)}
        self.flags |= {n: (rule, c) for n, c in flags.items()}
        rows = rows.withColumns({n: ~F.col(c).eqNullSafe(F.col(f"_was_{c}")) for n, c in flags.items()})
        return rows.drop(*(f"_was_{c}" for c in columns))

    @property
    def kept(self) -> list[str]:
        """Columns that a job's steps must hand on."""
        return [self.SEEN, *self.flags]

    def counted(self, rows: DataFrame) -> DataFrame:
        sums = [F.count_if(F.col(n)).alias(n) for n in self.flags]
        gone = F.coalesce(F.sum(F.col(self.SEEN) - 1), F.lit(0).cast("long")).alias(self.SEEN)
        return rows.observe(self.observation, gone, *sums).drop(*self.kept)

    def found(self) -> list[tuple[str, str, int]]:
        """(rule, column, n) of the action that ran."""
        got = _observed(self.observation)
        return [("duplicate", "ts", got.get(self.SEEN, 0)), *((*self.flags[n], got.get(n, 0)) for n in self.flags)]

    def report(self) -> DataFrame:
        return SparkSession.active().createDataFrame(self.found(), "rule string, column string, n long")


class _NoCounts(Counts):
    def __init__(self):
        self.flags = {}

    def step(self, rows: DataFrame, rule: str, columns: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return change(rows) if columns else rows

    @property
    def kept(self) -> list[str]:
        return []

    def counted(self, rows: DataFrame) -> DataFrame:
        return rows


def _once(df: DataFrame, keys: list[str], seq: str, counts: Counts) -> DataFrame:
    return grid.first_of_duplicates(df, keys, seq, count=counts.SEEN if counts.kept else None)


def _zscore(rows: DataFrame, keys: list[str], columns: list[str], window: int, least: int, chunk_rows: int | None) -> DataFrame:
    """W3; with `chunk_rows`, a series longer than that is cut into chunks with the rows around them."""
    if chunk_rows is None:
        return windows.null_zscore_outliers(rows, keys, columns, window, least)
    run = lambda r, k: windows.null_zscore_outliers(r, k, columns, window, least)
    return scale.with_halo(rows, keys, run, window // 2, (window - 1) // 2, chunk_rows)


def _filled(rows: DataFrame, keys: list[str], columns: list[str], limit: int, chunk_rows: int | None) -> DataFrame:
    """W5; with `chunk_rows`, over chunks, of rows that are written first, as they are read twice."""
    if chunk_rows is None:
        return windows.interpolate(rows, keys, columns, limit=limit)
    path = files.scratch(rows.sparkSession, "to-fill")
    rows.write.parquet(path)
    return windows.interpolate_in_chunks(rows.sparkSession.read.schema(rows.schema).parquet(path), keys, columns, limit=limit, size=chunk_rows)


def load_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """The load and photovoltaic columns of a feed."""
    return [c for c in ("load", "load_forecast") if c in columns], [c for c in columns if c.startswith("pv_")]


def prepared_load(df: DataFrame, keys: list[str], seq: str = "ingest_seq", counts: Counts | None = None) -> DataFrame:
    """E1 up to what is known of a row alone: duplicates, negatives."""
    counts = counts or _NoCounts()
    load, pv = load_columns(df.columns)
    rows = _once(df.select(*keys, "ts", seq, *load, *pv), keys, seq, counts).drop(seq)
    return counts.step(rows, "negative", pv, lambda r: r.withColumns({c: clip_negative(c) for c in pv}))


def judged_load(rows: DataFrame, keys: list[str], bounds: dict | None = None, chunk_rows: int | None = None, counts: Counts | None = None, known: DataFrame | None = None) -> DataFrame:
    """E1 up to the nulls that are to be filled: night, z-score, bounds."""
    counts, bounds = counts or _NoCounts(), schemas.PV_BOUNDS if bounds is None else bounds
    load, pv = load_columns(rows.columns)
    rows = counts.step(rows, "night", pv, lambda r: clean.zero_at_night(r, keys, pv, apart=chunk_rows is not None, known=known))
    rows = counts.step(rows, "zscore", load, lambda r: _zscore(r, keys, load, 672, 96, chunk_rows))
    bounded = [c for c in pv if c in bounds]
    return counts.step(rows, "bounds", bounded, lambda r: r.withColumns({c: within(c, *bounds[c]) for c in bounded}))


def finished_load(rows: DataFrame, keys: list[str], interpolate: int = 6, chunk_rows: int | None = None, counts: Counts | None = None) -> DataFrame:
    """E1's end: interpolation, hourly grid, PV total."""
    counts, (load, pv) = counts or _NoCounts(), load_columns(rows.columns)
    rows = counts.step(rows, "filled", [*load, *pv], lambda r: _filled(r, keys, [*load, *pv], interpolate, chunk_rows))
    hourly = grid.resample(counts.counted(rows), keys, {c: (c, "mean") for c in load} | {c: (c, "sum") for c in pv})
    return hourly.withColumn("pv_total", null_skipping_sum(pv)) if pv else hourly


def clean_load(df: DataFrame, keys: list[str], seq: str = "ingest_seq", bounds: dict | None = None, interpolate: int = 6, chunk_rows: int | None = None, counts: Counts | None = None) -> DataFrame:
    """Duplicates, negatives, night, z-score, bounds, interpolation, hourly grid, PV total.

    With `chunk_rows`, no task holds a whole series.  `counts` is filled by the action that runs the
    result (A24)."""
    rows = judged_load(prepared_load(df, keys, seq, counts), keys, bounds, chunk_rows, counts)
    return finished_load(rows, keys, interpolate, chunk_rows, counts)


def forecast_values(rows: DataFrame, keys: list[str], counts: Counts | None = None) -> list[str]:
    """The columns of the summary that are cleaned."""
    return [c for c in rows.columns if c not in (*keys, "ts", *(counts or _NoCounts()).kept) and not c.endswith(("_n_runs", "_lead_time"))]


def forecast_groups(numbers: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Of those: the solar ones, the ones that can't be negative, the pressures."""
    of = lambda *names: [c for c in numbers if any(n in c for n in names)]
    solar = of("GLOB", "DURSUN", "pred_radiation", "pred_sunshine")
    return solar, [*solar, *of("TOT_PREC", "pred_precipitation")], of("PS", "pred_pressure")


def prepared_forecast(df: DataFrame, keys: list[str], seq: str = "ingest_seq", counts: Counts | None = None) -> DataFrame:
    """E2 up to what is known of a row alone: sentinels, duplicates, run summary, aliases, bounds."""
    counts = counts or _NoCounts()
    values = [c for c in df.columns if c not in (*keys, "ts", seq)]
    rows = _once(df.select(*keys, "ts", seq, *values), keys, seq, counts)
    rows = counts.step(rows, "sentinel", values, lambda r: r.withColumns({c: sentinel_to_null(c) for c in values}))
    summary = {}
    for short in schemas.FORECAST_ALIASES:
        summary |= forecast.wide_summary(values, f"{short}_ctrl", short)
    rows = rows.select(*keys, "ts", *counts.kept, *(e.alias(n) for n, e in summary.items()))
    alias = {f"{s}_best": a for s, a in schemas.FORECAST_ALIASES.items()} | {f"{s}_spread": f"{a}_spread" for s, a in schemas.FORECAST_ALIASES.items()}
    rows = rows.withColumns({a: F.col(c) for c, a in alias.items() if c in summary})
    limits = {c: b for c, b in schemas.bounds_of_forecast().items() if c in rows.columns}
    return counts.step(rows, "bounds", [*limits], lambda r: r.withColumns({c: within(c, *b) for c, b in limits.items()}))


def judged_forecast(rows: DataFrame, keys: list[str], chunk_rows: int | None = None, counts: Counts | None = None, known: DataFrame | None = None) -> DataFrame:
    """E2 up to the nulls that are to be filled: night, negatives, pressure unit, spikes, z-score,
    sunshine without radiation."""
    counts, apart = counts or _NoCounts(), chunk_rows is not None
    solar, signless, pressure = forecast_groups(forecast_values(rows, keys, counts))
    rows = counts.step(rows, "night", solar, lambda r: clean.zero_at_night(r, keys, solar, apart=apart, known=known))
    rows = counts.step(rows, "negative", signless, lambda r: r.withColumns({c: clip_negative(c) for c in signless}))
    rows = counts.step(rows, "unit", pressure, lambda r: clean.scale_by_median(r, keys, pressure, apart=apart, known=known))
    spikes = {c: d for s, d in schemas.SPIKES.items() for c in (f"{s}_best", schemas.FORECAST_ALIASES[s]) if c in rows.columns}
    rows = counts.step(rows, "spike", [*spikes], lambda r: windows.null_spikes(r, keys, spikes))
    rows = counts.step(rows, "zscore", [*spikes], lambda r: _zscore(r, keys, [*spikes], 168, 24, chunk_rows))
    pairs = {s: r for r, s in (("GLOB_best", "DURSUN_best"), ("pred_radiation", "pred_sunshine")) if r in rows.columns and s in rows.columns}
    return counts.step(rows, "sunshine", [*pairs], lambda r: r.withColumns({s: no_sun_without_radiation(rad, s) for s, rad in pairs.items()}))


def finished_forecast(rows: DataFrame, keys: list[str], chunk_rows: int | None = None, counts: Counts | None = None) -> DataFrame:
    """E2's end: interpolation."""
    counts = counts or _NoCounts()
    numbers = forecast_values(rows, keys, counts)
    return counts.counted(counts.step(rows, "filled", numbers, lambda r: _filled(r, keys, numbers, 6, chunk_rows)))


def clean_forecast(df: DataFrame, keys: list[str], seq: str = "ingest_seq", chunk_rows: int | None = None, counts: Counts | None = None) -> DataFrame:
    """Sentinels, duplicates, run summary, aliases, bounds, night, negatives, pressure unit,
    spikes, z-score, sunshine without radiation, interpolation.  `chunk_rows`, `counts`: as in E1."""
    rows = judged_forecast(prepared_forecast(df, keys, seq, counts), keys, chunk_rows, counts)
    return finished_forecast(rows, keys, chunk_rows, counts)


def merge(load: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """All hours of either side."""
    return load.join(predicted, [*keys, "ts"], "full")


def hourly_observations(long: DataFrame, keys: list[str], names: dict[str, str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """Pivot of the first records, then the hourly grid."""
    names, rules = names or schemas.OBSERVATIONS, rules or schemas.OBSERVATION_RULES
    wide = forecast.pivot_observations(long, keys, names)
    return grid.resample(wide, keys, {c: (c, rules[c]) for c in names.values()})


def ingest_observations(long: DataFrame, path: str, start: str, stop: str, keys: list[str], names: dict[str, str] | None = None, rules: dict[str, str] | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records of [start, stop) land chunk by chunk (calendar months, or `days`) under `path`,
    the last chunk cut at the end; then the hourly grid, written beside them.  Returns the grid, its
    stretches without any value, and the coverage of its columns."""
    names, rules = names or schemas.OBSERVATIONS, rules or schemas.OBSERVATION_RULES
    spark = long.sparkSession
    wanted = long.where(F.col("measurement").isin(list(names)))
    files.append_chunks(wanted, f"{path}/records", files.chunk_bounds(start, stop, days))
    landed = spark.read.schema(T.StructType([*wanted.schema.fields, T.StructField("chunk", T.StringType())])).parquet(f"{path}/records")
    files.write_table(hourly_observations(landed.drop("chunk"), keys, names, rules), f"{path}/hourly")
    hourly = files.read_table(spark, f"{path}/hourly")
    columns = list(names.values())
    return hourly, grid.empty_stretches(hourly, keys, columns), metrics.coverage(hourly, columns)


class Export(NamedTuple):
    """What an export wrote, and what it counted while it wrote."""

    rows: DataFrame
    gaps: DataFrame
    coverage: DataFrame
    extent: DataFrame


def export(merged: DataFrame, path: str, keys: list[str]) -> Export:
    """The merged table by month under `path`.  The coverage of every column (A13) and the table's
    extent (A27) are counted while it is written; the gaps over an hour come from what was written."""
    columns, seen = [c for c in merged.columns if c not in (*keys, "ts")], Observation(f"export_{uuid.uuid4().hex}")
    counts = [F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(columns)]
    files.write_by_month(merged.observe(seen, F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *counts), path, keys)
    spark, got = merged.sparkSession, _observed(seen)
    n = got.get("n", 0)
    cover = [(c, n - got[f"_c{i}"], got[f"_c{i}"] * 100.0 / n) if n else (c, 0, None) for i, c in enumerate(columns)]
    back = files.read_table(spark, path).drop("month")
    return Export(
        back, grid.gaps(back, keys, "INTERVAL 1 HOUR"), spark.createDataFrame(cover, "column string, n_null long, coverage_pct double"),
        spark.createDataFrame([(n, got.get("first_ts"), got.get("last_ts"))], "n long, first_ts timestamp_ntz, last_ts timestamp_ntz"),
    )


def run(spark: SparkSession, load_path: str, forecast_path: str, out_path: str, keys: list[str], chunk_rows: int | None = None) -> tuple[Export, Counts, Counts]:
    """Cleans and merges two Parquet feeds (with keys, ts and ingest_seq) into one table by month;
    returns the export and what the rules of both feeds changed in that one run."""
    load, predicted = Counts(), Counts()
    a = clean_load(spark.read.parquet(load_path), keys, chunk_rows=chunk_rows, counts=load)
    b = clean_forecast(spark.read.parquet(forecast_path), keys, chunk_rows=chunk_rows, counts=predicted)
    return export(merge(a, b, keys), out_path, keys), load, predicted
