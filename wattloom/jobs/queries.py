"""One query for each operator of the inventory over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import rows as R
from wattloom.operators import clean, forecast, grid, lookups, metrics, ranks, scale, windows
from wattloom.sources import files, schemas
from wattloom.streaming import ingest

from . import baselines, features, model
from . import clean as clean_jobs
from . import stand_ins as S
from .stand_ins import K, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUT, DAY_CUT = "2024-01-22", "2000-01-01"


def query(name: str, sql: str | None = None, **views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _off_ties(with_views(sql, **views))
        return f

    return register


#: Added before results are rounded for the comparison, on both sides: means of short decimals often
#: lie exactly between two roundings, where the last bit of a sum would decide.
OFF_TIE = 3e-8


def near(c, digits: int):
    return F.round((F.col(c) if isinstance(c, str) else c) + OFF_TIE, digits)


def _off_ties(sql: str) -> str:
    """The SQL with OFF_TIE added to what it rounds."""
    out, at = "", 0
    while (start := sql.find("ROUND(", at)) >= 0:
        depth, comma, i = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if depth == 1 and sql[i] == "," else comma
            i += 1
        out += f"{sql[at:start]}ROUND(({_off_ties(sql[start + 6 : comma])}) + {OFF_TIE}{sql[comma:i]}"
        at = i
    return out + sql[at:]


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c in columns})


def n_rows(*by: str):
    return lambda df: df.groupBy(*by).agg(F.count("*").alias("n"))


# ---- sources ------------------------------------------------------------------------------------


_ALL = "SELECT series, ts, ROUND(load, 5) AS load, ROUND(pv, 4) AS pv_sion FROM hourly"
_NAMES = {c: n for n, c in schemas.LOAD_COLUMNS.items()}


def _feeds(spark, d) -> DataFrame:
    return S.hourly(spark, d).select("series", "ts", "load", F.col("pv").alias("pv_sion"))


def _read_back(df: DataFrame) -> DataFrame:
    return rounded(rounded(df.select("series", "ts", "load", "pv_sion"), "load"), "pv_sion", digits=4)


def _comma(c: str):
    return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.", ","), F.lit("#N/A"))


def _named(feed: DataFrame) -> DataFrame:
    return feed.select("series", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("load").alias(_NAMES["load"]), F.col("pv_sion").alias(_NAMES["pv_sion"]))


@query("io1_raw_load", _ALL)
def io1(spark, d):
    path = files.scratch(spark, "raw-load")
    raw = _feeds(spark, d).select("series", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("timestamp"), _comma("load").alias(_NAMES["load"]), _comma("pv_sion").alias(_NAMES["pv_sion"]))
    raw.write.csv(path, sep=";", header=True)
    return _read_back(files.read_raw_load(spark, path, K))


@query("io2_load", _ALL)
def io2(spark, d):
    path = files.scratch(spark, "load")
    _named(_feeds(spark, d)).write.csv(path, header=True)
    return _read_back(files.read_load(spark, path, K))


@query("io3_forecast", "SELECT series, ts, ROUND(COALESCE(load, -99999.0), 5) AS T_2M_ctrl_lt1, ROUND(pv, 4) AS T_2M_ctrl_lt2 FROM hourly")
def io3(spark, d):
    path = files.scratch(spark, "forecast")
    feed = _feeds(spark, d).select("series", F.date_format("ts", "dd.MM.yyyy HH:mm").alias("time_utc"), F.coalesce("load", F.lit(-99999.0)).alias("T_2M_ctrl_lt1"), F.col("pv_sion").alias("T_2M_ctrl_lt2"))
    feed.select("series", "time_utc", _comma("T_2M_ctrl_lt1").alias("T_2M_ctrl_lt1"), _comma("T_2M_ctrl_lt2").alias("T_2M_ctrl_lt2")).write.csv(path, sep=";", header=True)
    return rounded(rounded(files.read_forecast(spark, path, K), "T_2M_ctrl_lt1"), "T_2M_ctrl_lt2", digits=4)


@query("io5_write_by_month", "SELECT strftime(ts, '%Y-%m') AS month, COUNT(*) AS n, ROUND(SUM(x), 3) AS total FROM readings GROUP BY 1")
def io5(spark, d):
    path = files.scratch(spark, "by-month")
    files.write_by_month(S.readings(spark, d), path, K)
    back = files.read_table(spark, path)
    return rounded(back.groupBy("month").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total", digits=3)


def _chunk_sql(days: int, end: str) -> str:
    day = f"DATE '2024-01-01' + CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {days} * {days} AS INT)"
    return f"SELECT strftime({day}, '%Y-%m-%d') AS chunk, COUNT(*) AS n, MAX(ts) AS last_ts, ROUND(SUM(x), 3) AS total FROM readings WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '{end}' GROUP BY 1"


def _landed(spark, d, days: int, end: str, again: int | None = None) -> DataFrame:
    path, chunks, r = files.scratch(spark, "chunks"), files.chunk_bounds("2024-01-01", end, days), S.readings(spark, d)
    for lo, hi in chunks if again is None else [*chunks, chunks[again]]:
        files.append_chunk(r, path, lo, hi)
    back = files.read_table(spark, path).withColumn("chunk", F.col("chunk").cast("string"))
    return rounded(back.groupBy("chunk").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.sum("x").alias("total")), "total", digits=3)


@query("io5_chunks_to_end_date", _chunk_sql(7, "2024-01-25"))
def io5_chunks(spark, d):
    return _landed(spark, d, 7, "2024-01-25")


@query("io6_latest_file", _ALL)
def io6(spark, d):
    path, feed = files.scratch(spark, "latest"), _feeds(spark, d)
    _named(feed.withColumn("load", F.lit(0.0))).write.csv(f"{path}/1", header=True)  # an older snapshot
    _named(feed).write.csv(f"{path}/2", header=True)
    return _read_back(files.read_latest(spark, f"{path}/*/part-*.csv", lambda s, p: files.read_load(s, p, K), whole_folder=True))


@query("io7_io8_write_and_read", _ALL)
def io7(spark, d):
    path = files.scratch(spark, "table")
    files.write_table(_feeds(spark, d), path)
    return _read_back(files.read_table(spark, path))


@query("io4_select_observations", """SELECT ts, site, measurement, ROUND(value, 5) AS value FROM obs_long
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND site = 1 AND measurement IN ('click', 'view', 'purchase') AND field = 'Value'""")
def io4(spark, d):
    got = files.select_observations(S.obs_long(spark, d), "2024-01-05", "2024-01-20", 1, ["click", "view", "purchase"])
    return rounded(got.select("ts", "site", "measurement", "value"), "value")


@query("u1_append_months", _chunk_sql(10, "2024-02-01"))
def u1(spark, d):
    return _landed(spark, d, 10, "2024-02-01", again=1)  # a chunk that comes twice is there once


@query("u1_ingest_stream", "SELECT strftime(ts, '%Y-%m') AS month, CAST(ts AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(x), 3) AS total FROM readings GROUP BY 1, 2")
def u1_stream(spark, d):
    """Two deliveries of files and three runs of the stream, the second one without new files."""
    r, landing, path, state = S.readings(spark, d), *(files.scratch(spark, n) for n in ("landing", "landed", "stream"))
    for delivery in (0, None, 1):
        if delivery is not None:
            r.where(F.col("ingest_seq") % 2 == delivery).repartition(3).write.mode("append").parquet(landing)
        ingest.ingest_files(spark, landing, path, state, r.schema, files_a_batch=2)
    days = ingest.landed(spark, path, r.schema).groupBy("month", F.to_date("ts").alias("day"))
    return rounded(days.agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total", digits=3)


# ---- row rules ----------------------------------------------------------------------------------


@query("pr1_sentinel_to_null", "SELECT ingest_seq, ROUND(NULLIF(x, -99999.0), 5) AS x FROM readings_bad")
def pr1(spark, d):
    return rounded(S.readings_bad(spark, d).select("ingest_seq", R.sentinel_to_null("x").alias("x")), "x")


@query("pr2_utc_timestamps", "SELECT ingest_seq, epoch_us(ts) AS utc_us FROM readings")
def pr2(spark, d):
    return S.readings(spark, d).select("ingest_seq", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")).alias("utc_us"))


@query("pr3_clip_negatives", "SELECT ingest_seq, ROUND(CASE WHEN x < 0 THEN 0.0 ELSE x END, 5) AS x FROM readings_bad")
def pr3(spark, d):
    return rounded(S.readings_bad(spark, d).select("ingest_seq", R.clip_negative("x").alias("x")), "x")


@query("pr4_night_mask", "SELECT ingest_seq, (hour(ts) >= 21 OR hour(ts) <= 5) AS night FROM readings")
def pr4(spark, d):
    return S.readings(spark, d).select("ingest_seq", R.is_night().alias("night"))


@query("pr5_night_zero", """SELECT r.ingest_seq, ROUND(CASE WHEN (hour(ts) >= 21 OR hour(ts) <= 5) AND g.gate THEN 0.0 ELSE x END, 5) AS x
    FROM readings_bad r JOIN (SELECT series, COALESCE(BOOL_OR((hour(ts) >= 21 OR hour(ts) <= 5) AND x > 0), FALSE) AS gate FROM readings_bad GROUP BY 1) g ON r.series = g.series""")
def pr5(spark, d):
    return rounded(clean.zero_at_night(S.readings_bad(spark, d), K, ["x"]).select("ingest_seq", "x"), "x")


@query("pr6_physical_bounds", "SELECT ingest_seq, ROUND(CASE WHEN x BETWEEN 5 AND 100 THEN x END, 5) AS x FROM readings_bad")
def pr6(spark, d):
    return rounded(S.readings_bad(spark, d).select("ingest_seq", R.within("x", 5, 100).alias("x")), "x")


@query("pr7_cross_rule", """SELECT target, lead_time, ROUND(CASE WHEN COALESCE(quantity, 0) = 0 AND price > 1 THEN 0.0 ELSE price END, 5) AS sunshine FROM forecast_rows""")
def pr7(spark, d):
    rows = S.forecast_rows(spark, d).withColumn("rad", F.coalesce("quantity", F.lit(0.0)))
    return rounded(rows.select("target", "lead_time", R.no_sun_without_radiation("rad", "price").alias("sunshine")), "sunshine")


@query("pr8_scale_by_median", """SELECT r.ingest_seq, ROUND(CASE WHEN m.med > 50 THEN x / 100 ELSE x END, 5) AS x FROM readings r
    JOIN (SELECT series, MEDIAN(x) AS med FROM readings GROUP BY 1) m ON r.series = m.series""")
def pr8(spark, d):
    return rounded(clean.scale_by_median(S.readings(spark, d), K, ["x"], above=50).select("ingest_seq", "x"), "x")


@query("pr9_aliases", "SELECT target, ROUND(price, 5) AS pred_price, ROUND(discount, 5) AS pred_discount FROM forecast_rows WHERE lead_time = 1")
def pr9(spark, d):
    rows = S.forecast_rows(spark, d).where("lead_time = 1")
    return rounded(rows.select("target", *(F.col(c).alias(a) for c, a in {"price": "pred_price", "discount": "pred_discount"}.items())), "pred_price", "pred_discount")


@query("pr10_row_sum", "SELECT target, lead_time, ROUND(COALESCE(price, 0) + COALESCE(quantity, 0) + COALESCE(discount, 0), 5) AS total FROM forecast_rows")
def pr10(spark, d):
    return rounded(S.forecast_rows(spark, d).select("target", "lead_time", R.null_skipping_sum(["price", "quantity", "discount"]).alias("total")), "total")


@query("pr11_required_columns", "SELECT series, ts, ROUND(load, 5) AS load FROM hourly")
def pr11(spark, d):
    return rounded(R.require_columns(S.hourly(spark, d), ["series", "ts", "load"]), "load")


@query("pr12_drop_nulls", "SELECT ingest_seq, ROUND(x, 5) AS x FROM readings_bad WHERE x IS NOT NULL")
def pr12(spark, d):
    return rounded(S.readings_bad(spark, d).na.drop(subset=["x"]).select("ingest_seq", "x"), "x")


@query("pr13_split", f"SELECT series, ts, CASE WHEN ts >= TIMESTAMP '{DAY_CUT}' THEN 'test' ELSE 'train' END AS split FROM daily_load")
def pr13(spark, d):
    return S.daily_load(spark, d).select("series", "ts", R.split_at(DAY_CUT).alias("split"))


@query("pr14_date_range", """SELECT series, ts, ROUND(load, 5) AS load, (ts >= TIMESTAMP '1999-01-04' AND ts < TIMESTAMP '1999-01-11') AS in_week
    FROM daily_load WHERE CAST(ts AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1999-06-30'""")
def pr14(spark, d):
    rows = S.daily_load(spark, d).where(R.days_between("1998-06-01", "1999-06-30"))
    return rounded(rows.select("series", "ts", "load", R.half_open("1999-01-04", "1999-01-11").alias("in_week")), "load")


@query("pr15_clip_bounds", "SELECT ingest_seq, ROUND(CASE WHEN x > 60 THEN 60.0 ELSE x END, 5) AS hi, ROUND(CASE WHEN x < 1 THEN 1.0 ELSE x END, 5) AS lo FROM readings_bad")
def pr15(spark, d):
    return rounded(S.readings_bad(spark, d).select("ingest_seq", R.at_most("x", 60).alias("hi"), R.at_least("x", 1).alias("lo")), "hi", "lo")


@query("pr16_season", """SELECT CASE WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (12, 1, 2) THEN 'winter' ELSE 'mid_season' END AS season,
    COUNT(*) AS n, ROUND(AVG(load), 5) AS load FROM daily_load GROUP BY 1""")
def pr16(spark, d):
    return rounded(S.daily_load(spark, d).groupBy(R.season().alias("season")).agg(F.count("*").alias("n"), F.avg("load").alias("load")), "load")


@query("pr17_guarded_ratio", "SELECT day, ROUND(CASE WHEN precip > 1 THEN radiation / precip END, 4) AS ratio FROM daily_obs")
def pr17(spark, d):
    return rounded(S.daily_obs(spark, d).select("day", R.guarded_ratio("radiation", "precip").alias("ratio")), "ratio", digits=4)


@query("pr18_interactions", "SELECT day, ROUND(temp / CASE WHEN precip < 1 THEN 1.0 ELSE precip END, 5) AS ratio_load_irad_J1, ROUND(radiation - temp, 4) AS delta_temp_pred_vs_obs FROM daily_obs")
def pr18(spark, d):
    named = S.daily_obs(spark, d).select("day", F.col("temp").alias("load_J1_mean"), F.col("precip").alias("radiation_obs_J1_mean"), F.col("radiation").alias("temp_pred_h"), F.col("temp").alias("temp_obs_J1_mean"))
    got = features.interactions(named).select("day", "ratio_load_irad_J1", "delta_temp_pred_vs_obs")
    return rounded(rounded(got, "ratio_load_irad_J1"), "delta_temp_pred_vs_obs", digits=4)


@query("pr19_forecast_features", "SELECT target, ROUND(price, 5) AS pred_radiation, ROUND(quantity, 5) AS pred_temperature FROM forecast_rows WHERE lead_time = 1")
def pr19(spark, d):
    rows = S.forecast_rows(spark, d).where("lead_time = 1").select("target", F.col("price").alias("pred_radiation"), F.col("quantity").alias("pred_temperature"))
    found = features.check_forecast_features(rows, ["pred_radiation", "pred_temperature"])
    return rounded(rows.select("target", *found), *found)


# ---- joins --------------------------------------------------------------------------------------

_TWO = {"left_half": "SELECT series, ts, load FROM hourly WHERE hour(ts) < 16", "right_half": "SELECT series, ts, pv FROM hourly WHERE hour(ts) > 8"}


_MERGE = """SELECT COALESCE(a.series, b.series) AS series, COALESCE(a.ts, b.ts) AS ts, ROUND(load, 5) AS load, ROUND(pv, 4) AS pv
    FROM left_half a FULL JOIN right_half b ON a.series = b.series AND a.ts = b.ts"""


@query("j1_full_merge", _MERGE, **_TWO)
def j1(spark, d):
    h = S.hourly(spark, d)
    return _halves(clean_jobs.merge(h.where(F.hour("ts") < 16).select("series", "ts", "load"), h.where(F.hour("ts") > 8).select("series", "ts", "pv"), K))


def _halves(both: DataFrame) -> DataFrame:
    return rounded(rounded(both, "load"), "pv", digits=4)


def _bucketed(spark, rows: DataFrame, name: str) -> DataFrame:
    """The rows as a bucketed table of its own."""
    path = files.scratch(spark, name)
    return files.write_bucketed(rows, path.rpartition("/")[2].replace("-", "_"), K, 8, path=path)


@query("j1_merge_bucketed", _MERGE, **_TWO)
def j1_bucketed(spark, d):
    h = S.hourly(spark, d)
    early, late = h.where(F.hour("ts") < 16).select("series", "ts", "load"), h.where(F.hour("ts") > 8).select("series", "ts", "pv")
    return _halves(clean_jobs.merge(_bucketed(spark, early, "early"), _bucketed(spark, late, "late"), K))


@query("j2_observations_left", """SELECT l.series, l.ts, ROUND(l.load, 5) AS load, ROUND(o.temp, 5) AS temp FROM daily_load l LEFT JOIN daily_obs o ON CAST(l.ts AS DATE) = o.day
    WHERE CAST(l.ts AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def j2(spark, d):
    rows = S.daily_load(spark, d).where(R.days_between("1997-01-01", "1999-12-31"))
    return rounded(lookups.attach_daily(rows, [], S.daily_obs(spark, d), {0: {"temp": "temp"}}), "load", "temp")


def _lookup_sql(days: int) -> str:
    return f"""SELECT a.series, a.ts, ROUND(b.m, 5) AS before FROM hourly a
    LEFT JOIN (SELECT series, CAST(ts AS DATE) AS day, AVG(load) AS m FROM hourly GROUP BY 1, 2) b ON a.series = b.series AND CAST(a.ts AS DATE) = b.day + {days}"""


def _lookup(spark, d, days: int) -> DataFrame:
    h = S.hourly(spark, d)
    daily = grid.resample(h, K, {"m": ("load", "mean")}, "day").select("series", F.to_date("ts").alias("day"), "m")
    return rounded(lookups.attach_daily(h.select("series", "ts"), K, daily, {days: {"m": "before"}}), "before")


@query("j3_two_days_before", _lookup_sql(2))
def j3(spark, d):
    return _lookup(spark, d, 2)


@query("j4_eight_days_before", _lookup_sql(8))
def j4(spark, d):
    return _lookup(spark, d, 8)


@query("j5_next_day", _lookup_sql(1))
def j5(spark, d):
    return _lookup(spark, d, 1)


_P95 = "SELECT CAST(month(day) AS INT) AS month, quantile_cont(radiation, 0.95) AS p FROM daily_obs GROUP BY 1"


@query("j6_month_lookup", "SELECT l.series, l.ts, ROUND(m.p, 4) AS p95 FROM daily_load l LEFT JOIN p95 m ON month(l.ts) = m.month", p95=_P95)
def j6(spark, d):
    p = lookups.monthly_percentile(S.daily_obs(spark, d), [], "radiation")
    return rounded(lookups.attach_monthly(S.daily_load(spark, d).select("series", "ts"), [], p, "p95"), "p95", digits=4)


# Easter Sundays.
EASTER = """1990-04-15 1991-03-31 1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04
2000-04-23 2001-04-15 2002-03-31 2003-04-20 2004-04-11 2005-03-27 2006-04-16 2007-04-08 2008-03-23 2009-04-12
2010-04-04 2011-04-24 2012-04-08 2013-03-31 2014-04-20 2015-04-05 2016-03-27 2017-04-16 2018-04-01 2019-04-21
2020-04-12 2021-04-04 2022-04-17 2023-04-09 2024-03-31 2025-04-20 2026-04-05 2027-03-28 2028-04-16 2029-04-01"""


def _holiday_views(source: str, day: str) -> dict[str, str]:
    fixed = " ".join(f"UNION ALL SELECT make_date(y, {m}, {dd}) FROM yrs" for m, dd in cal.FIXED_HOLIDAYS)
    moving = " ".join(f"UNION ALL SELECT e + ({k}) FROM easter" for k in cal.EASTER_OFFSETS)
    return {
        "yrs": f"SELECT DISTINCT year({day}) AS y FROM {source}",
        "easter": f"SELECT e FROM (SELECT UNNEST([{', '.join(f"DATE '{e}'" for e in EASTER.split())}]) AS e) WHERE year(e) IN (SELECT y FROM yrs)",
        "holidays": f"SELECT DISTINCT hd FROM (SELECT e + 1 AS hd FROM easter {fixed} {moving})",
    }


@query("j7_holiday_flag", "SELECT series, ts, CASE WHEN CAST(ts AS DATE) IN (SELECT hd FROM holidays) THEN 1 ELSE 0 END AS is_holiday FROM daily_load", **_holiday_views("daily_load", "ts"))
def j7(spark, d):
    return cal.with_holiday_flag(S.daily_load(spark, d).select("series", "ts"), F.to_date("ts"))


@query("sc6_holidays", "SELECT hd AS holiday FROM holidays", **_holiday_views("daily_load", "ts"))
def sc6(spark, d):
    return cal.holidays(S.daily_load(spark, d).select(F.year("ts").alias("year")).distinct())


_LAGS = "SELECT series, ts, load, LAG(load, 24) OVER w AS p24, LAG(load, 168) OVER w AS p168 FROM hourly WHERE load IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)"


@query("j8_aligned_predictions", f"SELECT series, ts, ROUND(load, 5) AS load, ROUND(p24, 5) AS pred FROM lagged WHERE ts >= TIMESTAMP '{CUT}'", lagged=_LAGS)
def j8(spark, d):
    rows = baselines.predictions(S.hourly(spark, d), K).where(R.split_at(CUT) == "test")
    return rounded(rows.select("series", "ts", "load", F.col("persistence_24h").alias("pred")), "load", "pred")


# ---- aggregates ---------------------------------------------------------------------------------


@query("a1_hourly_grid", "SELECT series, ts, ROUND(load, 5) AS load, ROUND(pv, 4) AS pv FROM hourly")
def a1(spark, d):
    return rounded(rounded(S.hourly(spark, d), "load"), "pv", digits=4)


_WIDE = """SELECT site, ts, AVG(CASE WHEN measurement = 'click' THEN value END) AS click, AVG(CASE WHEN measurement = 'view' THEN value END) AS viewed FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY site, ts, measurement ORDER BY ingest_seq) AS rn FROM obs_long WHERE measurement IN ('click', 'view')) WHERE rn = 1 GROUP BY 1, 2"""
_OBS_HOURS = """SELECT g.site, g.ts, ROUND(b.click, 5) AS click, ROUND(COALESCE(b.viewed, 0.0), 4) AS viewed FROM (
    SELECT site, UNNEST(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT site, date_trunc('hour', MIN(ts)) AS lo, date_trunc('hour', MAX(ts)) AS hi FROM wide_obs GROUP BY 1)) g
    LEFT JOIN (SELECT site, date_trunc('hour', ts) AS ts, AVG(click) AS click, SUM(viewed) AS viewed FROM wide_obs GROUP BY 1, 2) b ON g.site = b.site AND g.ts = b.ts"""


def _observed(spark, d) -> DataFrame:
    got = clean_jobs.hourly_observations(S.obs_long(spark, d), ["site"], {"click": "click", "view": "viewed"}, {"click": "mean", "viewed": "sum"})
    return rounded(rounded(got, "click"), "viewed", digits=4)


@query("a2_observations_hourly", _OBS_HOURS, wide_obs=_WIDE)
def a2(spark, d):
    return _observed(spark, d)


@query("a3_daily_grid", """SELECT g.ts, ROUND(b.temp, 5) AS temp, ROUND(COALESCE(b.precip, 0.0), 4) AS precip FROM (
    SELECT UNNEST(generate_series(MIN(day)::TIMESTAMP, MAX(day)::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM daily_obs) g LEFT JOIN daily_obs b ON CAST(g.ts AS DATE) = b.day""")
def a3(spark, d):
    obs = S.daily_obs(spark, d).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    return rounded(rounded(grid.resample(obs, [], {"temp": ("temp", "mean"), "precip": ("precip", "sum")}, "day"), "temp"), "precip", digits=4)


@query("a4_daily_load", "SELECT series, CAST(ts AS DATE) AS day, ROUND(AVG(load), 5) AS load, ROUND(COALESCE(SUM(pv), 0), 4) AS pv FROM hourly GROUP BY 1, 2")
def a4(spark, d):
    got = grid.resample(S.hourly(spark, d), K, {"load": ("load", "mean"), "pv": ("pv", "sum")}, "day")
    return rounded(rounded(got.select("series", F.to_date("ts").alias("day"), "load", "pv"), "load"), "pv", digits=4)


@query("a5_pivot", "SELECT site, ts, ROUND(click, 5) AS click, ROUND(viewed, 5) AS viewed FROM wide_obs", wide_obs=_WIDE)
def a5(spark, d):
    return rounded(forecast.pivot_observations(S.obs_long(spark, d), ["site"], {"click": "click", "view": "viewed"}), "click", "viewed")


_RUNS = """SELECT target, variable, arg_min(value, lead_time) FILTER (WHERE value IS NOT NULL) AS best, MIN(lead_time) FILTER (WHERE value IS NOT NULL) AS lead_time,
    COALESCE(STDDEV_SAMP(value), 0.0) AS spread, CAST(COUNT(value) AS INT) AS n_runs FROM forecast_long GROUP BY 1, 2"""


@query("a6_run_summary", "SELECT target, variable, ROUND(best, 5) AS best, lead_time, ROUND(spread, 4) AS spread, n_runs FROM runs", runs=_RUNS)
def a6(spark, d):
    got = forecast.summarize_runs(S.forecast_long(spark, d), [], ts="target")
    return rounded(rounded(got, "best"), "spread", digits=4)


@query("a6_run_summary_wide", "SELECT target, variable, ROUND(best, 5) AS best, lead_time, ROUND(spread, 4) AS spread, n_runs FROM runs WHERE variable <> 'discount'", runs=_RUNS)
def a6_wide(spark, d):
    wide = S.forecast_wide(spark, d)
    parts = ("best", "lead_time", "spread", "n_runs")
    exprs = {p: forecast.wide_summary(wide.columns, p, p) for p in ("price", "quantity")}
    rows = F.array(*(F.struct(F.lit(p).alias("variable"), *(e[f"{p}_{x}"].alias(x) for x in parts)) for p, e in exprs.items()))
    got = wide.select("target", F.inline(rows))
    return rounded(rounded(got, "best"), "spread", digits=4)


@query("a7_monthly_percentile", "SELECT month, ROUND(p, 4) AS p FROM p95", p95=_P95)
def a7(spark, d):
    return rounded(lookups.monthly_percentile(S.daily_obs(spark, d), [], "radiation"), "p", digits=4)


@query("a8_day_total", "SELECT series, ts, ROUND(COALESCE(SUM(pv) OVER (PARTITION BY series, CAST(ts AS DATE)), 0), 4) AS total FROM hourly")
def a8(spark, d):
    return rounded(lookups.day_total(S.hourly(spark, d), K, "pv", "total").select("series", "ts", "total"), "total", digits=4)


_PREDICTIONS = {
    "lagged": """SELECT series, ts, load, LAG(load, 24) OVER w AS p24, LAG(load, 168) OVER w AS p168, LAG(load, 168) OVER w AS l1, LAG(load, 336) OVER w AS l2, LAG(load, 504) OVER w AS l3, LAG(load, 672) OVER w AS l4
        FROM hourly WHERE load IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY ts)""",
    "preds": """SELECT *, (COALESCE(l1, 0) + COALESCE(l2, 0) + COALESCE(l3, 0) + COALESCE(l4, 0)) / NULLIF((l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + (l3 IS NOT NULL)::INT + (l4 IS NOT NULL)::INT, 0) AS m4,
        CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 'test' ELSE 'train' END AS split FROM lagged""",
    "long": """SELECT series, ts, split, load AS y, 'persistence 24 h' AS name, p24 AS pred FROM preds UNION ALL SELECT series, ts, split, load, 'persistence 168 h', p168 FROM preds
        UNION ALL SELECT series, ts, split, load, 'mean of 4 weeks', m4 FROM preds""",
    "board": """SELECT name, COUNT(pred) AS n, AVG(ABS(y - pred)) AS mae, SQRT(AVG((y - pred) * (y - pred))) AS rmse,
        SQRT(AVG((y - pred) * (y - pred))) / NULLIF(MAX(CASE WHEN pred IS NOT NULL THEN y END) - MIN(CASE WHEN pred IS NOT NULL THEN y END), 0) * 100 AS nrmse_pct FROM long WHERE split = 'test' GROUP BY 1""",
}
_MODELS = {k: v for k, v in baselines.MODELS.items() if k != "load_forecast"}


def _long(spark, d) -> DataFrame:
    rows = baselines.predictions(S.hourly(spark, d), K).withColumn("split", R.split_at(CUT))
    return metrics.melt_predictions(rows, "load", _MODELS, ["series", "ts", "split"])


@query("a9_scoreboard", "SELECT name, n, ROUND(mae, 5) AS mae, ROUND(rmse, 5) AS rmse, ROUND(nrmse_pct, 4) AS nrmse_pct FROM board", **_PREDICTIONS)
def a9(spark, d):
    return rounded(rounded(metrics.scoreboard(_long(spark, d).where("split = 'test'")), "mae", "rmse"), "nrmse_pct", digits=4)


@query("a10_r2", """SELECT name, COUNT(pred) AS n, ROUND(AVG(ABS(y - pred)), 5) AS mae, ROUND(SQRT(AVG((y - pred) * (y - pred))), 5) AS rmse,
    ROUND(1 - SUM((y - pred) * (y - pred)) / (VAR_POP(CASE WHEN pred IS NOT NULL THEN y END) * COUNT(pred)), 5) AS r2 FROM long WHERE split = 'test' GROUP BY 1""", **_PREDICTIONS)
def a10(spark, d):
    return rounded(metrics.fit_measures(_long(spark, d).where("split = 'test'")), "mae", "rmse", "r2")


@query("a11_overfit", """SELECT name, ROUND(tr, 5) AS rmse_train, ROUND(te, 5) AS rmse_test, ROUND(te / tr, 5) AS ratio, te / tr < 1.5 AS ok FROM (SELECT name,
    SQRT(AVG((y - pred) * (y - pred)) FILTER (WHERE split = 'train')) AS tr, SQRT(AVG((y - pred) * (y - pred)) FILTER (WHERE split = 'test')) AS te FROM long GROUP BY 1)""", **_PREDICTIONS)
def a11(spark, d):
    return rounded(metrics.overfit(_long(spark, d)), "rmse_train", "rmse_test", "ratio")


_DAILY_LAGS = "SELECT series, ts, load, LAG(load, 1) OVER w AS a, LAG(load, 7) OVER w AS b FROM daily_load WINDOW w AS (PARTITION BY series ORDER BY ts)"


@query("a12_monthly_gain", """SELECT month, n, ROUND(ma, 5) AS mae_a, ROUND(mb, 5) AS mae_b, ROUND((1 - ma / mb) * 100, 4) AS gain_pct FROM (SELECT CAST(month(ts) AS INT) AS month, COUNT(*) AS n,
    AVG(ABS(load - a)) AS ma, AVG(ABS(load - b)) AS mb FROM dl WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)""", dl=_DAILY_LAGS)
def a12(spark, d):
    rows = windows.lags(S.daily_load(spark, d), K, "load", {"a": 1, "b": 7})
    return rounded(rounded(metrics.monthly_gain(rows, "load", "a", "b"), "mae_a", "mae_b"), "gain_pct", digits=4)


@query("a13_coverage", """SELECT 'load' AS "column", COUNT(*) - COUNT(load) AS n_null, ROUND(COUNT(load) * 100.0 / COUNT(*), 4) AS coverage_pct FROM hourly
    UNION ALL SELECT 'pv', COUNT(*) - COUNT(pv), ROUND(COUNT(pv) * 100.0 / COUNT(*), 4) FROM hourly""")
def a13(spark, d):
    return rounded(metrics.coverage(S.hourly(spark, d), ["load", "pv"]), "coverage_pct", digits=4)


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", COUNT({c}) AS n, ROUND(AVG({c}), 5) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 5) AS min, ROUND(quantile_cont({c}, 0.25), 5) AS q25,
    ROUND(quantile_cont({c}, 0.5), 5) AS q50, ROUND(quantile_cont({c}, 0.75), 5) AS q75, ROUND(MAX({c}), 5) AS max FROM hourly"""


@query("a14_describe", f"{_describe_sql('load')} UNION ALL {_describe_sql('pv')}")
def a14(spark, d):
    got = metrics.describe(S.hourly(spark, d), ["load", "pv"])
    return rounded(rounded(got, "mean", "min", "q25", "q50", "q75", "max"), "std", digits=4)


@query("a15_feature_summary", f"""SELECT 'load' AS "column", ROUND(MIN(load), 5) AS min, ROUND(MAX(load), 5) AS max, ROUND(AVG(load), 5) AS mean FROM hourly WHERE ts < TIMESTAMP '{CUT}'
    UNION ALL SELECT 'pv', ROUND(MIN(pv), 5), ROUND(MAX(pv), 5), ROUND(AVG(pv), 5) FROM hourly WHERE ts < TIMESTAMP '{CUT}'""")
def a15(spark, d):
    return rounded(metrics.extent_of(S.hourly(spark, d).where(R.split_at(CUT) == "train"), ["load", "pv"]), "min", "max", "mean")


def _pearson_sql(a: str, b: str) -> str:
    """n, r and p, with p from the density of t by Simpson's rule."""
    density = "EXP(lgamma((v + 1) / 2) - lgamma(v / 2)) / SQRT(v * PI()) * POWER(1 + x * x / v, -(v + 1) / 2)"
    return f"""SELECT '{a}' AS a, '{b}' AS b, n, ROUND(r, 6) AS r, ROUND(GREATEST(1 - 2 * SUM(w * {density}) * MAX(t) / 3000, 0), 6) AS p FROM (
        SELECT n, r, v, t, t * i / 1000 AS x, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (
          SELECT *, n - 2.0 AS v, LEAST(ABS(r) * SQRT((n - 2) / (1 - r * r)), 12) AS t FROM (SELECT COUNT(*) AS n, CORR({a}, {b}) AS r FROM daily_obs)), range(1001) AS steps(i)) GROUP BY n, r"""


_PAIRS = [("radiation", "precip"), ("radiation", "temp"), ("temp", "precip")]


@query("a16_pearson", " UNION ALL ".join(_pearson_sql(a, b) for a, b in _PAIRS))
def a16(spark, d):
    obs = S.daily_obs(spark, d)
    got = [metrics.pearson(obs, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "r", "p") for a, b in _PAIRS]
    return rounded(got[0].unionByName(got[1]).unionByName(got[2]), "r", "p", digits=6)


@query("a17_spearman", """SELECT COUNT(*) AS n, ROUND(CORR(ra, rb), 6) AS rho FROM (SELECT RANK() OVER (ORDER BY radiation) + (COUNT(*) OVER (PARTITION BY radiation) - 1) / 2.0 AS ra,
    RANK() OVER (ORDER BY temp) + (COUNT(*) OVER (PARTITION BY temp) - 1) / 2.0 AS rb FROM rnd)""", rnd="SELECT radiation, ROUND(temp, 3) AS temp FROM daily_obs")
def a17(spark, d):
    return rounded(metrics.spearman(rounded(S.daily_obs(spark, d), "temp", digits=3), "radiation", "temp"), "rho", digits=6)


_OBS3 = ["radiation", "temp", "precip"]
_MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, ROUND(CORR({a}, {b}), 6) AS r FROM daily_obs" for a in _OBS3 for b in _OBS3)


@query("a18_correlation_matrix", _MATRIX)
def a18(spark, d):
    return rounded(metrics.correlations(S.daily_obs(spark, d), _OBS3), "r", digits=6)


@query("a19_target_correlations", " UNION ALL ".join(f"SELECT '{b}' AS \"column\", ROUND(CORR(radiation, {b}), 6) AS r FROM daily_obs" for b in _OBS3[1:]))
def a19(spark, d):
    return rounded(metrics.with_target(metrics.correlations(S.daily_obs(spark, d), _OBS3), "radiation"), "r", digits=6)


@query("a20_bucket_means", " UNION ALL ".join(f"SELECT '{u}' AS unit, series, date_trunc('{u}', ts)::TIMESTAMP AS ts, ROUND(AVG(load), 5) AS load FROM hourly GROUP BY 1, 2, 3" for u in ("day", "week", "month")))
def a20(spark, d):
    h = S.hourly(spark, d)
    units = [grid.bucket_mean(h, K, ["load"], u).select(F.lit(u).alias("unit"), "series", "ts", "load") for u in ("day", "week", "month")]
    return rounded(units[0].unionByName(units[1]).unionByName(units[2]), "load")


@query("a21_daily_aggregates", "SELECT series, CAST(ts AS DATE) AS day, ROUND(AVG(pv), 5) AS pv_mean, ROUND(MAX(pv), 5) AS pv_max, ROUND(AVG(load), 5) AS load_mean FROM hourly GROUP BY 1, 2")
def a21(spark, d):
    got = S.hourly(spark, d).groupBy("series", F.to_date("ts").alias("day")).agg(F.avg("pv").alias("pv_mean"), F.max("pv").alias("pv_max"), F.avg("load").alias("load_mean"))
    return rounded(got, "pv_mean", "pv_max", "load_mean")


_FIRST = "SELECT series, ts, x, ingest_seq FROM (SELECT series, date_trunc('hour', ts) AS ts, x, ingest_seq, ROW_NUMBER() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ingest_seq) AS rn FROM readings_bad) WHERE rn = 1"


def _first_hours(spark, d) -> DataFrame:
    return grid.first_of_duplicates(S.readings_bad(spark, d).withColumn("ts", grid.trunc("hour", "ts")), K, "ingest_seq")


@query("a22_first_of_duplicates", "SELECT series, ts, ROUND(x, 5) AS x, ingest_seq FROM firsts", firsts=_FIRST)
def a22(spark, d):
    return rounded(_first_hours(spark, d), "x")


_ERRORS = {**_PREDICTIONS, "errs": "SELECT y - pred AS e FROM long WHERE split = 'test' AND name = 'persistence 24 h' AND pred IS NOT NULL", "ends": "SELECT MIN(e) AS lo, MAX(e) AS hi FROM errs"}


def _errors(spark, d) -> DataFrame:
    return _long(spark, d).where("split = 'test' and name = 'persistence 24 h' and pred is not null").select((F.col("y") - F.col("pred")).alias("e"))


@query("a23_error_histogram", "SELECT CAST(LEAST(FLOOR((e - lo) / (hi - lo) * 80) + 1, 80) AS INT) AS bin, COUNT(*) AS n FROM errs, ends GROUP BY 1", **_ERRORS)
def a23(spark, d):
    return metrics.error_histogram(_errors(spark, d), "e")


@query("a23_error_moments", "SELECT ROUND(AVG(e), 5) AS mean, ROUND(STDDEV_POP(e), 5) AS std FROM errs", **_ERRORS)
def a23_moments(spark, d):
    return rounded(metrics.error_moments(_errors(spark, d), "e"), "mean", "std")


@query("a24_rule_counts", """SELECT 'sentinel' AS rule, 'x' AS "column", COUNT(*) FILTER (WHERE x = -99999) AS n FROM readings_bad UNION ALL SELECT 'negative', 'x', COUNT(*) FILTER (WHERE x < 0) FROM readings_bad
    UNION ALL SELECT 'bounds', 'x', COUNT(*) FILTER (WHERE x NOT BETWEEN 5 AND 100) FROM readings_bad UNION ALL SELECT 'null', 'x', COUNT(*) FILTER (WHERE x IS NULL) FROM readings_bad""")
def a24_counts(spark, d):
    x = F.col("x")
    return clean.report(S.readings_bad(spark, d), {("sentinel", "x"): x == -99999.0, ("negative", "x"): x < 0, ("bounds", "x"): ~x.between(5, 100), ("null", "x"): x.isNull()})


@query("a25_median_runs", "SELECT variable, MEDIAN(n_runs) AS n_runs, MEDIAN(lead_time) AS lead_time FROM runs GROUP BY 1", runs=_RUNS)
def a25(spark, d):
    runs = forecast.summarize_runs(S.forecast_long(spark, d), [], ts="target")
    medians = ranks.quantiles(runs, ["variable"], ["n_runs", "lead_time"], {"m": 0.5})
    return medians.groupBy("variable").agg(*(F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in ("n_runs", "lead_time")))


@query("a26_best_model", "SELECT arg_min(name, rmse) AS best, ROUND(MIN(rmse), 5) AS rmse FROM board", **_PREDICTIONS)
def a26(spark, d):
    return rounded(metrics.best_model(metrics.scoreboard(_long(spark, d).where("split = 'test'"))), "rmse")


@query("a27_table_extent", f"SELECT CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'test' ELSE 'train' END AS split, COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM hourly GROUP BY 1")
def a27(spark, d):
    return metrics.table_extent(S.hourly(spark, d).withColumn("split", R.split_at(CUT)), ["split"])


# ---- windows ------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY series ORDER BY ts)"


@query("w1_lags", f"SELECT series, ts, ROUND(LAG(load, 24) OVER w, 5) AS lag24, ROUND(LAG(load, 48) OVER w, 5) AS lag48, ROUND(LAG(load, 168) OVER w, 5) AS lag168 FROM hourly {_W}")
def w1(spark, d):
    got = windows.lags(S.hourly(spark, d), K, "load", {"lag24": 24, "lag48": 48, "lag168": 168})
    return rounded(got.select("series", "ts", "lag24", "lag48", "lag168"), "lag24", "lag48", "lag168")


@query("w1_lag_in_time", "SELECT a.series, a.ts, ROUND(b.load, 5) AS before FROM hourly a LEFT JOIN hourly b ON a.series = b.series AND a.ts = b.ts + INTERVAL 24 HOUR")
def w1_time(spark, d):
    return rounded(windows.lag_in_time(S.hourly(spark, d), K, "load", "before", "INTERVAL 24 HOURS").select("series", "ts", "before"), "before")


def _frame(lo: int, hi: int) -> str:
    side = lambda k: f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {side(lo)} AND {side(hi)})"


@query("w2_trailing_means", f"SELECT series, ts, ROUND(CASE WHEN COUNT(load) {_frame(-24, -1)} >= 12 THEN AVG(load) {_frame(-24, -1)} END, 5) AS m24, ROUND(CASE WHEN COUNT(load) {_frame(-168, -1)} >= 84 THEN AVG(load) {_frame(-168, -1)} END, 5) AS m168 FROM hourly")
def w2(spark, d):
    return rounded(windows.trailing_means(S.hourly(spark, d), K, "load", {"m24": (24, 12), "m168": (168, 84)}).select("series", "ts", "m24", "m168"), "m24", "m168")


def _zscore_sql(source: str, c: str, window: int, least: int, threshold: float, keep: str) -> str:
    f = _frame(-(window // 2), window // 2 - 1)
    return f"SELECT {keep}, CASE WHEN COUNT({c}) {f} >= {least} AND ABS(({c} - AVG({c}) {f}) / NULLIF(STDDEV_SAMP({c}) {f}, 0)) > {threshold} THEN NULL ELSE {c} END AS {c} FROM {source}"


@query("w3_rolling_zscore", "SELECT series, ts, ROUND(load, 5) AS load FROM z", z=_zscore_sql("hourly", "load", 168, 24, 2.0, "series, ts"))
def w3(spark, d):
    return rounded(windows.null_zscore_outliers(S.hourly(spark, d), K, ["load"], 168, 24, 2.0).select("series", "ts", "load"), "load")


@query("w3_rolling_stats", f"SELECT series, ts, ROUND(AVG(load) {_frame(-336, 335)}, 5) AS roll_mean, ROUND(STDDEV_SAMP(load) {_frame(-336, 335)}, 4) AS roll_std, COUNT(load) {_frame(-336, 335)} AS roll_n FROM hourly")
def w3_stats(spark, d):
    got = scale.rolling_stats(S.hourly(spark, d), K, "load", 336, 335).select("series", "ts", "roll_mean", "roll_std", "roll_n")
    return rounded(rounded(got, "roll_mean"), "roll_std", digits=4)


@query("w3_zscore_with_halo", "SELECT series, ts, ROUND(load, 5) AS load FROM z", z=_zscore_sql("hourly", "load", 168, 24, 2.0, "series, ts"))
def w3_halo(spark, d):
    run = lambda rows, keys: windows.null_zscore_outliers(rows, keys, ["load"], 168, 24, 2.0)
    return rounded(scale.with_halo(S.hourly(spark, d), K, run, 84, 83, size=200, part="week").select("series", "ts", "load"), "load")


@query("w4_spikes", f"SELECT series, ts, ROUND(CASE WHEN ABS(load - LAG(load) OVER w) > 20 THEN NULL ELSE load END, 5) AS load FROM hourly {_W}")
def w4(spark, d):
    return rounded(windows.null_spikes(S.hourly(spark, d), K, {"load": 20.0}).select("series", "ts", "load"), "load")


def _interpolation(source: str, c: str, limit: int, tag: str = "i") -> dict[str, str]:
    p, q = "(PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    has = f"CASE WHEN {c} IS NOT NULL THEN"
    return {
        f"{tag}1": f"SELECT series, ts, {c}, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) AS rn, epoch_us(ts) AS s FROM {source}",
        f"{tag}2": f"""SELECT *, LAST_VALUE({has} rn END IGNORE NULLS) OVER p AS pn, LAST_VALUE({has} s END IGNORE NULLS) OVER p AS ps, LAST_VALUE({c} IGNORE NULLS) OVER p AS px,
            FIRST_VALUE({has} s END IGNORE NULLS) OVER q AS qs, FIRST_VALUE({c} IGNORE NULLS) OVER q AS qx FROM {tag}1 WINDOW p AS {p}, q AS {q}""",
        f"{tag}3": f"SELECT series, ts, CASE WHEN {c} IS NOT NULL THEN {c} WHEN pn IS NULL OR rn - pn > {limit} THEN NULL WHEN qs IS NULL THEN px ELSE px + (qx - px) * (s - ps) / (qs - ps) END AS {c} FROM {tag}2",
        f"{tag}4": f"SELECT series, ts, LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {c} FROM {tag}3",
        f"{tag}5": f"SELECT series, ts, FIRST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS {c} FROM {tag}4",
    }


_GAPPY = "SELECT series, ts, CASE WHEN hour(ts) BETWEEN 3 AND 17 AND day(ts) % 3 = 0 THEN NULL ELSE load END AS load FROM hourly"


def _gappy(spark, d) -> DataFrame:
    hole = F.hour("ts").between(3, 17) & (F.dayofmonth("ts") % 3 == 0)
    return S.hourly(spark, d).select("series", "ts", F.when(~hole, F.col("load")).alias("load"))


@query("w5_interpolation", "SELECT series, ts, ROUND(load, 5) AS load FROM i5", gappy=_GAPPY, **_interpolation("gappy", "load", 6))
def w5(spark, d):
    return rounded(windows.interpolate(_gappy(spark, d), K, ["load"]), "load")


@query("w5_interpolation_in_chunks", "SELECT series, ts, ROUND(load, 5) AS load FROM i5", gappy=_GAPPY, **_interpolation("gappy", "load", 6))
def w5_chunks(spark, d):
    return rounded(windows.interpolate_in_chunks(_gappy(spark, d), K, ["load"], size=40, part="week"), "load")


@query("w6_fill", """SELECT series, ts, ROUND(FIRST_VALUE(f IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 5) AS load FROM (
    SELECT series, ts, LAST_VALUE(load IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f FROM gappy)""", gappy=_GAPPY)
def w6(spark, d):
    return rounded(windows.fill(_gappy(spark, d), K, ["load"], 3, 2), "load")


_GAPS = """SELECT series, previous, ts AS current, epoch(ts)::BIGINT - epoch(previous)::BIGINT AS gap_s FROM (
    SELECT series, ts, LAG(ts) OVER (PARTITION BY series ORDER BY ts) AS previous FROM firsts) WHERE ts > previous + INTERVAL 1 HOUR"""


@query("w7_gaps", _GAPS, firsts=_FIRST)
def w7(spark, d):
    return grid.gaps(_first_hours(spark, d), K, "INTERVAL 1 HOUR")


_STRETCHES = """SELECT series, MIN(ts) AS start, MAX(COALESCE(nxt, ts)) AS "end" FROM (SELECT *, SUM(new) OVER (PARTITION BY series ORDER BY ts) AS island FROM (
    SELECT series, ts, load IS NULL AS empty, LEAD(ts) OVER w AS nxt, CASE WHEN load IS NULL AND NOT COALESCE(LAG(load IS NULL) OVER w, FALSE) THEN 1 ELSE 0 END AS new FROM gappy WINDOW w AS (PARTITION BY series ORDER BY ts)))
    WHERE empty GROUP BY series, island"""


@query("w8_empty_stretches", _STRETCHES, gappy=_GAPPY)
def w8(spark, d):
    return grid.empty_stretches(_gappy(spark, d), K, ["load"])


@query("w7_gaps_in_parts", _GAPS, firsts=_FIRST)
def w7_parts(spark, d):
    return scale.gaps_in_parts(_first_hours(spark, d), K, "INTERVAL 1 HOUR", part="day")


@query("w8_stretches_in_parts", _STRETCHES, gappy=_GAPPY)
def w8_parts(spark, d):
    return scale.stretches_in_parts(_gappy(spark, d), K, ["load"], part="day")


@query("w9_same_slot_mean", "SELECT series, ts, ROUND(AVG(load) OVER (PARTITION BY series, isodow(ts), hour(ts) ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 5) AS m FROM hourly")
def w9(spark, d):
    return rounded(windows.same_slot_mean(S.hourly(spark, d), K, "load", "m").select("series", "ts", "m"), "m")


@query("w10_mean_of_lags", "SELECT series, ts, ROUND(m4, 5) AS m FROM preds", **_PREDICTIONS)
def w10(spark, d):
    return rounded(baselines.predictions(S.hourly(spark, d), K).select("series", "ts", F.col("rolling_4weeks").alias("m")), "m")


@query("w11_persistence", "SELECT series, ts, ROUND(p24, 5) AS p24, ROUND(p168, 5) AS p168 FROM preds", **_PREDICTIONS)
def w11(spark, d):
    got = baselines.predictions(S.hourly(spark, d), K).select("series", "ts", F.col("persistence_24h").alias("p24"), F.col("persistence_168h").alias("p168"))
    return rounded(got, "p24", "p168")


@query("w12_occurrence", "SELECT ingest_seq, CAST(ROW_NUMBER() OVER (PARTITION BY site, ts, measurement ORDER BY ingest_seq) - 1 AS INT) AS dup FROM obs_long")
def w12(spark, d):
    return windows.occurrence(S.obs_long(spark, d), ["site", "ts", "measurement"], "ingest_seq").select("ingest_seq", F.col("dup").cast("int"))


# ---- top-k, sets, scalars -----------------------------------------------------------------------


@query("tk1_time_order", f"SELECT series, ts, CAST(ROW_NUMBER() OVER w AS INT) AS place FROM hourly {_W}")
def tk1(spark, d):
    return S.hourly(spark, d).select("series", "ts", F.row_number().over(grid.by_time(K)).alias("place"))


@query("tk2_top_features", """SELECT feature, importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, ROW_NUMBER() OVER (ORDER BY importance DESC, feature) <= 5 AS is_top5 FROM (
    SELECT l_returnflag || l_linenumber AS feature, ROUND(SUM(l_quantity), 3) AS importance FROM lineitem GROUP BY 1) ORDER BY importance DESC, feature LIMIT 10""")
def tk2(spark, d):
    rows = S.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("feature")).agg(near(F.sum("l_quantity"), 3).alias("importance"))
    return model.top_features(rows)


@query("tk3_first_gaps", f"SELECT * FROM ({_GAPS}) ORDER BY current, series LIMIT 10", firsts=_FIRST)
def tk3(spark, d):
    return grid.first_gaps(_first_hours(spark, d), K, "INTERVAL 1 HOUR")


@query("tk4_preview", "SELECT series, ts, ROUND(load, 5) AS load FROM hourly ORDER BY ts, series LIMIT 500")
def tk4(spark, d):
    return rounded(S.hourly(spark, d).select("series", "ts", "load").orderBy("ts", "series").limit(500), "load")


@query("u2_columns_side_by_side", "SELECT series, ts, ROUND(load * 2, 5) AS twice, ROUND(pv / 2, 5) AS half FROM hourly")
def u2(spark, d):
    return rounded(S.hourly(spark, d).withColumns({"twice": F.col("load") * 2, "half": F.col("pv") / 2}).select("series", "ts", "twice", "half"), "twice", "half")


@query("u3_results_as_rows", "SELECT name, split, COUNT(*) AS n, COUNT(pred) AS n_pred FROM long GROUP BY 1, 2", **_PREDICTIONS)
def u3(spark, d):
    return _long(spark, d).groupBy("name", "split").agg(F.count("*").alias("n"), F.count("pred").alias("n_pred"))


@query("sc1_time_parts", "SELECT ingest_seq, CAST(hour(ts) AS INT) AS h, CAST(month(ts) AS INT) AS m, CAST(year(ts) AS INT) AS y, CAST(isodow(ts) - 1 AS INT) AS wd FROM readings")
def sc1(spark, d):
    return S.readings(spark, d).select("ingest_seq", F.hour("ts").alias("h"), F.month("ts").alias("m"), F.year("ts").alias("y"), cal.monday_zero("ts").alias("wd"))


@query("sc2_iso_weekday", "SELECT ingest_seq, CAST(isodow(ts) AS INT) AS wd FROM readings")
def sc2(spark, d):
    return S.readings(spark, d).select("ingest_seq", cal.monday_one("ts").alias("wd"))


@query("sc3_weekend", "SELECT ingest_seq, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend FROM readings")
def sc3(spark, d):
    return S.readings(spark, d).select("ingest_seq", cal.is_weekend("ts").alias("weekend"))


@query("sc4_cyclic_utc", "SELECT ingest_seq, ROUND(SIN(2 * PI() * hour(ts) / 24), 6) + 0.0 AS hour_sin, ROUND(COS(2 * PI() * hour(ts) / 24), 6) + 0.0 AS hour_cos, ROUND(SIN(2 * PI() * month(ts) / 12), 6) + 0.0 AS month_sin FROM readings")
def sc4(spark, d):
    h, m = cal.cyclic(F.hour("ts"), 24), cal.cyclic(F.month("ts"), 12)
    parts = {"hour_sin": h[0], "hour_cos": h[1], "month_sin": m[0]}
    return S.readings(spark, d).select("ingest_seq", *((near(c, 6) + F.lit(0.0)).alias(n) for n, c in parts.items()))


_LOCAL = "timezone('Europe/Zurich', timezone('UTC', l_shipdate::TIMESTAMP))"


@query("sc5_cyclic_local", f"""SELECT DISTINCT l_shipdate::TIMESTAMP AS ts, ROUND(SIN(2 * PI() * (hour({_LOCAL}) + minute({_LOCAL}) / 60.0) / 24), 6) AS day_sin, ROUND(COS(2 * PI() * dayofyear({_LOCAL}) / 365.25), 6) AS year_cos FROM lineitem""")
def sc5(spark, d):
    ts = S.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
    at = cal.local("ts", "Europe/Zurich")
    return ts.select("ts", near(cal.cyclic(F.hour(at) + F.minute(at) / 60, 24)[0], 6).alias("day_sin"), near(cal.cyclic(F.dayofyear(at), 365.25)[1], 6).alias("year_cos"))


@query("sc7_date_shift", "SELECT ingest_seq, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - 2 AS two_before, strftime(ts, '%Y-%m-%d') AS text FROM readings")
def sc7(spark, d):
    return S.readings(spark, d).select("ingest_seq", F.to_date("ts").alias("day"), F.date_sub(F.to_date("ts"), 2).alias("two_before"), F.date_format("ts", "yyyy-MM-dd").alias("text"))


@query("sc8_lead_from_name", "SELECT target, variable, lead_time, ROUND(value, 5) AS value FROM forecast_long WHERE variable <> 'discount' AND value IS NOT NULL")
def sc8(spark, d):
    long = forecast.melt_leads(S.forecast_wide(spark, d), [], ["price", "quantity"], ts="target").where("value is not null")
    return rounded(long, "value")


@query("sc9_arithmetic", "SELECT target, lead_time, ROUND(SQRT(ABS(price - 1000)), 5) AS root, ROUND(price * price / 7, 2) AS part FROM forecast_rows")
def sc9(spark, d):
    got = S.forecast_rows(spark, d).select("target", "lead_time", F.sqrt(F.abs(F.col("price") - 1000)).alias("root"), (F.col("price") * F.col("price") / 7).alias("part"))
    return rounded(rounded(got, "root"), "part", digits=2)


_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query("sc10_month_labels", "SELECT strftime(ts, '%b') AS label, COUNT(*) AS n FROM daily_load GROUP BY 1")
def sc10(spark, d):
    label = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (i, m))), F.month("ts"))
    return n_rows("label")(S.daily_load(spark, d).select(label.alias("label")))


# ---- jobs ---------------------------------------------------------------------------------------


def _feed(spark, d) -> DataFrame:
    """Hourly-stamped load feed with repeated times: load, and a PV column with negatives."""
    r = S.readings_bad(spark, d).withColumn("ts", grid.trunc("hour", "ts"))
    x = R.sentinel_to_null("x")
    return r.select("series", "ts", "ingest_seq", x.alias("load"), (x / 2 - 5).alias("pv_sion"))


def _e1_views(pv: str) -> dict[str, str]:
    """E1 step by step; `pv` is what the bounds leave of pv_sion."""
    return {
        "feed": "SELECT series, date_trunc('hour', ts) AS ts, ingest_seq, NULLIF(x, -99999.0) AS load, NULLIF(x, -99999.0) / 2 - 5 AS pv_sion FROM readings_bad",
        "once": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, ts ORDER BY ingest_seq) AS rn FROM feed) WHERE rn = 1",
        "clipped": "SELECT series, ts, load, CASE WHEN pv_sion < 0 THEN 0.0 ELSE pv_sion END AS pv_sion, (hour(ts) >= 21 OR hour(ts) <= 5) AS night FROM once",
        "gate": "SELECT series, COALESCE(BOOL_OR(night AND pv_sion > 0), FALSE) AS gate FROM clipped GROUP BY 1",
        "dark": "SELECT c.series, ts, load, CASE WHEN night AND gate THEN 0.0 ELSE pv_sion END AS pv_sion FROM clipped c JOIN gate g ON c.series = g.series",
        "zed": _zscore_sql("dark", "load", 672, 96, 4.0, f"series, ts, {pv} AS pv_sion"),
        **_interpolation("zed", "load", 6, "il"),
        **_interpolation("zed", "pv_sion", 6, "ip"),
        "both_cols": "SELECT a.series, a.ts, a.load, b.pv_sion FROM il5 a JOIN ip5 b ON a.series = b.series AND a.ts = b.ts",
        "e1": """SELECT g.series, g.ts, b.load, COALESCE(b.pv_sion, 0.0) AS pv_sion FROM (SELECT series, UNNEST(generate_series(MIN(ts), MAX(ts), INTERVAL 1 HOUR)) AS ts FROM both_cols GROUP BY series) g
            LEFT JOIN (SELECT series, ts, AVG(load) AS load, SUM(pv_sion) AS pv_sion FROM both_cols GROUP BY 1, 2) b ON g.series = b.series AND g.ts = b.ts""",
    }


_E1 = _e1_views("CASE WHEN pv_sion BETWEEN 0 AND 40 THEN pv_sion END")


@query("e1_clean_load", "SELECT series, ts, ROUND(load, 5) AS load, ROUND(pv_sion, 5) AS pv_sion, ROUND(pv_sion, 5) AS pv_total FROM e1", **_E1)
def e1(spark, d):
    return rounded(clean_jobs.clean_load(_feed(spark, d), K, bounds={"pv_sion": (0, 40)}), "load", "pv_sion", "pv_total")


@query("e1_clean_load_in_chunks", "SELECT series, ts, ROUND(load, 5) AS load, ROUND(pv_sion, 5) AS pv_sion, ROUND(pv_sion, 5) AS pv_total FROM e1", **_E1)
def e1_chunks(spark, d):
    return rounded(clean_jobs.clean_load(_feed(spark, d), K, bounds={"pv_sion": (0, 40)}, chunk_rows=150), "load", "pv_sion", "pv_total")


_LOAD_REPORT = """SELECT 'duplicate' AS rule, 'ts' AS "column", COUNT(*) - (SELECT COUNT(*) FROM once) AS n FROM feed UNION ALL SELECT 'negative', 'pv_sion', COUNT(*) FROM once WHERE pv_sion < 0
    UNION ALL SELECT 'night', 'pv_sion', COUNT(*) FROM clipped c JOIN gate g ON c.series = g.series WHERE night AND gate AND pv_sion IS DISTINCT FROM 0.0
    UNION ALL SELECT 'zscore', 'load', COUNT(*) FROM dark a JOIN zed b ON a.series = b.series AND a.ts = b.ts WHERE a.load IS NOT NULL AND b.load IS NULL
    UNION ALL SELECT 'bounds', 'pv_sion', COUNT(*) FROM dark WHERE pv_sion NOT BETWEEN 0 AND 40
    UNION ALL SELECT 'filled', 'load', COUNT(*) FROM zed a JOIN il5 b ON a.series = b.series AND a.ts = b.ts WHERE a.load IS NULL AND b.load IS NOT NULL
    UNION ALL SELECT 'filled', 'pv_sion', COUNT(*) FROM zed a JOIN ip5 b ON a.series = b.series AND a.ts = b.ts WHERE a.pv_sion IS NULL AND b.pv_sion IS NOT NULL"""


@query("a24_load_report", _LOAD_REPORT, **_E1)
def a24_load(spark, d):
    counts = clean_jobs.Counts()
    files.write_table(clean_jobs.clean_load(_feed(spark, d), K, bounds={"pv_sion": (0, 40)}, counts=counts), files.scratch(spark, "load"))
    return counts.report()


_VARIABLES = {"T_2M": (0.4, 0.0), "GLOB": (6.0, -60.0), "PS": (150.0, 90_000.0), "DURSUN": (30.0, -100.0)}


def _forecast_feed(spark, d) -> DataFrame:
    """A forecast matrix of four variables and three leads by hour, from the hourly load; radiation
    does not go below 0, and every fifth hour comes twice."""
    h, w = S.hourly(spark, d), grid.by_time(K)
    leads = {f"{v}_ctrl_lt{k}": F.lag(F.col("load"), k - 1).over(w) * a + b for v, (a, b) in _VARIABLES.items() for k in (1, 2, 3)}
    leads |= {n: F.when(e < 0, 0.0).otherwise(e) for n, e in leads.items() if n.startswith("GLOB")}
    rows = h.select("series", "ts", *(F.coalesce(e, F.lit(-99999.0)).alias(n) for n, e in leads.items()))
    times = F.when(F.hour("ts") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("ingest_seq", F.explode(times))
    return rows.withColumns({n: F.col(n) + 7 * F.col("ingest_seq") for n in leads})


def _e2_views() -> dict[str, str]:
    """E2 step by step on long rows (series, ts, c, x), one for each column of the summary."""
    alias = {v: schemas.FORECAST_ALIASES[v] for v in _VARIABLES}
    low = lambda v, x: f"CASE WHEN {x} < 0 THEN 0.0 ELSE {x} END" if v == "GLOB" else x
    leads = " UNION ALL ".join(f"SELECT series, ts, '{v}' AS v, {k} AS k, {low(v, f'(a{k} * {a} + {b})')} AS x FROM fraw" for v, (a, b) in _VARIABLES.items() for k in (1, 2, 3))
    parts = [(f"{v}_{p}", v, p) for v in alias for p in ("best", "spread")] + [(a + ("_spread" if p == "spread" else ""), v, p) for v, a in alias.items() for p in ("best", "spread")]
    limits = {c: b for c, b in schemas.bounds_of_forecast().items() if c in {n for n, _, _ in parts}}
    of = lambda *names: ", ".join(f"'{n}'" for n, _, _ in parts if any(x in n for x in names))
    solar, pressure = of("GLOB", "DURSUN", "pred_radiation", "pred_sunshine"), of("PS", "pred_pressure")
    spikes = {c: d for s, d in schemas.SPIKES.items() for c in (f"{s}_best", alias[s])}
    night, f = "(hour(ts) >= 21 OR hour(ts) <= 5)", _frame(-84, 83).replace("PARTITION BY series", "PARTITION BY series, c")
    return {
        "fraw": "SELECT series, ts, load AS a1, LAG(load, 1) OVER w AS a2, LAG(load, 2) OVER w AS a3 FROM hourly WINDOW w AS (PARTITION BY series ORDER BY ts)",
        "flead": leads,
        "fsum": """SELECT series, ts, v, arg_min(x, k) FILTER (WHERE x IS NOT NULL) AS best, MIN(k) FILTER (WHERE x IS NOT NULL) AS lead_time,
            COALESCE(STDDEV_SAMP(x), 0.0) AS spread, CAST(COUNT(x) AS INT) AS n_runs FROM flead GROUP BY 1, 2, 3""",
        "fl0": " UNION ALL ".join(f"SELECT series, ts, '{n}' AS c, {p} AS x FROM fsum WHERE v = '{v}'" for n, v, p in parts),
        "fl1": f"SELECT series, ts, c, CASE {' '.join(f"WHEN c = '{c}' AND x NOT BETWEEN {lo} AND {hi} THEN NULL" for c, (lo, hi) in limits.items())} ELSE x END AS x FROM fl0",
        "fgate": f"SELECT series, c, COALESCE(BOOL_OR({night} AND x > 0), FALSE) AS gate FROM fl1 WHERE c IN ({solar}) GROUP BY 1, 2",
        "fl2": f"SELECT a.series, ts, a.c, CASE WHEN {night} AND gate THEN 0.0 ELSE x END AS x FROM fl1 a LEFT JOIN fgate g ON a.series = g.series AND a.c = g.c",
        "fl3": f"SELECT series, ts, c, CASE WHEN c IN ({solar}) AND x < 0 THEN 0.0 ELSE x END AS x FROM fl2",
        "fmed": f"SELECT series, c, MEDIAN(x) AS med FROM fl3 WHERE c IN ({pressure}) GROUP BY 1, 2",
        "fl4": "SELECT a.series, ts, a.c, CASE WHEN med > 10000 THEN x / 100 ELSE x END AS x FROM fl3 a LEFT JOIN fmed m ON a.series = m.series AND a.c = m.c",
        "fl5": f"""SELECT series, ts, c, CASE WHEN ABS(x - LAG(x) OVER (PARTITION BY series, c ORDER BY ts)) > CASE {' '.join(f"WHEN c = '{c}' THEN {d}" for c, d in spikes.items())} END THEN NULL ELSE x END AS x FROM fl4""",
        "fl6": f"SELECT series, ts, c, CASE WHEN c IN ({', '.join(f"'{c}'" for c in spikes)}) AND COUNT(x) {f} >= 24 AND ABS((x - AVG(x) {f}) / NULLIF(STDDEV_SAMP(x) {f}, 0)) > 4.0 THEN NULL ELSE x END AS x FROM fl5",
        "fl7": """SELECT a.series, a.ts, a.c, CASE WHEN r.x = 0 AND a.x > 1 THEN 0.0 ELSE a.x END AS x FROM fl6 a LEFT JOIN fl6 r ON a.series = r.series AND a.ts = r.ts
            AND ((a.c = 'DURSUN_best' AND r.c = 'GLOB_best') OR (a.c = 'pred_sunshine' AND r.c = 'pred_radiation'))""",
        **{n: v.replace("SELECT series, ts,", "SELECT series, ts, c,").replace("PARTITION BY series ", "PARTITION BY series, c ") for n, v in _interpolation("fl7", "x", 6, "fi").items()},
        "e2": "SELECT a.*, " + ", ".join(f"b.{v}_{p}" for v in alias for p in ("n_runs", "lead_time")) + " FROM (SELECT series, ts, " + ", ".join(f"MAX(CASE WHEN c = '{n}' THEN x END) AS {n}" for n, _, _ in parts) + " FROM fi5 GROUP BY 1, 2) a JOIN (SELECT series, ts, "
        + ", ".join(f"MAX(CASE WHEN v = '{v}' THEN {p} END) AS {v}_{p}" for v in alias for p in ("n_runs", "lead_time")) + " FROM fsum GROUP BY 1, 2) b ON a.series = b.series AND a.ts = b.ts",
    }


_E2 = _e2_views()
_E2_PARTS = [f"{v}_{p}" for v in _VARIABLES for p in ("best", "spread")] + [schemas.FORECAST_ALIASES[v] + p for v in _VARIABLES for p in ("", "_spread")]
_E2_COUNTS = [f"{v}_{p}" for v in _VARIABLES for p in ("n_runs", "lead_time")]


@query("e2_clean_forecast", f"SELECT series, ts, {', '.join(_E2_COUNTS)}, {', '.join(f'ROUND({c}, 5) AS {c}' for c in _E2_PARTS)} FROM e2", **_E2)
def e2(spark, d):
    return rounded(clean_jobs.clean_forecast(_forecast_feed(spark, d), K), *_E2_PARTS)


def _changed(rule: str, before: str, after: str, columns: str) -> str:
    return f"SELECT '{rule}' AS rule, a.c AS \"column\", COUNT(*) FILTER (WHERE a.x IS DISTINCT FROM b.x) AS n FROM {before} a JOIN {after} b ON a.series = b.series AND a.ts = b.ts AND a.c = b.c WHERE {columns} GROUP BY 2"


_SOLAR = "(a.c LIKE 'GLOB%' OR a.c LIKE 'DURSUN%' OR a.c LIKE 'pred_radiation%' OR a.c LIKE 'pred_sunshine%')"
_SPIKED = "a.c IN ('T_2M_best', 'pred_temperature', 'PS_best', 'pred_pressure')"
_FORECAST_REPORT = " UNION ALL ".join([
    "SELECT 'duplicate' AS rule, 'ts' AS \"column\", COUNT(*) AS n FROM hourly WHERE hour(ts) % 5 = 0",
    "SELECT 'sentinel', v || '_ctrl_lt' || k, COUNT(*) - COUNT(x) FROM flead GROUP BY 2",
    _changed("bounds", "fl0", "fl1", "TRUE"), _changed("night", "fl1", "fl2", _SOLAR), _changed("negative", "fl2", "fl3", _SOLAR), _changed("unit", "fl3", "fl4", "(a.c LIKE 'PS%' OR a.c LIKE 'pred_pressure%')"),
    _changed("spike", "fl4", "fl5", _SPIKED), _changed("zscore", "fl5", "fl6", _SPIKED), _changed("sunshine", "fl6", "fl7", "a.c IN ('DURSUN_best', 'pred_sunshine')"), _changed("filled", "fl7", "fi5", "TRUE"),
])


@query("a24_forecast_report", _FORECAST_REPORT, **_E2)
def a24_forecast(spark, d):
    counts = clean_jobs.Counts()
    files.write_table(clean_jobs.clean_forecast(_forecast_feed(spark, d), K, counts=counts), files.scratch(spark, "forecast"))
    return counts.report()


_MERGED = {**_e1_views("pv_sion"), **_E2, "merged": f"SELECT e1.load, e1.pv_sion, e1.pv_sion AS pv_total, {', '.join(f'e2.{c}' for c in [*_E2_PARTS, *_E2_COUNTS])} FROM e1 FULL JOIN e2 ON e1.series = e2.series AND e1.ts = e2.ts"}


@query("e3_merge_and_cover", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_null, ROUND(COUNT({c}) * 100.0 / COUNT(*), 4) AS coverage_pct FROM merged" for c in ["load", "pv_sion", "pv_total", *_E2_PARTS, *_E2_COUNTS]), **_MERGED)
def e3(spark, d):
    merged = clean_jobs.merge(clean_jobs.clean_load(_feed(spark, d), K, bounds={}), clean_jobs.clean_forecast(_forecast_feed(spark, d), K), K)
    return rounded(clean_jobs.export(merged, files.scratch(spark, "merged"), K).coverage, "coverage_pct", digits=4)


@query("a27_export_extent", "SELECT COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM (SELECT COALESCE(e1.ts, e2.ts) AS ts FROM e1 FULL JOIN e2 ON e1.series = e2.series AND e1.ts = e2.ts)", **_MERGED)
def a27_export(spark, d):
    merged = clean_jobs.merge(clean_jobs.clean_load(_feed(spark, d), K, bounds={}), clean_jobs.clean_forecast(_forecast_feed(spark, d), K), K)
    return clean_jobs.export(merged, files.scratch(spark, "merged"), K).extent


@query("e3_merge_bucketed", f"SELECT COALESCE(e1.series, e2.series) AS series, COALESCE(e1.ts, e2.ts) AS ts, ROUND(load, 5) AS load, ROUND(e1.pv_sion, 5) AS pv_sion, {', '.join(f'ROUND({c}, 5) AS {c}' for c in _E2_PARTS)} FROM e1 FULL JOIN e2 ON e1.series = e2.series AND e1.ts = e2.ts", **_MERGED)
def e3_bucketed(spark, d):
    """E1 to E3 on feeds that are bucketed by series: no exchange above the two scans."""
    load, predicted = _bucketed(spark, _feed(spark, d), "load"), _bucketed(spark, _forecast_feed(spark, d), "forecast")
    merged = clean_jobs.merge(clean_jobs.clean_load(load, K, bounds={}), clean_jobs.clean_forecast(predicted, K), K)
    return rounded(merged.select("series", "ts", "load", "pv_sion", *_E2_PARTS), "load", "pv_sion", *_E2_PARTS)


_E4_END = "2024-01-27"
_E4_WIDE = _WIDE.replace("FROM obs_long WHERE", f"FROM obs_long WHERE ts < TIMESTAMP '{_E4_END}' AND")


def _ingested(spark, d, rule: str):
    """Chunks of ten days, the last cut at the end date; both measurements by mean or by the feed's rules."""
    rules = {"click": "mean", "viewed": rule}
    return clean_jobs.ingest_observations(S.obs_long(spark, d), files.scratch(spark, "observations"), "2024-01-01", _E4_END, ["site"], {"click": "click", "view": "viewed"}, rules, days=10)


_E4_MEANS = {"wide_obs": _E4_WIDE, "obs_hours": _OBS_HOURS.replace("ROUND(b.click, 5)", "b.click").replace("ROUND(COALESCE(b.viewed, 0.0), 4)", "b.viewed").replace("SUM(viewed)", "AVG(viewed)")}


@query("e4_observations", _OBS_HOURS, wide_obs=_E4_WIDE)
def e4(spark, d):
    return rounded(rounded(_ingested(spark, d, "sum")[0], "click"), "viewed", digits=4)


@query("e4_empty_stretches", """SELECT site, MIN(ts) AS start, MAX(COALESCE(nxt, ts)) AS "end" FROM (SELECT *, SUM(new) OVER (PARTITION BY site ORDER BY ts) AS island FROM (
    SELECT site, ts, click IS NULL AND viewed IS NULL AS empty, LEAD(ts) OVER w AS nxt, CASE WHEN click IS NULL AND viewed IS NULL AND NOT COALESCE(LAG(click IS NULL AND viewed IS NULL) OVER w, FALSE) THEN 1 ELSE 0 END AS new
    FROM obs_hours WINDOW w AS (PARTITION BY site ORDER BY ts))) WHERE empty GROUP BY site, island""", **_E4_MEANS)
def e4_stretches(spark, d):
    return _ingested(spark, d, "mean")[1]


@query("e4_coverage", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_null, ROUND(COUNT({c}) * 100.0 / COUNT(*), 4) AS coverage_pct FROM obs_hours" for c in ("click", "viewed")), **_E4_MEANS)
def e4_coverage(spark, d):
    return rounded(_ingested(spark, d, "mean")[2], "coverage_pct", digits=4)


def _predicted(spark, d) -> DataFrame:
    """The hourly table with stand-in forecasts of every kind the matrices read."""
    h = S.hourly(spark, d)
    x = F.col("pv")
    names = ["pred_radiation", "pred_temperature", "pred_humidity", "pred_wind_speed", "pred_radiation_spread", "pred_temperature_spread", "pred_precipitation"]
    return h.withColumns({n: x * (i + 1) / 10 for i, n in enumerate(names)} | {"load_forecast": F.col("load") * 0.9})


_E5 = {
    "f1": f"""SELECT *, CASE WHEN CAST(ts AS DATE) IN (SELECT hd FROM holidays) THEN 1 ELSE 0 END AS is_holiday, LAG(load, 24) OVER w AS l24, LAG(load, 48) OVER w AS l48, LAG(load, 168) OVER w AS l168,
        CASE WHEN COUNT(load) {_frame(-24, -1)} >= 12 THEN AVG(load) {_frame(-24, -1)} END AS r24, CASE WHEN COUNT(load) {_frame(-168, -1)} >= 84 THEN AVG(load) {_frame(-168, -1)} END AS r168 FROM hourly {_W}""",
}


@query("e5_matrix_v1", f"""SELECT series, ts, ROUND(SIN(2 * PI() * hour(ts) / 24), 6) + 0.0 AS hour_sin, ROUND(COS(2 * PI() * hour(ts) / 24), 6) + 0.0 AS hour_cos, CAST(isodow(ts) - 1 AS INT) AS weekday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    ROUND(SIN(2 * PI() * month(ts) / 12), 6) + 0.0 AS month_sin, ROUND(COS(2 * PI() * month(ts) / 12), 6) + 0.0 AS month_cos, is_holiday, ROUND(pv * 1 / 10, 5) AS pred_radiation, ROUND(pv * 2 / 10, 5) AS pred_temperature, ROUND(pv * 3 / 10, 5) AS pred_humidity,
    ROUND(pv * 4 / 10, 5) AS pred_wind_speed, ROUND(pv * 5 / 10, 5) AS pred_radiation_spread, ROUND(pv * 6 / 10, 5) AS pred_temperature_spread, ROUND(l24, 5) AS load_lag_24h, ROUND(l48, 5) AS load_lag_48h, ROUND(l168, 5) AS load_lag_168h,
    ROUND(r24, 5) AS load_rolling_24h, ROUND(r168, 5) AS load_rolling_168h, ROUND(load, 5) AS load, CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 'test' ELSE 'train' END AS split
    FROM f1 WHERE load IS NOT NULL AND l24 IS NOT NULL AND l48 IS NOT NULL AND l168 IS NOT NULL AND r24 IS NOT NULL AND r168 IS NOT NULL""", **_holiday_views("hourly", "ts"), **_E5)
def e5(spark, d):
    m = features.matrix_v1(_predicted(spark, d), K, CUT)
    cyclic = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    m = m.withColumns({c: near(c, 6) + F.lit(0.0) for c in cyclic})
    return rounded(m, *(c for c in m.columns if c.startswith(("pred_", "load"))))


_E6_LOCAL = "timezone('Europe/Zurich', timezone('UTC', ts))"
_E6 = {
    "obs": "SELECT series, ts, load AS temp_obs, pv AS radiation_obs, pv / 2 AS precip_obs FROM hourly",
    "dobs": "SELECT series, CAST(ts AS DATE) AS day, AVG(temp_obs) AS temp, AVG(radiation_obs) AS rad, COALESCE(SUM(radiation_obs), 0) AS rad_sum, COALESCE(SUM(precip_obs), 0) AS precip FROM obs GROUP BY 1, 2",
    "clear": "SELECT series, month(day) AS month, quantile_cont(rad_sum, 0.95) AS p FROM dobs GROUP BY 1, 2",
    "dl": "SELECT series, CAST(ts AS DATE) AS day, AVG(load) AS m FROM hourly GROUP BY 1, 2",
    "base": f"SELECT *, {_E6_LOCAL} AS lt, CAST(ts AS DATE) AS day, LAG(load, 48) OVER w AS l48, COALESCE(SUM(pv / 10) OVER (PARTITION BY series, CAST(ts AS DATE)), 0) AS irad FROM hourly {_W}",
}


def _matrix_v2(spark, d) -> DataFrame:
    obs = S.hourly(spark, d).select("series", "ts", F.col("load").alias("temp_obs"), F.col("pv").alias("radiation_obs"), (F.col("pv") / 2).alias("precip_obs"))
    return features.matrix_v2(_predicted(spark, d), obs, K, cut=CUT)


@query("e6_matrix_v2", f"""SELECT b.series, b.ts, ROUND(SIN(2 * PI() * (hour(lt) + minute(lt) / 60.0) / 24), 6) + 0.0 AS time_of_day_sin, ROUND(COS(2 * PI() * (hour(lt) + minute(lt) / 60.0) / 24), 6) + 0.0 AS time_of_day_cos,
    ROUND(SIN(2 * PI() * dayofyear(lt) / 365.25), 6) + 0.0 AS day_of_year_sin, ROUND(COS(2 * PI() * dayofyear(lt) / 365.25), 6) + 0.0 AS day_of_year_cos, CAST(isodow(lt) AS INT) AS day_of_week,
    CASE WHEN CAST(lt AS DATE) IN (SELECT hd FROM holidays) THEN 1 ELSE 0 END AS is_holiday, ROUND(pv * 2 / 10, 5) AS temp_pred_h, ROUND(pv * 1 / 10, 5) AS irad_pred_h, ROUND(pv * 7 / 10, 5) AS precip_risk_h,
    ROUND(irad, 4) AS irad_pred_daily_sum, ROUND(irad / CASE WHEN c.p < 1 THEN 1.0 ELSE c.p END, 5) AS clear_sky_ratio, ROUND(o.temp, 5) AS temp_obs_J1_mean, ROUND(o.rad, 5) AS radiation_obs_J1_mean, ROUND(o.precip, 4) AS precip_obs_J1_sum,
    ROUND(d2.m, 5) AS load_J1_mean, ROUND(l48, 5) AS load_J1_same_hour, ROUND(d8.m, 5) AS load_J7_mean, ROUND(d2.m / CASE WHEN o.rad < 1 THEN 1.0 ELSE o.rad END, 5) AS ratio_load_irad_J1, ROUND(pv * 2 / 10 - o.temp, 5) AS delta_temp_pred_vs_obs,
    ROUND(load, 5) AS load, ROUND(load * 0.9, 5) AS load_forecast, CASE WHEN b.ts >= TIMESTAMP '{CUT}' THEN 'test' ELSE 'train' END AS split
    FROM base b LEFT JOIN clear c ON b.series = c.series AND month(b.ts) = c.month LEFT JOIN dobs o ON b.series = o.series AND b.day = o.day + 2
    LEFT JOIN dl d2 ON b.series = d2.series AND b.day = d2.day + 2 LEFT JOIN dl d8 ON b.series = d8.series AND b.day = d8.day + 8
    WHERE load IS NOT NULL AND l48 IS NOT NULL AND d2.m IS NOT NULL AND d8.m IS NOT NULL""", **_holiday_views("hourly", "ts"), **_E6)
def e6(spark, d):
    m = _matrix_v2(spark, d)
    cyclic = [c for c in m.columns if c.endswith(("_sin", "_cos"))]
    m = m.withColumns({c: near(c, 6) + F.lit(0.0) for c in cyclic})
    m = rounded(m, "irad_pred_daily_sum", "precip_obs_J1_sum", digits=4)
    four = (*cyclic, "series", "ts", "split", "day_of_week", "is_holiday", "irad_pred_daily_sum", "precip_obs_J1_sum")
    return rounded(m, *(c for c in m.columns if c not in four))


_E7 = {
    **_PREDICTIONS,
    "long": _PREDICTIONS["long"] + " UNION ALL SELECT series, ts, split, load, 'existing forecast', load * 0.9 FROM preds",
}


@query("e7_baselines", "SELECT name, n, ROUND(mae, 5) AS mae, ROUND(rmse, 5) AS rmse, ROUND(nrmse_pct, 4) AS nrmse_pct, name = (SELECT arg_min(name, rmse) FROM board) AS is_best FROM board", **_E7)
def e7(spark, d):
    board = baselines.with_best(baselines.scoreboard(_predicted(spark, d), K, CUT))
    return rounded(rounded(board, "mae", "rmse"), "nrmse_pct", digits=4)


# ---- model --------------------------------------------------------------------------------------

_E8 = {
    **_E6,
    "tested": f"""SELECT b.load AS y, b.load * 0.9 AS f, b.l48 AS s, d8.m AS k FROM base b LEFT JOIN dl d2 ON b.series = d2.series AND b.day = d2.day + 2 LEFT JOIN dl d8 ON b.series = d8.series AND b.day = d8.day + 8
        WHERE load IS NOT NULL AND l48 IS NOT NULL AND d2.m IS NOT NULL AND d8.m IS NOT NULL AND b.ts >= TIMESTAMP '{CUT}'""",
    "naive": " UNION ALL ".join(f"SELECT '{model.BENCHMARK[n]}' AS name, y, {c} AS pred FROM tested" for n, c in (("load_forecast", "f"), ("load_J1_same_hour", "s"), ("load_J7_mean", "k"))),
}


@query("e8_naive_models", """SELECT name, COUNT(pred) AS n, ROUND(AVG(ABS(y - pred)), 5) AS mae, ROUND(SQRT(AVG((y - pred) * (y - pred))), 5) AS rmse,
    ROUND(1 - SUM((y - pred) * (y - pred)) / (VAR_POP(y) * COUNT(y)), 5) AS r2 FROM naive GROUP BY 1""", **_E8)
def e8_naive(spark, d):
    return rounded(model.naive_measures(_matrix_v2(spark, d)), "mae", "rmse", "r2")


_FITS: dict = {}


def _fitted(spark, d):
    """E8's trees on matrix v2 at the production settings, grown once a session and folder, and the
    rows with their predictions."""
    rows = model.benchmark_rows(_matrix_v2(spark, d))
    at = (spark.sparkContext.applicationId, d)
    if at not in _FITS:
        _FITS[at] = model.fit(rows.where("split = 'train'"), schemas.FEATURES_V2)
    return _FITS[at], model.predict(_FITS[at], rows)


@query("m1_m2_fit_and_measure")
def m2(spark, d):
    return metrics.overfit(metrics.melt_predictions(_fitted(spark, d)[1], "load", {"pred_model": "trees"}, ["split"]))


@query("m3_importances")
def m3(spark, d):
    return model.importances(_fitted(spark, d)[0])


@query("m4_benchmark")
def m4(spark, d):
    return model.benchmark(_fitted(spark, d)[1])[0]


@query("m5_week_extract")
def m5(spark, d):
    return _fitted(spark, d)[1].where(R.half_open("2024-01-22", "2024-01-29")).select("series", "ts", "load", "pred_model", "load_forecast")


@query("e8_model_benchmark")
def e8(spark, d):
    return model.benchmark(_fitted(spark, d)[1])[1]


@query("e8_error_histogram")
def e8_errors(spark, d):
    return model.benchmark(_fitted(spark, d)[1])[2]


_E9_COLUMNS = ["load", "pv_J1_mean", "pv_J1_max", "load_J1_mean", "ratio_J1"]
_E9 = {
    "agg": "SELECT series, CAST(ts AS DATE) AS day, AVG(pv) AS pv_J1_mean, MAX(pv) AS pv_J1_max, AVG(load) AS load_J1_mean FROM hourly GROUP BY 1, 2",
    "joined": """SELECT h.load, a.pv_J1_mean, a.pv_J1_max, a.load_J1_mean, CASE WHEN a.pv_J1_mean > 1 THEN a.load_J1_mean / a.pv_J1_mean END AS ratio_J1 FROM hourly h
        JOIN agg a ON h.series = a.series AND CAST(h.ts AS DATE) = a.day + 1""",
    "full_rows": "SELECT * FROM joined WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _E9_COLUMNS),
}


@query("e9_day_before_study", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(CORR(load, {c}), 6) AS r FROM full_rows" for c in _E9_COLUMNS[1:]), **_E9)
def e9(spark, d):
    h = S.hourly(spark, d)
    daily = h.groupBy("series", F.to_date("ts").alias("day")).agg(F.avg("pv").alias("a"), F.max("pv").alias("b"), F.avg("load").alias("c"))
    rows = lookups.attach_daily(h, K, daily, {1: {"a": "pv_J1_mean", "b": "pv_J1_max", "c": "load_J1_mean"}})
    rows = rows.withColumn("ratio_J1", R.guarded_ratio("load_J1_mean", "pv_J1_mean"))
    return rounded(metrics.with_target(metrics.correlations(rows, _E9_COLUMNS), "load"), "r", digits=6)
