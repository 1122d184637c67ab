"""The driver's tables in the roles of the feeds, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import grid

K = ["series"]
ROWS_A_TASK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular meter readings (series, ts, x, ingest_seq)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", F.col("value").alias("x"), F.col("event_id").alias("ingest_seq"))


def readings_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with nulls, sentinels and negatives."""
    n = F.col("ingest_seq")
    bad = F.when(n % 13 == 0, None).when(n % 17 == 0, -99999.0).when(n % 19 == 0, -F.col("x")).otherwise(F.col("x"))
    return readings(spark, sf_dir).withColumn("x", bad)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, load, pv) on the hourly grid."""
    return grid.resample(readings(spark, sf_dir), K, {"load": ("x", "mean"), "pv": ("x", "sum")})


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations every ten minutes."""
    ts = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 600).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("site"), F.col("event_type").alias("measurement"), F.lit("Value").alias("field"), ts.alias("ts"), "value", F.col("event_id").alias("ingest_seq"),
    )


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, lead_time, price, quantity, discount), one row a target and lead.

    Dealt by target into parts of about ROWS_A_TASK lines, whatever their number, so that a task's
    memory does not grow with the table; what is grouped by target and more needs no other exchange."""
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    lines = table(spark, sf_dir, "lineitem")
    parts = max(-(-lines.count() // ROWS_A_TASK), 1)
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").repartition(parts, "l_orderkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("lead_time"))
    best = rows.agg(F.min(order).alias("r"))
    cut = lambda c, lo: F.when(F.col(f"r.{c}") > lo, F.col(f"r.{c}"))
    return best.select("target", "lead_time", F.col("r.l_extendedprice").alias("price"), cut("l_quantity", 10).alias("quantity"), cut("l_discount", 0.03).alias("discount"))


def forecast_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in ("price", "quantity", "discount")))
    return forecast_rows(spark, sf_dir).select("target", "lead_time", F.inline(values))  # keeps the dealing, as unpivot does not


def forecast_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, price_lt1..7, quantity_lt1..7)."""
    values = [F.max(F.when(F.col("lead_time") == k, F.col(c))).alias(f"{c}_lt{k}") for c in ("price", "quantity") for k in range(1, 8)]
    return forecast_rows(spark, sf_dir).groupBy("target").agg(*values)


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, load) of a long daily series on the daily grid; a day without orders has 0."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1e6).alias("x"))
    return grid.resample(rows, K, {"load": ("x", "sum")}, "day")


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, radiation, temp, precip) of one site."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return rows.agg(F.sum("l_quantity").alias("radiation"), (F.avg("l_discount") * 100).alias("temp"), F.sum("l_tax").alias("precip"))


#: The same rows in SQL, in the order in which they build on each other.
VIEWS = {
    "readings": "SELECT event_type AS series, ts, value AS x, event_id AS ingest_seq FROM events",
    "readings_bad": """SELECT series, ts, CASE WHEN ingest_seq % 13 = 0 THEN NULL WHEN ingest_seq % 17 = 0 THEN -99999.0
        WHEN ingest_seq % 19 = 0 THEN -x ELSE x END AS x, ingest_seq FROM readings""",
    "hourly": """SELECT g.series, g.ts, b.load, COALESCE(b.pv, 0.0) AS pv FROM (
          SELECT series, UNNEST(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (
            SELECT series, date_trunc('hour', MIN(ts)) AS lo, date_trunc('hour', MAX(ts)) AS hi FROM readings GROUP BY series)) g
        LEFT JOIN (SELECT series, date_trunc('hour', ts) AS ts, AVG(x) AS load, SUM(x) AS pv FROM readings GROUP BY 1, 2) b
        ON g.series = b.series AND g.ts = b.ts""",
    "obs_long": """SELECT CAST(user_id % 3 AS INT) AS site, event_type AS measurement, 'Value' AS field,
        time_bucket(INTERVAL 10 MINUTE, ts) AS ts, value, event_id AS ingest_seq FROM events""",
    "forecast_rows": """SELECT target, lead_time, price, CASE WHEN quantity > 10 THEN quantity END AS quantity,
        CASE WHEN discount > 0.03 THEN discount END AS discount FROM (
          SELECT l_orderkey AS target, l_linenumber AS lead_time, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount,
            ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS rn
          FROM lineitem) WHERE rn = 1""",
    "forecast_long": """SELECT target, lead_time, 'price' AS variable, price AS value FROM forecast_rows
        UNION ALL SELECT target, lead_time, 'quantity', quantity FROM forecast_rows
        UNION ALL SELECT target, lead_time, 'discount', discount FROM forecast_rows""",
    "daily_load": """SELECT g.series, g.ts, COALESCE(b.load, 0.0) AS load FROM (
          SELECT series, UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM (
            SELECT o_orderpriority AS series, date_trunc('day', MIN(o_orderdate))::TIMESTAMP AS lo, date_trunc('day', MAX(o_orderdate))::TIMESTAMP AS hi FROM orders GROUP BY 1)) g
        LEFT JOIN (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, SUM(o_totalprice / 1e6) AS load FROM orders GROUP BY 1, 2) b
        ON g.series = b.series AND g.ts = b.ts""",
    "daily_obs": """SELECT CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS radiation, AVG(l_discount) * 100 AS temp, SUM(l_tax) AS precip
        FROM lineitem GROUP BY 1""",
}


def with_views(body: str, **more: str) -> str:
    """The query after the views that it names, directly or through others, and any views of its own."""
    wanted, text = set(), body + " ".join(more.values())
    for name in reversed(VIEWS):
        if name in text:
            wanted.add(name)
            text += VIEWS[name]
    parts = [f"{n} AS ({v})" for n, v in (VIEWS | more).items() if n in wanted or n in more]
    return f"WITH {', '.join(parts)} {body}" if parts else body
