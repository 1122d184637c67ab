from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wattloom.functions import calendar, rows
from wattloom.streaming import resample


def test_easter_and_holidays(spark):
    years = spark.createDataFrame([(y,) for y in (1995, 2023, 2024, 2025)], "year int")
    got = [r[0] for r in years.orderBy("year").select(calendar.easter(F.col("year"))).collect()]
    assert got == [date(1995, 4, 16), date(2023, 4, 9), date(2024, 3, 31), date(2025, 4, 20)]
    days = {r[0] for r in calendar.holidays(years).collect()}
    assert {date(2024, 3, 29), date(2024, 4, 1), date(2024, 5, 9), date(2024, 5, 20), date(2024, 5, 30), date(2024, 8, 1)} <= days
    assert len(days) == 4 * 16


def test_local_day_in_summer_and_winter(spark):
    ts = [(datetime(2024, 7, 31, 22, 30),), (datetime(2024, 1, 1, 23, 30),), (datetime(2024, 3, 31, 0, 59),)]
    got = calendar.calendar_v2(spark.createDataFrame(ts, "ts timestamp_ntz")).orderBy("ts").collect()
    assert [(r.is_holiday, r.day_of_week) for r in got] == [(1, 2), (0, 7), (1, 4)]  # 2 January, Easter Sunday (no holiday itself), 1 August


def test_row_rules_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x double")
    got = df.select(rows.at_least("x", 1), rows.at_most("x", 2), rows.clip_negative("x"), rows.within("x", -1, 5), rows.null_skipping_sum(["x"])).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, 0.0), (1.0, -1.0, 0.0, -1.0, -1.0), (5.0, 2.0, 5.0, 5.0, 5.0)]
    with pytest.raises(ValueError, match="missing"):
        rows.require_columns(df, ["x", "y"])


def test_split_is_a_partition_with_a_gap(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in range(1, 11)], "ts timestamp_ntz")
    assert df.select(rows.split_at("2024-01-06").alias("s")).groupBy("s").count().count() == 2
    parts = {r.s: r["count"] for r in df.select(rows.split_at("2024-01-06", gap="INTERVAL 2 DAYS").alias("s")).groupBy("s").count().collect()}
    assert parts == {"train": 3, None: 2, "test": 5}


def test_stream_drops_repeats_and_buckets(spark, tmp_path):
    at = [datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 40), datetime(2024, 1, 1, 1, 10), datetime(2024, 1, 1, 9)]
    batch = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(at)], "k string, ts timestamp, x double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    first = resample.first_in_stream(stream, ["k"])
    q = first.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 4
    hours = resample.bucket_stream(stream, ["k"], {"m": ("x", "mean"), "s": ("x", "sum")})
    q = hours.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    got = {r.ts.hour: (r.m, r.s) for r in spark.table("hours").collect()}
    assert got[0] == (1.0, 3.0) and got[1] == (3.0, 3.0)
