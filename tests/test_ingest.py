"""The file stream, bucketed feeds."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.jobs import clean
from wattloom.operators import windows
from wattloom.sources import files
from wattloom.streaming import ingest


def day(spark, d: int, n: int = 5):
    rows = [(datetime(2024, 1, 30) + timedelta(days=d, hours=h), "s", "x", "Value", float(d * 100 + h), h) for h in range(n)]
    return spark.createDataFrame(rows, files.OBSERVATION_SCHEMA).coalesce(1)


def test_a_stream_takes_each_file_once(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    for d in range(3):
        day(spark, d).write.mode("append").parquet(landing)
    take = lambda **k: ingest.ingest_files(spark, landing, path, state, files.OBSERVATION_SCHEMA, files_a_batch=2, **k)
    values = lambda: sorted(r.value for r in ingest.landed(spark, path, files.OBSERVATION_SCHEMA).collect())
    assert take() == (15, 2)
    first = values()
    assert len(first) == 15
    assert take() == (0, 0) and values() == first  # no new file, nothing read
    day(spark, 3).write.mode("append").parquet(landing)
    assert take() == (5, 1) and len(values()) == 20
    assert {r.month for r in ingest.landed(spark, path, files.OBSERVATION_SCHEMA).collect()} == {"2024-01", "2024-02"}
    assert ingest.landed(spark, path, files.OBSERVATION_SCHEMA, (2, 2)).count() == 5


@pytest.mark.parametrize("written", [True, False])
def test_a_failed_batch_comes_again(spark, tmp_path, written):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    for d in range(4):
        day(spark, d).write.mode("append").parquet(landing)
    fail = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))

    def second(number):
        if number == 1:
            raise RuntimeError("lost")

    calls = []

    def shape(rows):
        calls.append(1)
        return rows if len(calls) == 1 else fail()

    hook = {"after_batch": second} if written else {"shape": shape}
    take = lambda **k: ingest.ingest_files(spark, landing, path, state, files.OBSERVATION_SCHEMA, files_a_batch=1, **k)
    with pytest.raises(Exception, match="lost"):
        take(**hook)
    day(spark, 4).write.mode("append").parquet(landing)
    assert take().rows == (20 if not written else 20)
    got = sorted(r.value for r in ingest.landed(spark, path, files.OBSERVATION_SCHEMA).collect())
    assert got == sorted(float(d * 100 + h) for d in range(5) for h in range(5))


def test_text_files_are_shaped_before_they_land(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("time_utc;T_2M_ctrl_lt1\n02/01/2023 03:00;1,5\n;NaN\n")
    raw = "time_utc string, T_2M_ctrl_lt1 string"
    from pyspark.sql.types import StructType

    shape = lambda r: r.select(files.day_first("time_utc").alias("ts"), files.decimal_comma("T_2M_ctrl_lt1").alias("x"))
    ingest.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), StructType.fromDDL(raw), "csv", shape=shape, sep=";", header="true")
    rows = ingest.landed(spark, str(tmp_path / "out"), StructType.fromDDL("ts timestamp_ntz, x double")).collect()
    assert sorted((str(r.ts), r.x, str(r.month)) for r in rows) == [("2023-01-02 03:00:00", 1.5, "2023-01"), ("None", None, "None")]


def bucketed(spark, tmp_path, rows, name):
    return files.write_bucketed(rows, name, ["k"], 4, path=str(tmp_path / name))


def test_bucketed_feeds_merge_without_an_exchange(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, start + timedelta(hours=i), 1, float(i % 24), float(i % 7)) for k in "abcdef" for i in range(120)], "k string, ts timestamp_ntz, ingest_seq int, load double, pv_sion double")
    wide = rows.select("k", "ts", "ingest_seq", F.col("load").alias("T_2M_ctrl_lt1"), (F.col("load") * 100).alias("GLOB_ctrl_lt1"))
    names = [f"feed_{n}_{abs(hash(str(tmp_path))) % 10**9}" for n in ("load", "forecast")]
    a, b = bucketed(spark, tmp_path, rows, names[0]), bucketed(spark, tmp_path, wide.where("k <> 'a'"), names[1])
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    job = lambda x, y: clean.merge(clean.clean_load(x, ["k"]), clean.clean_forecast(y, ["k"]), ["k"])
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(a.select("k", "ts", "load").join(b.select("k", "ts", "T_2M_ctrl_lt1"), ["k", "ts"], "full"))
        assert "Exchange" not in plan(windows.lags(a, ["k"], "load", {"l": 1}))
        assert "Exchange" not in plan(job(a, b))
        assert "Exchange" in plan(job(rows, wide))
        got, want = (sorted(map(str, job(*x).collect())) for x in ((a, b), (rows, wide.where("k <> 'a'"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        for n in names:
            spark.sql(f"DROP TABLE {n}")
    assert got == want and len(got) == 720


def test_readers_take_no_number_for_null(spark, tmp_path):
    (tmp_path / "load.csv").write_text("timestamp,standardised load [-]\n2023-01-01 00:00:00,NaN\n2023-01-01 01:00:00,Infinity\n2023-01-01 02:00:00,-Infinity\n2023-01-01 03:00:00,2\n")
    assert [r.load for r in files.read_load(spark, str(tmp_path / "load.csv")).orderBy("ts").collect()] == [None, None, None, 2.0]
    (tmp_path / "f.csv").write_text("time_utc;T_2M_ctrl_lt1;T_2M_ctrl_lt2\n02/01/2023 03:00;nan;-inf\n")
    assert tuple(files.read_forecast(spark, str(tmp_path / "f.csv")).first())[1:] == (None, None)


def test_the_series_of_a_day_are_spread(spark, tmp_path):
    rows = spark.range(4_000).select(F.col("id").alias("k"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"))
    files.write_by_month(rows, str(tmp_path / "out"), ["k"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4_000
