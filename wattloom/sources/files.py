"""Readers and writers of the feeds.  Every reader returns UTC timestamps without a zone."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import LOAD_COLUMNS, NULL_TOKENS


def _token(c: str) -> Column:
    text = F.trim(F.col(f"`{c}`"))
    return F.when(~text.isin(NULL_TOKENS), text)


def finite(c: Column) -> Column:
    """A double; NaN and the infinities are null, as a reading that is no number."""
    return F.when(F.abs(c) < float("inf"), c)


def decimal_comma(c: str) -> Column:
    """A text column with a decimal comma as a double; the null tokens, bad numbers and words like NaN or
    Infinity are null."""
    return finite(F.regexp_replace(_token(c), ",", ".").try_cast("double"))


def day_first(c: str) -> Column:
    """A day-first or ISO time as a timestamp without a zone."""
    text = F.trim(F.col(f"`{c}`"))
    ways = [F.try_to_timestamp(text, F.lit(f)) for f in ("dd/MM/yyyy HH:mm", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss")]
    return F.coalesce(*ways, F.try_to_timestamp(text)).cast("timestamp_ntz")


def _raw_csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def read_raw_load(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """IO1: the raw load feed (`;`, decimal comma, several null tokens), canonical names; `keys` are
    text columns that name the series, where a feed holds several."""
    raw = _raw_csv(spark, path, ";")
    return raw.select(*keys, day_first("timestamp").alias("ts"), *(decimal_comma(c).alias(n) for c, n in LOAD_COLUMNS.items() if c in raw.columns))


def read_load(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """IO2: the imported load feed (`,`, decimal point) under canonical names."""
    raw = _raw_csv(spark, path, ",")
    named = raw.withColumnsRenamed(LOAD_COLUMNS | {"timestamp": "ts"})
    return named.select(*keys, F.col("ts").try_cast("timestamp_ntz").alias("ts"), *(finite(F.col(c).try_cast("double")).alias(c) for c in LOAD_COLUMNS.values() if c in named.columns))


def read_forecast(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """IO3: the forecast matrix (`;`, decimal comma, day-first time), one double a lead time."""
    raw = _raw_csv(spark, path, ";")
    return raw.select(*keys, day_first("time_utc").alias("ts"), *(decimal_comma(c).alias(c) for c in raw.columns if c not in ("time_utc", *keys)))


OBSERVATION_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), T.StructField("site", T.StringType()), T.StructField("measurement", T.StringType()),
    T.StructField("field", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("ingest_seq", T.LongType()),
])


def select_observations(rows: DataFrame, start: str, stop: str, site, measurements: list[str], field: str = "Value") -> DataFrame:
    """IO4: observations of [start, stop), one site and field, some measurements; filters reach the scan."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, stop))
    return rows.where((F.col("ts") >= lo) & (F.col("ts") < hi) & (F.col("site") == site) & F.col("measurement").isin(measurements) & (F.col("field") == field))


SPREAD = 16  # tasks that the series of one day are spread over


def write_by_month(rows: DataFrame, path: str, keys: Sequence[str] = (), ts: str = "ts") -> None:
    """IO5: Parquet by month; months in rows replace those of an earlier run, others stay.  A day of all
    series (`keys`) is spread over tasks by a hash of the series."""
    by_month = rows.withColumn("month", F.date_format(ts, "yyyy-MM"))
    series = [F.pmod(F.xxhash64(*keys), F.lit(SPREAD))] if keys else []
    by_month.repartition("month", F.to_date(ts), *series).sortWithinPartitions(ts).write.option("partitionOverwriteMode", "dynamic").partitionBy("month").mode("overwrite").parquet(path)


def append_chunk(rows: DataFrame, path: str, start: str, stop: str, ts: str = "ts") -> None:
    """IO5, U1: the rows of [start, stop) as the chunk `start` of a Parquet table.  A chunk that comes
    again replaces itself; the other chunks stay."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, stop))
    part = rows.where((F.col(ts) >= lo) & (F.col(ts) < hi)).withColumn("chunk", F.lit(start))
    part.write.option("partitionOverwriteMode", "dynamic").partitionBy("chunk").mode("overwrite").parquet(path)


def append_chunks(rows: DataFrame, path: str, bounds: Sequence[tuple[str, str]], ts: str = "ts") -> None:
    """IO5, U1: all chunks of consecutive bounds from one pass over the rows; as append_chunk for each."""
    if not bounds:
        return
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (bounds[0][0], bounds[-1][1]))
    starts = F.array(*(F.struct(F.lit(start).cast("timestamp_ntz").alias("at"), F.lit(start).alias("chunk")) for start, _ in bounds))
    own = F.array_max(F.filter(starts, lambda s: s["at"] <= F.col(ts)))["chunk"]
    part = rows.where((F.col(ts) >= lo) & (F.col(ts) < hi)).withColumn("chunk", own)
    part.write.option("partitionOverwriteMode", "dynamic").partitionBy("chunk").mode("overwrite").parquet(path)


def chunk_bounds(start: str, stop: str, days: int | None = None) -> list[tuple[str, str]]:
    """IO5: [start, stop) in calendar months, or in steps of `days`; the last one ends at `stop`."""
    at, end, out = date.fromisoformat(start), date.fromisoformat(stop), []
    while at < end:
        after = at + timedelta(days) if days else date(at.year + at.month // 12, at.month % 12 + 1, 1)
        out.append((at.isoformat(), min(after, end).isoformat()))
        at = after
    return out


def write_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int = 200, ts: str = "ts", path: str | None = None) -> DataFrame:
    """A feed as the table `name`, bucketed by series and sorted by time within: what works by series
    (duplicates, windows, the merge of two such feeds) then needs no exchange.  Tables that are to meet
    need equal bucket numbers.  `path` puts the files elsewhere than in the warehouse."""
    spread = rows.repartition(buckets, *keys)  # one task, so one file, a bucket
    out = spread.write.bucketBy(buckets, *keys).sortBy(*keys, ts).format("parquet").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)
    return rows.sparkSession.table(name)


def read_latest(spark: SparkSession, pattern: str, reader=read_load, by: str = "file_modification_time", whole_folder: bool = False) -> DataFrame:
    """IO6: the latest of the files that the glob matches, by time or (by='file_name') by name;
    `whole_folder` reads all files beside it, for snapshots of several files."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    order = F.struct("modificationTime", "path") if by == "file_modification_time" else F.col("path")
    found = files.agg(F.max_by("path", order)).first()[0]
    if found is None:
        raise FileNotFoundError(pattern)
    return reader(spark, found.rpartition("/")[0] if whole_folder else found)


def write_table(rows: DataFrame, path: str, ts: str = "ts", form: str = "parquet") -> None:
    """IO7: the result, sorted by time within its files; csv has a header."""
    out = rows.sortWithinPartitions(ts).write.mode("overwrite")
    out.csv(path, header=True) if form == "csv" else out.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """IO8: a table written before."""
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares with its executors."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="wattloom-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
