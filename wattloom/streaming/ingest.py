"""IO5, U1, E4 as a file stream: each run takes in the files that have come since the last one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Landed(NamedTuple):
    """What a run took in."""

    rows: int
    batches: int


def ingest_files(
    spark: SparkSession, landing: str, path: str, checkpoint: str, schema: StructType, form: str = "parquet", ts: str = "ts", files_a_batch: int = 1_000,
    shape: Callable[[DataFrame], DataFrame] | None = None, after_batch: Callable[[int], None] | None = None, **options: str,
) -> Landed:
    """New files of the folder `landing` go to the Parquet table `path`, by month of `ts` and by batch.

    The stream's checkpoint knows the files that were read; a run ends when no new one is left, and
    without new files it reads none.  A batch that failed comes again with the same number and the same
    files and replaces what it had written, so nothing is lost or doubled.  A batch has at most
    `files_a_batch` files.  `shape` changes the rows before they are written (parsing, renaming, a
    filter); `after_batch` is called with the number of a batch once it is written.  Rows without a time
    land in the month of null."""
    source = spark.readStream.schema(schema).format(form).options(**options).option("maxFilesPerTrigger", files_a_batch).load(landing)

    def land(batch: DataFrame, number: int) -> None:
        rows = (shape(batch) if shape else batch).withColumns({"month": F.date_format(ts, "yyyy-MM"), "batch": F.lit(number)})
        rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").mode("overwrite").parquet(path)
        if after_batch:
            after_batch(number)

    query = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    return Landed(sum(p["numInputRows"] for p in done), len(done))


def landed(spark: SparkSession, path: str, schema: StructType, batches: tuple[int, int] | None = None) -> DataFrame:
    """The rows of the table, with month and batch; `batches` (first, last) reads only those."""
    known = StructType([*schema.fields]).add("month", "string").add("batch", "long")
    rows = spark.read.schema(known).parquet(path)
    return rows if batches is None else rows.where(F.col("batch").between(*batches))
