"""Small pieces that several operators share: stored intermediates, label joins, id folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach; a temporary one where a
    local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wattloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a short, durable lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % folds


def whole_text(text: str | Column = "text") -> Column:
    """The text with null as the empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) with one 0/1 label an id; repeated ids take the largest, nulls go."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y"))
    return rows.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows in the order of a hash of the key, so that any run takes the same."""
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            yield batch


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: int, ratio: float = 0) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled documents of each class that satisfy
    `learn`, and at most `ratio` (if given) times the smaller class.  The bound is on the labelled ids, so the text table is read once and never shuffled."""
    known = one_label(labels, column).where(learn)
    limit = {y: per_class for y in (0, 1)}
    if ratio:
        fewer = min((n for _, n in known.groupBy("y").count().collect()), default=0)
        limit = {y: min(per_class, int(ratio * fewer) + 1) for y in (0, 1)}
    ids = bounded_sample(known.where("y = 0"), "doc_id", limit[0]).union(bounded_sample(known.where("y = 1"), "doc_id", limit[1]))
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id")


def bounded_texts(sample: DataFrame, size: Column, limit: int) -> DataFrame:
    """Of a stored labelled sample (doc_id, text, y, ...): for each y, texts in the order of a hash of
    the id until their sizes add up to `limit`; a text of more than a quarter of that is passed over."""
    sized = sample.select("doc_id", "y", size.cast("long").alias("size")).where(F.col("size") <= limit // 4)
    before = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit("bound")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ids = sized.withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= limit).select("doc_id").distinct()
    return sample.join(ids, "doc_id", "left_semi")


def at_most(rows: DataFrame, count: str, limit: int, parts: int = 1024) -> int:
    """The least c >= 1 for which no more than `limit` rows have count >= c, exact for any counts.

    A pass by bit length finds the power of two below c, then each pass parts what is left of the
    range, so that the driver holds at most `parts` rows."""
    size = F.col(count).cast("long")

    def sizes(part: DataFrame, bucket: Column) -> list[tuple[int, int]]:
        return sorted((tuple(r) for r in part.groupBy(bucket.alias("b")).count().collect()), reverse=True)

    above, lo, hi = 0, 1, 1
    for b, n in sizes(rows.where(size >= 1), F.length(F.bin(size))):
        if above + n > limit:
            lo, hi = (1 << (b - 1)) + 1, 1 << b
            break
        above += n
    while lo < hi:  # c is in lo ... hi; `above` rows have count >= hi
        width = -(-(hi - lo) // parts)
        for b, n in sizes(rows.where((size >= lo) & (size < hi)), F.expr(f"({count} - {lo}) div {width}")):
            if above + n > limit:
                lo, hi = lo + b * width + 1, min(lo + (b + 1) * width, hi)
                break
            above += n
        else:
            break
    return lo
