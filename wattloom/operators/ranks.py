"""Exact ranks from counts by value, cut into ranges, and exact percentiles from sketched brackets: no
task holds a whole series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.sources.files import scratch

from .scale import attach


def ranked_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, n_equal, n_upto, n_all): how many rows of the series have this value, this or a
    smaller one, any.  Nulls are left out.

    Counts by value are range-partitioned and written, so that a range keeps its number; a table of
    one row a range and series gives what lies before each range, and each range adds up its own."""
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n_equal"))
    path = scratch(spark, "value-ranges")
    ranges = counts.repartitionByRange(*keys, column).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(path)
    stored = spark.read.schema(ranges.schema).parquet(path)
    sizes = stored.groupBy(*keys, "_part").agg(F.sum("n_equal").alias("_size"))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(series).alias("n_all")
    )
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_part") == F.col("_p"))
    within = F.sum("n_equal").over(Window.partitionBy(*keys, "_part").orderBy(column))
    ranked = stored.withColumn("_within", within).join(sizes, same)
    return ranked.select(*keys, column, "n_equal", (F.col("_before") + F.col("_within")).alias("n_upto"), "n_all")


#: A bracket of a rank is the sketch's value MARGIN of the rows before it and after it; a KLL sketch of
#: SKETCH items is off by some 0.4 % of the rows.  Brackets of GATHER rows and less are counted by value.
SKETCH, MARGIN, GATHER, GRID = 800, 0.012, 10_000, 200


def _sketch(inside: Column) -> Column:
    return F.kll_sketch_agg_double(F.when(inside, F.col("value")), F.lit(SKETCH))


def quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: dict[str, float], gather: int = GATHER) -> DataFrame:
    """(keys, column, names of shares...): exact linear percentiles of each column of each series; a
    column without values has no row, and NaN is none.

    Nothing is sorted or ranked as a whole.  A sketch of the rows gives two values that should lie on
    either side of a wanted rank; one aggregate counts how many rows lie before, at and between them,
    which settles the rank or proves the bracket, and sketches what is between.  That goes on (each time
    over some 3 % of the rows before) until so few rows are left that they are counted by value.  A
    bracket that misses its rank is drawn wider, so the result is exact whatever the sketch says."""
    group = [*keys, "column"]
    doubles = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    values = doubles.unpivot(keys, columns, "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = values.groupBy(*group).agg(F.count("*").alias("n"), _sketch(F.lit(True)).alias("sketch"))
    place = lambda s: (F.col("n") - 1) * F.lit(s)
    ranks = F.array_distinct(F.array(*(f(place(s)).cast("long") for s in shares.values() for f in (F.floor, F.ceil))))
    state = sizes.select(
        *group, "n", F.explode(ranks).alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"),
        F.col("n").alias("inside"), "sketch", F.lit(MARGIN).alias("margin"), F.lit(None).cast("double").alias("x"),
    )
    state, open_ranks = _kept(state, gather)
    between = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi")))
    while open_ranks:
        at = (F.col("rank") - F.col("below") + 0.5) / F.col("inside")
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))  # its ranks must be constants
        end = lambda p: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), p.cast("int"))))
        aims = state.where(_is_open(gather)).withColumn("grid", grid)
        aims = aims.withColumns({"a": end(F.floor((at - F.col("margin")) * GRID)), "b": end(F.ceil((at + F.col("margin")) * GRID))}).drop("grid")
        rows = attach(values, aims.select(*group, "rank", "lo", "hi", "a", "b"), group).where(between)
        v, a, b = F.col("value"), F.col("a"), F.col("b")
        inner = (v > a) & (v < b)
        found = rows.groupBy(*group, "rank").agg(
            F.count_if(v < a).alias("_lt"), F.count_if(v == a).alias("_a"), F.count_if(inner).alias("_in"), F.count_if((v == b) & (b > a)).alias("_b"), _sketch(inner).alias("_sketch"),
        )
        left = F.col("rank") - F.col("below")
        to_a = F.col("_lt") + F.col("_a")
        to_b = to_a + F.col("_in")
        is_a, is_in, is_b = (left >= F.col("_lt")) & (left < to_a), (left >= to_a) & (left < to_b), (left >= to_b) & (left < to_b + F.col("_b"))
        told = attach(aims, found, [*group, "rank"], "left")
        step = lambda new, old: F.when(is_in, F.col(new) if isinstance(new, str) else new).otherwise(F.col(old)).alias(old)
        told = told.select(
            *group, "n", "rank", step("a", "lo"), step("b", "hi"), step(F.col("below") + to_a, "below"), step("_in", "inside"), step("_sketch", "sketch"),
            F.when(is_in, F.lit(MARGIN)).otherwise(F.col("margin") * 4).alias("margin"), F.when(is_a, a).when(is_b, b).alias("x"),
        )
        state, open_ranks = _kept(state.where(~_is_open(gather)).unionByName(told), gather)
    few = state.where("x is null").select(*group, "rank", "lo", "hi", "below")
    counted = attach(values, few, group).where(between).groupBy(*group, "rank", "below", "value").agg(F.count("*").alias("n_equal"))
    upto = F.sum("n_equal").over(Window.partitionBy(*group, "rank").orderBy("value"))
    last = counted.withColumn("_upto", upto).where(F.col("_upto") > F.col("rank") - F.col("below")).groupBy(*group, "rank").agg(F.min("value").alias("x"))
    known = state.where("x is not null").select(*group, "rank", "x").unionByName(last)
    order = known.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("order"))  # two entries a share
    out = attach(state.groupBy(*group).agg(F.max("n").alias("n")), order, group)
    of = lambda e: F.element_at("order", e.cast("long"))

    def linear(s: float) -> Column:
        low, high, part = of(F.floor(place(s))), of(F.ceil(place(s))), place(s) - F.floor(place(s))
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return out.select(*group, *(linear(s).alias(n) for n, s in shares.items()))


def _is_open(gather: int) -> Column:
    """Ranks that need another bracket."""
    return F.col("x").isNull() & (F.col("inside") > gather) & (F.col("margin") < 1)


def _kept(state: DataFrame, gather: int) -> tuple[DataFrame, int]:
    """The state (some rows a series and column) as a written table, and how many ranks are open."""
    path = scratch(state.sparkSession, "brackets")
    state.write.parquet(path)
    back = state.sparkSession.read.schema(state.schema).parquet(path)
    return back, back.where(_is_open(gather)).count()


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean, without a window over all rows."""
    ranks = ranked_counts(df, [], column).select(column, (F.col("n_upto") - (F.col("n_equal") - 1) / 2).alias(name))
    return df.join(ranks, column, "left")
