"""Operators on a series in time order.  All of one call share a partitioning and an order, so Spark
plans one exchange and one sort for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import by_time
from .scale import place, rolling_stats, spread


def lags(df: DataFrame, keys: list[str], column: str, steps: dict[str, int], ts: str = "ts") -> DataFrame:
    """Values of k rows before, {name: k}."""
    w = by_time(keys, ts)
    return df.withColumns({name: F.lag(column, k).over(w) for name, k in steps.items()})


def lag_in_time(df: DataFrame, keys: list[str], column: str, name: str, step: str, ts: str = "ts") -> DataFrame:
    """W1 by the clock: the value exactly `step` ('INTERVAL 24 HOURS') before, null if there is none."""
    past = df.select(*keys, (F.col(ts) + F.expr(step)).alias(ts), F.col(column).alias(name))
    return df.join(past, [*keys, ts], "left")


def trailing_means(df: DataFrame, keys: list[str], column: str, windows: dict[str, tuple[int, int]], ts: str = "ts") -> DataFrame:
    """{name: (rows, least)}: means of the rows before, null with fewer than `least` values."""
    out = {}
    for name, (rows, least) in windows.items():
        f = by_time(keys, ts).rowsBetween(-rows, -1)
        out[name] = F.when(F.count(column).over(f) >= least, F.avg(column).over(f))
    return df.withColumns(out)


def null_zscore_outliers(df: DataFrame, keys: list[str], columns: list[str], window: int, least: int, threshold: float = 4.0, ts: str = "ts") -> DataFrame:
    """Values over `threshold` sample deviations from the mean of the centred window (rows
    i - window/2 to i + window/2 - 1) become null, and NaN does; windows of fewer than `least` values or
    without spread judge nothing.  Moments of blocks, all columns at once: O(n) for any window."""
    stats = rolling_stats(df, keys, {c: f"_z_{c}" for c in columns}, window // 2, (window - 1) // 2, ts)
    out = {}
    for c in columns:
        mean, std = F.col(f"_z_{c}_mean"), F.col(f"_z_{c}_std")
        far = F.abs(F.col(c) - mean) > threshold * std
        judged = (F.col(f"_z_{c}_n") >= least) & (std > 1e-12 * F.abs(mean)) & far  # rounding is no spread
        out[c] = F.when(~F.coalesce(judged, F.lit(False)) & ~F.isnan(c), F.col(c))
    return stats.withColumns(out).select(*df.columns)


def spike_flags(keys: list[str], steps: dict[str, float], ts: str = "ts") -> dict[str, Column]:
    """Which values differ by more than a step from the row before (as it was read)."""
    w = by_time(keys, ts)
    return {c: F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) > d, F.lit(False)) for c, d in steps.items()}


def null_spikes(df: DataFrame, keys: list[str], steps: dict[str, float], ts: str = "ts") -> DataFrame:
    return df.withColumns({c: F.when(~f, F.col(c)) for c, f in spike_flags(keys, steps, ts).items()})


def fill(df: DataFrame, keys: list[str], columns: list[str], forward: int, backward: int, ts: str = "ts") -> DataFrame:
    """Forward over at most `forward` rows, then backward over at most `backward`."""
    w = by_time(keys, ts)
    ahead = df.withColumns({c: F.last(c, True).over(w.rowsBetween(-forward, 0)) for c in columns})
    return ahead.withColumns({c: F.first(c, True).over(w.rowsBetween(0, backward)) for c in columns})


def fill_between(df: DataFrame, keys: list[str], columns: list[str], at: str, micros: str, limit: int, around: int, strict: bool) -> DataFrame:
    """W5 of rows that have their place in the series (`at`) and their time in microseconds."""
    w, back = by_time(keys, at), Window.partitionBy(*keys).orderBy(F.desc(at))
    # both frames grow by a row from one row to the next, the second one in falling order of time
    past, future = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, back))
    ends = {}
    for c in columns:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("n"), F.col(micros).alias("s"), F.col(c).alias("x")))
        ends |= {f"_p_{c}": F.last(here, True).over(past), f"_q_{c}": F.last(here, True).over(future)}
    between = df.withColumns(ends)
    out = {}
    for c in columns:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        line = p["x"] + F.try_divide((q["x"] - p["x"]) * (F.col(micros) - p["s"]), q["s"] - p["s"])  # 0 only on carried rows
        near = F.col(at) - p["n"] <= limit
        if strict:
            near = q.isNotNull() & (q["n"] - p["n"] - 1 <= limit)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNotNull() & near, F.when(q.isNull(), p["x"]).otherwise(line))
    filled = between.withColumns(out).select(*df.columns)
    return filled if strict else fill(filled, keys, columns, around, around, at)


def interpolate(df: DataFrame, keys: list[str], columns: list[str], limit: int = 6, around: int = 2, strict: bool = False, ts: str = "ts") -> DataFrame:
    """Linear in time over the first `limit` nulls of a gap (after the last value: that value), then
    `around` rows forward and `around` backward.  strict: only gaps of at most `limit` are filled."""
    rows = df.withColumns({"_at": F.row_number().over(by_time(keys, ts)), "_s": F.unix_micros(F.col(ts).cast("timestamp"))})
    return fill_between(rows, keys, columns, "_at", "_s", limit, around, strict).select(*df.columns)


def interpolate_in_chunks(
    df: DataFrame, keys: list[str], columns: list[str], limit: int = 6, around: int = 2, strict: bool = False, size: int = 100_000, ts: str = "ts", part: str = "month",
) -> DataFrame:
    """W5 over chunks of `size` rows: the same rows as windows.interpolate, no task larger than a chunk.

    A chunk's last and first values go to a table of one row a chunk.  A window over it says for each
    chunk which value comes before it and which after, for every column, and those rows join the chunk
    as rows outside its own.  `around` rows on either side serve the fills at its ends.  `df` is read
    twice; store it first if it is costly."""
    halo = 0 if strict else around
    if size <= halo:
        raise ValueError("a chunk must be longer than the fill")
    placed = place(df, keys, ts, part).withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")))
    own, ends = F.floor(F.col("_at") / size), []
    within = F.col("_at") - own * size
    for i, c in enumerate(columns):
        here = F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("n"), F.col("_s").alias("s"), F.col(c).cast("double").alias("x")))
        ends += [F.max(here).alias(f"_l{i}"), F.max(F.when(within < size - halo, here)).alias(f"_li{i}")]
        ends += [F.min(here).alias(f"_f{i}"), F.min(F.when(within >= halo, here)).alias(f"_fi{i}")]
    chunks = placed.groupBy(*keys, own.alias("_chunk")).agg(*ends)
    rising, falling = (Window.partitionBy(*keys).orderBy(o) for o in ("_chunk", F.desc("_chunk")))
    farther = lambda w: w.rowsBetween(Window.unboundedPreceding, -2)
    carried = []
    for i in range(len(columns)):
        p = F.coalesce(F.lag(f"_li{i}").over(rising), F.last(f"_l{i}", True).over(farther(rising)))
        q = F.coalesce(F.lag(f"_fi{i}").over(falling), F.last(f"_f{i}", True).over(farther(falling)))
        carried += [F.struct(F.lit(i).alias("i"), e.alias("e")) for e in (p, q)]
    carry = chunks.select(*keys, "_chunk", F.array(*carried).alias("_c")).select(*keys, "_chunk", F.explode("_c").alias("_c")).where("_c.e is not null")
    carry = carry.select(
        *keys, "_chunk", F.lit(-1).cast("long").alias("_own"), F.col("_c.e.n").alias("_at"), F.col("_c.e.s").alias("_s"),
        *(F.when(F.col("_c.i") == i, F.col("_c.e.x")).alias(c) for i, c in enumerate(columns)),
    )
    rows = spread(placed.withColumns({c: F.col(c).cast("double") for c in columns}), halo, halo, size)
    both = rows.unionByName(carry, allowMissingColumns=True)
    out = fill_between(both, [*keys, "_chunk"], columns, "_at", "_s", limit, around, strict)
    return out.where("_own = _chunk").select(*df.columns)


def same_slot_mean(df: DataFrame, keys: list[str], column: str, name: str, rows: int = 4, ts: str = "ts") -> DataFrame:
    """Mean of the last `rows` earlier rows of the same weekday and hour."""
    w = Window.partitionBy(*keys, F.weekday(ts), F.hour(ts)).orderBy(ts).rowsBetween(-rows, -1)
    return df.withColumn(name, F.avg(column).over(w))


def mean_of_lags(df: DataFrame, keys: list[str], column: str, name: str, steps: list[int], ts: str = "ts") -> DataFrame:
    """Mean of the lags that are not null."""
    w = by_time(keys, ts)
    past = [F.lag(column, k).over(w) for k in steps]
    n = reduce(lambda a, b: a + b, (p.isNotNull().cast("int") for p in past))
    total = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in past))
    return df.withColumn(name, F.when(n > 0, total / n))


def occurrence(df: DataFrame, keys: list[str], seq: str, name: str = "dup") -> DataFrame:
    """0, 1, 2, ... of the rows of a group in the order of seq."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(seq)) - 1)
