"""Series too long for one task: rows cut into chunks, with what a chunk needs from outside.

A row's place in its series comes from its place in its time part and the number of rows in the parts
before, so no task holds more than a part or a chunk.  Frames of a few rows get the rows around a
chunk (`with_halo`); what reaches back without bound, like the last value before a gap, is carried in
from a small table of one row a chunk (`windows.interpolate_in_chunks`).  Gaps and empty stretches are found
within time parts and stitched over a table of one row a part (`gaps_in_parts`, `stretches_in_parts`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import by_time, empty_runs


def attach(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of `facts`, by keys of which any may be null; without keys, `facts` has
    one row."""
    if not on:
        return rows.crossJoin(F.broadcast(facts))  # one row
    renamed = facts.withColumnsRenamed({k: f"_k_{k}" for k in on})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on))
    return rows.join(renamed, same, how).drop(*(f"_k_{k}" for k in on))


def place(df: DataFrame, keys: list[str], ts: str = "ts", part: str = "month") -> DataFrame:
    """The rows with `_at`, their place in the series from 0.  Rows of one series and time must be one."""
    parted = df.withColumn("_part", F.date_trunc(part, ts))
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    placed = parted.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(ts)))
    placed = attach(placed, starts, [*keys, "_part"])
    return placed.withColumn("_at", F.col("_from") + F.col("_in") - 1).drop("_part", "_from", "_in")


def spread(placed: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Placed rows with `_own`, their chunk, once for every chunk (`_chunk`) that they are in or near."""
    first = F.greatest(F.floor((F.col("_at") - after) / size), F.lit(0))
    last = F.floor((F.col("_at") + before) / size)
    return placed.withColumn("_own", F.floor(F.col("_at") / size)).withColumn("_chunk", F.explode(F.sequence(first, last)))


def with_halo(df: DataFrame, keys: list[str], run: Callable[[DataFrame, list[str]], DataFrame], before: int, after: int, size: int = 100_000, ts: str = "ts", part: str = "month") -> DataFrame:
    """run(rows, keys) over chunks of `size` rows of a series, each with the rows around it that a row
    frame of `before` and `after` needs: the same rows as run(df, keys), with no task larger than a
    chunk or a time part."""
    chunked = spread(place(df, keys, ts, part), before, after, size).drop("_at")
    return run(chunked, [*keys, "_chunk"]).where("_own = _chunk").drop("_own", "_chunk")


def gaps_in_parts(df: DataFrame, keys: list[str], expected: str, ts: str = "ts", part: str = "month") -> DataFrame:
    """W7 over time parts: the same rows as grid.gaps.  Each part gives its inner gaps; the gaps between
    parts come from their first and last times."""
    parted = df.select(*keys, ts, F.date_trunc(part, ts).alias("_part"))
    inner = parted.withColumn("previous", F.lag(ts).over(by_time([*keys, "_part"], ts)))
    ends = parted.groupBy(*keys, "_part").agg(F.min(ts).alias(ts), F.max(ts).alias("_last"))
    between = ends.withColumn("previous", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")))
    steps = inner.select(*keys, ts, "previous").unionByName(between.select(*keys, ts, "previous"))
    seconds = F.timestamp_diff("SECOND", F.col("previous"), F.col(ts))
    return steps.where(F.col(ts) > F.col("previous") + F.expr(expected)).select(*keys, "previous", F.col(ts).alias("current"), seconds.alias("gap_s"))


def stretches_in_parts(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", part: str = "month") -> DataFrame:
    """W8 over time parts: the same rows as grid.empty_stretches.  A stretch inside a part is known there;
    one that touches a part's end goes on to the first good row of a later part, and one that touches
    its beginning counts only if the part before did not end in it."""
    parted = df.withColumn("_part", F.date_trunc(part, ts))
    runs = empty_runs(parted, [*keys, "_part"], columns, ts)
    empty = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in columns), F.lit(True))
    parts = parted.groupBy(*keys, "_part").agg(F.min(F.when(~empty, F.col(ts))).alias("_good"), F.max(ts).alias("_last"), F.max_by(empty, ts).alias("_ends_empty"))
    rising, falling = (Window.partitionBy(*keys).orderBy(o) for o in ("_part", F.desc("_part")))
    later = falling.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_part", F.coalesce(F.lag("_ends_empty").over(rising), F.lit(False)).alias("_goes_on"),
        F.coalesce(F.last("_good", True).over(later), F.max("_last").over(Window.partitionBy(*keys))).alias("_until"),
    )
    known = attach(runs, parts, [*keys, "_part"])
    own = known.where(~(F.col("_from_first") & F.col("_goes_on")))
    return own.select(*keys, "start", F.when(F.col("_to_last"), F.col("_until")).otherwise(F.col("end")).alias("end"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two sets of rows together; either may be empty."""
    n = a["n"] + b["n"]
    off = b["m"] - a["m"]
    m = a["m"] + off * b["n"] / n
    q = a["q"] + b["q"] + off * off * a["n"] * b["n"] / n
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(F.struct(a["_b"].alias("_b"), n.alias("n"), m.alias("m"), q.alias("q")))


def rolling_stats(df: DataFrame, keys: list[str], columns: str | dict[str, str], before: int, after: int, ts: str = "ts", name: str = "roll") -> DataFrame:
    """<name>_mean, _std (sample) and _n over rows i-before .. i+after of a column, or of several
    {column: name}; O(n) for any width.  NaN counts as null.

    The series is cut into blocks as long as the frame, so that a frame is the end of one block and the
    beginning of the next.  Moments of all beginnings and all ends come from growing frames within the
    blocks, and two moments are merged for each row: sums never run longer than a frame, so values
    of any size and NaN elsewhere in the series do no harm."""
    named = columns if isinstance(columns, dict) else {columns: name}
    w, width = by_time(keys, ts), before + after + 1
    placed = df.withColumn("_b", F.floor((F.row_number().over(w) - 1) / width))
    rising, falling = (Window.partitionBy(*keys, "_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (ts, F.desc(ts)))
    numbers = {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(named)}
    placed = placed.withColumns({n: F.when(~F.isnan(x), x) for n, x in numbers.items()})
    for tag, frame in (("_p", rising), ("_e", falling)):
        facts = {i: zip("nmv", (F.count(f"_x{i}"), F.avg(f"_x{i}"), F.var_pop(f"_x{i}"))) for i in range(len(named))}
        placed = placed.withColumns({f"{tag}{i}{k}": f.over(frame) for i, found in facts.items() for k, f in found})
    moments = lambda tag, i: F.struct("_b", *(F.col(f"{tag}{i}{k}").alias(k) for k in "nm"), (F.col(f"{tag}{i}v") * F.col(f"{tag}{i}n")).alias("q"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {}
    for i in range(len(named)):
        beginning = moments("_p", i)
        ends |= {f"_r{i}": F.coalesce(F.lead(beginning, after).over(w), F.last(beginning).over(whole)), f"_l{i}": F.lag(moments("_e", i), before).over(w)}
    placed = placed.withColumns(ends)
    out = {}
    for i, n in enumerate(named.values()):
        left, right = F.col(f"_l{i}"), F.col(f"_r{i}")
        frame = F.when(left.isNull(), right).when(left["_b"] == right["_b"], left).otherwise(_merged(left, right))
        out[f"_m{i}"] = frame
    placed, out = placed.withColumns(out), {}
    for i, n in enumerate(named.values()):
        m = F.col(f"_m{i}")
        out |= {f"{n}_mean": m["m"], f"{n}_std": F.when(m["n"] >= 2, F.sqrt(m["q"] / (m["n"] - 1))), f"{n}_n": m["n"]}
    return placed.withColumns(out).select(*df.columns, *out)
