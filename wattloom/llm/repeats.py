"""Repeated passages: every byte that a LENGTH-byte string covers which also starts anywhere else.

Prefix doubling ranks strings by ever longer prefixes and drops positions whose rank is unique;
`doubled_spans` does just that with Spark, over every position.  A rank for every byte is many times the
input, so `repeated_spans` names the bytes by doubling within a text and ranks sampled positions: in
every LENGTH-byte window the PREFIX-byte string with the least hash (leftmost if tied) is its anchor,
and equal windows have equal anchors in the same place.  So

1. anchors are ranked by PREFIX bytes; an anchor of unique rank has no window that repeats;
2. those left are ranked by all the bytes of their windows: where two are equal, all of their windows
   are past the threshold at once;
3. where anchors of one PREFIX rank have unlike surroundings, each of their windows is ranked by its
   LENGTH bytes.

Ranks are 64-bit fingerprints, which Spark groups.  Between the rounds only the surviving positions
travel; which anchors survive reaches the text through a Bloom filter of bounded size, whose false
positives are settled by the exact grouping that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, stored, whole_text
from .textblocks import NAMED, Block, blocks, mix64, name_ranges, names, text_buffers

LENGTH = 200
PREFIX = NAMED
FILTER_MB = 32
HOT = 2_000
PIECE = 1_000_000
_POSITION_BITS = np.uint64(24)


@dataclass
class Anchors:
    """Of each run of windows with one anchor: document in the block, first window, windows, how often
    the same bytes follow at once (in a text that repeats a byte or a short string, every run does), place
    of the anchor after the first window, rank of the prefix, rank of all bytes of the windows."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    times: np.ndarray
    shift: np.ndarray
    prefix: np.ndarray
    whole: np.ndarray


def anchors(block: Block, length: int = LENGTH) -> Anchors:
    prefix = NAMED
    n, windows = len(block.data), length - prefix + 1
    if n < length:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    h = names(block.data)
    at = np.arange(n - prefix + 1)
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    least, span = (h & ~low) | at.astype(np.uint64), 1
    size = n - length + 1
    while 2 * span <= windows:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:size], least[windows - span : windows - span + size])
    anchor = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(block)), np.diff(block.offsets))[:size]
    inside = np.arange(size) + length <= block.offsets[1:][doc]
    new = np.ones(size, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, size))
    start, count = start[inside[start]], count[inside[start]]
    shift = anchor[start] - start
    whole = mix64(name_ranges(h, start, start + count - 1 + length) + mix64(shift.astype(np.uint64)))
    doc = doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (count[1:] != count[:-1]) | (shift[1:] != shift[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
    own = np.flatnonzero(new)
    times = np.diff(np.append(own, len(start)))
    return Anchors(doc[own], start[own], count[own], times, shift[own], h[anchor[start[own]]], whole[own])


class Filter:
    """A Bloom filter with three bits a key."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, size: int) -> np.ndarray:
        return np.stack([mix64(h + np.uint64(k * 0x1357)) % np.uint64(size) for k in range(3)])

    def has(self, h: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 64
        at = self.places(h, size)
        return np.logical_and.reduce([(self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) for p in at]).astype(bool)


def bloom(keys: DataFrame, column: str, limit_mb: float = FILTER_MB) -> Filter:
    """A filter of the keys: 16 bits a key, at most limit_mb in all (then with more false positives)."""
    n = keys.count()
    words = max(16, min(int(limit_mb * 125_000), n // 4 + 1))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            p = Filter.places(batch.column(0).to_numpy().view(np.uint64), words * 64).ravel()
            word, which = np.unique(p >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, which, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    got = keys.select(column).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


def _fresh(tid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which texts of a block the task has not met: copies are handled by their count alone."""
    return np.array([not (x in seen or seen.add(x)) for x in tid.tolist()], bool)


def _pieces(tids: np.ndarray, texts: pa.Array, seen: set[int]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, int]]:
    """Blocks of texts, their tids, which of them are new to the task, and where in its text a block
    begins: long texts come in pieces that share LENGTH - 1 bytes, so that every window is in one."""
    for block in blocks(texts, PIECE):
        tid = tids[block.row : block.row + len(block)]
        fresh = _fresh(tid, seen)
        if len(block) > 1 or len(block.data) <= PIECE + LENGTH:
            yield block, tid, fresh, 0
            continue
        for lo in range(0, len(block.data) - LENGTH + 1, PIECE):
            data = block.data[lo : lo + PIECE + LENGTH - 1]
            yield Block(block.row, data, np.array([0, len(data)])), tid, fresh, lo


def _position(tid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(tid.view(np.uint64) + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _ranked(texts: DataFrame) -> DataFrame:
    """(prefix, at): the PREFIX rank of every anchor and a fingerprint of where it is; of one that follows
    itself, two of its places."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            seen: set[int] = set()
            tids = batch.column(0).to_numpy()
            for block, tid, fresh, base in _pieces(tids, batch.column(1), seen):
                a = anchors(block)
                ok = fresh[a.doc]
                again = np.flatnonzero(ok)[a.times[ok] > 1]
                each = np.concatenate([np.flatnonzero(ok), again])
                doc, start, prefix = a.doc[each], a.start[each], a.prefix[each]
                start[len(start) - len(again) :] += a.count[again]
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(_position(tid[doc], base + start - block.offsets[doc]))], ["prefix", "at"])

    return texts.mapInArrow(run, "prefix long, at long")


SURVIVOR = "prefix long, whole long, tid long, start int, count int, times int"


def _survivors(texts: DataFrame, repeated: Filter) -> DataFrame:
    """Anchors whose PREFIX rank is not unique, and a few that the filter lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(repeated)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            seen: set[int] = set()
            tids = batch.column(0).to_numpy()
            for block, tid, fresh, base in _pieces(tids, batch.column(1), seen):
                a = anchors(block)
                ok = fresh[a.doc]
                ok[ok] = shared.value.has(a.prefix[ok])
                doc, start = a.doc[ok], a.start[ok]
                local = (base + start - block.offsets[doc]).astype(np.int32)
                out = [a.prefix[ok].view(np.int64), a.whole[ok].view(np.int64), tid[doc], local, a.count[ok].astype(np.int32), a.times[ok].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["prefix", "whole", "tid", "start", "count", "times"])

    return texts.mapInArrow(run, SURVIVOR)


WINDOWS = "key long, hot boolean, tid long, start int, whole long, bytes binary"


def _surroundings(texts: DataFrame, mixed: Filter, hot: Filter) -> DataFrame:
    """The bytes of the windows of anchors with unlike surroundings; of anchors whose PREFIX rank is
    hot, a row for each window instead, keyed by the window's rank."""
    shared = texts.sparkSession.sparkContext.broadcast((mixed, hot))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, hot = shared.value
        for batch in batches(rows):
            seen: set[int] = set()
            met: set[int] = set()
            tids = batch.column(0).to_numpy()
            for block, tid, fresh, base in _pieces(tids, batch.column(1), seen):
                a = anchors(block)
                ok = fresh[a.doc]
                ok[ok] = mixed.has(a.whole[ok])
                ok = np.flatnonzero(ok)
                ok = ok[_fresh(a.whole[ok], met)] if len(ok) else ok
                is_hot = hot.has(a.prefix[ok])
                raw = block.data.tobytes()
                one, each = ok[~is_hot], ok[is_hot]
                local = base + a.start[one] - block.offsets[a.doc[one]]
                parts = [raw[s : s + c - 1 + LENGTH] for s, c in zip(a.start[one].tolist(), a.count[one].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.prefix[one].view(np.int64)), pa.array(np.zeros(len(one), bool)), pa.array(tid[a.doc[one]]), pa.array(local.astype(np.int32)), pa.array(a.whole[one].view(np.int64)), pa.array(parts, pa.binary())],
                    ["key", "hot", "tid", "start", "whole", "bytes"],
                )
                if len(each):
                    count = a.count[each]
                    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    start, doc = np.repeat(a.start[each], count) + nth, np.repeat(a.doc[each], count)
                    rank = name_ranges(names(block.data), start, start + LENGTH)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank.view(np.int64)), pa.array(np.ones(n, bool)), pa.array(tid[doc]), pa.array((base + start - block.offsets[doc]).astype(np.int32)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())],
                        ["key", "hot", "tid", "start", "whole", "bytes"],
                    )

    return texts.mapInArrow(run, WINDOWS)


SPANS = "tid long, start int, stop int"


def _window_runs(keys: np.ndarray, tid: np.ndarray, start: np.ndarray, column: pa.Array) -> pa.RecordBatch:
    """Runs of windows that occur in another row of the same key, as byte spans."""
    block = Block(0, *text_buffers(column))
    count = np.diff(block.offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = block.offsets[row] + nth
    rank = mix64(name_ranges(names(block.data), at, at + LENGTH) + mix64(keys[row].view(np.uint64)))
    _, which, times = np.unique(rank, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    edge = np.ones(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (twice[1:] != twice[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(row)))
    first, size = first[twice[first]], size[twice[first]]
    begin = start[row[first]] + nth[first]
    return pa.RecordBatch.from_arrays([pa.array(tid[row[first]]), pa.array(begin.astype(np.int32)), pa.array((begin + size - 1 + LENGTH).astype(np.int32))], ["tid", "start", "stop"])


def _compare_windows(rows: DataFrame) -> DataFrame:
    """Repeated windows within each PREFIX rank: the rows of a rank meet in one task, in order, and
    are taken a few thousand at a time (a rank of more rows is hot and goes another way)."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches(batches_in):
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
            keys, whole = part.column(0).to_numpy(), part.column(4).to_numpy()
            new = np.ones(len(keys), bool)  # equal surroundings, which several tasks met, once
            new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
            part = part.filter(pa.array(new))
            keys = part.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            if cut:
                yield from compare(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None:
            yield from compare(rest)

    def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        keys = part.column(0).to_numpy()
        lo = 0
        while lo < len(keys):
            hi = min(lo + 4000, len(keys))
            if hi < len(keys):
                back = int(np.searchsorted(keys, keys[hi], "left"))
                hi = back if back > lo else int(np.searchsorted(keys, keys[lo], "right"))
            p = part.slice(lo, hi - lo).combine_chunks()
            yield _window_runs(p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(2).to_numpy(), p.column(3).chunk(0))
            lo = hi

    ordered = rows.select("key", "tid", "start", "bytes", "whole").repartition("key").sortWithinPartitions("key", "whole")
    return ordered.mapInArrow(run, SPANS)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tid, start, stop): byte spans covered by strings that also start elsewhere, for texts
    (tid, text); spans of a text may overlap.  Copies of a text count here as one text."""
    twice = F.min("at") != F.max("at")
    ranks = _ranked(texts).groupBy("prefix").agg(twice.alias("twice")).where("twice").select("prefix")
    survivors = stored(_survivors(texts, bloom(stored(ranks, "rep-ranks"), "prefix")), "rep-survivors")
    at = F.struct("tid", "start")
    wholes = survivors.groupBy("prefix", "whole").agg(((F.min(at) != F.max(at)) | (F.max("times") > 1)).alias("same"))
    wholes = stored(wholes, "rep-wholes")
    mixed = wholes.groupBy("prefix").agg(F.count("*").alias("n"), F.min(F.col("same").cast("int")).alias("all_same"))
    mixed = mixed.where("n > 1 and all_same = 0")
    unlike = stored(wholes.join(mixed.select("prefix"), "prefix").select("whole"), "rep-unlike")
    hot = mixed.where(F.col("n") > HOT).select("prefix")
    around = stored(_surroundings(texts, bloom(unlike, "whole"), bloom(stored(hot, "rep-hot"), "prefix")), "rep-around")

    end = F.col("start") + F.col("count") * F.col("times") - 1 + LENGTH
    same = survivors.join(wholes.where("same").select("whole"), "whole").select("tid", "start", end.cast("int").alias("stop"))
    few = _compare_windows(around.where("not hot"))
    windows = around.where("hot").select(F.col("key"), "tid", "start")
    # stored, so that the join below is between two plain exchanges, whose hot keys Spark splits
    known = stored(windows.groupBy("key").agg((F.min(at) != F.max(at)).alias("same")).where("same").select("key"), "rep-known")
    many = windows.join(known, "key").select("tid", "start", (F.col("start") + LENGTH).cast("int").alias("stop"))
    return same.unionByName(few).unionByName(many)


def doubled_spans(texts: DataFrame, length: int = LENGTH, first: int = 25) -> DataFrame:
    """(tid, start, stop): the same spans by plain prefix doubling over every position of different
    texts (tid, text): ranks of `first` bytes, then of twice as many from pairs of ranks, the last round
    at the offset that reaches `length`; positions whose rank is unique are dropped after each round.

    A rank is the least position with its string, so it is exact.  Every position of the texts is a row
    at first: tables, not corpora.  Texts shorter than `length` have no spans; empty tables none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                at = np.arange(max(len(raw) - first + 1, 0))
                parts = pa.array([raw[i : i + first] for i in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tid)), pa.array(at), parts], ["tid", "at", "s"])

    def reranked(rows: DataFrame, by: list[str]) -> DataFrame:
        string = Window.partitionBy(*by)
        ranks = rows.select("tid", "at", F.min(F.struct("tid", "at")).over(string).alias("rank"), F.count("*").over(string).alias("n"))
        return stored(ranks.where("n > 1").select("tid", "at", "rank"), "rep-doubled")

    ranks, size = reranked(texts.select("tid", "text").mapInArrow(run, "tid long, at long, s binary"), ["s"]), first
    while size < length:
        step = min(size, length - size)
        on = ranks.select("tid", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        ranks, size = reranked(ranks.join(on, ["tid", "at"]), ["rank", "then"]), size + step
    return ranks.select("tid", F.col("at").cast("int").alias("start"), (F.col("at") + length).cast("int").alias("stop"))


def _map_removed(rows: DataFrame) -> DataFrame:
    """Digests of (doc_id, text, copies, spans)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in):
            out = []
            for text, copies, spans in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = text.as_buffer().to_pybytes()
                runs = removed_runs(len(raw), copies.as_py(), spans)
                kept, last = [], 0
                for a, b in runs:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                whole = b"".join(kept)
                out.append((len(raw), len(raw) - len(whole), len(runs), hashlib.sha256(whole).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_runs(size: int, copies: int, spans: pa.Scalar) -> list[tuple[int, int]]:
    """The maximal removed runs of a text: all of it where it has a copy, else its merged spans."""
    if copies > 1 and size >= LENGTH:
        return [(0, size)]
    runs: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in (spans.as_py() or [])):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append([*s])
    return [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs.

    Null texts are empty; texts under LENGTH bytes lose nothing; equal rows are copies of each
    other and lose everything; repeated or null ids give a row each; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("tid", F.xxhash64("text"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= LENGTH).select("tid", "text"))
    merged = spans.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    copies = rows.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = stored(copies.join(merged, "tid", "full"), "rep-facts")
    joined = rows.join(facts, "tid", "left")
    return _map_removed(joined.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans"))
