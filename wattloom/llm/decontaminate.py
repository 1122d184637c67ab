"""Benchmark decontamination by greedy string tiling.

Token runs of MIN_MATCH words that a document shares with a test item are the seeds; they come from
a rolling hash of the token fingerprints (Karp-Rabin).  Seeds on one diagonal join to matches; the
longest match is marked, what is left of the others is tried again, until no unmarked match of
MIN_MATCH words remains.  A document is contaminated by an item of which the tiles cover at least
THRESHOLD, in whatever order the passages stand.

The items are taken in blocks of bounded size, each of which goes to all tasks and meets every
document once: documents are never shuffled, and a passage that a third of them share costs no more
than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, whole_text
from .textblocks import Block, Tokens, blocks, ngram_hashes, tokenize

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_MB = 16
FILTER_BITS = 22
EXPANDED = 2_000_000


@dataclass
class Items:
    """A block of test items: ids, tokens, and their sorted seed hashes with (item, position)."""

    ids: list[int]
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    position: np.ndarray
    likely: np.ndarray

    def places_of(self, item: int) -> np.ndarray:
        """The places of an item's seeds."""
        if not hasattr(self, "_by_item"):
            self._by_item = np.argsort(self.item, kind="stable")
            self._first = np.searchsorted(self.item[self._by_item], np.arange(len(self.ids) + 1))
        return self._by_item[self._first[item] : self._first[item + 1]]

    def ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of h that are seeds of some item, and the first and number of their seeds."""
        maybe = np.flatnonzero(self.likely[h >> np.uint64(64 - FILTER_BITS)])
        lo = np.searchsorted(self.seeds, h[maybe], "left")
        count = np.searchsorted(self.seeds, h[maybe], "right") - lo
        has = count > 0
        return maybe[has], lo[has], count[has]


def index_items(rows: list[tuple[int, str]]) -> Items:
    column = pa.array([text or "" for _, text in rows], pa.string())
    tokens, hashes, item, position = [], [], [], []
    for block in blocks(column):
        t = tokenize(block)
        h, bounds = ngram_hashes(t, MIN_MATCH)
        doc = np.repeat(np.arange(len(block)), np.diff(bounds))
        hashes.append(h)
        item.append(block.row + doc)
        position.append(np.arange(len(h)) - bounds[doc])
        tokens += [t.hash[a:b] for a, b in zip(t.bounds, t.bounds[1:])]
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(h, kind="stable")
    likely = np.zeros(1 << FILTER_BITS, bool)
    likely[h >> np.uint64(64 - FILTER_BITS)] = True
    empty = [np.zeros(0, np.int64)]
    return Items([i for i, _ in rows], tokens, h[order], np.concatenate(empty + item)[order], np.concatenate(empty + position)[order], likely)


def greedy_tiles(i: np.ndarray, j: np.ndarray, text_size: int, item_size: int, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, length) from the seed pairs (i, j) of `least` tokens."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(i - j) != 0)) + 1
    first = np.concatenate([[0], cut]) if len(i) else cut
    size = np.diff(np.append(first, len(i))) + least - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[first], j[first])] if len(i) else []
    heapq.heapify(heap)
    text_used, item_used = np.zeros(text_size, bool), np.zeros(item_size, bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = text_used[a : a + n] | item_used[b : b + n]
        if not taken.any():
            text_used[a : a + n] = item_used[b : b + n] = True
            tiles.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for lo, hi in edges.reshape(-1, 2):
            if hi - lo >= least:
                heapq.heappush(heap, (int(lo - hi), int(a + lo), int(b + lo)))
    return tiles


def _spread(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place of the ranges lo ... lo + count."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(lo)), count), np.repeat(lo, count) + nth


def _candidates(doc: np.ndarray, lo: np.ndarray, count: np.ndarray, items: Items, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) pairs of which the shared seeds, wherever they stand, cover enough of the item:
    tiles can't cover more.  Each different seed of a document counts once, and a few documents are
    taken at a time, so that passages which many items share stay cheap."""
    order = np.lexsort((lo, doc))
    doc, lo, count = doc[order], lo[order], count[order]
    once = np.ones(len(doc), bool)
    once[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])
    doc, lo, count = doc[once], lo[once], count[once]
    out, at = [], 0
    upto = np.cumsum(count)
    while at < len(doc):
        to = int(np.searchsorted(upto, upto[at] - count[at] + EXPANDED, "right"))
        to = max(int(np.searchsorted(doc, doc[min(to, len(doc) - 1)], "left")) if to < len(doc) else to, int(np.searchsorted(doc, doc[at], "right")))
        which, seed = _spread(lo[at:to], count[at:to])
        d, item, pos = doc[at:to][which], items.item[seed], items.position[seed]
        order = np.lexsort((pos, item, d))
        d, item, pos = d[order], item[order], pos[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
        step = np.full(len(d), MIN_MATCH)
        step[:-1] = np.where(new[1:], MIN_MATCH, np.minimum(np.diff(pos), MIN_MATCH))
        first = np.flatnonzero(new)
        enough = np.add.reduceat(step, first) >= threshold * sizes[item[first]] if len(first) else np.zeros(0, bool)
        out.append((d[first][enough], item[first][enough]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _block_matches(block: Block, items: Items, threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, item tokens, covered tokens, tiles) of what passes the threshold."""
    t: Tokens = tokenize(block)
    h, bounds = ngram_hashes(t, MIN_MATCH)
    at, lo, count = items.ranges(h)
    if not len(at):
        return
    doc = np.searchsorted(bounds, at, "right") - 1
    sizes = np.array([len(x) for x in items.tokens])
    for d, item in zip(*(x.tolist() for x in _candidates(doc, lo, count, items, sizes, threshold))):
        a, b = np.searchsorted(doc, [d, d + 1])
        own = items.places_of(item)  # rising, as are the ranges' places
        first, stop = np.searchsorted(own, lo[a:b]), np.searchsorted(own, lo[a:b] + count[a:b])
        which, place = _spread(first, stop - first)
        tiles = greedy_tiles(at[a:b][which] - bounds[d], items.position[own[place]], t.bounds[d + 1] - t.bounds[d], int(sizes[item]))
        total = sum(n for _, _, n in tiles)
        if total >= threshold * sizes[item]:
            yield block.row + d, item, int(sizes[item]), total, len(tiles)


def _item_blocks(benchmark: DataFrame, block_mb: float) -> Iterator[Items]:
    """The different test items (key, text) in blocks of about block_mb."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // (block_mb * 1e6)) + 1
    for k in range(n):
        part = benchmark.where(F.pmod(F.col("key"), F.lit(n)) == k) if n > 1 else benchmark
        yield index_items(sorted((r.key, r.text) for r in part.select("key", "text").collect()))


def _different(benchmark: DataFrame) -> DataFrame:
    """(text, key): every different text of the items, numbered."""
    texts = benchmark.select("text").where("text is not null").distinct()
    return stored(texts.withColumn("key", F.monotonically_increasing_id()), "leak-items")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_mb: float = BLOCK_MB) -> DataFrame:
    """A row for each document and test item of which the document's tiles cover the threshold.

    Null and empty texts match nothing, nor do items of fewer than MIN_MATCH tokens, which would
    condemn every text with their words; repeated rows on either side give a row each; other columns
    are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    items_of = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    different = _different(items_of)
    found = []
    for items in _item_blocks(different, block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(rows_in: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows_in):
                got = [m for b in blocks(batch.column(1)) for m in _block_matches(b, shared.value, threshold)]
                ids = batch.column(0).take(pa.array([m[0] for m in got], pa.int64()))
                key = pa.array([shared.value.ids[m[1]] for m in got], pa.int64())
                rest = [pa.array([m[k] for m in got], pa.int64()) for k in (2, 3, 4)]
                cover = pa.array([m[3] / m[2] for m in got], pa.float64())
                yield pa.RecordBatch.from_arrays([ids, key, *rest, cover], ["doc_id", "key", "item_tokens", "covered_tokens", "n_tiles", "coverage"])

        found.append(rows.mapInArrow(run, "doc_id long, key long, item_tokens long, covered_tokens long, n_tiles long, coverage double"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    keys = items_of.join(different, "text").select("key", "item_id")
    return out.join(keys, "key").select("doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows of docs, with all their columns, that no test item contaminates.

    Null and empty texts stay, as nothing matches them; so do all rows where the items are empty or too
    short; repeated rows meet the same fate; an empty table stays empty."""
    for items in _item_blocks(_different(benchmark), block_mb):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows):
                keep = np.ones(batch.num_rows, bool)
                for b in blocks(batch.column(batch.schema.get_field_index("text"))):
                    for m in _block_matches(b, shared.value, threshold):
                        keep[m[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
