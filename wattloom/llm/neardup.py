"""Near duplicates by DartMinHash signatures, banded joining and exact checks.

A text is a weighted set of shingles of five words, weighted by how often they occur.  Darts fall on
every unit of a shingle's weight as a Poisson process in rank, drawn from hashes alone; each dart goes
to one coordinate, whose earliest dart is kept.  Two texts agree in a coordinate with the probability
of their weighted Jaccard similarity.  Texts that agree in a band of coordinates are candidates.

Equal texts are one node from the start.  Two steps find the links between candidates, exactly:

1. star: in each bucket the node with the most candidates, the pivot, is compared with the others,
   one pair a node and bucket; connected components give the first classes;
2. blocks: a bucket that still holds several classes is cut into chunks of bounded size, and every two
   chunks meet in a group of their own, which compares nodes of different classes by one matrix product
   and returns a spanning forest of its links.  So no pair of a bucket is ever a row; a chunk is sent
   once for each other chunk of its bucket.

Classes are connected components of all links, by repeated least labels; no link between candidates
is lost and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, stored, whole_text
from .textblocks import Block, blocks, mix64, ngram_hashes, tokenize

SHINGLE = 5
SIMILAR = 0.8
ROWS = 5
BANDS = 20
COORDINATES = ROWS * BANDS
CHUNK_TEXTS = 512
CHUNK_CELLS = 1 << 18
TILE = 4096


def weighted_cells(block: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit cells of each document's weighted shingle set, and n_docs+1 offsets: the w-th
    occurrence of a shingle is a cell of its own.  A text of fewer words is one shingle."""
    t = tokenize(block)
    h, bounds = ngram_hashes(t, shingle)
    short = np.flatnonzero((np.diff(t.bounds) > 0) & (np.diff(bounds) == 0))
    own = np.zeros(len(short), np.uint64)
    for i in range(shingle - 1):
        at = t.bounds[short] + i
        has = at < t.bounds[short + 1]
        own = np.where(has, mix64(own * np.uint64(0x9FB21C651E98DF25) + t.hash[np.minimum(at, len(t.hash) - 1)]), own) if len(short) else own
    doc = np.concatenate([np.repeat(np.arange(len(block)), np.diff(bounds)), short])
    h = np.concatenate([h, own])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix64(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(doc, np.arange(len(block) + 1))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(cells: np.ndarray, bounds: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate, (n_docs, k); zeros for empty sets.

    Each cell is a unit of weight; its darts arrive in rank as a Poisson process of rate 1.  About
    k ln k + 2k darts a set are thrown; where a coordinate stays empty, all darts up to twice the rank
    are."""
    n = len(bounds) - 1
    out = np.zeros((n, k), np.uint64)
    weight = np.diff(bounds)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        size = weight[todo]
        at = np.repeat(bounds[todo], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc, h, rank = np.repeat(np.arange(len(todo)), size), mix64(cells[at] ^ np.uint64(0xDA27)), np.zeros(size.sum())
        darts = []
        while len(h):
            rank = rank - np.log(_uniform(h))
            keep = rank <= limit[todo][doc]
            doc, h, rank = doc[keep], h[keep], rank[keep]
            darts.append((doc, rank, mix64(h + np.uint64(0x51ED))))
            h = mix64(h + np.uint64(0x9E37))
        doc, rank, dart = (np.concatenate([d[i] for d in darts]) for i in range(3))
        slot = doc * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        sig = np.zeros(len(todo) * k, np.uint64)
        sig[slot[order]] = dart[order] | np.uint64(1)  # the last to be written is the earliest dart
        sig = sig.reshape(len(todo), k)
        full = (sig != 0).all(axis=1)
        out[todo[full]] = sig[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature, (n_docs, BANDS)."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(9)), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(3) + rows[:, :, i])
    return key


def text_key(text: str | Column = "text") -> Column:
    """The 128-bit name of a text; null counts as the empty text."""
    return F.unhex(F.md5(whole_text(text)))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each different text of rows (tid, id, text): tid, node (a number), keys (one for
    each band; empty without words), size in cells, copies and the least id of the copies.

    A task signs a text once; the copies that it meets again only count."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches(rows):
            fresh = np.array([not (x in seen or seen.add(x)) for x in batch.column(0).to_pylist()], bool)
            keys: list = [None] * batch.num_rows
            size: list = [None] * batch.num_rows
            at = np.flatnonzero(fresh)
            for block in blocks(batch.column(2).take(pa.array(at))):
                cells, bounds = weighted_cells(block)
                signed = band_keys(dart_signatures(cells, bounds)).view(np.int64)
                for i, (k, n) in enumerate(zip(signed, np.diff(bounds).tolist())):
                    keys[at[block.row + i]], size[at[block.row + i]] = (k.tolist() if n else []), n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(size, pa.int64())], ["tid", "id", "keys", "size"])

    signed = rows.select("tid", "id", "text").mapInArrow(run, "tid binary, id long, keys array<long>, size long")
    one = signed.groupBy("tid").agg(F.first("keys", True).alias("keys"), F.max("size").alias("size"), F.count("*").alias("copies"), F.min("id").alias("least"))
    return stored(one.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, size, n) of the buckets with several nodes; of buckets with the same nodes, one."""
    buckets = nodes.select("node", "size", F.explode("keys").alias("key"))
    of = buckets.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)))
    once = stored(of.where("n > 1").groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n"), "dup-keys")
    return stored(buckets.join(once, "key"), "dup-shared")


def _cells(texts: DataFrame) -> DataFrame:
    """(node, cells): the sorted 64-bit cells of each text (node, text), as bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for block in blocks(batch.column(1)):
                cells, bounds = weighted_cells(block)
                out = [np.sort(cells[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, len(block)), pa.array(out, pa.binary())], ["node", "cells"])

    return texts.mapInArrow(run, "node long, cells binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted cell lists."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum()) if len(both) else 0
    return common / (len(both) - common) if len(both) else 1.0


def _similar_pairs(pairs: DataFrame, cells: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (u, v) whose texts are similar."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            near = [similarity(x.as_buffer(), y.as_buffer()) >= similar - 1e-12 for x, y in zip(batch.column(2), batch.column(3))]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    left = cells.select(F.col("node").alias("u"), F.col("cells").alias("a"))
    right = cells.select(F.col("node").alias("v"), F.col("cells").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _star_pairs(shared: DataFrame) -> DataFrame:
    """(u, v) with u < v: each node of a bucket with the pivot of the bucket."""
    degree = stored(shared.groupBy("node").agg(F.sum("n").alias("degree")), "dup-degree")
    pivots = stored(shared.join(degree, "node").groupBy("key").agg(F.max_by("node", "degree").alias("pivot")), "dup-pivots")
    star = shared.join(pivots, "key").where("node <> pivot")
    return star.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()


def overlaps(cells: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many cells each of the lists `left` shares with each of `right`: a matrix product over the
    cells that two lists have, a tile of columns at a time."""
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    _, column, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, TILE):
        a, b = np.searchsorted(column, [lo, lo + TILE])
        has = np.zeros((len(cells), min(TILE, width - lo)), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this symmetric matrix."""
    new, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        stack = [root] if new[root] else []
        new[root] = False
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & new)
            new[found] = False
            out += [(at, int(x)) for x in found]
            stack += found.tolist()
    return out


def _block_links(blocks_of: DataFrame, similar: float) -> DataFrame:
    """(u, v): classes linked within a block (key, lo, hi) of nodes (chunk, class_of, cells)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        chunk, cls = (table.column(c).to_numpy() for c in ("chunk", "class_of"))
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("cells")]
        size = np.array([len(c) for c in cells])
        left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        common = overlaps(cells, left, right)
        near = np.zeros((len(cells), len(cells)), bool)
        near[np.ix_(left, right)] = common >= (similar - 1e-12) * (size[left][:, None] + size[right] - common)
        near &= cls[:, None] != cls
        links = spanning_links(near | near.T)
        u, v = ([cls[e[i]] for e in links] for i in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return blocks_of.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long")


def _open_blocks(shared: DataFrame, label: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, lo, hi, chunk, class_of, cells) of the buckets of three and more nodes that are not one
    class yet: each node goes to the blocks of its chunk with every chunk of its bucket."""
    classed = stored(shared.where("n > 2").join(label, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("class_of")), "dup-classed")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_TEXTS, F.sum("size") / CHUNK_CELLS)).cast("int")
    of = classed.groupBy("key").agg(F.min("class_of").alias("a"), F.max("class_of").alias("b"), chunks.alias("m"))
    of = stored(of.where("a <> b").select("key", "m"), "dup-open")
    chunk = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    rows = classed.join(of, "key").withColumn("chunk", chunk).join(cells, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "class_of", "cells")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of every node with a link (u, v).

    Least labels spread over the links, and every round also jumps to the label of the label, so that
    the rounds grow with the logarithm of a chain's length."""
    both = stored(links.union(links.select("v", "u")).distinct(), "dup-links")
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("root")), "dup-label")
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("other"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = label.join(near, "node").join(jump, "root", "left")
        new = new.select("node", F.col("root").alias("old"), F.least("root", "other", F.coalesce("above", "root")).alias("root"))
        new = stored(new, "dup-label")
        discard(label)
        label = new.select("node", "root")
        if not new.where("root <> old").take(1):
            discard(both)
            return label
        label.stored_at = new.stored_at


def text_classes(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(tid, root, copies, least) for every different text of rows (tid, id, text): root names its
    class of texts that are similar."""
    nodes = _nodes(rows)
    shared = _shared_buckets(nodes)
    candidates = stored(shared.select("node").distinct().join(nodes.select("node", "tid"), "node"), "dup-candidates")
    # copies go before the shuffle (map-side), so that a text that most rows share is not one hot key
    cells = stored(_cells(rows.select("tid", "text").dropDuplicates(["tid"]).join(candidates, "tid").select("node", "text")), "dup-cells")
    first = components(stored(_similar_pairs(_star_pairs(shared), cells, similar), "dup-star"))
    second = components(stored(_block_links(_open_blocks(shared, first, cells), similar), "dup-between"))
    label = nodes.select("node", "tid", "copies", "least").join(first, "node", "left").withColumn("mid", F.coalesce("root", "node")).drop("root")
    label = label.join(second.withColumnRenamed("node", "mid"), "mid", "left")
    return stored(label.select("tid", F.coalesce("root", "mid").alias("root"), "copies", "least"), "dup-texts")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("tid"), F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))


def duplicate_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, class_size): every row of docs with the least doc_id of its class.

    A class is a connected component of texts that are equal or similar.  Null texts count as empty
    ones, which are copies of each other; texts without words are similar only to equal texts;
    repeated ids give a row each; the class of rows whose ids are all null is null; other columns are
    ignored; an empty table gives no rows.  One text is handled whole in one task."""
    rows = _rows(docs)
    texts = text_classes(rows, similar)
    sizes = stored(texts.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "dup-sizes")
    of = stored(texts.select("tid", "root").join(sizes, "root").select("tid", "class_id", "class_size"), "dup-of")
    return rows.select(F.col("id").alias("doc_id"), "tid").join(of, "tid").select("doc_id", "class_id", "class_size")


def drop_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of docs, with all its columns, of each class: that of the least id (any one of equal
    rows; null ids come last).  Nulls and texts without words as in duplicate_classes; an empty table
    gives no rows."""
    texts = text_classes(_rows(docs), similar)
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "tid")).alias("b"))
    keep = stored(best.select(F.col("b.tid").alias("tid"), F.col("b.least").alias("keep")), "dup-keep")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("tid"))
    kept = rows.join(keep, "tid").where(F.col("id").eqNullSafe(F.col("keep")))
    return kept.dropDuplicates(["tid", "id"]).select("row.*")
