"""Language ID: a byte convolutional network over fixed-length windows.

Byte embeddings feed filters of several widths; the greatest response of each filter in a window goes
to a softmax over the languages.  Training is numpy with Adam on windows that a hash draws from all
windows of each language, at most WINDOWS_A_LANGUAGE and fewer where there are very many languages.  All windows of a text are scored in batches, and their probabilities are averaged by
their lengths.  Because a filter of width k over embedded bytes is a sum of k table look-ups, scoring
adds rows of byte-pair tables instead of multiplying matrices for every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_fold, whole_text
from .textblocks import Block, blocks, mix64

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
WINDOWS_A_LANGUAGE = 9_000
ALL_WINDOWS = 450_000
STEPS = 900
UNKNOWN = "und"


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, the tables that take a byte pair or (for an odd rest) one byte."""
        out = []
        for w in self.filters:
            single = [self.embed @ w[j] for j in range(len(w))]
            out.append([(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < len(single) else single[j] for j in range(0, len(single), 2)])
        return out

    def responses(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The greatest response of every filter in each window."""
        pair = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
        out = []
        for k, parts in zip(WIDTHS, tables):
            span = windows.shape[1] - k + 1
            total = np.take(parts[0], pair[:, :span], axis=0)
            for i, part in enumerate(parts[1:], 1):
                at = pair[:, 2 * i : 2 * i + span] if len(part) == 65536 else windows[:, 2 * i : 2 * i + span]
                total += np.take(part, at, axis=0)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, responses: np.ndarray) -> np.ndarray:
        z = responses @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows that cover every text of the block, their documents and byte counts."""
    size = np.diff(block.offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(block)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = block.offsets[doc] + nth * WINDOW
    length = np.minimum(WINDOW, block.offsets[doc + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    data = np.append(block.data, np.zeros(WINDOW, np.uint8))
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), doc, length


def train_net(windows: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 1, steps: int = STEPS) -> ByteNet:
    """Adam on softmax cross-entropy; the gradient of a maximum goes to the bytes that gave it."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    net = ByteNet(languages, rng.normal(0, 1, (256, EMBED)), [rng.normal(0, (k * EMBED) ** -0.5, (k, EMBED, FILTERS)) for k in WIDTHS], np.zeros(n_out), rng.normal(0, n_out**-0.5, (n_out, len(languages))), np.zeros(len(languages)))
    params = [net.embed, *net.filters, net.bias, net.dense, net.dense_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(y == c) for c in range(len(languages))]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(i, max(1, 96 // len(of))) for i in of])
        b = windows[at]
        e = net.embed[b]
        raw, where = [], []
        for k, w in zip(WIDTHS, net.filters):
            span = WINDOW - k + 1
            r = sum((e[:, j : j + span].reshape(-1, EMBED) @ w[j]).reshape(len(b), span, FILTERS) for j in range(k))
            where.append(r.argmax(axis=1))
            raw.append(np.take_along_axis(r, where[-1][:, None], axis=1)[:, 0])
        h = np.concatenate(raw, axis=1) + net.bias
        act = np.maximum(h, 0)
        d = net.probabilities(act)
        d[np.arange(len(b)), y[at]] -= 1
        d /= len(b)
        back = (d @ net.dense.T) * (h > 0)
        g_embed, g_filters, lo = np.zeros_like(net.embed), [], 0
        for k, w, pos in zip(WIDTHS, net.filters, where):
            gk, g_w = back[:, lo : lo + FILTERS], np.zeros_like(w)
            for j in range(k):
                byte = np.take_along_axis(b, pos + j, axis=1)
                g_w[j] = np.einsum("nfe,nf->ef", net.embed[byte], gk)
                np.add.at(g_embed, byte, gk[:, :, None] * w[j].T[None])
            g_filters.append(g_w)
            lo += FILTERS
        grads = [g_embed, *g_filters, back.sum(axis=0), act.T @ d, d.sum(axis=0)]
        rate = 0.02 * (1 - 0.95 * step / steps)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.embed, net.filters = net.embed.astype(np.float32), [w.astype(np.float32) for w in net.filters]
    return net


def train(docs: DataFrame, folds: int = 3, held: int = 1, windows: int = WINDOWS_A_LANGUAGE) -> ByteNet | None:
    """A net of all languages of the rows whose id fold is not `held`, from about `windows` windows of
    each, any windows of their texts (ALL_WINDOWS over all languages); None without any."""
    rows = docs.where(F.col("lang").isNotNull() & (id_fold("doc_id", folds) != held)).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("seed"), whole_text().alias("text"))
    counts = rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).where("n > 0").collect()
    if not counts:
        return None
    limit = max(1, min(windows, ALL_WINDOWS // len(counts)))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, limit / r.n)) for r in counts], "lang string, share double")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_in):
            seed, part = batch.column(1).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            for block in blocks(batch.column(2)):
                w, doc, _ = windows_of(block)
                nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
                drawn = mix64(seed[block.row + doc] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
                take = drawn.astype(np.float64) * 2.0**-53 < part[block.row + doc]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.row + doc[take])), pa.array([x.tobytes() for x in w[take]], pa.binary())], ["lang", "w"])

    got = rows.join(F.broadcast(share), "lang").select("lang", "seed", "text", "share").mapInArrow(run, "lang string, w binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "w"], kind="stable")  # the same net whatever the order of arrival
    languages = sorted(set(got["lang"]))
    y = np.searchsorted(np.array(languages), got["lang"].to_numpy(str))
    return train_net(np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW), y, languages)


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    A null text, or one without a letter, is `und` with score 0, as are all texts where no language
    can be learned; repeated or null ids give a row each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net and [[t.astype(np.float32) for t in parts] for parts in net.pair_tables()]
        for batch in batches(rows):
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for block in blocks(batch.column(3), 500_000) if net else ():
                w, doc, length = windows_of(block)
                if not len(w):
                    continue
                p = np.concatenate([net.probabilities(net.responses(w[i : i + 256], tables)) for i in range(0, len(w), 256)])
                total = np.zeros((len(block), p.shape[1]))
                some = np.unique(doc)
                total[some] = np.add.reduceat(p * length[:, None], np.searchsorted(doc, some))
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                at = slice(block.row, block.row + len(block))
                best[at], score[at] = total.argmax(axis=1), total.max(axis=1)
            best[~letters], score[~letters] = -1, 0
            names = np.array([*(net.languages if net else []), UNKNOWN], dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_fold("doc_id", folds) == held).alias("held_out"), whole_text().rlike(r"\p{L}").alias("letters"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
