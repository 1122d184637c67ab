"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A unit is a word or a word's shape: upper case, marks, digits, and whether it repeats the word before.
The LEXICON commonest words of the labelled training sample are units of their own, all others share
WORDS units by hash.  Every unit has a fixed sparse index vector; its context vector
is the sum of the index vectors beside it over all documents, which Spark adds up in whole numbers.
A document is the mean of its words' and of its shapes' normalised vectors.  The network is trained
on a bounded sample of labelled documents; a temperature, fitted on other labelled documents, and
the class shares make its outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_fold, labelled_sample, one_label, stored, whole_text
from .textblocks import Block, Places, Tokens, blocks, mix64, tokenize

LEXICON = 8192
WORDS = 4096
SHAPES = 288
UNITS = LEXICON + WORDS + SHAPES
DIM = 32
HIDDEN = 16
PER_CLASS = 6_000
ACCEPT_AT = 0.3

_unit = mix64(np.arange(UNITS, dtype=np.uint64) + np.uint64(77))
INDEX = np.stack([_unit % np.uint64(DIM), (_unit >> np.uint64(20)) % np.uint64(DIM)]).astype(np.int64)
SIGN = np.stack([1 - 2 * ((_unit >> np.uint64(k)) & np.uint64(1)).astype(np.int64) for k in (40, 41)]).astype(float)

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.int32)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1


def units(block: Block, lexicon: Places) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Word and shape units of the tokens of a block."""
    t = tokenize(block)
    counts = []
    for kind in (_UPPER, _DIGIT, _MARK):
        total = np.concatenate([[0], np.cumsum(kind[block.data])])
        counts.append(total[t.end] - total[t.start])
    upper, digit, mark = counts
    other = t.end - t.start - upper - digit - mark
    again = np.zeros(len(t.hash), np.int64)
    again[1:] = (t.hash[1:] == t.hash[:-1]) & (t.doc[1:] == t.doc[:-1])
    shape = np.minimum(upper, 2) + 3 * np.minimum(mark, 3) + 12 * np.minimum(digit, 2) + 36 * (other > 0) + 72 * (other > 12) + 144 * again
    at, known = lexicon.find(t.hash)
    return t, np.where(known, at, LEXICON + (t.hash % np.uint64(WORDS)).astype(np.int64)), LEXICON + WORDS + shape


def common_words(sample: DataFrame, limit: int = LEXICON) -> np.ndarray:
    """The sorted fingerprints of the commonest words of the texts (ties by fingerprint)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for block in blocks(batch.column(0)):
                h, n = np.unique(tokenize(block).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = sample.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(limit).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def context_vectors(docs: DataFrame, lexicon: np.ndarray) -> np.ndarray:
    """The normalised context vector of every unit over all documents, UNITS x DIM."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Places(shared.value)
        total = np.zeros(UNITS * DIM)
        for batch in batches(rows):
            for block in blocks(batch.column(0)):
                t, word, shape = units(block, words)
                beside = np.flatnonzero(t.doc[1:] == t.doc[:-1])
                for a, b in ((word, word), (word, shape), (shape, shape)):
                    for i, j in ((0, 1), (1, 0)):
                        of, near = a[beside + i] * DIM, b[beside + j]
                        for k in (0, 1):
                            total += np.bincount(of + INDEX[k][near], SIGN[k][near], UNITS * DIM)
        used = np.flatnonzero(np.abs(total.reshape(UNITS, DIM)).sum(axis=1))
        flat = total.reshape(UNITS, DIM)[used].astype(np.int64)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * DIM, pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), vectors], ["unit", "v"])

    rows = docs.select(whole_text().alias("text")).mapInArrow(run, "unit int, v array<long>")
    got = rows.groupBy("unit").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM))).toPandas()
    out = np.zeros((UNITS, DIM))
    if len(got):
        out[got["unit"].to_numpy()] = got.drop(columns="unit").to_numpy(float)
    for k in (0, 1):  # a unit's own index vector keeps units of like contexts apart
        np.add.at(out, (np.arange(UNITS), INDEX[k]), SIGN[k] * np.linalg.norm(out, axis=1) * 0.5)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(block: Block, vectors: np.ndarray, lexicon: Places) -> np.ndarray:
    """Document vectors: mean of the words', mean of the shapes', log length."""
    t, word, shape = units(block, lexicon)
    n = len(block)
    counts = np.diff(t.bounds)
    out = np.zeros((n, 2 * DIM + 1))
    for i, u in enumerate((word, shape)):
        pairs, times = np.unique(t.doc * UNITS + u, return_counts=True)
        of = pairs // UNITS
        weighted = vectors[pairs % UNITS] * times[:, None]
        some = np.flatnonzero(np.bincount(of, minlength=n))
        if len(some):
            out[some, i * DIM : (i + 1) * DIM] = np.add.reduceat(weighted, np.searchsorted(of, some))
    out[:, :-1] /= np.maximum(counts, 1)[:, None]
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    """tanh layer and an output; the logit is divided by the temperature and shifted to the classes'
    shares."""

    lexicon: np.ndarray
    vectors: np.ndarray
    weights: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    temperature: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.shift, -35, 35)))


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 1, steps: int = 1500) -> list[np.ndarray]:
    """Adam on batches drawn with both classes alike."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    of = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(i, 64) for i in of if len(i)])
        a, t = x[at], y[at]
        hidden = np.tanh(a @ w[0] + w[1])
        d = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -35, 35))) - t) / len(at)
        back = d[:, None] * w[2] * (1 - hidden**2)
        grads = [a.T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.01 * (1 - 0.9 * step / steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Network:
    learn = id_fold("doc_id", folds) != held
    sample = stored(labelled_sample(docs, labels, "quality", learn, per_class), "quality-sample")
    sample = sample.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0)
    lexicon = common_words(sample.where(~F.col("calibrate")))
    vectors = context_vectors(docs, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, vectors))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = Places(shared.value[0]), shared.value[1]
        for batch in batches(rows):
            x = np.concatenate([pooled(b, vectors, words) for b in blocks(batch.column(2))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["y", "calibrate", "x"])

    got = sample.select("y", "calibrate", "text").mapInArrow(run, "y int, calibrate boolean, x array<double>").toPandas()
    width = 2 * DIM + 1
    x, y, hold = np.array(got["x"].tolist()).reshape(-1, width), got["y"].to_numpy(float), got["calibrate"].to_numpy(bool)
    net = Network(lexicon, vectors, [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], np.zeros(width), np.ones(width))
    if not len(y):
        return net
    if hold.all():  # too few to keep some for the temperature
        hold = np.zeros(len(y), bool)
    net.mean, net.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    net.weights = train_network((x[~hold] - net.mean) / net.spread, y[~hold])
    shares = {r.y: r["count"] for r in one_label(labels, "quality").where(learn).groupBy("y").count().collect()}
    weight = {c: shares.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)}
    net.shift = float(np.log((weight[1] + 1e-9) / (weight[0] + 1e-9)))
    if len(set(y[hold])) == 2:
        z = net.logit(x[hold])
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        balance = np.concatenate([np.flatnonzero(y[hold] == c) for c in (0, 1)])
        net.temperature = float(min(grid, key=lambda k: _log_loss(z[balance] / k, y[hold][balance])))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts have the zero vector; repeated or null ids give a row each; without labels
    every score is the constant that the class shares give; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        words = Places(net.lexicon)
        for batch in batches(rows):
            score = np.concatenate([net.score(pooled(b, net.vectors, words)) for b in blocks(batch.column(2))])
            out = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= ACCEPT_AT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_fold("doc_id", folds) == held).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
