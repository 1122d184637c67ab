"""Toxicity: two class-conditional Kneser-Ney bigram models over shared backoff counts.

Spark counts the word pairs of the labelled training documents by class; a start stands before the
first word.  Each class has an interpolated bigram model: discounted counts of the pair, then how many
different words a word follows, and below that one distribution that both classes share (in how many
classes a word occurs), so that an expression too rare to judge weighs the same on both sides.  All
pairs count and keep their mass, however rare; a class's discounts for pairs met once, twice and more
often come from its own counts of counts.  The sample is bounded in words, and so are the tables.

A document's two log-likelihoods are compared, normalised by its length.  Beside that stand the sums in
which an expression said less often than a limit is judged by its last word.  A logistic curve, fitted on labelled
documents that the counts never saw, turns all into a probability; the limit and the ridge are those
which foretell best there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_texts, id_fold, labelled_sample, stored, whole_text
from .textblocks import Places, Tokens, blocks, mix64, sum_by, tokenize

PER_CLASS = 8_000
WORDS_A_CLASS = 1 << 20
WORD_DISCOUNT = 0.75
STRONG = (3.0, 1.5)
LIMITS = (1, 3, 6, 12, 24, 48)
PLAIN = 3
FEATURES = 2 + 2 * len(STRONG)
RIDGES = (1.0, 10.0, 100.0)
REJECT_AT = 0.7
START = np.uint64(0x5AD0)


def _pairs_of(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word after the word before it (a start before the first), and the latter."""
    before = np.empty_like(t.hash)
    before[1:] = t.hash[:-1]
    before[t.bounds[:-1][np.diff(t.bounds) > 0]] = START
    return mix64(before * np.uint64(3) + mix64(t.hash)), before


def count_pairs(sample: DataFrame) -> DataFrame:
    """(g, h, w, n0, n1): how often the word w follows h in the texts of each class (text, y)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(0)):
                t = tokenize(block)
                pair, before = _pairs_of(t)
                y = label[block.row + t.doc]
                u, first, of = np.unique(pair, return_index=True, return_inverse=True)
                n = [np.bincount(of, y == c, len(u)).astype(np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, before[first], t.hash[first], *n)], ["g", "h", "w", "n0", "n1"])

    rows = sample.select("text", "y").mapInArrow(run, "g long, h long, w long, n0 long, n1 long")
    return rows.groupBy("g").agg(F.min("h").alias("h"), F.min("w").alias("w"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass
class Comparison:
    """Log-likelihood ratios, toxic over ordinary: of pairs that were counted, else of the word plus
    that of backing off from the word before it.  A pair's level is how many of LIMITS its counts in both
    classes reach."""

    words: np.ndarray
    word_ratio: np.ndarray
    unseen_ratio: float
    before: np.ndarray
    backoff_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    pair_level: np.ndarray
    weights: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float = 0.5
    limit: int | None = None

    def places(self) -> tuple[Places, Places, Places]:
        if not hasattr(self, "_places"):
            self._places = tuple(Places(k) for k in (self.words, self.before, self.pairs))
        return self._places

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def ratios(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The log-ratio of every word after the word before it, that of the word alone, the pair's level
        (0: not counted), and which words were counted."""
        words, befores, pairs = self.places()
        pair, before = _pairs_of(t)
        at, known = words.find(t.hash)
        lower = np.full(len(t.hash), self.unseen_ratio)
        lower[known] = self.word_ratio[at[known]]
        back, has = befores.find(before)
        place, paired = pairs.find(pair)
        ratio, level = lower.copy(), np.zeros(len(t.hash), np.int64)
        ratio[has] += self.backoff_ratio[back[has]]
        ratio[paired], level[paired] = self.pair_ratio[place[paired]], self.pair_level[place[paired]]
        return ratio, lower, level, known

    def features(self, t: Tokens) -> np.ndarray:
        """Of each document: mean ratio of all pairs, log length, share of unseen words; and under the
        limit (under each, where none is chosen yet) mean ratio, ratio over the root of the length, and
        the evidence of strong expressions, by length and in all."""
        ratio, lower, level, known = self.ratios(t)
        n = np.diff(t.bounds)
        m = np.maximum(n, 1)
        out = [sum_by(ratio, t.bounds) / m, np.log1p(n), sum_by(~known, t.bounds) / m]
        for k in range(1, len(LIMITS) + 1) if self.limit is None else [self.limit]:
            judged = np.where(level >= k, ratio, lower)
            total = sum_by(judged, t.bounds)
            out += [total / m, total / np.sqrt(m)]
            for strong in STRONG:
                beyond = sum_by(np.maximum(judged - strong, 0), t.bounds)
                out += [beyond / m, np.log1p(beyond)]
        return np.column_stack(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.constant)
        x = (features - self.scale[0]) / self.scale[1]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def _sorted_columns(rows: DataFrame, key: str, value: Column, level: Column | None = None) -> list[np.ndarray]:
    got = rows.select(key, value.cast("float").alias("v"), *([] if level is None else [level.cast("byte").alias("l")])).toArrow()
    keys = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return [keys[order], *(got.column(i).to_numpy()[order] for i in range(1, got.num_columns))]


def own_discounts(n1: int, n2: int, n3: int, n4: int, usual: float = WORD_DISCOUNT) -> tuple[float, float, float]:
    """The discounts of modified Kneser-Ney smoothing for pairs met once, twice and more often, from how
    many pairs are met one to four times; the usual one where a count of counts is missing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    of = [k - (k + 1) * y * above / here if y and here and above else usual for k, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1), k - 0.05) for k, d in enumerate(of, 1))


def pair_discounts(pairs: DataFrame) -> list[tuple[float, float, float]]:
    """Each class's discounts, from its own counts of counts."""
    got = pairs.agg(*(F.count(F.when(F.col(f"n{y}") == k, 1)) for y in (0, 1) for k in range(1, 5))).first()
    return [own_discounts(*got[4 * y : 4 * y + 4]) for y in (0, 1)]


def compare(pairs: DataFrame, discounts: list[tuple[float, float, float]] | None = None, word_discount: float = WORD_DISCOUNT) -> Comparison:
    """Kneser-Ney models of both classes from the counts of pairs, as tables of their log-ratios."""
    discounts = pair_discounts(pairs) if discounts is None else discounts
    each = lambda name, f: [f(y).alias(f"{name}{y}") for y in (0, 1)]
    seen = lambda y: F.sum((F.col(f"n{y}") > 0).cast("long"))

    def taken(y: int) -> Column:
        n, d = F.col(f"n{y}"), discounts[y]
        return F.when(n <= 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])

    histories = stored(pairs.groupBy("h").agg(*each("s", lambda y: F.sum(f"n{y}")), *each("d", lambda y: F.sum(taken(y)))), "tox-histories")
    words = stored(pairs.groupBy("w").agg(*each("k", seen)), "tox-words")
    known = lambda y: (F.col(f"k{y}") > 0).cast("long")
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("k0"), F.col("k1"), known(0), known(1)))).first()
    places = total[2] + total[3] + 1  # one is left for all words that neither class has
    spare = [word_discount * total[2 + y] / total[y] if total[y] else 1.0 for y in (0, 1)]
    unseen = float(np.log(spare[1] / spare[0]))
    lowest = (known(0) + known(1)) / F.lit(float(places))
    word_p = [F.greatest(F.col(f"k{y}") - word_discount, F.lit(0.0)) / float(max(total[y], 1)) + spare[y] * lowest for y in (0, 1)]
    back = [F.when(F.col(f"s{y}") > 0, F.col(f"d{y}") / F.col(f"s{y}")).otherwise(1.0) for y in (0, 1)]
    both = pairs.join(histories, "h").join(words, "w")
    pair_p = [F.when(F.col(f"s{y}") > 0, (F.col(f"n{y}") - taken(y)) / F.col(f"s{y}")).otherwise(0.0) + back[y] * word_p[y] for y in (0, 1)]
    said = F.col("n0") + F.col("n1")
    level = sum((F.when(said >= e, 1).otherwise(0) for e in LIMITS), F.lit(0))
    return Comparison(
        *_sorted_columns(words, "w", F.log(word_p[1] / word_p[0])), unseen,
        *_sorted_columns(histories, "h", F.log(back[1] / back[0])), *_sorted_columns(both, "g", F.log(pair_p[1] / pair_p[0]), level),
    )


def _map_features(docs: DataFrame, model: Comparison, keep: list[str], schema: str, finish) -> DataFrame:
    """Rows of `keep` columns and what finish(model, features) gives for the text in the last column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            f = np.concatenate([shared.value.features(tokenize(b)) for b in blocks(batch.column(len(keep)))])
            more = finish(shared.value, f)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more.values()], [*keep, *more])

    return docs.select(*keep, whole_text().alias("text")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a weighted logistic curve with an intercept; a single class gives a constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def foretold(x: np.ndarray, y: np.ndarray, ridge: float) -> float:
    """The loss of logistic curves on a quarter of the rows each, fitted on the others."""
    part, out = np.arange(len(y)) % 4, 0.0
    for k in range(4):
        w = fit_logistic(x[part != k], y[part != k], np.ones((part != k).sum()), ridge)
        z = x[part == k] @ w[:-1] + w[-1]
        out += np.logaddexp(0, np.where(y[part == k] == 1, -z, z)).sum()
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class: int = PER_CLASS, words_a_class: int = WORDS_A_CLASS) -> Comparison:
    """The models and the curve, from labelled documents whose id fold is not `held`: at most
    `per_class` of a class and 1.5 times the smaller class, with at most `words_a_class` words."""
    sample = stored(labelled_sample(docs, labels, "toxic", id_fold("doc_id", folds) != held, per_class, 1.5), "tox-sample")
    sample = stored(bounded_texts(sample, F.size(F.split("text", r"[ \t\n\x0b\f\r]+")), words_a_class), "tox-bounded")
    sample = sample.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0)
    model = compare(stored(count_pairs(sample.where(~F.col("calibrate"))), "tox-pairs"))

    def finish(model: Comparison, f: np.ndarray) -> dict[str, pa.Array]:
        return {f"f{i}": pa.array(f[:, i]) for i in range(f.shape[1])}

    width = PLAIN + FEATURES * len(LIMITS)
    got = _map_features(sample.where("calibrate"), model, ["doc_id", "y"], "doc_id long, y int, " + ", ".join(f"f{i} double" for i in range(width)), finish).toPandas().sort_values(["doc_id", "f0"])
    x, y = got[[f"f{i}" for i in range(width)]].to_numpy(), got["y"].to_numpy(float)
    if len(set(y)) == 2:
        scale = np.array([x.mean(axis=0), x.std(axis=0) + 1e-9])
        z = (x - scale[0]) / scale[1]
        of = lambda k: np.r_[:PLAIN, PLAIN + FEATURES * (k - 1) : PLAIN + FEATURES * k]
        tried = [(foretold(z[:, of(k)], y, r), k, r) for k in range(1, len(LIMITS) + 1) for r in RIDGES]
        _, model.limit, ridge = min(tried)
        model.scale = scale[:, of(model.limit)]
        model.weights = fit_logistic(z[:, of(model.limit)], y, np.ones(len(y)), ridge)
    else:
        count = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
        model.limit = 1
        model.constant = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts are scored as texts without words; repeated or null ids give a row each;
    where the labels leave only one class to calibrate on, all scores are its smoothed share; other
    columns are ignored."""
    model = train(docs, labels, folds, held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_fold("doc_id", folds) == held).alias("held_out"))
    return _map_features(rows, model, ["doc_id", "held_out"], "doc_id long, held_out boolean, score double, predicted int", _decide)


def _decide(model: Comparison, f: np.ndarray) -> dict[str, pa.Array]:
    score = model.score(f)
    return {"score": pa.array(score), "predicted": pa.array((score >= REJECT_AT).astype(np.int32))}


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected as toxic.

    Null and empty texts are judged as texts without words; repeated rows meet the same fate; an empty
    table stays empty."""
    model = train(docs, labels, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            text = batch.column(batch.schema.get_field_index("text"))
            f = np.concatenate([shared.value.features(tokenize(b)) for b in blocks(text)])
            yield batch.filter(pa.array(shared.value.score(f) < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)
