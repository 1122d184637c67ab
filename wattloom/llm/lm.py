"""Language-model scoring: a log-bilinear model over words, trained with noise-contrastive estimation,
with the unigram base beside it.

Spark counts every token of the training documents.  The DICTIONARY commonest words have a context
vector each, the HEAD commonest ones also an output of their own; words are grouped by their endings,
and what has no output of its own is the rest of its group, drawn within it by its smoothed count, so
that probabilities add up to one over all words.

The context of a token is the sum of the vectors of the POSITIONS tokens before it, each through the
matrix of its position.  An output's probability is that of its group times its own within the group,
both normalised by batched matrix products.  The documents are dealt to shards of about SHARD_TOKENS
by a hash; each shard takes steps over all its tokens from the shared start, in an order of its own,
against sampled noise groups and the noise of each group's outputs.  Spark adds up what the shards
learned, weighted by how often they met it, and the next round begins from the mean.  So the model
depends on the rows alone, not on how they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, batches, id_fold, stored, whole_text
from .textblocks import Places, Tokens, blocks, mix64, sum_by, tokenize

HEAD = 1 << 11
GROUPS = 128
DICTIONARY = 1 << 17
DIM = 16
POSITIONS = 3
NOISE = 24
ROUNDS = 1
FIRST_STEP = 512
STEP_TOKENS = 2048
BATCH = 1024
BLOCK = 500_000
SHARD_TOKENS = 1 << 22
SHARD_TASKS = 1 << 14
RATE = 0.18
RUN_COST = 3000  # of a product's call, in numbers of a table
END_HASH = -1


def word_group(tokens: Tokens) -> np.ndarray:
    """The group of each token, by its last two bytes."""
    last = tokens.low[tokens.end - 1].astype(np.uint64)
    before = tokens.low[np.maximum(tokens.end - 2, tokens.start)].astype(np.uint64)
    return (mix64(last * np.uint64(256) + before) % np.uint64(GROUPS)).astype(np.int64)


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, grp, c): how often each token fingerprint occurs; grp is its group."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            h, c, grp = [np.array([END_HASH])], [np.array([batch.num_rows])], [np.array([0])]
            for block in blocks(batch.column(0)):
                t = tokenize(block)
                u, first, n = np.unique(t.hash.view(np.int64), return_index=True, return_counts=True)
                h.append(u)
                c.append(n)
                grp.append(word_group(t)[first])
            u, first, at = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
            total = np.bincount(at, np.concatenate(c)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.concatenate(grp)[first].astype(np.int32)), pa.array(total)], ["h", "grp", "c"])

    rows = docs.select(whole_text().alias("text")).mapInArrow(run, "h long, grp int, c long")
    return rows.groupBy("h").agg(F.min("grp").alias("grp"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The commonest words (at most DICTIONARY): fingerprint, count, group and output.  The outputs lie
    by group, first[g] ... first[g + 1], the last of a group being its rest; the end is one of group
    0.  And what all words' probabilities need: totals over the corpus and over the rest of each group."""

    hash: np.ndarray
    count: np.ndarray
    output: np.ndarray
    first: np.ndarray
    output_count: np.ndarray
    end: int
    tokens: int
    types: int
    rest_tokens: np.ndarray
    rest_types: np.ndarray
    rare_below: int
    end_count: int = 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words, and which of them are there."""
        if not hasattr(self, "_places"):
            self._places = Places(self.hash.view(np.uint64))
        return self._places.find(h.view(np.uint64))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def outputs(self, t: Tokens, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = self.first[word_group(t) + 1] - 1
        out[known] = self.output[at[known]]
        return out

    @property
    def is_rest(self) -> np.ndarray:
        out = np.zeros(len(self.output_count), bool)
        out[self.first[1:] - 1] = True
        return out

    @property
    def group_of(self) -> np.ndarray:
        return np.repeat(np.arange(GROUPS), np.diff(self.first))

    @property
    def base_floor(self) -> float:
        return np.log10(self.tokens + 0.1 * (self.types + 1))


def lexicon(counts: DataFrame) -> Lexicon:
    """The dictionary from the counts of tokens; of equal counts at its border, the least hashes."""
    words = counts.where(F.col("h") != END_HASH)
    least = at_most(words, "c", DICTIONARY)
    top = words.where(F.col("c") >= least).select("h", "c", "grp").toPandas()
    if least > 1 and len(top) < DICTIONARY:
        tied = words.where(F.col("c") == least - 1).select("h", "c", "grp").orderBy("h").limit(DICTIONARY - len(top)).toPandas()
        top = pd.concat([top, tied])
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    h, c, grp = (top[k].to_numpy(np.int64)[order] for k in ("h", "c", "grp"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end_count = int(counts.where(F.col("h") == END_HASH).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    heads = np.lexsort((h, -c))[:HEAD]
    heads = heads[np.lexsort((-c[heads], grp[heads]))]
    n, v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in words.groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r.grp], v[r.grp] = r.n, r.v
    own = np.bincount(grp[heads], minlength=GROUPS)
    n, v = n - np.bincount(grp[heads], c[heads], GROUPS), v - own
    size = own + 1
    size[0] += 1  # the end, before the others of its group
    first = np.concatenate([[0], np.cumsum(size)])
    nth = np.arange(len(heads)) - np.repeat(np.cumsum(own) - own, own)
    output = first[grp + 1] - 1
    output[heads] = first[grp[heads]] + nth + (grp[heads] == 0)
    output_count = np.zeros(first[-1])
    output_count[output[heads]] = c[heads]
    output_count[first[1:] - 1] = n
    output_count[0] = end_count
    return Lexicon(h, c, output, first, output_count, 0, int(total[0]), int(total[1]), n, v, least, end_count)


@dataclass
class Sequence:
    """Every token of a block and the end of every document, with one end before all: the word (its
    place in the dictionary, or what stands for a group's other words or the end), output, document,
    and the places of the tokens before it."""

    word: np.ndarray
    output: np.ndarray
    doc: np.ndarray
    before: list[np.ndarray]


def sequence(t: Tokens, lex: Lexicon, at: np.ndarray, known: np.ndarray) -> Sequence:
    """Positions before a document's first token are its end."""
    docs, words = len(t.bounds) - 1, len(lex.hash)
    n = len(t.hash) + docs + 1
    ends = np.concatenate([[0], t.bounds[1:] + np.arange(docs) + 1])
    plain = np.ones(n, bool)
    plain[ends] = False
    word, output = np.full(n, words + GROUPS), np.full(n, lex.end)
    word[plain] = np.where(known, at, words + word_group(t))
    output[plain] = lex.outputs(t, at, known)
    doc = np.concatenate([[-1], np.repeat(np.arange(docs), np.diff(t.bounds) + 1)])
    start = np.concatenate([[0], ends[:-1]])[doc + 1] if docs else np.zeros(1, np.int64)
    start[doc >= 0] = ends[doc[doc >= 0]]
    place = np.arange(n)
    return Sequence(word, output, doc, [np.maximum(place - k, start) for k in range(1, POSITIONS + 1)])


@dataclass
class LogBilinear:
    """Context vectors of words (with those of the other words of each group, and the end), a matrix
    for each position, and vectors and biases of groups and outputs."""

    word: np.ndarray
    position: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def context(self, s: Sequence) -> np.ndarray:
        """The predicted vector of every place of the sequence but the first."""
        e, position = self.word.take(s.word, axis=0), self.position.reshape(-1, DIM)
        out = np.empty((len(e) - 1, DIM), e.dtype)
        for lo in range(0, len(out), BATCH):
            out[lo : lo + BATCH] = _seen(e, [b[lo + 1 : lo + 1 + BATCH] for b in s.before]) @ position
        return out

    def log_probabilities(self, r: np.ndarray, output: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-probability of each output after its context r, normalised over all outputs."""
        group = np.repeat(np.arange(GROUPS, dtype=np.uint8), np.diff(first))[output]
        reach = np.sqrt(np.einsum("ij,ij->i", r, r).max(initial=0))
        small_group, small_output = _bound(reach, self.group, self.group_bias) < 79, _bound(reach, self.output, self.output_bias) < 79
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(GROUPS + 1, dtype=np.uint8)).tolist()
        both, nth = _with_one(r.take(order, axis=0)), (output - first[group]).take(order)
        groups, outputs = np.column_stack([self.group, self.group_bias]), np.column_stack([self.output, self.output_bias])
        log_p = np.empty(len(r))
        for g in range(GROUPS):
            table = outputs[first[g] : first[g + 1]]
            for lo in range(cut[g], cut[g + 1], BATCH):
                at = slice(lo, min(lo + BATCH, cut[g + 1]))
                z = both[at] @ groups.T
                own = z[:, g].copy()
                log_p[at] = own - _log_sum(z, small_group)
                if len(table) > 1:
                    z = both[at] @ table.T
                    own = z[np.arange(len(z)), nth[at]]
                    log_p[at] += own - _log_sum(z, small_output)
        out = np.empty(len(r))
        out[order] = log_p
        return out


def _seen(e: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """The vectors at the places before, side by side."""
    return e.take(np.stack(before, axis=1).reshape(-1), axis=0).reshape(len(before[0]), -1)


def _with_one(r: np.ndarray) -> np.ndarray:
    """Rows with a one at their end, which a product multiplies by the bias."""
    out = np.ones((len(r), r.shape[1] + 1), r.dtype)
    out[:, :-1] = r
    return out


def _bound(reach: float, vectors: np.ndarray, bias: np.ndarray) -> float:
    """What no score of these vectors exceeds, either way, for contexts no longer than `reach`."""
    return reach * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()) + np.abs(bias).max()


def _log_sum(z: np.ndarray, small: bool = False) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials, written over z; rows are shifted where they
    could leave the range of numbers, unless they are known to be small."""
    top = np.zeros(1, z.dtype)
    if not small and max(z.max(), -z.min()) > 80:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], z.dtype)) + top


def start_model(lex: Lexicon, seed: int = 1) -> LogBilinear:
    """Contexts that say nothing yet: the groups' and outputs' shares."""
    rng = np.random.default_rng(seed)
    f = np.float32
    share = lex.output_count + 0.5
    in_group = np.add.reduceat(share, lex.first[:-1])
    return LogBilinear(
        np.zeros((len(lex.hash) + GROUPS + 1, DIM), f), np.stack([np.eye(DIM) / (k + 1) for k in range(POSITIONS)]).astype(f),
        rng.normal(0, 0.3, (GROUPS, DIM)).astype(f), np.log(in_group / in_group.sum()).astype(f),
        rng.normal(0, 0.3, (len(share), DIM)).astype(f), np.log(share / in_group[lex.group_of]).astype(f),
    )


def _sum_rows(ids: np.ndarray, values: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and the sums of their rows; slot has a place for every id, whatever is in it."""
    place = np.arange(len(ids))
    slot[ids] = place
    last = slot[ids]  # one row of each id
    chosen, rest = np.flatnonzero(last == place), np.flatnonzero(last != place)
    slot[ids[chosen]] = np.arange(len(chosen))
    out = values.take(chosen, axis=0)
    pair = values.shape[1] // 2  # numbers are added in pairs, as complex ones: half as many places
    at = (slot[ids[rest]] * pair)[:, None] + np.arange(pair)
    np.add.at(out.view(np.complex64).reshape(-1), at.reshape(-1), values.take(rest, axis=0).view(np.complex64).reshape(-1))
    return ids[chosen], out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), written over x: of scores with their signs turned."""
    with np.errstate(over="ignore"):  # what is small comes to 0
        np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _runs(first: np.ndarray, share: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring groups (from, to) whose tables are multiplied as one: a product of many small tables
    takes less time than the products, though what lies outside a token's own group is cleared.
    The least expected cost of a step; groups without a choice of outputs are left out."""
    begin, met = first.tolist(), np.concatenate([[0], np.cumsum(share)]).tolist()
    cost, back = [0.0], []
    for to in range(1, len(begin)):
        lone = begin[to] - begin[to - 1] < 2
        ways = [(cost[at] + (0 if lone and at == to - 1 else RUN_COST + STEP_TOKENS * (met[to] - met[at]) * (begin[to] - begin[at])), at) for at in range(to)]
        cost.append(min(ways)[0])
        back.append(min(ways)[1])
    out, to = [], len(back)
    while to:
        at = back[to - 1]
        if begin[to] - begin[at] > to - at:
            out.append((at, to))
        to = at
    return out[::-1]


class Trainer:
    """NCE steps over sequences, from a model that stays as it is; AdaGrad rates."""

    def __init__(self, model: LogBilinear, lex: Lexicon, seed: int = 1):
        self.model = LogBilinear(*(x.copy() for x in (model.word, model.position, model.group, model.group_bias, model.output, model.output_bias)))
        self.first, self.group_of, self.rng = lex.first, lex.group_of.astype(np.uint8), np.random.default_rng(seed)
        start = start_model(lex)  # its shares are the noise
        group_noise = np.exp(start.group_bias.astype(float))
        m = self.model
        # signs are turned, as _sigmoid takes them
        self.group_shift = (np.log(NOISE * group_noise) - m.group_bias).astype(np.float32)
        self.drawn = np.cumsum(group_noise / group_noise.sum())
        self.output_weight = (NOISE * np.exp(start.output_bias)).astype(np.float32)[:, None]
        self.output_shift = (np.log(NOISE) + start.output_bias - m.output_bias).astype(np.float32)[:, None]
        self.runs = _runs(self.first, group_noise / group_noise.sum())
        self.width, self.run_first = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for k, to in self.runs:
            self.width[k:to], self.run_first[k:to] = self.first[to] - self.first[k], self.first[k]
        self.has_choice = np.diff(self.first) > 1
        self.slot = np.zeros(len(m.word), np.int64)
        self.met = np.zeros(len(model.word), np.int64)
        self.output_met = np.zeros(len(model.output), np.int64)
        self.seen = {id(x): np.full(len(x), 1.0, np.float32) for x in (m.word, m.position, m.group, m.output)}
        self.tokens = 0

    def move(self, table: np.ndarray, ids: np.ndarray | slice, gradient: np.ndarray) -> None:
        seen = self.seen[id(table)]
        flat = gradient.reshape(len(gradient), -1)
        now = seen[ids] + np.einsum("ij,ij->i", flat, flat) / np.float32(flat.shape[1])
        seen[ids] = now
        rate = RATE / np.sqrt(now)
        change = rate.reshape(-1, *[1] * (gradient.ndim - 1)) * gradient
        if isinstance(ids, slice):
            table[ids] -= change
        else:  # faster than table[ids] -= change
            table[ids] = np.subtract(table.take(ids, axis=0), change, out=change)

    def step(self, s: Sequence, lo: int, hi: int) -> None:
        """One step over the places lo ... hi of a sequence."""
        m, n = self.model, hi - lo
        base = max(lo - POSITIONS, 0)
        word = s.word[base:hi]
        e = m.word.take(word, axis=0)
        before = [np.maximum(b[lo:hi] - base, 0) for b in s.before]
        seen, position = _seen(e, before), m.position.reshape(-1, DIM)
        r = seen @ position
        group = self.group_of[s.output[lo:hi]]
        order = np.argsort(group, kind="stable")
        both = _with_one(r.take(order, axis=0))
        r_in, y, g = both[:, :DIM], s.output[lo:hi][order], group[order]
        cut = np.searchsorted(g, np.arange(GROUPS + 1, dtype=np.uint8))
        # groups against shared noise groups
        noise = np.searchsorted(self.drawn, self.rng.random(NOISE)).clip(0, GROUPS - 1)
        own_group, noise_group = m.group.take(g, axis=0), m.group[noise]
        hit = _sigmoid(self.group_shift[g] - np.einsum("ij,ij->i", r_in, own_group)) - 1
        false = _sigmoid(both @ np.column_stack([-noise_group, self.group_shift[noise]]).T)
        back = np.multiply(own_group, hit[:, None], out=own_group)
        back += false @ noise_group
        is_noise = (np.arange(GROUPS)[:, None] == noise).astype(np.float32)
        d_group = is_noise @ (false.T @ r_in)
        met = np.flatnonzero(np.diff(cut))
        d_group[met] += np.add.reduceat(r_in * hit[:, None], cut[met], axis=0)
        # outputs against the noise of their own group, in expectation: the runs' tables, one after the other
        turned, weighted = np.column_stack([-m.output, self.output_shift]), m.output * self.output_weight
        d_output, d_in = np.zeros_like(m.output), np.zeros_like(back)
        row = np.concatenate([[0], np.cumsum(self.width[g])])
        flat = np.empty(row[-1], np.float32)
        first, cuts, rows = self.first.tolist(), cut.tolist(), row[cut].tolist()
        tables = []
        for k, last in self.runs:
            at, to, a, b = cuts[k], cuts[last], first[k], first[last]
            if at < to:
                d = flat[rows[k] : rows[last]].reshape(to - at, b - a)
                np.matmul(both[at:to], turned[a:b].T, out=d)
                tables.append((k, last, at, to, a, b, d))
        _sigmoid(flat)
        for k, last, at, _, a, b, d in tables:
            for i in range(k, last) if last - k > 1 else ():
                if cuts[i] < cuts[i + 1]:
                    own_rows = d[cuts[i] - at : cuts[i + 1] - at]
                    own_rows[:, : first[i] - a] = 0
                    own_rows[:, first[i + 1] - a if first[i + 1] - first[i] > 1 else first[i] - a :] = 0
        chosen = np.flatnonzero(self.has_choice[g])
        own = row[chosen] + y[chosen] - self.run_first[g[chosen]]
        hit = flat[own]
        flat[own] += (hit - 1) / self.output_weight[y[chosen], 0]  # all are weighted below
        for _, _, at, to, a, b, d in tables:
            np.matmul(d, weighted[a:b], out=d_in[at:to])
            np.matmul(d.T, r_in[at:to], out=d_output[a:b])
        d_output *= self.output_weight
        back += d_in
        d_r = np.empty_like(back)
        d_r[order] = back
        scale = np.float32(1 / np.sqrt(n))
        d_position = (seen.T @ d_r).reshape(m.position.shape)
        moved = d_r @ position.T
        d_word = np.zeros_like(e)
        for k, b in enumerate(before):  # a step back, but for the beginnings of documents
            part, at = moved[:, k * DIM : (k + 1) * DIM], lo - k - 1 - base
            odd = np.flatnonzero(b != np.arange(at, at + n))
            np.add.at(d_word, b[odd], part[odd])
            part[odd] = 0
            skip = max(-at, 0)
            d_word[at + skip : at + n] += part[skip:]
        self.move(m.word, *_sum_rows(word, d_word, self.slot))
        self.move(m.position, slice(None), d_position * scale)
        self.move(m.group, slice(None), d_group * scale)
        self.move(m.output, slice(None), d_output * scale)
        np.add.at(self.met, word, 1)
        self.output_met += np.bincount(y, minlength=len(self.output_met))
        self.tokens += n

    def take(self, s: Sequence) -> None:
        """Steps over a whole sequence: short ones at a shard's beginning, up to STEP_TOKENS later."""
        lo = 1
        while lo < len(s.word):
            hi = min(lo + min(max(self.tokens // 256, FIRST_STEP), STEP_TOKENS), len(s.word))
            self.step(s, lo, hi)
            lo = hi

    def learned(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, rows, weights, vectors) of what was met: how much each shard's rows count."""
        m = self.model
        words, outputs = np.flatnonzero(self.met), np.flatnonzero(self.output_met)
        whole = np.full(1, self.tokens, np.int64)
        yield 0, words, self.met[words], m.word[words]
        yield 1, np.arange(POSITIONS * DIM), whole.repeat(POSITIONS * DIM), m.position.reshape(-1, DIM)
        yield 2, np.arange(GROUPS), whole.repeat(GROUPS), m.group
        yield 3, outputs, self.output_met[outputs], m.output[outputs]


def in_shards(docs: DataFrame, tokens: int) -> DataFrame:
    """(shard, text): the rows of docs in shards of about SHARD_TOKENS, by a hash of id and text, each
    shard in one task and in the order of another hash; a task has several shards only where there
    are more than SHARD_TASKS."""
    n = max(-(-tokens // SHARD_TOKENS), 1)
    tasks = min(n, SHARD_TASKS)
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    rows = docs.select(
        F.pmod(F.xxhash64(*key, F.lit("shard")), F.lit(n)).alias("shard"), F.xxhash64(*key, F.lit("order")).alias("nth"), whole_text().alias("text")
    )
    rows = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return rows.sortWithinPartitions("shard", "nth", "text").select("shard", "text")


def train_round(docs: DataFrame, lex: Lexicon, model: LogBilinear) -> LogBilinear:
    """The mean of what the shards learn from their documents, each starting from `model`."""
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def parts(trainer: Trainer) -> Iterator[pa.RecordBatch]:
        for kind, ids, weight, vectors in trainer.learned():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * DIM, pa.int32()), pa.array((vectors * weight[:, None]).astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int32)), pa.array(weight), lists], ["kind", "id", "n", "v"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        trainer, now = None, None
        for batch in batches(rows):
            shard = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(shard)]):
                if trainer is None or shard[lo] != now:
                    if trainer is not None:
                        yield from parts(trainer)
                    trainer, now = Trainer(model, lex, int(shard[lo]) + 1), shard[lo]
                for block in blocks(batch.column(1).slice(lo, hi - lo), BLOCK):
                    t = tokenize(block)
                    trainer.take(sequence(t, lex, *lex.find(t.hash.view(np.int64))))
        if trainer is not None:
            yield from parts(trainer)

    rows = in_shards(docs, lex.tokens).mapInArrow(run, "kind int, id int, n long, v array<double>")
    mean = rows.groupBy("kind", "id").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)))
    got = mean.select("kind", "id", *((F.col(f"v{i}") / F.col("n")).cast("float").alias(f"v{i}") for i in range(DIM))).toArrow()
    kind, ids = got.column(0).to_numpy(), got.column(1).to_numpy()
    vectors = np.stack([got.column(i + 2).to_numpy() for i in range(DIM)], axis=1) if len(kind) else np.zeros((0, DIM), np.float32)
    new = LogBilinear(*(x.copy() for x in (model.word, model.position.reshape(-1, DIM), model.group, model.group_bias, model.output, model.output_bias)))
    for k, table in enumerate((new.word, new.position, new.group, new.output)):
        table[ids[kind == k]] = vectors[kind == k]
    new.position = new.position.reshape(POSITIONS, DIM, DIM)
    return new


SCORED = "rid long, h long, tf long, doc struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"


def _map_scores(docs: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """A row for each document with what the dictionary gives, and a row for each of its words that
    the dictionary lacks (their counts are still to be joined)."""
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))
    fields = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        within = np.log10(lex.rest_tokens + 0.1 * (lex.rest_types + 1))
        own, is_rest, group_of = np.log10(lex.count + 0.1), lex.is_rest, lex.group_of
        rid = TaskContext.get().partitionId() << 40
        end_known = lex.tokens > 0
        for batch in batches(rows):
            ids, held = batch.column(0).cast(pa.int64()), batch.column(1)
            for block in blocks(batch.column(2), BLOCK):
                t = tokenize(block)
                n = len(block)
                h = t.hash.view(np.int64)
                at, known = lex.find(h)
                s = sequence(t, lex, at, known)
                log_p = model.log_probabilities(model.context(s), s.output[1:], lex.first) / np.log(10)
                score = np.bincount(s.doc[1:], log_p, n)
                inside = np.zeros(len(h))
                inside[known] = own[at[known]]
                outputs = lex.outputs(t, at, known)
                rest = is_rest[outputs]
                rest_part = np.zeros(len(h))
                rest_part[rest] = inside[rest] - within[group_of[outputs[rest]]]
                score += sum_by(rest_part, t.bounds)
                base = sum_by(inside, t.bounds) + np.log10(lex.end_count + 0.1) - (np.diff(t.bounds) + 1) * lex.base_floor
                n_known = sum_by(known, t.bounds) + end_known
                doc_rows = pa.StructArray.from_arrays(
                    [ids.slice(block.row, n), held.slice(block.row, n), *(pa.array(x) for x in (np.diff(t.bounds) + 1, n_known, base, score))], fields=list(fields)
                )
                own_rid = rid + np.arange(n)
                rid += n
                yield pa.RecordBatch.from_arrays([pa.array(own_rid), pa.array(mix64(own_rid.astype(np.uint64)).view(np.int64)), pa.nulls(n, pa.int64()), doc_rows], ["rid", "h", "tf", "doc"])
                rare = ~known
                if rare.any():
                    order = np.lexsort((h[rare], t.doc[rare]))
                    rh, rd = h[rare][order], t.doc[rare][order]
                    new = np.ones(len(rh), bool)
                    new[1:] = (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])
                    first = np.flatnonzero(new)
                    tf = np.diff(np.append(first, len(rh)))
                    yield pa.RecordBatch.from_arrays([pa.array(own_rid[rd[first]]), pa.array(rh[first]), pa.array(tf), pa.nulls(len(first), fields)], ["rid", "h", "tf", "doc"])

    return docs.select("doc_id", "held_out", whole_text().alias("text")).mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Unigram base and log-bilinear scores (log10) of every whole text.

    Learns from the documents whose id fold is not 0.  Null and empty texts are one end token;
    repeated or null ids give a row each; with no training document all words are unknown; other
    columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_fold("doc_id", folds) == 0).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = stored(token_counts(train), "lm-counts")
    lex = lexicon(counts)
    model = start_model(lex)
    for _ in range(ROUNDS):
        model = train_round(train, lex, model)
    rare = counts.where(F.col("c") < lex.rare_below).select("h", "c")
    joined = _map_scores(rows, lex, model).join(rare, "h", "left")
    is_word = F.col("tf").isNotNull()
    part = F.when(is_word, F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).otherwise(0.0)
    sums = joined.groupBy("rid").agg(F.max("doc").alias("doc"), F.sum(part).alias("part"), F.sum(F.when(is_word & F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    return sums.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.n_known") + F.col("more")).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("doc.base") + F.col("part")).alias("base_score"), (F.col("doc.score") + F.col("part")).alias("score"),
    )
