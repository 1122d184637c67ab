"""Mixing to target weights: soft domain membership and nonnegative document rates.

All of it is DataFrame work.  A multinomial word model, counted on a bounded sample of each
domain of a labelled table, gives every document a probability for each domain (with a temperature fitted on labelled
documents that the counts left out).  The rates x >= 0 minimise the squared distance of the expected
domain totals sum_i x_i n_i p_i to the target totals by accelerated projected gradient steps from
x = 1.  Rates are measured in the metric of the token counts and totals in the metric in which the
gradient map has norm 1 (residuals are whitened by the domains' Gram matrix), so the step size is 1
and a few steps are enough; each is one aggregate over the documents, and what the driver holds is
one number a domain and step.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, whole_text

SAMPLE = 12_000
SPARE = 16
BROADCAST_IDS = 1 << 20
VOCABULARY = 4_000
SMOOTH = 0.5
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64)
STEPS = 30
KEPT = 5
ROUNDS = 10
NEARER = 0.9
STILL = 10
CLOSE = 1e-4
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else low or high quality; unlabelled rows go, one row an id."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    rows = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
    return rows.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _words(text: str | Column = "text") -> Column:
    """Lower-cased words, and one empty word that stands for the document itself."""
    return F.concat(F.filter(F.split(F.lower(whole_text(text)), r"[ \t\n\x0b\f\r]+"), lambda w: w != ""), F.array(F.lit("")))


@dataclass
class Membership:
    domains: list[str]
    weights: DataFrame
    prior: list[float]
    temperature: float = 1.0
    bounded: bool = True

    def sums(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Word weights summed over the texts of rows, one row for each of the keys."""
        words = rows.select(*keys, _words().alias("words"))
        words = words.select(*keys, (F.size("words") - 1).cast("long").alias("n_tokens"), F.explode("words").alias("word"))
        hit = words.join(F.broadcast(self.weights) if self.bounded else self.weights, "word")
        return hit.groupBy(*keys, "n_tokens").agg(*(F.sum(f"w{d}").alias(f"s{d}") for d in range(len(self.domains))))

    def posterior(self, temperature: float) -> list[Column]:
        """The probability of each domain from the sums; they add up to 1."""
        z = [F.lit(p) + F.col(f"s{d}") / temperature for d, p in enumerate(self.prior)]
        top = F.greatest(*z) if len(z) > 1 else z[0]
        e = [F.exp(x - top) for x in z]
        total = sum(e[1:], e[0])
        return [x / total for x in e]


def learn_membership(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, vocabulary: int | None = VOCABULARY) -> Membership | None:
    """The word model from about `sample` labelled documents of each domain (all, where there are no
    more), of the `vocabulary` commonest words, which are broadcast, or (None) of all their words, which
    are joined; the domains and their prior are those of all labels that have a document.  None where no
    document has a label."""
    have = labelled.select("doc_id", "domain").join(docs.select("doc_id"), "doc_id", "left_semi")
    have = stored(have, "mix-known")
    known = {r.domain: r.n for r in have.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not known:
        return None
    domains = sorted(known)
    sizes = docs.sparkSession.createDataFrame([(d, min(sample / n, 1.0), max(n / sample, 1.0), n < SPARE) for d, n in known.items()], "domain string, share double, stands_for double, few boolean")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
    ids = have.join(F.broadcast(sizes), "domain").where(drawn)
    ids = F.broadcast(ids) if len(domains) * sample <= BROADCAST_IDS else ids
    rows = docs.select("doc_id", "text").join(ids, "doc_id")
    rows = rows.withColumn("fit", F.col("few") | (F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) > 0))
    words = rows.where("fit").select("domain", F.explode(_words()).alias("word"))
    counts = stored(words.groupBy("domain", "word").agg(F.count("*").alias("c")), "mix-counts")
    n_of = lambda d: F.sum(F.when(F.col("domain") == d, F.col("c")).otherwise(0))
    table = counts.where("word <> ''").groupBy("word").agg(F.sum("c").alias("c"), *(n_of(d).alias(f"c{i}") for i, d in enumerate(domains)))
    table = stored(table if vocabulary is None else table.orderBy(F.desc("c"), "word").limit(vocabulary), "mix-words")
    totals = table.agg(F.count("*"), *(F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(len(domains)))).first()
    weights = table.select("word", *(F.log((F.col(f"c{i}") + SMOOTH) / (totals[i + 1] + SMOOTH * totals[0])).alias(f"w{i}") for i in range(len(domains))))
    own = docs.sparkSession.createDataFrame([("",)], "word string").select("word", *(F.lit(0.0).alias(f"w{i}") for i in range(len(domains))))
    all_ids = sum(known.values())
    model = Membership(domains, stored(weights.unionByName(own), "mix-weights"), [float(np.log(known[d] / all_ids)) for d in domains], bounded=vocabulary is not None)
    held = stored(model.sums(rows.where("not fit").withColumn("rid", F.monotonically_increasing_id()), ["rid", "domain", "stands_for"]), "mix-held")
    losses = []
    for t in TEMPERATURES:
        right = F.coalesce(*(F.when(F.col("domain") == d, p) for d, p in zip(domains, model.posterior(t))), F.lit(0.0))
        losses.append(F.sum(-F.log(F.greatest(right, F.lit(1e-12))) * F.col("stands_for")) / F.sum("stands_for"))
    loss = held.agg(*losses).first()
    if loss[0] is not None:
        model.temperature = float(min(zip(loss, TEMPERATURES))[1])
    return model


def _moved(state: DataFrame, steps: list[list[float]], domains: int) -> DataFrame:
    """The state after further steps: x and y of each row, by its posteriors; the next gradient is taken at y.
    Plain columns, so that a step is a few instructions of generated code."""
    for *g, momentum in steps:
        down = sum((F.col(f"p{d}") * g[d] for d in range(1, domains)), F.col("p0") * g[0])
        state = state.withColumns({"x": F.greatest(F.col("y") - down, F.lit(0.0)), "w": F.col("x")})
        state = state.withColumn("y", F.col("x") + momentum * (F.col("x") - F.col("w")))
    return state.drop("w")


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> DataFrame:
    """members(n_tokens, p array) with the rate of each row.

    Targets of domains that have no labelled document are left out and the others rescaled, with a
    warning; a known domain without a target has target 0.  Where the rows stand is stored every KEPT
    steps, so that a pass goes over no more steps than that.  Steps are taken until the totals are
    within CLOSE of the targets.  Where STILL steps move no total by CLOSE (targets that no rates reach), a
    round of STEPS comes no tenth nearer, or ROUNDS are over, a warning says by how much they are missed."""
    k = len(domains)
    lost = sorted(d for d, t in targets.items() if t > 0 and d not in domains)
    if lost:
        warnings.warn(f"mixing: no labelled document of {', '.join(lost)}; the other targets are rescaled", RuntimeWarning, stacklevel=2)
    want = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total or not want.sum():
        return members.withColumn("rate", F.lit(1.0))
    want = want / want.sum()
    gram = members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[a] * F.col("p")[b]) for a in range(k) for b in range(k))).first()
    whiten = np.linalg.pinv(np.array(gram, float).reshape(k, k) / total, rcond=1e-6, hermitian=True)
    kept = members.columns
    parts = [f"p{d}" for d in range(k)]
    state = members.withColumns({c: F.col("p")[d] for d, c in enumerate(parts)} | {"x": F.lit(1.0), "y": F.lit(1.0)})
    kept_state = None
    steps: list[list[float]] = []  # those that the state has not taken yet
    taken = 0
    seen: list[np.ndarray] = []
    momentum, before, last, rounds = 1.0, np.inf, np.inf, 0
    while True:
        rows = _moved(state.select("n_tokens", *parts, "x", "y"), steps, k)
        got = rows.agg(*(F.sum(F.col("n_tokens") * F.col(c) * F.col(v)) for v in ("y", "x") for c in parts)).first()
        at_y, at_x = np.array(got[:k], float) / total, np.array(got[k:], float) / total
        off = np.abs(at_x - want).max()
        if off < CLOSE:
            break
        seen.append(at_x)
        if len(seen) > STILL and np.abs(at_x - np.array(seen[-STILL - 1 : -1])).max() < CLOSE:  # the nearest there is
            warnings.warn(f"mixing: the totals miss the targets by up to {off:.2g} and come no nearer: " + ", ".join(f"{d} {a:.4f} for {w:.4f}" for d, a, w in zip(domains, at_x, want)), RuntimeWarning, stacklevel=2)
            break
        if taken == STEPS:  # a round is over
            rounds, nearer, last, taken = rounds + 1, off < NEARER * last, off, 0
            if not nearer or rounds == ROUNDS:
                warnings.warn(f"mixing: after {rounds * STEPS} steps the totals miss the targets by up to {off:.2g}: " + ", ".join(f"{d} {a:.4f} for {w:.4f}" for d, a, w in zip(domains, at_x, want)), RuntimeWarning, stacklevel=2)
                break
        if len(steps) == KEPT:
            before_it, kept_state = kept_state, stored(_moved(state, steps, k), "mix-rates")
            state, steps = kept_state, []
            if before_it is not None:
                discard(before_it)
        miss = float((at_y - want) @ whiten @ (at_y - want))
        if miss > before:  # overshot: begin the acceleration anew
            momentum = 1.0
        before = miss
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        steps.append([*(whiten @ (at_y - want)).tolist(), (momentum - 1) / following])
        taken += 1
        momentum = following
    return _moved(state, steps, k).select(*kept, F.col("x").alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, vocabulary: int | None = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, domain, p, rate, copies) of every row of docs.

    `domain` is the likeliest, `p` the probabilities in the order of `domains`, `copies` the whole
    number that the rate comes to (its rest by a hash of the id).  Null and empty texts have 0 tokens
    and the prior as p; repeated or null ids give a row each; without labels every rate is 1."""
    targets = TARGETS if targets is None else targets
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.monotonically_increasing_id())
    model = learn_membership(docs, labelled, vocabulary=vocabulary)
    if model is None:
        out = rows.select("doc_id", (F.size(_words()) - 1).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    else:
        p = model.posterior(model.temperature)
        members = stored(model.sums(rows, ["rid", "doc_id"]).select("rid", "doc_id", "n_tokens", F.array(*p).alias("p")), "mix-members")
        best = F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("p", F.array_max("p")).cast("int"))
        out = fit_rates(members, model.domains, targets).select("doc_id", "n_tokens", best.alias("domain"), "p", "rate")
    rest = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn("copies", (F.floor("rate") + (rest < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
