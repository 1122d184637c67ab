"""Operator 13: filter interaction audit by a subset-zeta transform.

Every document has a mask of the filters that it fails.  Documents are counted by part and mask, and
the zeta transform turns the 2^k counts of a part into the number of documents whose failures lie
within any set of filters, so the survivors of every filter subset are known at once: those whose
failures lie within the complement.  A step of an order is the difference between two neighbouring
subsets, for all documents and for those with a label alike, and the Shapley sums are differences
weighted by how many orders have a subset in front.

Only (id, part, mask, digest) leaves the texts; counts are combined in the map tasks, so copies in
any number and hot parts shrink before each shuffle.  All work is DataFrame functions.

Odd input: a null text is empty, a null part is the empty text, a null id comes after all others
(so its copies of a known text are redundant, and nulls among themselves are not); repeated rows are
documents of their own, and none of them has the smaller id; labels that repeat an id count when any
says 1; labels of unknown or null ids count nowhere; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, words, distinct_words, upper, points, symbols) of every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"),
        (F.length("t") - F.length(F.translate("t", UPPER, ""))).alias("upper"), F.length("t").alias("points"), F.col("t").rlike(r"[#$%&*|]").alias("symbols"),
    )


#: The filters of the audit that a text decides: letter to failure condition over text_facts.
FILTERS: dict[str, Column | str] = {
    "A": "words < 200",
    "B": "100L * distinct_words < 50L * words",
    "C": "100L * upper > 2L * points",
    "D": "symbols",
}


def _bit(i: int) -> int:
    return 1 << i


def failure_counts(facts: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the filters that they fail, bit i the i-th of
    `filters`, and the highest bit for texts that a smaller id has, anywhere in the table."""
    copy = _bit(len(filters))
    bits = [F.when(F.expr(f), F.lit(_bit(i))).otherwise(F.lit(0)) for i, f in enumerate(filters.values())]
    # a null id meets no label; its digest spreads such rows over the tasks of the join
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.xxhash64("digest")).alias("id")]
    rows = facts.select("doc_id", *key, "part", "digest", reduce(lambda a, b: a + b, bits).alias("mask"))
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.join(known.withColumn("no_id", F.lit(False)), ["no_id", "id"], "left")
    rows = rows.select("doc_id", "no_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*kind, "no_id", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct("no_id", "doc_id", "n"))
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), first.alias("least"))
    kinds = kinds.withColumn("table_least", F.min(F.struct("least.no_id", "least.doc_id")).over(Window.partitionBy("digest")))
    own = F.struct("least.no_id", "least.doc_id").eqNullSafe(F.col("table_least"))
    originals = F.when(own, F.col("least.n")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - originals).alias("n")))
    parted = kinds.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return parted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def zeta(counts: Column, k: int) -> Column:
    """Of an array of 2^k counts by mask: for every set, the sum over the masks that lie within it."""
    def step(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(sums, i - bit)).otherwise(F.lit(0)))

    return F.aggregate(F.array(*(F.lit(_bit(i)) for i in range(k))), counts, step)


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """A row for every part, order of the filters and step, from failure_counts; filter i is
    letters[i].  (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, filter)"""
    k = len(letters)
    full = _bit(k) - 1
    names = {"n": "g", "n_good": "gg", "n_toxic": "gt"}
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names))))  # 2^k cells at most
    table = counts.groupBy("part").agg(cells.alias("cells"))
    by_mask = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.element_at(F.col("cells"), m)[c], F.lit(0).cast("long")))
    table = table.select("part", *(by_mask(c).alias(n) for c, n in names.items()))
    table = table.select("part", *(zeta(F.col(n), k).alias(n) for n in names.values()))
    table = table.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))))
    table = table.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    mask_of = lambda test: reduce(lambda a, b: a + b, (F.when(test(F.instr("filter_order", x)), F.lit(_bit(i))).otherwise(F.lit(0)) for i, x in enumerate(letters)))
    table = table.withColumns({"before": mask_of(lambda at: at < F.col("step")), "own": mask_of(lambda at: at == F.col("step"))})

    def within(sums: str, mask: Column) -> Column:
        return F.get(F.col(sums), mask)

    def lost(sums: str, before: Column) -> Column:
        """Survivors of `before` less those of it and the own filter."""
        return within(sums, F.lit(full) - before) - within(sums, F.lit(full) - before - F.col("own"))

    orders = F.array(*(F.lit(factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1")) if bin(s).count("1") < k else 0) for s in range(full + 1)))
    apart = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(apart, F.lit(0).cast("long"), lambda total, s: total + F.get(orders, s) * lost("g", s))
    removed, fails = lost("g", F.col("before")), within("g", F.lit(full)) - within("g", F.lit(full) - F.col("own"))
    return table.select(
        "part", "filter_order", "step", within("g", F.lit(full) - F.col("before") - F.col("own")).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (within("g", F.col("own")) - within("g", F.lit(0))).alias("unique_fails"), lost("gg", F.col("before")).alias("good_lost"), lost("gt", F.col("before")).alias("toxic_lost"),
        shapley.alias("shapley"), F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters on every part of the documents (doc_id, text, source) with the
    labels (doc_id, quality, toxic)."""
    return audit_orders(failure_counts(text_facts(docs), labels), "".join(FILTERS) + "E")
