"""Training-data pipeline over `documents`: each stage works on all rows that the one before kept.

Toxic documents go, one document of each near-duplicate class stays, documents that hold benchmark
items go, personal data is replaced in the texts, and the rest get rates that bring the expected
tokens of the quality domains to their target weights.  All stages but the last return the columns
of documents; the last returns (doc_id, n_tokens, domain, p, rate, copies).

Every stage takes null, empty and very long texts, repeated rows, null ids, extra columns and empty
tables: a null text stays null and is handled as an empty one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import common, decontaminate, mixing, neardup, pii, toxicity
from wattloom.llm.queries import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; repeated rows meet the same fate.  Where the labels
    know one class only, all documents have its share as their score."""
    ship(spark)
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id (one of equal rows, null
    ids last).  Null and empty texts are one class; other texts without words are alike only if equal."""
    ship(spark)
    return neardup.drop_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go; null, empty and short items condemn
    none."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes [EMAIL], [IP], [CARD] or [PHONE]; all rows stay, of which
    n_chars is counted anew."""
    ship(spark)
    return pii.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of the documents under the target weights of the quality domains; a row for
    each row.  Texts without words have the prior as p; without labels every rate is 1."""
    return mixing.mix(docs, mixing.label_domains(common.table(spark, sf_dir, "labels")), WEIGHTS)


#: Target shares of the expected tokens; what is left of a domain without a share gets rate 0.
WEIGHTS = {"high": 0.9, "low": 0.1}


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("mixing", mix_domains),
]

#: The stages train models and hash texts, which SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents; rows as the
    last stage gives them, none for an empty table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
