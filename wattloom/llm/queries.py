"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import common

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that they need no path of the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, data = Path(__file__).resolve().parents[2], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted((root / "wattloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    path = Path(tempfile.mkdtemp(prefix="wattloom-")) / "wattloom.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.text_clips(_documents(spark, sf_dir))


def clips_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of every document that is stored as an AVI file."""
    from . import media

    return media.avi_clips(media.text_files(_documents(spark, sf_dir)), "doc_id", "media")


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score_documents(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score_toxicity(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contaminated(_documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.duplicate_classes(_documents(spark, sf_dir))


def op6_shape_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find_pii(_documents(spark, sf_dir))


def op7_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.remove_repeats(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_documents(spark, sf_dir), mixing.label_domains(common.table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.score_quality(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(_documents(spark, sf_dir))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: base phrases and labels of the licence notices in its whole text."""
    from . import licences

    return licences.scan(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every sound vector of `embeddings` and component."""
    from . import whitening

    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every source, order of the five filters and step."""
    from . import audit

    return audit.audit_filters(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


def _shipping(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    ordered = [*sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0])), clips_of_documents]
    return {f.__name__: partial(_shipping, f) for f in ordered}


#: op13 without masks or transforms: every order's steps over the documents by what they fail.
_AUDIT = r"""WITH texts AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t FROM documents),
facts AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, MIN(doc_id) OVER (PARTITION BY t) AS least FROM texts),
fails AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, COALESCE(least < doc_id, least IS NOT NULL) AS e FROM facts),
known AS (SELECT doc_id, BOOL_OR(quality = 1) AS good, BOOL_OR(toxic = 1) AS toxic FROM labels GROUP BY 1),
kinds AS (SELECT part, a, b, c, d, e, COUNT(*) AS n, COUNT(*) FILTER (WHERE good) AS n_good, COUNT(*) FILTER (WHERE toxic) AS n_toxic
  FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
  JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) AS s(step)),
judged AS (SELECT part, filter_order, step, f, n, n_good, n_toxic, CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS hit,
  (a AND contains(earlier, 'A')) OR (b AND contains(earlier, 'B')) OR (c AND contains(earlier, 'C')) OR (d AND contains(earlier, 'D')) OR (e AND contains(earlier, 'E')) AS gone,
  a::INT + b::INT + c::INT + d::INT + e::INT AS n_hits FROM kinds, steps),
rows AS (SELECT part, filter_order, step, f, SUM(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, SUM(n) FILTER (WHERE hit AND NOT gone) AS removed, SUM(n) FILTER (WHERE hit AND gone) AS redundant,
  SUM(n) FILTER (WHERE hit AND n_hits = 1) AS unique_fails, SUM(n_good) FILTER (WHERE hit AND NOT gone) AS good_lost, SUM(n_toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost FROM judged GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, COALESCE(kept, 0)::BIGINT AS kept, COALESCE(removed, 0)::BIGINT AS removed, COALESCE(redundant, 0)::BIGINT AS redundant, COALESCE(unique_fails, 0)::BIGINT AS unique_fails,
  COALESCE(good_lost, 0)::BIGINT AS good_lost, COALESCE(toxic_lost, 0)::BIGINT AS toxic_lost, SUM(COALESCE(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley, f AS filter FROM rows"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no rows that DuckDB SQL gives on whole tables; the tests hold them
    against brute force, exact round trips or held-out accuracy."""
    return {"op13_filter_audit": _AUDIT}
