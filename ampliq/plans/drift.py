"""Snapshot drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import records as R
from ..session import cut_to_parquet
from . import shapes as X
from .registry import query
from .sites import _CALLS

_FRESH = _CALLS + """, base_sha AS (SELECT DISTINCT sha256(seq) AS sha FROM subjects WHERE doc_id % 10 < 8),
fresh AS (SELECT doc_id, sha256(seq) AS sha, CASE WHEN grp = 'en' THEN 'target' ELSE 'off_target' END AS role FROM subjects s
  WHERE doc_id % 10 >= 1 AND NOT EXISTS (SELECT 1 FROM base_sha b WHERE b.sha = sha256(s.seq)))"""


def fresh_records(spark, folder):
    rows = X.subjects(spark, folder).withColumn("sequence_sha256", F.sha2("seq", 256)).withColumn(
        "role", F.when(F.col("grp") == "en", "target").otherwise("off_target"))
    # Two overlapping corpus versions, as two dated releases of one source are.
    return D.new_records(rows.filter("doc_id % 10 < 8"), rows.filter("doc_id % 10 >= 1"))


def _kept(spark, folder):
    """New records, worked out once for all that reads them."""
    return cut_to_parquet(fresh_records(spark, folder).select("doc_id", "seq", "sequence_sha256", "role"))


def _scan(spark, folder, fresh):
    return D.scan_assays(X.assays(spark, folder), fresh, assay="item_id", record="doc_id", min_product=20, max_len=30)


@query("new_snapshot_records", f"WITH {_FRESH} SELECT role, count(*)::BIGINT AS n, count(DISTINCT sha)::BIGINT AS sequences FROM fresh GROUP BY 1")
def new_snapshot_records(spark, folder):
    return fresh_records(spark, folder).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("sequence_sha256").alias("sequences"))


_COUNTS = _FRESH + """, c AS (SELECT item_id, count(*) FILTER (role = 'target') AS t, count(*) FILTER (role = 'target' AND has_probe AND ident < 85) AS lp,
  count(*) FILTER (role = 'off_target' AND (NOT has_probe OR ident >= 85)) AS os FROM calls JOIN fresh USING (doc_id) GROUP BY 1),
dc AS (SELECT a.item_id, (SELECT count(*) FROM fresh WHERE role = 'target') AS nt, (SELECT count(*) FROM fresh WHERE role = 'off_target') AS no, (SELECT count(*) FROM subjects WHERE grp = 'en' AND doc_id % 10 >= 1) AS cur, coalesce(t, 0) AS t, coalesce(lp, 0) AS lp, coalesce(os, 0) AS os FROM assays a LEFT JOIN c USING (item_id))"""


@query("drift_states", f"""WITH {_COUNTS} SELECT item_id, nt::BIGINT AS n_target, no::BIGINT AS n_off, (nt - t)::BIGINT AS lost_product, lp::BIGINT AS lost_probe, os::BIGINT AS off_signal,
  CASE WHEN cur = 0 THEN 'Evidence insufficient' WHEN os > 0 THEN 'Possible signal-generating off-target' WHEN nt - t > 0 OR lp > 0 THEN 'Possible target dropout' WHEN nt + no > 0 THEN 'Stable with new variation' ELSE 'Stable' END AS state FROM dc""")
def drift_states(spark, folder):
    fresh = _kept(spark, folder)
    out = D.drift_counts(X.assays(spark, folder), fresh, _scan(spark, folder, fresh), assay="item_id", record="doc_id")
    current = X.subjects(spark, folder).filter("grp = 'en' and doc_id % 10 >= 1").agg(F.count("*").alias("n_current"))
    out = out.crossJoin(current)  # one row
    # The scan reads both versions whole, so it is complete; additions on either side are new variation.
    state = R.drift_state(F.lit(True), F.col("n_current"), F.col("off_signal") > 0, (F.col("lost_product") > 0) | (F.col("lost_probe") > 0), F.col("n_target") + F.col("n_off"))
    return out.withColumn("state", state).drop("n_current")


@query("vulnerability_records", f"""WITH {_FRESH}, r AS (SELECT item_id, f.doc_id, sha, CASE WHEN role = 'target' AND c.doc_id IS NULL THEN 'new_target_lost_coherent_product'
  WHEN role = 'target' AND has_probe AND ident < 85 THEN 'new_target_lost_probe_recognition'
  WHEN role = 'off_target' AND c.doc_id IS NOT NULL AND (NOT has_probe OR ident >= 85) THEN 'new_signal_generating_off_target' END AS code
  FROM fresh f CROSS JOIN assays a LEFT JOIN calls c USING (item_id, doc_id)), k AS (
  SELECT DISTINCT item_id, code, sha, sha256('scan-1|' || item_id || '|' || code || '|' || sha) AS fp FROM r WHERE code IS NOT NULL)
SELECT item_id, code, 'VR-2026-' || upper(left(fp, 12)) AS record_id FROM k""")
def vulnerability_records(spark, folder):
    fresh = _kept(spark, folder)
    reasons = D.drift_reasons(X.assays(spark, folder), fresh, _scan(spark, folder, fresh), assay="item_id", record="doc_id")
    return D.vulnerability_records(reasons, assay="item_id", scan_id="scan-1", year=2026).select("item_id", "code", "record_id")
