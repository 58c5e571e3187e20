"""Bench-record queries: feedback, votes, splits, validation plates, contracts, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators.corpus import keep_first
from ..session import table
from . import shapes as X
from .registry import query
from .sites import _CALLS, _calls

_FEEDBACK = """feedback AS (SELECT o_orderkey, o_custkey % 200 AS assay_id, o_custkey % 25 AS target_group,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, o_orderpriority AS run_id,
  80 + fmod(o_totalprice, 40) AS efficiency, 0.9::DOUBLE + (o_orderkey % 100) / 1000::DOUBLE AS r2, o_orderkey % 40 AS matrix FROM orders)"""


def feedback(spark, folder):
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("partial")
    return o.select("o_orderkey", (F.col("o_custkey") % 200).alias("assay_id"), (F.col("o_custkey") % 25).alias("target_group"),
                    status.alias("status"), F.col("o_orderpriority").alias("run_id"),
                    (80.0 + F.col("o_totalprice") % 40).alias("efficiency"), (0.9 + (F.col("o_orderkey") % 100) / 1000.0).alias("r2"), (F.col("o_orderkey") % 40).alias("matrix"))


@query("feedback_rejects", """SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_unknown'
  WHEN o_totalprice / 1000 > 300 THEN 'efficiency_out_of_range' ELSE 'assay_missing' END AS error, count(*)::BIGINT AS n
FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_totalprice / 1000 > 300 OR o_custkey % 9 = 0 GROUP BY 1""")
def feedback_rejects(spark, folder):
    o = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("other").alias("status"),
        (F.col("o_totalprice") / 1000).alias("efficiency"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("assay_id"))
    return (o.withColumn("error", R.feedback_error(o)).filter("error is not null").groupBy("error").agg(F.count("*").alias("n")))


@query("feedback_status", f"""WITH {_FEEDBACK}, u AS (SELECT assay_id, target_group, status, run_id, r2, count(*) AS copies FROM feedback GROUP BY ALL)
SELECT sum(copies)::BIGINT AS n_normalized, count(*)::BIGINT AS n_unique, sum(copies - 1)::BIGINT AS n_duplicates, count(*)::BIGINT AS n_labeled,
  count(*) FILTER (status = 'success')::BIGINT AS n_success, count(*) FILTER (status = 'failed')::BIGINT AS n_failed,
  count(*) FILTER (status = 'partial')::BIGINT AS n_partial, 0::BIGINT AS missing_group, 1.0::DOUBLE AS efficiency_complete, 0::BIGINT AS n_rejected FROM u""")
def feedback_status(spark, folder):
    return R.dataset_status(feedback(spark, folder), ["assay_id", "target_group", "status", "run_id", "r2"])


@query("outcome_conflicts", f"""WITH {_FEEDBACK} SELECT assay_id, run_id, string_agg(DISTINCT status, ',' ORDER BY status) AS outcomes FROM feedback
GROUP BY 1, 2 HAVING count(DISTINCT status) > 1""")
def outcome_conflicts(spark, folder):
    out = R.outcome_conflicts(feedback(spark, folder), ["assay_id", "run_id"])
    return out.withColumn("outcomes", F.array_join("outcomes", ","))


@query("assay_evidence", f"""WITH {_FEEDBACK}, g AS (SELECT assay_id, count(*) AS n_records, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'failed') AS f,
  count(DISTINCT (target_group, run_id)) AS ctx, median(efficiency) AS me, median(r2) AS mr FROM feedback GROUP BY 1)
SELECT assay_id, n_records::BIGINT AS n_records, s::BIGINT AS n_success, f::BIGINT AS n_failed, ctx::BIGINT AS n_contexts, round(me, 6) AS median_efficiency,
  round(mr, 6) AS median_r2, CASE WHEN s + f < 2 THEN 'insufficient_local_evidence' WHEN s > 0 AND f > 0 THEN 'mixed_local_evidence'
  WHEN s > 0 THEN 'consistent_local_success' ELSE 'consistent_local_failure' END AS evidence_state, round(CASE WHEN s + f > 0 THEN s / (s + f)::DOUBLE END, 6) AS success_fraction FROM g""")
def assay_evidence(spark, folder):
    out = R.assay_evidence(feedback(spark, folder), "assay_id", ["target_group", "run_id"])
    return out.select("assay_id", "n_records", "n_success", "n_failed", "n_contexts", F.round("median_efficiency", 6).alias("median_efficiency"),
                      F.round("median_r2", 6).alias("median_r2"), "evidence_state", F.round("success_fraction", 6).alias("success_fraction"))


@query("pairwise_assay_votes", f"""WITH {_FEEDBACK}, c AS (SELECT target_group, run_id, matrix, assay_id, min(status) AS o FROM feedback WHERE status IN ('success', 'failed')
  GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT status) = 1), v AS (SELECT least(w.assay_id, l.assay_id) AS a, greatest(w.assay_id, l.assay_id) AS b, w.assay_id AS w
  FROM c w JOIN c l ON w.target_group = l.target_group AND w.run_id = l.run_id AND w.matrix = l.matrix AND w.o = 'success' AND l.o = 'failed')
SELECT a, b, count(*)::BIGINT AS n_contexts, count(*) FILTER (w = a)::BIGINT AS for_a, count(DISTINCT w) > 1 AS conflict,
  CASE WHEN count(DISTINCT w) = 1 THEN min(w) END AS preferred FROM v GROUP BY 1, 2""")
def pairwise_assay_votes(spark, folder):
    return R.pairwise_votes(feedback(spark, folder), ["target_group", "run_id", "matrix"], "assay_id")


@query("calibration_gate", f"""WITH {_FEEDBACK}, g AS (SELECT count(*) AS n, count(DISTINCT target_group) AS k, count(*) FILTER (status = 'success') AS s,
  count(*) FILTER (status = 'failed') AS f FROM feedback), o AS (SELECT count(*) AS clash FROM (SELECT 1 FROM feedback GROUP BY assay_id, run_id HAVING count(DISTINCT status) > 1))
SELECT n::BIGINT AS n_labeled, k::BIGINT AS n_groups, s::BIGINT AS n_success, f::BIGINT AS n_failed, clash::BIGINT AS n_conflicts, 0::BIGINT AS n_rejected,
  round(least(s, f) / (s + f)::DOUBLE, 6) AS minority_fraction, concat_ws(',', CASE WHEN n < 100 THEN 'few_labeled' END, CASE WHEN k < 10 THEN 'few_groups' END,
  CASE WHEN least(s, f) < 25 THEN 'few_of_one_outcome' END, CASE WHEN least(s, f) / (s + f)::DOUBLE < 0.2 THEN 'imbalanced' END,
  CASE WHEN n > 0 THEN 'version_missing' END, CASE WHEN clash > 0 THEN 'conflicts' END) AS unmet FROM g, o""")
def calibration_gate(spark, folder):
    rows = feedback(spark, folder)
    out = R.calibration_gate(rows, rows.filter(R.feedback_error(rows).isNotNull()), R.outcome_conflicts(rows, ["assay_id", "run_id"]))
    return out.select("n_labeled", "n_groups", "n_success", "n_failed", "n_conflicts", "n_rejected", F.round("minority_fraction", 6).alias("minority_fraction"),
                      F.array_join("unmet", ",").alias("unmet"))


@query("group_safe_split", f"""WITH {_FEEDBACK}, s AS (SELECT target_group, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS dataset_split FROM (
  SELECT target_group, ('0x' || sha256(target_group::VARCHAR)[1:12])::BIGINT::DOUBLE / 281474976710656 AS u FROM feedback))
SELECT dataset_split, count(*)::BIGINT AS records, count(DISTINCT target_group)::BIGINT AS groups FROM s GROUP BY 1""")
def group_safe_split(spark, folder):
    return R.split_by_group(feedback(spark, folder), "target_group").groupBy("dataset_split").agg(
        F.count("*").alias("records"), F.countDistinct("target_group").alias("groups"))


@query("benchmark_corpus_checks", """WITH c AS (SELECT o_custkey AS case_id, o_orderpriority AS split, o_custkey % 25 AS grp FROM orders)
SELECT 'multiple_splits' AS problem, count(*)::BIGINT AS n FROM (SELECT case_id FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'group_leakage', count(*) FROM (SELECT grp FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'missing_split', count(*) FROM customer WHERE c_custkey NOT IN (SELECT case_id FROM c)
UNION ALL SELECT 'unknown_case', count(DISTINCT case_id) FROM c WHERE case_id NOT IN (SELECT c_custkey FROM customer)""")
def benchmark_corpus_checks(spark, folder):
    cases = table(spark, folder, "customer").select(F.col("c_custkey").alias("case_id"))
    splits = table(spark, folder, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("split"),
                                                   (F.col("o_custkey") % 25).alias("grp"))

    def several(key):
        return splits.groupBy(key).agg(F.countDistinct("split").alias("k")).filter("k > 1")

    parts = {"multiple_splits": several("case_id"), "group_leakage": several("grp"),
             "missing_split": cases.join(splits, "case_id", "left_anti"),
             "unknown_case": splits.join(cases, "case_id", "left_anti").select("case_id").distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("case_disagreements", f"""WITH {_CALLS}, st AS (SELECT doc_id, item_id, CASE WHEN has_probe AND ident < 85 THEN 'product_without_probe'
  WHEN has_probe THEN 'signal_product' ELSE 'product' END AS state FROM calls), k AS (SELECT doc_id, state, count(*) AS n FROM st GROUP BY 1, 2),
a AS (SELECT doc_id, sum(n) AS seen, count(*) AS kinds, sum(n * n) AS sq, (SELECT count(*) FROM assays) AS p FROM k GROUP BY 1)
SELECT doc_id, (kinds + CASE WHEN p > seen THEN 1 ELSE 0 END)::BIGINT AS n_states, ((p * p - sq - (p - seen) * (p - seen)) // 2)::BIGINT AS n_distinguished FROM a""")
def case_disagreements(spark, folder):
    calls = _calls(spark, folder)
    state = R.prediction_state(F.lit(True), F.col("probe").isNotNull(), F.col("probe_binds"))
    panel = X.assays(spark, folder).agg(F.count("*").alias("panel"))
    return R.case_disagreements(calls.select("doc_id", "item_id", state.alias("state")), "doc_id", "item_id", panel)


# Forty neighbouring parts are one plan: even keys its candidates, odd ones its cases.
_PLATE = """cands AS (SELECT p_partkey // 40 AS plan, p_partkey AS cand, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS ci,
  count(*) OVER (PARTITION BY p_partkey // 40) AS nc FROM part WHERE p_partkey % 2 = 0),
cases AS (SELECT p_partkey // 40 AS plan, 'case-' || p_partkey AS kase, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY 'case-' || p_partkey) - 1 AS si FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT plan, kase, cand, r AS replicate, ((ci - si - r + 1) % nc + nc) % nc AS turn, sha256('7|' || plan || '|' || kase || '|' || r) AS block
  FROM cases JOIN cands USING (plan), range(1, 4) t(r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY block, turn) - 1 AS slot FROM e)"""


def _plan():
    return F.floor(F.col("p_partkey") / 40)


def plates(spark, folder):
    part = table(spark, folder, "part").select(_plan().alias("plan"), "p_partkey")
    cands = part.filter("p_partkey % 2 = 0").select("plan", F.col("p_partkey").alias("cand"))
    cases = part.filter("p_partkey % 2 = 1").select("plan", F.concat(F.lit("case-"), "p_partkey").alias("kase"))
    placed = R.plate_entries(cands, cases, "cand", "kase", 3, 7, ["plan"])
    wells = R.well_table(spark).withColumnRenamed("slot", "ws")
    return (placed.withColumn("plate", F.floor(F.col("slot") / 96)).withColumn("ws", F.col("slot") % 96).join(wells, "ws").drop("ws"))


@query("plate_layout", f"""WITH {_PLATE} SELECT plan, kase, cand, replicate::BIGINT AS replicate, (slot // 96)::BIGINT AS plate,
  chr((65 + slot % 96 % 8)::INT) || (slot % 96 // 8 + 1) AS well, (slot % 96 % 8 IN (0, 7) OR slot % 96 // 8 IN (0, 11)) AS edge_well FROM placed""")
def plate_layout(spark, folder):
    return plates(spark, folder).select("plan", "kase", "cand", "replicate", "plate", "well", "edge_well")


@query("plate_result_checks", f"""WITH {_PLATE}, w AS (SELECT DISTINCT plan, chr((65 + slot % 96 % 8)::INT) || (slot % 96 // 8 + 1) AS well FROM placed),
r AS (SELECT p_partkey // 40 AS plan, p_partkey AS line, chr((65 + p_partkey % 9)::INT) || (p_partkey % 12 + 1) AS well, p_size * 2.0::DOUBLE AS cq,
  CASE p_partkey % 5 WHEN 0 THEN 'amplified' WHEN 1 THEN 'not_amplified' WHEN 2 THEN 'missing' WHEN 3 THEN 'invalid' ELSE 'odd' END AS observed FROM part),
j AS (SELECT r.*, w.well IS NOT NULL AS planned, row_number() OVER (PARTITION BY r.plan, r.well ORDER BY line) AS nth FROM r LEFT JOIN w ON r.plan = w.plan AND r.well = w.well)
SELECT plan, coalesce(CASE WHEN NOT planned THEN 'unknown well' WHEN nth > 1 THEN 'duplicate well' WHEN observed = 'odd' THEN 'observed state is not allowed'
  WHEN cq NOT BETWEEN 0 AND 80 THEN 'cq is outside the permitted range' END, 'ok') AS error, count(*)::BIGINT AS n FROM j GROUP BY 1, 2""")
def plate_result_checks(spark, folder):
    wells = plates(spark, folder).select("plan", "well").distinct()
    k = F.col("p_partkey")
    observed = F.element_at(F.array(*[F.lit(x) for x in ("Amplified", "not amplified", "missing", "invalid", "odd")]), (k % 5 + 1).cast("int"))
    rows = table(spark, folder, "part").select(
        _plan().alias("plan"), k.alias("line"), F.concat(F.char(65 + k % 9), (k % 12 + 1).cast("string")).alias("well"),
        (F.col("p_size") * 2.0).alias("cq"), F.lit(None).cast("double").alias("efficiency"), observed.alias("observed"))
    out = R.check_results(rows, wells, ["plan"])
    return out.groupBy("plan", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("replicate_interpretation", """WITH r AS (SELECT l_suppkey AS candidate_id, l_linenumber AS case_id, CASE l_returnflag WHEN 'R' THEN 'missing' WHEN 'A' THEN 'amplified'
  ELSE 'not_amplified' END AS observed, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS cq, CASE WHEN l_linenumber % 2 = 0 THEN 'signal_product' ELSE 'no_product' END AS expected FROM lineitem),
g AS (SELECT candidate_id, case_id, count(*) AS n, count(*) FILTER (observed <> 'missing') AS o, count(*) FILTER (observed = 'amplified') AS a,
  count(*) FILTER (observed = 'not_amplified') AS x, avg(cq) AS m, min(expected) AS e FROM r GROUP BY 1, 2)
SELECT candidate_id, case_id::BIGINT AS case_id, n::BIGINT AS n_replicates, a::BIGINT AS n_amplified, round(m, 6) AS mean_cq, CASE WHEN o = 0 THEN 'missing'
  WHEN (e = 'signal_product' AND a = o) OR (e <> 'signal_product' AND x = o) THEN 'supported' WHEN a > 0 AND x > 0 THEN 'mixed' ELSE 'contradicted' END AS agreement FROM g""")
def replicate_interpretation(spark, folder):
    li = table(spark, folder, "lineitem")
    flag = F.col("l_returnflag")
    rows = li.select(F.col("l_suppkey").alias("candidate_id"), F.col("l_linenumber").alias("case_id"),
                     F.when(flag == "R", "missing").when(flag == "A", "amplified").otherwise("not_amplified").alias("observed"),
                     F.when(flag == "A", F.col("l_quantity")).alias("cq"),
                     F.when(F.col("l_linenumber") % 2 == 0, "signal_product").otherwise("no_product").alias("expected"))
    out = R.interpret_replicates(rows, ["candidate_id", "case_id"])
    return out.select("candidate_id", "case_id", "n_replicates", "n_amplified", F.round("mean_cq", 6).alias("mean_cq"), "agreement")


@query("assay_readiness", f"""WITH {_FEEDBACK}, a AS (SELECT assay_id, avg(efficiency) AS e, max(r2) AS r, count(*) AS n FROM feedback GROUP BY 1),
c AS (SELECT assay_id, CASE WHEN e BETWEEN 90 AND 110 THEN 'pass' WHEN e BETWEEN 85 AND 115 THEN 'warn' ELSE 'fail' END AS s, true AS need FROM a
  UNION ALL SELECT assay_id, CASE WHEN r >= 0.98 THEN 'pass' WHEN r >= 0.95 THEN 'warn' ELSE 'fail' END, true FROM a
  UNION ALL SELECT assay_id, CASE WHEN n % 3 = 0 THEN 'na' ELSE 'review' END, true FROM a)
SELECT assay_id, count(*) FILTER (s = 'na')::BIGINT AS n_missing, CASE WHEN bool_or(s = 'fail') THEN 'fail' WHEN bool_or(s = 'na') THEN 'incomplete'
  WHEN bool_or(s IN ('warn', 'review')) THEN 'review' ELSE 'pass' END AS state FROM c GROUP BY 1""")
def assay_readiness(spark, folder):
    def graded(col, ok, soft):
        return F.when(ok, "pass").when(soft, "warn").otherwise("fail")

    a = feedback(spark, folder).groupBy("assay_id").agg(F.avg("efficiency").alias("e"), F.max("r2").alias("r"), F.count("*").alias("n"))
    checks = F.array(
        F.struct(F.lit("efficiency").alias("check"), graded("e", F.col("e").between(90, 110), F.col("e").between(85, 115)).alias("status")),
        F.struct(F.lit("linearity").alias("check"), graded("r", F.col("r") >= 0.98, F.col("r") >= 0.95).alias("status")),
        F.struct(F.lit("single_product").alias("check"), F.when(F.col("n") % 3 == 0, "na").otherwise("review").alias("status")))
    return R.readiness(a.select("assay_id", F.inline(checks)), "assay_id")


@query("run_context_differences", """WITH m AS (SELECT l_returnflag AS run, l_linenumber::VARCHAR AS field, sum(l_orderkey)::VARCHAR AS value FROM lineitem
  WHERE NOT (l_returnflag = 'A' AND l_linenumber = 3) GROUP BY 1, 2)
SELECT coalesce(a.field, b.field) AS field, a.value AS "left", b.value AS "right" FROM (SELECT * FROM m WHERE run = 'A') a FULL JOIN (SELECT * FROM m WHERE run = 'R') b
  ON a.field = b.field WHERE a.value IS DISTINCT FROM b.value""")
def run_context_differences(spark, folder):
    li = table(spark, folder, "lineitem").filter("not (l_returnflag = 'A' and l_linenumber = 3)")
    manifests = li.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").cast("string").alias("field")).agg(
        F.sum("l_orderkey").cast("string").alias("value"))
    return R.context_differences(manifests, "A", "R")


@query("reproducibility_states", """WITH s AS (SELECT p_brand AS run, count(*) FILTER (p_size % 2 = 0) = count(*) FILTER (p_size % 2 = 1) AS same_set,
  bool_or(p_size = 7) AS ordered, min(p_size) = 1 AS manifests, max(p_size) >= 50 AS ctx FROM part GROUP BY 1)
SELECT run, CASE WHEN manifests AND NOT (same_set AND ordered) THEN 'critical_non_reproducibility' WHEN ctx AND same_set AND NOT ordered THEN 'unexplained_order_change'
  WHEN ctx AND ordered THEN 'reproduced' WHEN NOT ctx THEN 'context_changed' ELSE 'insufficient_provenance' END AS state FROM s""")
def reproducibility_states(spark, folder):
    s = table(spark, folder, "part").groupBy(F.col("p_brand").alias("run")).agg(
        (F.count_if(F.col("p_size") % 2 == 0) == F.count_if(F.col("p_size") % 2 == 1)).alias("same_set"),
        F.bool_or(F.col("p_size") == 7).alias("ordered"), (F.min("p_size") == 1).alias("manifests"), (F.max("p_size") >= 50).alias("ctx"))
    return s.select("run", R.reproducibility_state(F.col("manifests"), F.col("ctx"), F.col("same_set"), F.col("ordered"), ~F.col("ctx")).alias("state"))


@query("contract_comparison", """WITH c AS (SELECT p_type AS policy, p_brand AS run, bool_or(p_size = 1) AS valid, count(*) % 2 = 0 AS ctx, max(p_size) % 2 = 0 AS search,
  min(p_partkey) % 2 = 0 AS winner, sum(p_size) % 2 = 0 AS result FROM part GROUP BY 1, 2)
SELECT policy, run, CASE WHEN NOT valid THEN 'invalid_contract' WHEN ctx AND search AND result THEN 'equivalent_reproduction'
  WHEN ctx AND search AND winner THEN 'winner_equivalent_with_declared_result_set_difference' WHEN ctx AND search THEN 'configuration_equivalent_result_drift'
  WHEN winner AND result THEN 'scientifically_comparable_with_declared_context_difference' ELSE 'not_directly_comparable' END AS state FROM c""")
def contract_comparison(spark, folder):
    c = table(spark, folder, "part").groupBy(F.col("p_type").alias("policy"), F.col("p_brand").alias("run")).agg(
        F.bool_or(F.col("p_size") == 1).alias("valid"), (F.count("*") % 2 == 0).alias("same_context"), (F.max("p_size") % 2 == 0).alias("same_search"),
        (F.min("p_partkey") % 2 == 0).alias("same_winner"), (F.sum("p_size") % 2 == 0).alias("same_result"))
    checks = {n: F.col(n) for n in ("valid", "same_context", "same_search", "same_winner", "same_result")}
    checks.update(same_policy=F.col("same_winner"), same_engine=F.col("same_result"), same_profile=F.lit(True), same_objective=F.lit(True))
    return c.select("policy", "run", R.contract_state(checks).alias("state"))


@query("objective_prerequisites", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 < 1 THEN 'off_target_corpus' ELSE '' END
  WHEN 1 THEN CASE WHEN o_custkey % 3 < 2 THEN 'several_targets' ELSE '' END
  WHEN 2 THEN CASE WHEN o_custkey % 3 < 1 THEN 'panel' ELSE '' END ELSE CASE WHEN o_custkey % 3 < 1 THEN 'junction_coordinates' ELSE '' END END AS missing FROM orders""")
def objective_prerequisites(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    names = F.array(*[F.lit(x) for x in ("confirmatory", "broad_inclusivity", "multiplex", "transcript_specific")])
    n = F.col("o_custkey") % 3
    missing = R.objective_prerequisites(F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), n, n, n, n)
    return o.select("o_orderkey", F.array_join(missing, ",").alias("missing"))


@query("imported_run_ranks", """SELECT p_brand AS run, p_type AS candidate, min(p_partkey)::BIGINT AS first_row,
  row_number() OVER (PARTITION BY p_brand ORDER BY min((p_partkey, p_size))[2], p_type)::BIGINT AS rank FROM part GROUP BY 1, 2""")
def imported_run_ranks(spark, folder):
    """Keep the first row of each candidate of a run, then renumber ranks without gaps."""
    from pyspark.sql import Window
    part = table(spark, folder, "part").select(F.col("p_brand").alias("run"), F.col("p_type").alias("candidate"), F.col("p_partkey").alias("first_row"), "p_size")
    first = keep_first(part, ["run", "candidate"], [F.col("first_row")])
    w = Window.partitionBy("run").orderBy("p_size", "candidate")
    return first.select("run", "candidate", "first_row", F.row_number().over(w).alias("rank"))


@query("marker_availability", """SELECT lang AS taxon, source AS marker, count(*)::BIGINT AS n, count(*) FILTER (n_chars > 500)::BIGINT AS long_records,
  row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::BIGINT AS place FROM documents GROUP BY 1, 2""")
def marker_availability(spark, folder):
    from pyspark.sql import Window
    docs = table(spark, folder, "documents")
    out = docs.groupBy(F.col("lang").alias("taxon"), F.col("source").alias("marker")).agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("long_records"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("taxon").orderBy(F.desc("n"), "marker")))
