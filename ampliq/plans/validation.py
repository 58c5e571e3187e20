"""Queries on validation inputs, run changes and single-placement PCR."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import single_placement as SP
from ..operators import validation as V
from ..session import table
from . import shapes as X
from .design import _PROBED, triplets
from .ranking import _CAND, candidates
from .registry import query
from .sites import _PLACED


@query("candidate_validation", """WITH c AS (SELECT p_brand AS plan, p_partkey AS line, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE 'c' || p_partkey % 90 END AS id,
  regexp_replace(translate(upper(p_name), 'U', 'T'), '[^ACGTRYSWKMBDHVN]', '', 'g') AS f, regexp_replace(translate(upper(CASE WHEN p_size % 7 <> 0 THEN p_type END), 'U', 'T'), '[^ACGTRYSWKMBDHVN]', '', 'g') AS r,
  CASE WHEN p_size % 4 = 0 THEN 'unspecified' ELSE 'sybr' END AS chem FROM part),
n AS (SELECT plan, line, coalesce(nullif(trim(id), ''), 'candidate-' || line) AS id, f, coalesce(r, '') AS r, chem FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY plan, f, r, chem ORDER BY line) AS nth FROM n WHERE f <> '' AND coalesce(r, '') <> ''),
o AS (SELECT *, CASE WHEN line <> min(line) OVER (PARTITION BY plan, id) THEN 'candidate_id_repeated' END AS e FROM k WHERE nth = 1),
z AS (SELECT *, coalesce(e, CASE WHEN count(*) FILTER (e IS NULL) OVER (PARTITION BY plan) < 2 THEN 'too_few_candidates' END) AS error FROM o)
SELECT plan, id AS candidate_id, coalesce(error, 'ok') AS state FROM z UNION ALL SELECT plan, id, 'primer_missing' FROM n WHERE f = '' OR r = ''""")
def candidate_validation(spark, folder):
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(
        F.col("p_brand").alias("plan"), F.col("p_partkey").alias("line"),
        F.when(size % 6 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("p_partkey") % 90)).alias("candidate_id"), F.col("p_name").alias("forward"),
        F.when(size % 7 != 0, F.col("p_type")).alias("reverse"), F.lit(None).cast("string").alias("probe"), F.when(size % 4 != 0, "sybr").alias("chemistry"))
    good, bad = V.validate_candidates(rows, ["plan"], "line")
    return good.select("plan", "candidate_id", F.lit("ok").alias("state")).unionByName(bad.select("plan", "candidate_id", F.col("error").alias("state")))


@query("case_validation", """WITH c AS (SELECT source AS plan, doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || doc_id % 40 END AS id, CASE doc_id % 6 WHEN 0 THEN 'near-neighbour' WHEN 1 THEN 'OffTarget' WHEN 2 THEN 'control'
    WHEN 3 THEN 'target' WHEN 4 THEN 'off-target' END AS role, CASE doc_id % 9 WHEN 0 THEN 'Synthetic' WHEN 1 THEN 'guess' END AS material,
  regexp_replace(translate(upper(replace(coalesce(text, ''), 'ß', 'ss')), 'U', 'T'), '[^ACGTRYSWKMBDHVN]', '', 'g') AS seq FROM documents),
n AS (SELECT plan, doc_id, coalesce(nullif(id, ''), 'case-' || doc_id) AS id, CASE role WHEN 'near-neighbour' THEN 'off_target' WHEN 'OffTarget' THEN 'off_target' WHEN 'off-target' THEN 'off_target'
  ELSE coalesce(role, 'target') END AS role, lower(coalesce(material, 'natural')) AS material, seq FROM c)
SELECT plan, id AS case_id, role, coalesce(CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY plan, id) THEN 'case_id_repeated' WHEN seq = '' THEN 'sequence_missing'
  WHEN role NOT IN ('target', 'off_target') THEN 'role_unknown' WHEN material = 'guess' THEN 'material_unknown' END, sha256(seq)) AS state FROM n""")
def case_validation(spark, folder):
    d = F.col("doc_id")
    role = F.element_at(F.array(*[F.lit(x) for x in ("near-neighbour", "OffTarget", "control", "target", "off-target", None)]), (d % 6 + 1).cast("int"))
    rows = table(spark, folder, "documents").select(
        F.col("source").alias("plan"), "doc_id", F.when(d % 5 == 0, "").otherwise(F.concat("lang", (d % 40).cast("string"))).alias("case_id"), role.alias("role"),
        F.lit(None).cast("string").alias("grp"), F.when(d % 9 == 0, "Synthetic").when(d % 9 == 1, "guess").alias("material"), F.col("text").alias("sequence"))
    good, bad = V.validate_cases(rows, ["plan"], "doc_id")
    return (good.select("plan", "case_id", "role", F.col("sequence_sha256").alias("state"))
            .unionByName(bad.select("plan", "case_id", "role", F.col("error").alias("state"))))


@query("condition_validity", """WITH c AS (SELECT o_orderkey, o_totalprice / 100 AS mv, (o_orderkey % 41)::DOUBLE / 10 - 0.2::DOUBLE AS dv, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 30) / 10::DOUBLE END AS dntp,
  CASE o_custkey % 11 WHEN 0 THEN 'much' WHEN 1 THEN 'NaN' WHEN 2 THEN '0' ELSE '200' END AS dna, 25 + o_custkey % 65 AS anneal FROM orders)
SELECT o_orderkey, e AS error, CASE WHEN e IS NULL AND coalesce(dntp, 0.8) >= dv THEN 'no_free_magnesium' END AS warning FROM (SELECT *, CASE
  WHEN mv NOT BETWEEN 0 AND 2000 THEN 'mv_out_of_range' WHEN dv NOT BETWEEN 0 AND 200 THEN 'dv_out_of_range' WHEN dntp NOT BETWEEN 0 AND 100 THEN 'dntp_out_of_range'
  WHEN dna = 'much' THEN 'dna_not_numeric' WHEN dna = 'NaN' THEN 'dna_not_finite' WHEN dna = '0' THEN 'dna_out_of_range' WHEN anneal NOT BETWEEN 30 AND 85 THEN 'anneal_out_of_range'
  WHEN mv + dv <= 0 THEN 'no_salt' END AS e FROM c) z""")
def condition_validity(spark, folder):
    o, k, c = table(spark, folder, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    dna = F.when(c % 11 == 0, "much").when(c % 11 == 1, "NaN").when(c % 11 == 2, "0").otherwise("200")
    rows = o.select("o_orderkey", (F.col("o_totalprice") / 100).alias("mv"), ((k % 41).cast("double") / 10 - 0.2).alias("dv"),
                    F.when(c % 3 > 0, (c % 30) / 10.0).alias("dntp"), dna.alias("dna"), (25 + c % 65).alias("anneal"))
    return V.condition_errors(rows).select("o_orderkey", "error", "warning")


def _failures(shift):
    """Hard failures of a candidate under one setting of the limits."""
    return F.array_compact(F.array(F.when(F.col("signal_subjects") > 0, "offtarget_signal"), F.when(F.col("target_coverage") < 1.0 - shift, "coverage_below"),
                                   F.when(F.col("robustness") < 0.5 + shift, "conditions_failed")))


def _failures_sql(shift):
    return (f"list_filter([CASE WHEN signal_subjects > 0 THEN 'offtarget_signal' END, CASE WHEN target_coverage < 1.0::DOUBLE - {shift}::DOUBLE THEN 'coverage_below' END, "
            f"CASE WHEN robustness < 0.5::DOUBLE + {shift}::DOUBLE THEN 'conditions_failed' END], lambda x: x IS NOT NULL)")


_LABELS = ["best_specificity", "best_inclusivity", "best_short_amplicon"]
_BEST = "[min((signal_subjects, product_subjects, rank))[3], min((-target_coverage, -worst_3prime, rank))[3], min((amplicon, rank))[2]]"


def _side_sql(name, order, gone, shift):
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order}, id) AS rank, {_failures_sql(shift)} AS failures FROM cand WHERE id % 10 <> {gone}),
{name}b AS (SELECT run, {_BEST} AS best FROM {name}0 GROUP BY 1),
{name} AS (SELECT s.*, len(failures) = 0 AS valid, list_filter([CASE WHEN best[1] = rank THEN 'best_specificity' END, CASE WHEN best[2] = rank THEN 'best_inclusivity' END,
  CASE WHEN best[3] = rank THEN 'best_short_amplicon' END], lambda x: x IS NOT NULL) AS cats FROM {name}0 s JOIN {name}b USING (run))"""


def _side(rows, order, gone, shift):
    """One of two runs over the same candidates: its own order, its own limits, its own winners per category."""
    run = R.ranked(rows.where(F.col("id") % 10 != gone).withColumn("rank_key", F.array(F.col(order).cast("double"))), ["run"], ["id"]).withColumn("failures", _failures(shift))
    best = run.groupBy("run").agg(F.min_by("rank", F.struct("signal_subjects", "product_subjects", "rank")).alias("b1"),
                                  F.min_by("rank", F.struct(-F.col("target_coverage"), -F.col("worst_3prime"), F.col("rank"))).alias("b2"),
                                  F.min_by("rank", F.struct("amplicon", "rank")).alias("b3"))
    cats = F.array_compact(F.array(*[F.when(F.col(f"b{n}") == F.col("rank"), label) for n, label in enumerate(_LABELS, 1)]))
    return run.join(best, "run").withColumns({"hard_valid": F.size("failures") == 0, "categories": cats})


@query("run_candidate_changes", f"""WITH {_CAND}, {_side_sql('l', 'p_retailprice', 1, 0.05)}, {_side_sql('r', 'p_size', 2, 0.01)}
SELECT l.run, l.id, (l.rank - r.rank)::BIGINT AS rank_shift, l.valid <> r.valid AS validity_changed,
  array_to_string(list_sort(list_filter(r.failures, lambda x: NOT list_contains(l.failures, x))), ',') AS failures_added,
  array_to_string(list_sort(list_filter(l.failures, lambda x: NOT list_contains(r.failures, x))), ',') AS failures_removed,
  array_to_string(list_sort(list_filter(r.cats, lambda x: NOT list_contains(l.cats, x))), ',') AS categories_added,
  array_to_string(list_sort(list_filter(l.cats, lambda x: NOT list_contains(r.cats, x))), ',') AS categories_removed,
  CASE WHEN l.probe_identity IS NOT NULL THEN 0::DOUBLE END AS probe_identity_delta FROM l JOIN r ON l.run = r.run AND l.id = r.id""")
def run_candidate_changes(spark, folder):
    rows = candidates(spark, folder)
    out = V.candidate_changes(_side(rows, "p_retailprice", 1, 0.05), _side(rows, "p_size", 2, 0.01), ["run", "id"])
    listed = [F.array_join(c, ",").alias(c) for c in ("failures_added", "failures_removed", "categories_added", "categories_removed")]
    return out.select("run", "id", "rank_shift", "validity_changed", *listed, "probe_identity_delta")


_SINGLE = _PLACED + """, hits AS (SELECT item_id, role, doc_id, strand, CASE strand WHEN '+' THEN off + 1 ELSE length(seq) - off - 11 END AS lo
  FROM placed JOIN subjects USING (doc_id) WHERE (12 - neg) / 12.0 >= 0.75 AND right(w, 1) = right(oligo, 1)),
made AS (SELECT p.item_id, p.doc_id, m.lo + 11 - p.lo + 1 AS size, p.lo AS a, m.lo + 11 AS b, p.role AS lp FROM hits p JOIN hits m
  ON p.item_id = m.item_id AND p.doc_id = m.doc_id AND p.strand = '+' AND m.strand = '-' AND p.lo <= m.lo + 11 AND p.lo + 11 <= m.lo + 5 AND m.lo + 11 - p.lo + 1 BETWEEN 20 AND 3000),
seg AS (SELECT made.*, probe, length(probe) AS n, substr(seq, a, size) AS s, reverse(translate(probe, 'ACGT', 'TGCA')) AS rcp FROM made JOIN subjects USING (doc_id) JOIN assays USING (item_id)),
spot AS (SELECT item_id, doc_id, max(greatest(n - hamming(substr(s, i, n), probe), n - hamming(substr(s, i, n), rcp))) AS hit
  FROM (SELECT *, unnest(generate_series(1, length(s) - n + 1)) AS i FROM seg WHERE probe IS NOT NULL AND length(s) >= n) z GROUP BY 1, 2)"""


@query("single_placement_products", f"""WITH {_SINGLE} SELECT item_id, doc_id, size::BIGINT AS size, a::BIGINT AS span_lo, b::BIGINT AS span_hi, lp AS left_primer,
  CASE WHEN probe IS NOT NULL THEN coalesce(hit, 0) / n::DOUBLE >= 0.8 END AS probe_binds FROM seg LEFT JOIN spot USING (item_id, doc_id)""")
def single_placement_products(spark, folder):
    return SP.single_placement_products(X.assays(spark, folder), X.subjects(spark, folder), assay="item_id", subject="doc_id", min_product=20)


@query("exact_locations", f"""WITH {_PROBED} SELECT trip.item_id, forward, reverse, probe, p_strand, f_start::BIGINT AS f_start, instr(t, CASE WHEN p_strand = '+' THEN probe ELSE reverse(translate(probe, 'ACGT', 'TGCA')) END)::BIGINT - 1 AS first_anywhere,
  (CASE WHEN instr(substr(t, f_end + 1, r_start - f_end), CASE WHEN p_strand = '+' THEN probe ELSE reverse(translate(probe, 'ACGT', 'TGCA')) END) > 0
   THEN f_end + instr(substr(t, f_end + 1, r_start - f_end), CASE WHEN p_strand = '+' THEN probe ELSE reverse(translate(probe, 'ACGT', 'TGCA')) END) - 1 END)::BIGINT AS probe_start,
  instr(t, forward)::BIGINT - 1 AS f_at FROM trip JOIN templates USING (item_id)""")
def exact_locations(spark, folder):
    """Where the oligos of every triplet lie in their template."""
    rows = triplets(spark, folder).join(X.templates(spark, folder), "item_id")
    start, _ = SP.probe_span(F.col("t"), F.col("probe"), F.col("p_strand"), F.col("f_end"), F.col("r_start"))
    needle = F.when(F.col("p_strand") == "+", F.col("probe")).otherwise(SP.S.revcomp(F.col("probe")))
    return rows.select("item_id", "forward", "reverse", "probe", "p_strand", "f_start", SP.locate(needle, F.col("t")).alias("first_anywhere"),
                       start.alias("probe_start"), SP.locate(F.col("forward"), F.col("t")).alias("f_at"))
