"""Ranking queries over candidate evidence derived from the part table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import ranking_wide as RW
from ..operators.stats import wilson_interval
from ..session import table
from .registry import query

_CAND = """cand AS (SELECT p_brand AS run, p_partkey AS id, p_size % 5 <> 0 AS hard_valid,
  CASE WHEN p_size % 5 = 0 THEN 1 + p_size % 2 ELSE 0 END AS n_failures,
  CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS signal_subjects, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + p_size % 3 AS product_subjects,
  1 - (p_partkey % 4) * 0.02::DOUBLE AS target_coverage, 1 - (p_size % 10) / 100::DOUBLE AS worst_3prime,
  CASE WHEN p_partkey % 5 <> 0 THEN 0.9::DOUBLE + (p_partkey % 10) / 100::DOUBLE END AS probe_identity,
  (p_partkey % 3 + 1) / 3::DOUBLE AS robustness, (round(p_retailprice * 100)::BIGINT % 700) / 100::DOUBLE AS triplet_penalty,
  -(p_size % 8)::DOUBLE AS worst_dimer, length(p_name) / 10::DOUBLE AS practical_penalty, 1 + p_partkey % 4 AS degeneracy_fold,
  p_partkey % 3 AS panel_risk, CASE p_size % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'size' ELSE 'none' END AS junction_level,
  p_partkey * 13 % 2000 AS f_start, 'F' || p_partkey % 37 AS forward, 'R' || p_partkey % 41 AS reverse, 60 + p_size * 2 AS amplicon,
  p_size, p_retailprice, length(p_name) AS name_len FROM part)"""

_ORDER = """(NOT hard_valid)::INT, n_failures, signal_subjects, product_subjects, -target_coverage, -worst_3prime,
  -coalesce(probe_identity, 0), -robustness, triplet_penalty, -worst_dimer, practical_penalty, degeneracy_fold, f_start, forward, reverse, id"""

_RANKED = f"""{_CAND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_ORDER}) AS rank FROM cand)"""


def candidates(spark, folder):
    p, c = table(spark, folder, "part"), F.col
    signal = F.when(c("p_partkey") % 7 == 0, 1).otherwise(0)
    failures = F.when(c("p_size") % 5 == 0, 1 + c("p_size") % 2).otherwise(0)
    return p.select(
        c("p_brand").alias("run"), c("p_partkey").alias("id"), (c("p_size") % 5 != 0).alias("hard_valid"),
        failures.alias("n_failures"), signal.alias("signal_subjects"), (signal + c("p_size") % 3).alias("product_subjects"),
        (1.0 - (c("p_partkey") % 4) * 0.02).alias("target_coverage"), (1.0 - (c("p_size") % 10) / 100.0).alias("worst_3prime"),
        F.when(c("p_partkey") % 5 != 0, 0.9 + (c("p_partkey") % 10) / 100.0).alias("probe_identity"),
        ((c("p_partkey") % 3 + 1) / 3.0).alias("robustness"),
        ((F.round(c("p_retailprice") * 100).cast("long") % 700) / 100.0).alias("triplet_penalty"),
        (-(c("p_size") % 8)).cast("double").alias("worst_dimer"), (F.length("p_name") / 10.0).alias("practical_penalty"),
        (1 + c("p_partkey") % 4).alias("degeneracy_fold"), (c("p_partkey") % 3).alias("panel_risk"),
        F.when(c("p_size") % 3 == 0, "strong").when(c("p_size") % 3 == 1, "size").otherwise("none").alias("junction_level"),
        (c("p_partkey") * 13 % 2000).alias("f_start"), F.concat(F.lit("F"), c("p_partkey") % 37).alias("forward"),
        F.concat(F.lit("R"), c("p_partkey") % 41).alias("reverse"), (60 + c("p_size") * 2).alias("amplicon"),
        "p_size", "p_retailprice", F.length("p_name").alias("name_len"))


def ranking(spark, folder):
    return R.ranked(R.keyed(candidates(spark, folder)), ["run"], ["f_start", "forward", "reverse", "id"])


@query("candidate_ranking", f"WITH {_RANKED} SELECT run, id, rank::BIGINT AS rank FROM ranked")
def candidate_ranking(spark, folder):
    return ranking(spark, folder).select("run", "id", "rank")


@query("objective_rankings", f"""WITH {_CAND} SELECT run, id, 'degraded_template' AS objective, row_number() OVER (PARTITION BY run ORDER BY
  (NOT hard_valid)::INT, n_failures, signal_subjects, product_subjects, -target_coverage, -worst_3prime, -coalesce(probe_identity, 0),
  practical_penalty, degeneracy_fold, -robustness, triplet_penalty, -worst_dimer, id)::BIGINT AS rank FROM cand
UNION ALL SELECT run, id, 'multiplex', row_number() OVER (PARTITION BY run ORDER BY (NOT hard_valid)::INT, n_failures, signal_subjects,
  product_subjects, panel_risk, -target_coverage, -worst_3prime, -coalesce(probe_identity, 0), -robustness, triplet_penalty, -worst_dimer,
  practical_penalty, degeneracy_fold, id) FROM cand
UNION ALL SELECT run, id, 'transcript_specific', row_number() OVER (PARTITION BY run ORDER BY (NOT hard_valid)::INT, n_failures,
  CASE junction_level WHEN 'strong' THEN 0 WHEN 'size' THEN 1 ELSE 2 END, signal_subjects, product_subjects, -target_coverage, -worst_3prime,
  -coalesce(probe_identity, 0), -robustness, triplet_penalty, -worst_dimer, practical_penalty, degeneracy_fold, id) FROM cand""")
def objective_rankings(spark, folder):
    names = F.array(*[F.lit(x) for x in ("degraded_template", "multiplex", "transcript_specific")])
    rows = candidates(spark, folder).withColumn("objective", F.explode(names))
    out = R.ranked(R.keyed(rows, "objective"), ["run", "objective"], ["id"])
    return out.select("run", "id", "objective", "rank")


@query("decisive_components", f"""WITH {_RANKED}, n AS (SELECT run, id, rank, [(NOT hard_valid)::INT::DOUBLE, n_failures, signal_subjects, product_subjects,
  -target_coverage, -worst_3prime, -coalesce(probe_identity, 0), -robustness, triplet_penalty, -worst_dimer, practical_penalty, degeneracy_fold] AS k FROM ranked),
p AS (SELECT *, lead(k) OVER (PARTITION BY run ORDER BY rank) AS nx FROM n)
SELECT run, id, CASE WHEN nx IS NULL THEN NULL WHEN k = nx THEN 'deterministic_tie_breaker' ELSE ['hard_validity', 'hard_failure_count', 'offtarget', 'offtarget',
  'coverage', 'coverage', 'coverage', 'robustness', 'triplet', 'triplet', 'practical', 'practical'][list_min(list_filter(range(1, 13), lambda i: k[i] <> nx[i]))] END AS decisive FROM p""")
def decisive_components(spark, folder):
    return R.decisive_component(ranking(spark, folder), ["run"], "balanced").select("run", "id", "decisive")


@query("display_scores", f"""WITH {_CAND} SELECT id, round(greatest(0, least(CASE WHEN hard_valid THEN 100 ELSE 49 END::DOUBLE, 100 - 35 * least(1, signal_subjects)
  - 15 * greatest(0, product_subjects - signal_subjects) - 30 * greatest(0, 1 - target_coverage) - 12 * greatest(0, 1 - robustness)
  - least(15, triplet_penalty) - least(8, practical_penalty) - 8 * panel_risk)), 6) AS score FROM cand""")
def display_scores(spark, folder):
    return candidates(spark, folder).select("id", F.round(R.display_score(), 6).alias("score"))


_PREF = f"""{_RANKED}, e AS (SELECT *, id % 9 <> 0 AS off_ok, id % 4 <> 0 AS panel_ok FROM ranked),
n AS (SELECT *, lead((hard_valid::INT, signal_subjects, product_subjects, target_coverage, panel_risk, robustness, triplet_penalty,
    practical_penalty, off_ok, panel_ok)) OVER (PARTITION BY run ORDER BY rank) AS x FROM e),
pref AS (SELECT run, id, rank, x, hard_valid, signal_subjects, product_subjects, target_coverage, panel_risk, robustness, triplet_penalty,
  practical_penalty, off_ok, panel_ok, CASE WHEN x IS NULL THEN 'insufficient evidence to compare' WHEN hard_valid::INT <> x[1] THEN 'strong preference'
  WHEN signal_subjects <> x[2] OR product_subjects <> x[3] THEN CASE WHEN off_ok AND x[9] THEN 'strong preference' ELSE 'insufficient evidence to distinguish' END
  WHEN abs(target_coverage - x[4]) >= 0.05 THEN 'strong preference' WHEN abs(target_coverage - x[4]) >= 0.01 THEN 'moderate preference'
  WHEN panel_risk <> x[5] THEN CASE WHEN panel_ok AND x[10] THEN 'moderate preference' ELSE 'insufficient evidence to distinguish' END
  WHEN abs(robustness - x[6]) >= 0.34 THEN 'moderate preference'
  WHEN abs(x[7] - triplet_penalty) <= 0.75 AND abs(x[8] - practical_penalty) <= 0.75 THEN
    CASE WHEN off_ok AND x[9] THEN 'near-equivalent alternatives' ELSE 'insufficient evidence to distinguish' END
  WHEN NOT (off_ok AND x[9]) THEN 'insufficient evidence to distinguish' ELSE 'moderate preference' END AS preference FROM n)"""


def _preferences(spark, folder):
    rows = ranking(spark, folder).withColumns({
        "objective": F.lit("balanced"), "target_epcr": F.lit(True), "condition_robustness": F.lit(True),
        "offtarget_epcr": F.col("id") % 9 != 0, "panel": F.col("id") % 4 != 0, "junction": F.lit(False)})
    return R.preference_states(rows, ["run"])


@query("preference_states", f"WITH {_PREF} SELECT run, id, preference FROM pref")
def preference_states(spark, folder):
    return _preferences(spark, folder).select("run", "id", "preference")


@query("rank_bands", f"""WITH {_PREF}, b AS (SELECT *, CASE WHEN lag(preference) OVER (PARTITION BY run ORDER BY rank) IN
  ('near-equivalent alternatives', 'insufficient evidence to distinguish') THEN 0 ELSE 1 END AS b FROM pref)
SELECT run, id, (sum(b) OVER (PARTITION BY run ORDER BY rank))::BIGINT AS band FROM b""")
def rank_bands(spark, folder):
    return R.rank_bands(_preferences(spark, folder), ["run"]).select("run", "id", "band")


@query("rank_reversal_triggers", f"""WITH {_PREF} SELECT run, id, CASE WHEN x IS NULL THEN 'another_candidate_available' ELSE concat_ws(',',
  CASE WHEN x[4] > target_coverage + 1e-9 THEN 'broad_inclusivity' END,
  CASE WHEN x[2] < signal_subjects OR (x[2] = signal_subjects AND x[3] < product_subjects) THEN 'confirmatory_exclusivity' END,
  CASE WHEN x[6] > robustness + 1e-9 THEN 'condition_variation' END, CASE WHEN x[8] + 0.5 < practical_penalty THEN 'practical_priority' END,
  CASE WHEN x[7] + 0.75 < triplet_penalty THEN 'triplet_priority' END, CASE WHEN NOT off_ok OR NOT x[9] THEN 'offtarget_corpus_supplied' END,
  CASE WHEN NOT panel_ok OR NOT x[10] THEN 'panel_supplied' END) END AS triggers FROM pref""")
def rank_reversal_triggers(spark, folder):
    out = R.reversal_triggers(_preferences(spark, folder))
    return out.select("run", "id", F.array_join("triggers", ",").alias("triggers"))


_WHOLE = (_PREF.replace("p_brand AS run", "'all' AS run").replace("'R' || p_partkey % 41 AS reverse", "'R' || p_partkey % 41 AS reverse, p_partkey % 6 <> 0 AS junction_ok")
          .replace("practical_penalty, off_ok, panel_ok)) OVER", "practical_penalty, off_ok, panel_ok, junction_ok, k)) OVER")
          .replace("id % 4 <> 0 AS panel_ok FROM", """id % 4 <> 0 AS panel_ok, [(NOT hard_valid)::INT::DOUBLE, n_failures, signal_subjects, product_subjects,
  -target_coverage, -worst_3prime, -coalesce(probe_identity, 0), -robustness, triplet_penalty, -worst_dimer, practical_penalty, degeneracy_fold] AS k FROM""")
          .replace("pref AS (SELECT run, id, rank, x,", "pref AS (SELECT run, id, rank, x, k, probe_identity, n_failures, junction_ok,"))


@query("explained_ranking", f"""WITH {_WHOLE}, b AS (SELECT *, CASE WHEN lag(preference) OVER (PARTITION BY run ORDER BY rank) IN
  ('near-equivalent alternatives', 'insufficient evidence to distinguish') THEN 0 ELSE 1 END AS b FROM pref)
SELECT id, rank::BIGINT AS rank, CASE WHEN x IS NULL THEN NULL WHEN k = x[12] THEN 'deterministic_tie_breaker' ELSE ['hard_validity', 'hard_failure_count', 'offtarget', 'offtarget',
  'coverage', 'coverage', 'coverage', 'robustness', 'triplet', 'triplet', 'practical', 'practical'][list_min(list_filter(range(1, 13), lambda i: k[i] <> x[12][i]))] END AS decisive,
  preference, (sum(b) OVER (PARTITION BY run ORDER BY rank))::BIGINT AS band, CASE WHEN x IS NULL THEN 'another_candidate_available' ELSE coalesce(nullif(concat_ws(',',
  CASE WHEN x[4] > target_coverage + 1e-9 THEN 'broad_inclusivity' END,
  CASE WHEN x[2] < signal_subjects OR (x[2] = signal_subjects AND x[3] < product_subjects) THEN 'confirmatory_exclusivity' END,
  CASE WHEN x[6] > robustness + 1e-9 THEN 'condition_variation' END, CASE WHEN x[8] + 0.5 < practical_penalty THEN 'practical_priority' END,
  CASE WHEN x[7] + 0.75 < triplet_penalty THEN 'triplet_priority' END, CASE WHEN NOT off_ok OR NOT x[9] THEN 'offtarget_corpus_supplied' END,
  CASE WHEN NOT panel_ok OR NOT x[10] THEN 'panel_supplied' END, CASE WHEN NOT junction_ok OR NOT x[11] THEN 'junction_verified' END,
  CASE WHEN preference IN ('near-equivalent alternatives', 'insufficient evidence to distinguish') THEN 'same_band' END), ''), 'new_bench_evidence') END AS triggers,
  concat_ws(',', CASE WHEN target_coverage >= 0.999 THEN CASE WHEN probe_identity IS NOT NULL THEN 'all_targets_with_probe' ELSE 'all_targets' END END,
    CASE WHEN off_ok AND signal_subjects = 0 THEN 'no_offtarget_signal' END, CASE WHEN robustness >= 1 THEN 'all_conditions' END) AS strengths,
  concat_ws(',', CASE WHEN target_coverage < 0.999 AND target_coverage > 0 THEN 'targets_missed' END, CASE WHEN NOT off_ok THEN 'exclusivity_unresolved'
    WHEN signal_subjects > 0 THEN 'offtarget_signal' END, CASE WHEN robustness < 1 THEN 'conditions_failed' END, CASE WHEN n_failures > 0 THEN 'hard_failures' END) AS weaknesses FROM b""")
def explained_ranking(spark, folder):
    """The whole table as one run, ranked and explained over slices."""
    rows = candidates(spark, folder).withColumns({
        "run": F.lit("all"), "objective": F.lit("balanced"), "target_epcr": F.lit(True), "condition_robustness": F.lit(True),
        "offtarget_epcr": F.col("id") % 9 != 0, "panel": F.col("id") % 4 != 0, "junction": F.col("id") % 6 != 0})
    out = RW.explained(R.keyed(rows), ["run"], ["f_start", "forward", "reverse", "id"], has_probe=F.col("probe_identity").isNotNull())
    listed = [F.array_join(c, ",").alias(c) for c in ("triggers", "strengths", "weaknesses")]
    return out.select("id", "rank", "decisive", "preference", "band", *listed)


@query("pareto_fronts", f"""WITH RECURSIVE {_CAND}, d AS (SELECT a.run, a.id AS winner, b.id AS loser FROM cand a JOIN cand b ON a.run = b.run
  AND a.p_size <= b.p_size AND a.p_retailprice <= b.p_retailprice AND a.name_len <= b.name_len AND a.id % 17 <= b.id % 17
  AND (a.p_size, a.p_retailprice, a.name_len, a.id % 17) <> (b.p_size, b.p_retailprice, b.name_len, b.id % 17)),
f(run, id, front) AS (SELECT run, id, 1 FROM cand UNION SELECT f.run, d.loser, front + 1 FROM f JOIN d ON d.run = f.run AND d.winner = f.id)
SELECT run, id, max(front)::BIGINT AS front FROM f GROUP BY 1, 2""")
def pareto_fronts(spark, folder):
    rows = candidates(spark, folder).withColumn("m4", F.col("id") % 17)
    return R.pareto_fronts(rows, ["run"], "id", ["p_size", "p_retailprice", "name_len", "m4"]).select("run", "id", "front")


_PHASES = [("alternate_region", "AND NOT list_contains(pairs, c.pair) AND NOT list_contains(regions, c.region)"),
           ("alternate_primer_pair", "AND NOT list_contains(pairs, c.pair)"), ("alternate_probe", "")]
_TAKES = " OR ".join(f"(phase = {i} {test})" for i, (_, test) in enumerate(_PHASES))


# The fill is sequential: a recursive walk over the candidates of a run, three times, with what is used so far.
@query("finalist_selection", f"""WITH RECURSIVE {_RANKED}, v AS (SELECT *, (f_start // 250)::BIGINT AS region, forward || '|' || reverse AS pair,
  row_number() OVER (PARTITION BY run ORDER BY rank) AS pos_no, count(*) OVER (PARTITION BY run) AS m FROM ranked WHERE hard_valid),
w AS (SELECT run, [min(rank), arg_min(rank, (signal_subjects, product_subjects, rank)), arg_min(rank, (-target_coverage, -worst_3prime, rank)),
  arg_min(rank, (-robustness, rank)), arg_min(rank, (amplicon, rank)), arg_min(rank, (degeneracy_fold, rank)), arg_min(rank, (panel_risk, rank))] AS won FROM v GROUP BY run),
c0 AS (SELECT run, unnest(['recommended_balanced', 'best_specificity', 'best_inclusivity', 'most_condition_robust', 'best_short_amplicon', 'minimal_degeneracy',
  'best_multiplex_fit']) AS cat, unnest(won) AS rank, unnest(range(7)) AS pos FROM w),
c1 AS (SELECT c0.run, cat, pos, pair, region, first_value(c0.rank) OVER (PARTITION BY c0.run, pair ORDER BY pos) AS rank FROM c0 JOIN v ON v.run = c0.run AND v.rank = c0.rank),
c2 AS (SELECT run, rank, string_agg(cat, ',' ORDER BY pos) AS label FROM c1 GROUP BY 1, 2),
walk(run, phase, pos_no, ranks, labels, pairs, regions) AS (
  SELECT run, 0, 1, list(rank ORDER BY rank), list(label ORDER BY rank), list(pair ORDER BY rank), list(region ORDER BY rank)
  FROM c2 JOIN v USING (run, rank) GROUP BY run
  UNION ALL SELECT run, CASE WHEN c.pos_no = c.m THEN phase + 1 ELSE phase END, CASE WHEN c.pos_no = c.m THEN 1 ELSE c.pos_no + 1 END,
    CASE WHEN t THEN list_append(ranks, c.rank) ELSE ranks END, CASE WHEN t THEN list_append(labels, ['alternate_region', 'alternate_primer_pair', 'alternate_probe'][phase + 1]) ELSE labels END,
    CASE WHEN t THEN list_append(pairs, c.pair) ELSE pairs END, CASE WHEN t THEN list_append(regions, c.region) ELSE regions END
  FROM (SELECT walk.*, c, len(ranks) < 10 AND NOT list_contains(pairs, c.pair) AND ({_TAKES}) AS t FROM walk JOIN v c ON c.run = walk.run AND c.pos_no = walk.pos_no WHERE phase < 3) z),
e AS (SELECT run, unnest(ranks) AS rank, unnest(labels) AS label FROM walk WHERE phase = 3),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rank) AS slot FROM e)
SELECT s.run, id, label FROM s JOIN v USING (run, rank) WHERE slot <= 10""")
def finalist_selection(spark, folder):
    return R.finalists(ranking(spark, folder), ["run"], 10).select("run", "id", "label")


_TWO = f"""{_CAND}, l AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY p_retailprice, id) AS rank FROM cand WHERE id % 10 <> 1),
r AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY p_size, id) AS rank FROM cand WHERE id % 10 <> 2)"""


def _two_runs(spark, folder):
    c = candidates(spark, folder)

    def side(col, gone):
        w = Window.partitionBy("run").orderBy(col, "id")
        return c.filter(F.col("id") % 10 != gone).select("run", "id", F.row_number().over(w).alias("rank"))

    return side("p_retailprice", 1), side("p_size", 2)


@query("rank_stability", f"""WITH {_TWO}, b AS (SELECT coalesce(l.run, r.run) AS run, l.rank AS l, r.rank AS r FROM l FULL JOIN r ON l.run = r.run AND l.id = r.id)
SELECT run, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)::BIGINT AS n_shared, count(*) FILTER (l IS NULL)::BIGINT AS n_added,
  count(*) FILTER (r IS NULL)::BIGINT AS n_removed, count(*) FILTER (l <= 10 AND r <= 10)::BIGINT AS top_overlap,
  round(1 - 6 * sum((l - r) * (l - r))::DOUBLE / (count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)::DOUBLE
    * (pow(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL), 2) - 1)), 6) AS spearman,
  round(count(*) FILTER (l <= 10 AND r <= 10) / (count(*) FILTER (l <= 10 OR r <= 10))::DOUBLE, 6) AS top_jaccard FROM b GROUP BY run""")
def rank_stability(spark, folder):
    left, right = _two_runs(spark, folder)
    out = R.rank_stability(left, right, ["run"], "id")
    return out.select("run", "n_shared", "n_added", "n_removed", "top_overlap", F.round("spearman", 6).alias("spearman"),
                      F.round("top_jaccard", 6).alias("top_jaccard"))


@query("rank_reversals", f"""WITH {_TWO}, b AS (SELECT l.run, l.id, l.rank AS l, r.rank AS r FROM l JOIN r ON l.run = r.run AND l.id = r.id)
SELECT x.run, count(*)::BIGINT AS n_pairs, count(*) FILTER ((x.l < y.l) <> (x.r < y.r))::BIGINT AS n_reversed
FROM b x JOIN b y ON x.run = y.run AND x.id < y.id GROUP BY 1""")
def rank_reversals(spark, folder):
    left, right = _two_runs(spark, folder)
    return R.reversed_pairs(left, right, ["run"], "id").select("run", "n_pairs", "n_reversed")


@query("run_comparison", f"""WITH {_TWO} SELECT coalesce(l.run, r.run) AS run, coalesce(l.id, r.id) AS id, l.rank::BIGINT AS left_rank, r.rank::BIGINT AS right_rank,
  (l.rank - r.rank)::BIGINT AS rank_shift, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' ELSE 'shared' END AS presence
FROM l FULL JOIN r ON l.run = r.run AND l.id = r.id""")
def run_comparison(spark, folder):
    left, right = _two_runs(spark, folder)
    both = left.withColumnRenamed("rank", "left_rank").join(right.withColumnRenamed("rank", "right_rank"), ["run", "id"], "full")
    presence = F.when(F.col("left_rank").isNull(), "added").when(F.col("right_rank").isNull(), "removed").otherwise("shared")
    return both.select("run", "id", "left_rank", "right_rank", (F.col("left_rank") - F.col("right_rank")).alias("rank_shift"),
                       presence.alias("presence"))


_EXPECT = "id % 6 = 0"


@query("ranking_benchmark", f"""WITH {_RANKED}, t AS (SELECT run, max(CASE WHEN {_EXPECT} AND rank <= 1 THEN 1 ELSE 0 END) AS top1,
  max(CASE WHEN {_EXPECT} AND rank <= 3 THEN 1 ELSE 0 END) AS top3, max(CASE WHEN rank = 1 AND hard_valid AND signal_subjects = 0 THEN 1 ELSE 0 END) AS clean,
  count(DISTINCT f_start // 250) FILTER (rank <= 3) AS regions FROM ranked GROUP BY run)
SELECT count(*)::BIGINT AS n, avg(top1) AS top1, avg(top3) AS top3, avg(clean) AS clean_top1, round(avg(regions), 6) AS mean_regions,
  round(greatest(0, ((avg(top3) + 3.8414588206941236::DOUBLE / (2 * count(*))) - 1.959963984540054::DOUBLE * sqrt(avg(top3) * (1 - avg(top3)) / count(*)
    + 3.8414588206941236::DOUBLE / (4 * count(*) * count(*)))) / (1 + 3.8414588206941236::DOUBLE / count(*))), 6) AS top3_low FROM t""")
def ranking_benchmark(spark, folder):
    hit = F.expr(_EXPECT)
    per = ranking(spark, folder).groupBy("run").agg(
        F.max(F.when(hit & (F.col("rank") <= 1), 1).otherwise(0)).alias("top1"),
        F.max(F.when(hit & (F.col("rank") <= 3), 1).otherwise(0)).alias("top3"),
        F.max(F.when((F.col("rank") == 1) & F.col("hard_valid") & (F.col("signal_subjects") == 0), 1).otherwise(0)).alias("clean"),
        F.countDistinct(F.when(F.col("rank") <= 3, F.floor(F.col("f_start") / 250))).alias("regions"))
    out = per.agg(F.count("*").alias("n"), F.avg("top1").alias("top1"), F.avg("top3").alias("top3"), F.sum("top3").alias("hits"),
                  F.avg("clean").alias("clean_top1"), F.round(F.avg("regions"), 6).alias("mean_regions"))
    low, _ = wilson_interval(F.col("hits"), F.col("n"))
    return out.withColumn("top3_low", F.round(low, 6)).drop("hits")


@query("pairwise_preference_accuracy", f"""WITH {_RANKED} SELECT g.run, count(*)::BIGINT AS pairs, count(*) FILTER (g.rank < b.rank)::BIGINT AS good
FROM ranked g JOIN ranked b ON g.run = b.run AND g.id % 6 = 0 AND b.id % 6 <> 0 GROUP BY 1""")
def pairwise_preference_accuracy(spark, folder):
    """Accepted-above-rejected pairs from one running count per run instead of a pair join."""
    good = F.expr(_EXPECT)
    w = Window.partitionBy("run").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    above = F.sum(F.when(good, 1).otherwise(0)).over(w)
    rows = ranking(spark, folder).withColumn("good_above", above).withColumn("good", good)
    out = rows.groupBy("run").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"),
                                  F.sum(F.when(~F.col("good"), F.col("good_above")).otherwise(0)).alias("good_pairs"))
    out = out.select("run", (F.col("g") * F.col("b")).alias("pairs"), F.col("good_pairs").alias("good"))
    return out.filter("pairs > 0")


@query("evidence_ablation", f"""WITH {_CAND}, x AS (SELECT * REPLACE (0 AS signal_subjects, 0 AS product_subjects,
  CASE WHEN p_size % 5 = 0 AND p_size % 2 = 1 THEN false ELSE true END AS hard_valid, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 1 THEN 1 ELSE 0 END AS n_failures) FROM cand)
SELECT run, arg_min(id, r)::BIGINT AS winner FROM (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY {_ORDER}) AS r FROM x) GROUP BY run""")
def evidence_ablation(spark, folder):
    """Winner per run once off-target evidence and its failures are taken away."""
    rows = candidates(spark, folder)
    names = F.when(F.col("n_failures") == 2, F.array(F.lit("offtarget_product"), F.lit("length"))).when(
        F.col("n_failures") == 1, F.array(F.lit("offtarget_product"))).otherwise(F.array().cast("array<string>"))
    out = R.ranked(R.keyed(R.ablate(rows.withColumn("failures", names), "specificity")), ["run"], ["f_start", "forward", "reverse", "id"])
    return out.filter("rank = 1").select("run", F.col("id").alias("winner"))


def _noise_sql(label):
    return f"""(2 * ('0x' || sha256(run || '|' || id || '|' || k || '|{label}')[1:12])::BIGINT::DOUBLE / {float(16 ** 12 - 1):.1f}::DOUBLE - 1)"""


@query("perturbation_stability", f"""WITH {_RANKED}, k AS (SELECT r.* REPLACE (
  least(1, greatest(0, target_coverage + 0.003::DOUBLE * {_noise_sql('coverage')})) AS target_coverage,
  least(1, greatest(0, worst_3prime + 0.005::DOUBLE * {_noise_sql('3prime')})) AS worst_3prime,
  least(1, greatest(0, probe_identity + 0.003::DOUBLE * {_noise_sql('probe')})) AS probe_identity,
  least(1, greatest(0, robustness + 0.03::DOUBLE * {_noise_sql('robust')})) AS robustness,
  greatest(0, triplet_penalty + 0.25::DOUBLE * {_noise_sql('triplet')}) AS triplet_penalty,
  greatest(0, practical_penalty + 0.15::DOUBLE * {_noise_sql('practical')}) AS practical_penalty), k FROM ranked r, range(0, 4) t(k)),
w AS (SELECT run, k, id FROM (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY {_ORDER}) AS rr FROM k) WHERE rr = 1)
SELECT w.run, avg(CASE WHEN w.id = b.id THEN 1 ELSE 0 END) AS stable_fraction FROM w JOIN ranked b ON b.run = w.run AND b.rank = 1 GROUP BY 1""")
def perturbation_stability(spark, folder):
    rows = ranking(spark, folder).withColumnRenamed("rank", "base")
    noisy = R.perturb(rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))), "run", "id", "k")
    won = R.ranked(R.keyed(noisy), ["run", "k"], ["f_start", "forward", "reverse", "id"]).filter("rank = 1")
    return won.groupBy("run").agg(F.avg((F.col("base") == 1).cast("int")).alias("stable_fraction"))


@query("wrong_winner_categories", f"""WITH {_RANKED} SELECT CASE WHEN NOT hard_valid THEN 'hard_invalid_winner' WHEN signal_subjects > 0 THEN 'signal_offtarget_winner'
  WHEN target_coverage < 1 THEN 'coverage_tradeoff' ELSE 'soft_or_tie_break_ordering' END AS category, count(*)::BIGINT AS n
FROM ranked WHERE rank = 1 AND NOT ({_EXPECT}) GROUP BY 1""")
def wrong_winner_categories(spark, folder):
    c = F.col
    category = (F.when(~c("hard_valid"), "hard_invalid_winner").when(c("signal_subjects") > 0, "signal_offtarget_winner")
                .when(c("target_coverage") < 1, "coverage_tradeoff").otherwise("soft_or_tie_break_ordering"))
    return (ranking(spark, folder).filter((c("rank") == 1) & ~F.expr(_EXPECT))
            .groupBy(category.alias("category")).agg(F.count("*").alias("n")))


@query("candidate_diversity", f"""WITH {_CAND} SELECT run, count(*)::BIGINT AS n, count(DISTINCT (forward, reverse))::BIGINT AS unique_pairs,
  count(DISTINCT f_start // 250)::BIGINT AS regions FROM cand GROUP BY run""")
def candidate_diversity(spark, folder):
    return candidates(spark, folder).groupBy("run").agg(
        F.count("*").alias("n"), F.countDistinct("forward", "reverse").alias("unique_pairs"),
        F.countDistinct(F.floor(F.col("f_start") / 250)).alias("regions"))


@query("candidate_ids", """SELECT p_partkey, 'cand_' || left(sha256(upper(p_brand) || '|' || upper(p_type) || '|' || upper(p_name)), 20) AS candidate_id,
  sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey || '}') AS content FROM part""")
def candidate_ids(spark, folder):
    from ..operators.records import candidate_id, content_hash
    part = table(spark, folder, "part")
    return part.select("p_partkey", candidate_id(F.upper("p_brand"), F.upper("p_type"), F.upper("p_name")).alias("candidate_id"),
                       content_hash(["p_partkey", "p_name", "p_brand"]).alias("content"))
