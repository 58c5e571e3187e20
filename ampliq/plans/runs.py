"""Run analytics: traces, melts, standard curves, detection limits, expression, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as X
from ..operators import quant as Q
from ..operators import traces as T
from ..session import spread, table
from .registry import query

_TRACES = """traces AS (
  SELECT c_custkey AS well, k::DOUBLE AS cycle, 50 + 2 * k::DOUBLE / 45
    + CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1000 / (1 + exp(-0.6::DOUBLE * (k - (20 + c_custkey % 15)))) END
    + ((c_custkey * k) % 7) / 10.0::DOUBLE AS fluor
  FROM customer, range(1, 46) r(k))"""


def traces(spark, folder):
    wells = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    k = F.col("k").cast("double")
    logistic = F.when(F.col("c_custkey") % 11 == 0, 0.0).otherwise(
        1000.0 / (1.0 + F.exp(-0.6 * (k - (20 + F.col("c_custkey") % 15)))))
    one = wells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(45))))
    return one.select(F.col("c_custkey").alias("well"), k.alias("cycle"),
                      (50.0 + 2.0 * k / 45.0 + logistic + (F.col("c_custkey") * F.col("k")) % 7 / 10.0).alias("fluor"))


_BASE = f"""WITH {_TRACES}, b AS (
  SELECT well, regr_slope(fluor, cycle) AS slope, avg(fluor) AS ym, avg(cycle) AS xm
  FROM traces WHERE cycle BETWEEN 3 AND 15 GROUP BY well),
r AS (SELECT t.well, t.cycle, (t.cycle - 1)::BIGINT AS k, fluor - (ym + slope * (t.cycle - xm)) AS resid, slope, ym
  FROM traces t JOIN b USING (well)),
z AS (SELECT well, stddev_samp(resid) AS noise FROM r WHERE cycle BETWEEN 3 AND 15 GROUP BY well),
n AS (SELECT r.*, noise, greatest(10 * noise, 1e-12) AS thr,
  min(resid) OVER (PARTITION BY well ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS low3,
  lag(resid) OVER (PARTITION BY well ORDER BY cycle) AS prev FROM r JOIN z USING (well)),
s1 AS (SELECT *, CASE WHEN k IN (0, 44) THEN resid ELSE (lag(resid) OVER w + resid + lead(resid) OVER w) / 3 END AS y1
  FROM n WINDOW w AS (PARTITION BY well ORDER BY cycle)),
s2 AS (SELECT *, CASE WHEN k IN (0, 44) THEN y1 ELSE (lag(y1) OVER w + y1 + lead(y1) OVER w) / 3 END AS y
  FROM s1 WINDOW w AS (PARTITION BY well ORDER BY cycle)),
s3 AS (SELECT *, lag(y) OVER w - 2 * y + lead(y) OVER w AS d2 FROM s2 WINDOW w AS (PARTITION BY well ORDER BY cycle)),
s4 AS (SELECT *, CASE WHEN d2 > 0 THEN CASE WHEN (lag(d2) OVER w - 2 * d2 + lead(d2) OVER w) IS NULL THEN cycle ELSE
    cycle + 0.5::DOUBLE * (lag(d2) OVER w - lead(d2) OVER w) / (lag(d2) OVER w - 2 * d2 + lead(d2) OVER w) END END AS vertex
  FROM s3 WINDOW w AS (PARTITION BY well ORDER BY cycle)),
hit AS (SELECT well, min(k) AS k FROM n WHERE k >= 15 AND k <= 42 AND low3 >= thr GROUP BY well),
cq AS (SELECT n.well, cycle - 1 + CASE WHEN prev > 0
    THEN (log10(thr) - log10(prev)) / (log10(resid) - log10(prev)) ELSE (thr - prev) / (resid - prev) END AS raw
  FROM n JOIN hit ON n.well = hit.well AND n.k = hit.k),
sdm AS (SELECT well, arg_max(vertex, (d2, -k)) FILTER (d2 IS NOT NULL) AS sdm FROM s4 GROUP BY well),
g AS (SELECT well, max(thr) AS threshold, max(noise) AS noise, max(slope) AS baseline_slope, max(ym) AS baseline_fluor,
  max(resid) FILTER (k >= 15) - min(resid) FILTER (k >= 15) AS amplitude,
  count(*) FILTER (k > 15 AND resid > prev) / 29::DOUBLE AS rise_fraction,
  avg(resid) FILTER (k >= 41) AS tail FROM n GROUP BY well),
a AS (SELECT g.*, raw, sdm, coalesce(raw IS NOT NULL AND amplitude >= greatest(10 * noise, 3 * threshold)
  AND tail >= greatest(1.5 * threshold, 5 * noise) AND rise_fraction >= 0.45, false) AS amplified
  FROM g LEFT JOIN cq USING (well) LEFT JOIN sdm USING (well))
"""


@query("cq_calls", _BASE + """SELECT well, amplified, round(CASE WHEN amplified THEN raw END, 4) AS cq_threshold,
  round(CASE WHEN amplified THEN sdm END, 4) AS cq_sdm, round(amplitude, 3) AS amplitude,
  round(rise_fraction, 4) AS rise_fraction FROM a""")
def cq_calls(spark, folder):
    out = T.call_cq(traces(spark, folder), ["well"])
    return out.select("well", "amplified", F.round("cq_threshold", 4).alias("cq_threshold"),
                      F.round("cq_sdm", 4).alias("cq_sdm"), F.round("amplitude", 3).alias("amplitude"),
                      F.round("rise_fraction", 4).alias("rise_fraction"))


@query("trace_baselines", _BASE + """SELECT well, round(baseline_fluor, 4) AS baseline_fluor,
  round(baseline_slope, 6) AS baseline_slope, round(noise, 6) AS noise, round(threshold, 5) AS threshold FROM a""")
def trace_baselines(spark, folder):
    out = T.call_cq(traces(spark, folder), ["well"])
    return out.select("well", F.round("baseline_fluor", 4).alias("baseline_fluor"),
                      F.round("baseline_slope", 6).alias("baseline_slope"), F.round("noise", 6).alias("noise"),
                      F.round("threshold", 5).alias("threshold"))


@query("trace_arrays", """WITH x AS (SELECT user_id || ':' || event_type AS well, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS cycle FROM events)
SELECT well, CASE WHEN count(*) < 6 THEN 'need >= 6 cycles of fluorescence' ELSE 'ok' END AS state,
  round(sum(cycle * value), 3) AS moment FROM x GROUP BY well""")
def trace_arrays(spark, folder):
    """Array-shaped wells back to readings, with short wells flagged; the readings of a user and kind of event are a well."""
    events = table(spark, folder, "events")
    wells = (events.groupBy(F.concat_ws(":", "user_id", "event_type").alias("well"))
             .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
             .select("well", F.col("r.value").alias("fluor")))
    rows = T.explode_traces(wells, ["well"])
    bad = T.trace_errors(rows, ["well"])
    moment = rows.groupBy("well").agg(F.round(F.sum(F.col("cycle") * F.col("fluor")), 3).alias("moment"))
    return moment.join(bad, "well", "left").select("well", F.coalesce("error", F.lit("ok")).alias("state"), "moment")


_MELTS = """melts AS (SELECT c_custkey AS well, 65 + 0.5::DOUBLE * i AS temp, i AS k,
    1000 / (1 + exp((65 + 0.5::DOUBLE * i - (78 + c_custkey % 9)) / 0.7::DOUBLE))
    + CASE WHEN c_custkey % 5 = 0 THEN 500 / (1 + exp((65 + 0.5::DOUBLE * i - (72 + c_custkey % 9)) / 0.7::DOUBLE)) ELSE 0 END AS fluor
  FROM customer, range(0, 61) r(i))"""

_PEAKS = f"""WITH {_MELTS},
m1 AS (SELECT *, CASE WHEN k IN (0, 60) THEN fluor ELSE (lag(fluor) OVER w + fluor + lead(fluor) OVER w) / 3 END AS y1
  FROM melts WINDOW w AS (PARTITION BY well ORDER BY k)),
m2 AS (SELECT *, CASE WHEN k IN (0, 60) THEN y1 ELSE (lag(y1) OVER w + y1 + lead(y1) OVER w) / 3 END AS y
  FROM m1 WINDOW w AS (PARTITION BY well ORDER BY k)),
m3 AS (SELECT *, CASE WHEN k IN (0, 60) THEN 0 ELSE -(lead(y) OVER w - lag(y) OVER w) END AS d
  FROM m2 WINDOW w AS (PARTITION BY well ORDER BY k)),
m4 AS (SELECT *, max(d) OVER (PARTITION BY well) AS dmax, lag(d, 1) OVER w AS a1, lead(d, 1) OVER w AS b1,
  lag(d, 2) OVER w AS a2, lead(d, 2) OVER w AS b2 FROM m3 WINDOW w AS (PARTITION BY well ORDER BY k)),
peaks AS (SELECT well, k, round(temp + CASE WHEN a1 - 2 * d + b1 = 0 OR abs(0.5::DOUBLE * (a1 - b1) / (a1 - 2 * d + b1)) > 1 THEN 0
    ELSE 0.5::DOUBLE * (a1 - b1) / (a1 - 2 * d + b1) * 0.5::DOUBLE END, 2) AS tm, round(d, 4) AS height FROM m4
  WHERE dmax > 0 AND d >= 0.1::DOUBLE * dmax AND d >= a1 AND d >= b1 AND d > a2 AND d > b2 AND k BETWEEN 2 AND 58)
"""


def melts(spark, folder):
    wells = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    t = 65.0 + 0.5 * F.col("i")
    main = 1000.0 / (1.0 + F.exp((t - (78 + F.col("c_custkey") % 9)) / 0.7))
    side = F.when(F.col("c_custkey") % 5 == 0, 500.0 / (1.0 + F.exp((t - (72 + F.col("c_custkey") % 9)) / 0.7))).otherwise(0.0)
    return (wells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(60))))
            .select(F.col("c_custkey").alias("well"), t.alias("temp"), (main + side).alias("fluor")))


@query("melt_peaks", _PEAKS + "SELECT well, k::BIGINT AS k, tm, height FROM peaks")
def melt_peaks(spark, folder):
    return T.melt_peaks(melts(spark, folder), ["well"])


@query("melt_products", _PEAKS + """, kept AS (SELECT p.* FROM peaks p WHERE NOT EXISTS (
    SELECT 1 FROM peaks q WHERE q.well = p.well AND q.height > p.height AND abs(q.tm - p.tm) <= 0.8))
SELECT well, count(*)::BIGINT AS n_peaks, arg_max(tm, height) AS dominant_tm, count(*) = 1 AS single_product FROM kept GROUP BY well""")
def melt_products(spark, folder):
    return T.merge_peaks(T.melt_peaks(melts(spark, folder), ["well"]), ["well"]).drop("peaks")


_STANDARDS = """standards AS (SELECT l_suppkey AS assay_id, pow(10::DOUBLE, l_linenumber) AS quantity,
  CASE WHEN NOT (l_linenumber <= 2 AND l_returnflag = 'R') THEN 40 - 3.3::DOUBLE * l_linenumber + (l_discount - 0.05::DOUBLE) END AS cq
  FROM lineitem)"""

_LEVELS = f"""WITH {_STANDARDS}, levels AS (SELECT assay_id, quantity, log10(quantity) AS x, count(*) AS n, count(cq) AS detected,
  avg(cq) AS mean_cq, stddev_samp(cq) AS sd_cq FROM standards GROUP BY 1, 2, 3)"""


def standards(spark, folder):
    li = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_discount")
    missed = (F.col("l_linenumber") <= 2) & (F.col("l_returnflag") == "R")
    return li.select(F.col("l_suppkey").alias("assay_id"), F.pow(F.lit(10.0), F.col("l_linenumber")).alias("quantity"),
                     F.when(~missed, 40.0 - 3.3 * F.col("l_linenumber") + (F.col("l_discount") - 0.05)).alias("cq"))


@query("standard_levels", _LEVELS + """ SELECT assay_id, quantity, n::BIGINT AS n, detected::BIGINT AS detected,
  round(mean_cq, 4) AS mean_cq, round(CASE WHEN detected > 1 THEN sd_cq END, 4) AS sd_cq,
  round(100.0::DOUBLE * detected / n, 4) AS detection_rate FROM levels""")
def standard_levels(spark, folder):
    out = Q.level_table(standards(spark, folder), ["assay_id"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean_cq", "sd_cq", "detection_rate")})


_T = "[" + ", ".join(f"{t}::DOUBLE" for t in Q.T975) + "]"


@query("standard_curves", _LEVELS + f""", c AS (SELECT assay_id, count(mean_cq) AS k, sum(n) AS obs, sum(detected) AS det,
  regr_slope(mean_cq, x) AS slope, regr_intercept(mean_cq, x) AS intercept, regr_sxx(mean_cq, x) AS sxx,
  regr_syy(mean_cq, x) AS syy, regr_sxy(mean_cq, x) AS sxy, min(quantity) FILTER (detected = n) AS lowest FROM levels GROUP BY 1),
d AS (SELECT *, greatest(syy - sxy * sxy / sxx, 0) AS ss FROM c WHERE k >= 2 AND sxx > 0),
e AS (SELECT *, 1 - ss / syy AS r2, CASE WHEN k >= 3 THEN sqrt(ss / (k - 2) / sxx) END AS se FROM d)
SELECT assay_id, k::BIGINT AS n_levels, obs::BIGINT AS n_observations, det::BIGINT AS n_detected, round(slope, 4) AS slope,
  round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(se, 5) AS slope_se,
  round(CASE WHEN slope < -0.25 AND -1 / slope <= 4 THEN pow(10::DOUBLE, -1 / slope) - 1 END, 5) AS efficiency,
  round(slope - {_T}[(k - 2)::BIGINT] * se, 4) AS slope_low, r2 >= 0.98 AS r2_ok,
  slope BETWEEN -3.58 AND -3.10 AS slope_ok, lowest AS lowest_fully_detected FROM e""")
def standard_curves(spark, folder):
    out = Q.standard_curve(standards(spark, folder), ["assay_id"])
    return out.select("assay_id", "n_levels", "n_observations", "n_detected", F.round("slope", 4).alias("slope"),
                      F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"),
                      F.round("slope_se", 5).alias("slope_se"), F.round("efficiency", 5).alias("efficiency"),
                      F.round("slope_low", 4).alias("slope_low"), "r2_ok", "slope_ok", "lowest_fully_detected")


@query("detection_limits", f"""WITH RECURSIVE {_STANDARDS}, pts AS (
  SELECT assay_id, log10(quantity) AS x, CASE WHEN cq IS NULL THEN 0 ELSE 1 END AS y FROM standards),
m AS (SELECT assay_id, avg(x) AS mx, stddev_pop(x) AS sx, min(x) AS xmin, max(x) AS xmax, count(*) AS n, sum(y) AS hits FROM pts GROUP BY 1),
z AS (SELECT p.assay_id, (x - mx) / sx AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM pts p JOIN m USING (assay_id) GROUP BY 1, 2),
fit(assay_id, it, b0, b1) AS (SELECT assay_id, 0, 0::DOUBLE, 0::DOUBLE FROM m
  UNION ALL SELECT assay_id, it + 1, b0 + CASE WHEN flat THEN 0 ELSE (h11 * g0 - h01 * g1) / det END,
    b1 + CASE WHEN flat THEN 0 ELSE (h00 * g1 - h01 * g0) / det END FROM (
    SELECT *, h00 * h11 - h01 * h01 AS det, abs(h00 * h11 - h01 * h01) < 1e-12 AS flat FROM (
    SELECT f.assay_id, it, b0, b1, sum(y - n * p) AS g0, sum((y - n * p) * z) AS g1, sum(n * p * (1 - p)) AS h00,
      sum(n * p * (1 - p) * z) AS h01, sum(n * p * (1 - p) * z * z) AS h11
    FROM (SELECT f.*, z.z, z.n, z.y, 1 / (1 + exp(-(b0 + b1 * z.z))) AS p FROM fit f JOIN z USING (assay_id) WHERE it < 60) f
    GROUP BY 1, 2, 3, 4))),
last AS (SELECT assay_id, b0, b1 FROM fit WHERE it = 60),
o AS (SELECT m.assay_id, n, hits, xmin, xmax, b1, (ln(19::DOUBLE) - b0) / b1 * sx + mx AS x95 FROM last JOIN m USING (assay_id))
SELECT assay_id, n::BIGINT AS n_calls, CASE WHEN n >= 4 AND hits BETWEEN 1 AND n - 1 AND b1 > 0 AND x95 BETWEEN xmin - 1 AND xmax + 1
  THEN round(x95, 4) END AS log10_lod95 FROM o""")
def detection_limits(spark, folder):
    out = Q.detection_limit(standards(spark, folder), ["assay_id"])
    return out.select("assay_id", "n_calls", F.round("log10_lod95", 4).alias("log10_lod95"))


@query("standard_point_rejects", """SELECT l_linestatus AS run, CASE WHEN l_quantity - 5 <= 0
    THEN 'quantity_not_positive'
    ELSE 'cq_out_of_range' END AS error, count(*)::BIGINT AS points
FROM lineitem WHERE l_quantity - 5 <= 0 OR l_extendedprice / 1000 > 80 OR l_extendedprice / 1000 <= 0 GROUP BY 1, 2""")
def standard_point_rejects(spark, folder):
    pts = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("run"), (F.col("l_quantity") - 5).alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("cq"))
    return (pts.withColumn("error", Q.point_errors(pts)).filter("error is not null")
            .groupBy("run", "error").agg(F.count("*").alias("points")))


@query("copy_numbers", """SELECT p_partkey, p_size::BIGINT AS length, kind,
  round(log10(p_retailprice * 1e-9 / (p_size * mw) * 6.02214076e23), 6) AS log10_copies,
  round(p_retailprice / 6.02214076e23 * p_size * mw / 1e-9 * 1e15, 2) AS femto_ng FROM (
  SELECT *, CASE kind WHEN 'dsDNA' THEN 650.0::DOUBLE WHEN 'ssDNA' THEN 330.0::DOUBLE ELSE 340.0::DOUBLE END AS mw FROM (
    SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'dsDNA' WHEN 1 THEN 'ssDNA' ELSE 'RNA' END AS kind FROM part))""")
def copy_numbers(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("length"), "p_retailprice")
    kind = F.element_at(F.array(F.lit("dsDNA"), F.lit("ssDNA"), F.lit("RNA")), (F.col("p_partkey") % 3 + 1).cast("int"))
    part = part.withColumn("kind", kind)
    return part.select("p_partkey", "length", "kind",
                       F.round(F.log10(Q.copies_per_ul(F.col("p_retailprice"), F.col("length"), F.col("kind"))), 6).alias("log10_copies"),
                       F.round(Q.ng_for_copies(F.col("p_retailprice"), F.col("length"), F.col("kind")) * 1e15, 2).alias("femto_ng"))


@query("dilution_series", """SELECT p_partkey, i::BIGINT AS step, round(p_retailprice / pow(10::DOUBLE, i), 8) AS copies
FROM part, range(0, 6) r(i)""")
def dilution_series(spark, folder):
    out = Q.dilution_series(table(spark, folder, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return out.select("p_partkey", "step", F.round("copies", 8).alias("copies"))


_CQ = """cq AS (SELECT user_id AS sample, user_id % 3 AS grp, event_type AS gene, 20 + avg(value) / 100 AS cq
  FROM events GROUP BY user_id, event_type)"""


def cq_table(spark, folder):
    ev = table(spark, folder, "events").select("user_id", "event_type", "value")
    return ev.groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("gene")).agg(
        (20.0 + F.avg("value") / 100.0).alias("cq")).withColumn("grp", F.col("sample") % 3)


_DCQ = f"""WITH {_CQ}, r AS (SELECT sample, grp, avg(cq) AS ref FROM cq WHERE gene IN ('view', 'click') GROUP BY 1, 2 HAVING count(*) = 2),
d AS (SELECT sample, grp, gene AS target, cq - ref AS dcq FROM cq JOIN r USING (sample, grp) WHERE gene NOT IN ('view', 'click')),
g AS (SELECT target, grp, count(*) AS n, avg(dcq) AS mean_dcq, CASE WHEN count(*) > 1 THEN stddev_samp(dcq) ELSE 0 END AS sd_dcq FROM d GROUP BY 1, 2)"""


@query("relative_quantities", _DCQ + " SELECT sample, grp, target, round(dcq, 6) AS dcq FROM d")
def relative_quantities(spark, folder):
    out = X.relative_quantities(cq_table(spark, folder), ["view", "click"], [])
    return out.select("sample", "grp", "target", F.round("dcq", 6).alias("dcq"))


@query("fold_changes", _DCQ + """ SELECT g.target, g.grp, g.n::BIGINT AS n, round(g.mean_dcq, 6) AS mean_dcq, round(g.sd_dcq, 6) AS sd_dcq,
  round(g.mean_dcq - c.mean_dcq, 6) AS ddcq, round(pow(2::DOUBLE, c.mean_dcq - g.mean_dcq), 6) AS fold_livak,
  round(pow(2::DOUBLE, -(g.mean_dcq - c.mean_dcq + g.sd_dcq)), 6) AS fold_low,
  round(pow(2::DOUBLE, -(g.mean_dcq - c.mean_dcq - g.sd_dcq)), 6) AS fold_high, g.n < 3 AS low_n
FROM g JOIN g c ON g.target = c.target AND c.grp = 0""")
def fold_changes(spark, folder):
    q = X.relative_quantities(cq_table(spark, folder), ["view", "click"], [])
    out = X.fold_changes(q, [], 0)
    return out.select("target", "grp", "n", "low_n", *[F.round(c, 6).alias(c) for c in (
        "mean_dcq", "sd_dcq", "ddcq", "fold_livak", "fold_low", "fold_high")])


_EFF = {"view": 95.0, "click": 102.0, "purchase": 90.0, "error": 88.0}


@query("efficiency_corrected_folds", f"""WITH {_CQ}, q AS (SELECT *, -cq * ln(1 + CASE gene {' '.join(
    f"WHEN '{g}' THEN {e}::DOUBLE" for g, e in _EFF.items())} ELSE 100 END / 100) AS lnq FROM cq),
r AS (SELECT sample, grp, avg(lnq) AS ref FROM q WHERE gene IN ('view', 'click') GROUP BY 1, 2 HAVING count(*) = 2),
g AS (SELECT gene AS target, grp, avg(lnq - ref) AS m FROM q JOIN r USING (sample, grp) WHERE gene NOT IN ('view', 'click') GROUP BY 1, 2)
SELECT g.target, g.grp, round(exp(g.m - c.m), 6) AS fold_pfaffl FROM g JOIN g c ON g.target = c.target AND c.grp = 0""")
def efficiency_corrected_folds(spark, folder):
    q = X.relative_quantities(cq_table(spark, folder), ["view", "click"], [], efficiencies=_EFF)
    return X.fold_changes(q, [], 0).select("target", "grp", F.round("fold_pfaffl", 6).alias("fold_pfaffl"))


@query("gene_dispersion", f"""WITH {_CQ} SELECT gene, round(avg(cq), 6) AS cq_mean, round(stddev_samp(cq), 6) AS cq_sd,
  round(100 * stddev_samp(cq) / avg(cq), 6) AS cq_cv, CASE WHEN stddev_samp(cq) > 1 THEN 'review (SD > 1 Cq)' ELSE 'within 1 Cq' END AS screen
FROM cq GROUP BY gene""")
def gene_dispersion(spark, folder):
    out = X.gene_dispersion(cq_table(spark, folder), [])
    return out.select("gene", "screen", *[F.round(c, 6).alias(c) for c in ("cq_mean", "cq_sd", "cq_cv")])


_FULL = f"""WITH {_CQ}, full_s AS (SELECT sample FROM cq GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT gene) FROM cq)),
c AS (SELECT grp, sample, gene, -cq AS lq FROM cq WHERE sample IN (SELECT sample FROM full_s)),
v AS (SELECT a.grp, a.gene, b.gene AS other, stddev_samp(a.lq - b.lq) AS v FROM c a JOIN c b ON a.sample = b.sample AND a.gene <> b.gene GROUP BY 1, 2, 3)"""


def _stable_cq(spark, folder):
    cq = X.complete_samples(cq_table(spark, folder), [])
    return cq.withColumn("lq", X.log2_quantity(F.col("cq")))


@query("pairwise_gene_variation", _FULL + " SELECT grp, gene, other, round(v, 6) AS v FROM v")
def pairwise_gene_variation(spark, folder):
    out = X.pairwise_variation(_stable_cq(spark, folder), ["grp"])
    return out.withColumn("v", F.round("v", 6))


def _rounds(n):
    steps = ["m0 AS (SELECT grp, gene, avg(v) AS m FROM v GROUP BY 1, 2)",
             "w0 AS (SELECT grp, max((m, gene))[2] AS gene, max((m, gene))[1] AS m FROM m0 GROUP BY grp)"]
    for i in range(1, n):
        gone = " AND ".join(f"NOT EXISTS (SELECT 1 FROM w{j} w WHERE w.grp = v.grp AND w.gene IN (v.gene, v.other))" for j in range(i))
        steps.append(f"m{i} AS (SELECT grp, gene, avg(v) AS m FROM v WHERE {gone} GROUP BY 1, 2)")
        steps.append(f"w{i} AS (SELECT grp, max((m, gene))[2] AS gene, max((m, gene))[1] AS m FROM m{i} GROUP BY grp)")
    return ", ".join(steps)


_GENES = 5


@query("reference_gene_ranking", _FULL + ", " + _rounds(_GENES - 1) + " SELECT grp, gene, place::BIGINT AS place, round(m, 6) AS m FROM ("
       + " UNION ALL ".join(f"SELECT grp, gene, {_GENES - i} AS place, m FROM w{i}" for i in range(_GENES - 2))
       + f" UNION ALL SELECT grp, gene, 1, m FROM m{_GENES - 2})")
def reference_gene_ranking(spark, folder):
    v = X.pairwise_variation(_stable_cq(spark, folder), ["grp"])
    out = X.stability_ranking(v, ["grp"])
    return out.select("grp", "gene", "place", F.round("m", 6).alias("m"))


@query("normalisation_panel_size", _FULL + ", " + _rounds(_GENES - 1) + ", ranked AS (SELECT grp, gene, row_number() OVER (PARTITION BY grp ORDER BY place, gene) AS ix FROM ("
       + " UNION ALL ".join(f"SELECT grp, gene, {_GENES - i} AS place FROM w{i}" for i in range(_GENES - 2))
       + f" UNION ALL SELECT grp, gene, 1 FROM m{_GENES - 2}))" + """, nf AS (SELECT *, avg(lq) OVER (PARTITION BY grp, sample ORDER BY ix) AS nf
  FROM c JOIN ranked USING (grp, gene)), nx AS (SELECT *, lead(nf) OVER (PARTITION BY grp, sample ORDER BY ix) AS nn FROM nf)
SELECT grp, ix::BIGINT AS n, round(stddev_samp(nf - nn), 6) AS v FROM nx WHERE ix >= 2 AND nn IS NOT NULL GROUP BY 1, 2""")
def normalisation_panel_size(spark, folder):
    cq = _stable_cq(spark, folder)
    ranking = X.stability_ranking(X.pairwise_variation(cq, ["grp"]), ["grp"])
    out = X.panel_size_variation(cq, ranking, ["grp"])
    return out.select("grp", "n", F.round("v", 6).alias("v"))
