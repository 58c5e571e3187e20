"""Design queries: primer gates, pairs, probes, beams, evidence gates and redesign."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo as T
from ..operators import design as D
from ..operators import evidence as E
from ..operators import placement as B
from ..operators import redesign as RD
from ..operators import tallies as TL
from ..operators import window_gates as W
from ..operators.sites import find_sites
from ..operators.products import junction_relation
from ..operators.corpus import running_offsets
from ..session import spread, table
from ..sources.profiles import chemistry, objective
from . import shapes as X
from .oligos import nn_sql, tm_sql
from .ranking import _CAND, candidates
from .registry import query
from .sites import _PLACED

SHORT = chemistry("sybr_generic", len_min=12, len_max=13, gc_min=20.0, gc_max=80.0, tm_min=20.0, tm_max=60.0, tm_opt=40.0,
                  amp_min=20, amp_max=75, min_probe_gap=0, pair_tm_gap_max=5.0, max_3prime_gc=4, max_any_run=4,
                  no_three_prime_t=True, probe_offset_min=-30.0, probe_offset_max=20.0)

_RUN = "list_max(list_transform(regexp_extract_all(oligo, 'A+|C+|G+|T+'), lambda x: length(x)))"
_GRUN = "coalesce(list_max(list_transform(regexp_extract_all(oligo, 'G+'), lambda x: length(x))), 0)"


def _gate_sql(source, key, c, len_min, len_max):
    """CTE ``gated(key, start, end, strand, oligo, tm, rejection)`` over windows of ``source(key, t)``."""
    t = "AND right(oligo, 1) = 'T'" if c["no_three_prime_t"] else "AND false"
    return f"""w AS (SELECT {key}, i AS s, i + k AS e, substr(t, i + 1, k) AS g FROM (SELECT {key}, t, i, unnest(generate_series({len_min}, least({len_max}, length(t) - i))) AS k
    FROM (SELECT {key}, t, unnest(generate_series(0, length(t) - {len_min})) AS i FROM {source}))),
wins AS (SELECT {key}, s, e, '+' AS strand, g AS oligo FROM w UNION ALL SELECT {key}, s, e, '-', reverse(translate(g, 'ACGT', 'TGCA')) FROM w),
uniq AS (SELECT DISTINCT oligo FROM wins), {nn_sql('uniq', 'oligo', 'oligo')}, {tm_sql()},
gated AS (SELECT wins.*, melt.tm, CASE WHEN 100.0::DOUBLE * melt.gc NOT BETWEEN {c['gc_min']} AND {c['gc_max']} THEN 'gc'
  WHEN melt.tm NOT BETWEEN {c['tm_min']} AND {c['tm_max']} THEN 'tm' WHEN true {t} THEN 'three_prime_T'
  WHEN length(translate(right(oligo, 5), 'AT', '')) > {c['max_3prime_gc']} THEN 'three_prime_gc'
  WHEN {_GRUN} >= {c['max_g_run']} THEN 'g_run' WHEN {_RUN} >= {c['max_any_run']} THEN 'homopolymer' END AS rejection
  FROM wins JOIN melt USING (oligo))"""


_DOC_C = chemistry("parasite_sybr")


@query("primer_gate_attrition", f"""WITH {X.SUBJECTS}, src AS (SELECT doc_id, grp, seq AS t FROM subjects), {_gate_sql('src', 'grp', _DOC_C, 18, 18)}
SELECT grp, strand, coalesce(rejection, 'retained') AS outcome, count(*)::BIGINT AS n FROM gated GROUP BY 1, 2, 3""")
def primer_gate_attrition(spark, folder):
    return W.window_attrition(X.subjects(spark, folder), ["grp"], "seq", 18, 18, _DOC_C)


_PRIMERS = f"{X.TEMPLATES}, {_gate_sql('templates', 'item_id', SHORT, 12, 13)}, primers AS (SELECT * FROM gated WHERE rejection IS NULL)"


def primers(spark, folder):
    wins = D.enumerate_windows(spread(X.templates(spark, folder), "item_id"), ["item_id"], "t", 12, 13)
    passed = wins.filter(D.primer_rejection(F.col("oligo"), SHORT, structure=False).isNull())
    return passed.withColumn("tm", T.melting_temperature(F.col("oligo")))


_PAIRS = f"""{_PRIMERS}, pairs AS (SELECT f.item_id, f.s AS f_start, f.e AS f_end, r.s AS r_start, r.e AS r_end, f.oligo AS forward, r.oligo AS reverse,
  r.e - f.s AS amplicon, abs(f.tm - r.tm) AS gap, f.tm AS f_tm, r.tm AS r_tm, abs((f.tm + r.tm) / 2 - 40) + abs(f.tm - r.tm) AS score FROM primers f JOIN primers r
  ON f.item_id = r.item_id AND f.strand = '+' AND r.strand = '-' AND r.e - f.s BETWEEN 20 AND 75 AND r.s >= f.e AND abs(f.tm - r.tm) <= 5)"""


def pairs(spark, folder):
    return D.pair_primers(primers(spark, folder), ["item_id"], SHORT, dimers=False)


@query("primer_pairs", f"WITH {_PAIRS} SELECT item_id, f_start::BIGINT AS f_start, r_end::BIGINT AS r_end, forward, reverse, amplicon::BIGINT AS amplicon, round(score, 4) AS score FROM pairs")
def primer_pairs(spark, folder):
    return pairs(spark, folder).select("item_id", "f_start", "r_end", "forward", "reverse", "amplicon", F.round("score", 4).alias("score"))


@query("top_primer_pairs", f"""WITH {_PAIRS} SELECT item_id, rn::BIGINT AS rn, forward, reverse FROM (SELECT *, row_number() OVER (PARTITION BY item_id
  ORDER BY round(score, 6), forward, reverse, f_start, r_end) AS rn FROM pairs) WHERE rn <= 10""")
def top_primer_pairs(spark, folder):
    order = [F.round("score", 6), F.col("forward"), F.col("reverse"), F.col("f_start"), F.col("r_end")]
    top = D.top_per_key(pairs(spark, folder), ["item_id"], order, 10)
    w = Window.partitionBy("item_id").orderBy(*order)
    return top.select("item_id", F.row_number().over(w).alias("rn"), "forward", "reverse")


_SCORED = f"{_PAIRS}, sp AS (SELECT * REPLACE (round(score, 6) AS score) FROM pairs)"


@query("diverse_pair_beam", f"""WITH {_SCORED}, n AS (SELECT *, f_start // 20 AS region, amplicon // 25 AS band, row_number() OVER (PARTITION BY item_id, f_start // 10, r_end // 10, amplicon // 25
    ORDER BY score, forward, reverse, f_start, r_end) <= 2 AS kept FROM sp),
f AS (SELECT *, kept AND row_number() OVER (PARTITION BY item_id, kept, region ORDER BY score, forward, reverse, f_start, r_end) = 1 AS first FROM n),
d AS (SELECT *, CASE WHEN first THEN 0 ELSE row_number() OVER (PARTITION BY item_id, region, band, kept AND NOT first ORDER BY score, forward, reverse, f_start, r_end) END AS depth FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id, kept ORDER BY depth, CASE WHEN first THEN lpad(region::VARCHAR, 12, '0') ELSE '(' || region || ', ' || band || ')' END COLLATE "C") AS line FROM d)
SELECT item_id, f_start::BIGINT AS f_start, r_end::BIGINT AS r_end, CASE WHEN NOT kept THEN 'near_duplicate_budget' WHEN line > 8 THEN 'diversity_beam_budget' ELSE 'retained' END AS decision FROM l""".replace(' COLLATE "C"', ""))
def diverse_pair_beam(spark, folder):
    scored = pairs(spark, folder).withColumn("score", F.round("score", 6))
    out = D.retain_diverse_pairs(scored, ["item_id"], limit=8, region=20)
    return out.select("item_id", "f_start", "r_end", "decision")


_PROBED = f"""{_SCORED}, pw AS (SELECT * FROM wins JOIN melt USING (oligo) WHERE e - s = 12 AND NOT contains(left(oligo, 3), 'G')
  AND length(oligo) - length(replace(oligo, 'C', '')) >= length(oligo) - length(replace(oligo, 'G', '')) AND {_GRUN} < 4 AND {_RUN} < 4),
trip AS (SELECT sp.*, pw.oligo AS probe, pw.strand AS p_strand, pw.s AS p_start, pw.e AS p_end, pw.tm - greatest(f_tm, r_tm) AS off FROM sp JOIN pw
  ON sp.item_id = pw.item_id AND sp.f_end <= pw.s AND pw.e <= sp.r_start WHERE pw.tm - greatest(f_tm, r_tm) BETWEEN -30 AND 20)"""


def probes(spark, folder):
    wins = D.enumerate_windows(spread(X.templates(spark, folder), "item_id"), ["item_id"], "t", 12, 12)
    return wins.filter(D.probe_rejection(F.col("oligo"), SHORT).isNull()).withColumn("tm", T.melting_temperature(F.col("oligo")))


def triplets(spark, folder):
    """Every pair with every probe between its primers; limits belong to the beams."""
    made = pairs(spark, folder).withColumn("score", F.round("score", 6))
    return D.attach_probes(made, probes(spark, folder), ["item_id"], SHORT)


@query("probe_candidates", f"""WITH {_PROBED} SELECT item_id, forward, reverse, probe, p_strand, p_start::BIGINT AS p_start, round(off, 4) AS "offset" FROM trip""")
def probe_candidates(spark, folder):
    return triplets(spark, folder).select("item_id", "forward", "reverse", "probe", "p_strand", "p_start", F.round("offset", 4).alias("offset"))


@query("diverse_probe_beam", f"""WITH {_PROBED}, p AS (SELECT *, round(abs(off - 9), 6) AS pen FROM trip),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id, f_start, r_end, forward, reverse, p_strand ORDER BY pen, probe, p_strand, p_start, p_end) = 1 AS first,
  '(''' || p_strand || ''', ' || p_start // 8 || ', ' || round_even(off / 1.5, 0)::INT || ')' AS stratum FROM p),
d AS (SELECT *, CASE WHEN first THEN 0 ELSE row_number() OVER (PARTITION BY item_id, f_start, r_end, forward, reverse, stratum, first ORDER BY pen, probe, p_strand, p_start, p_end) END AS depth FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id, f_start, r_end, forward, reverse ORDER BY depth, CASE WHEN first THEN pen END, stratum, pen, probe, p_strand, p_start, p_end) AS line FROM d)
SELECT item_id, forward, reverse, count(*) FILTER (line <= 4)::BIGINT AS retained, min(probe) FILTER (line <= 4) AS first_probe, count(DISTINCT p_strand) FILTER (line <= 4)::BIGINT AS strands FROM l GROUP BY 1, 2, 3""")
def diverse_probe_beam(spark, folder):
    rows = triplets(spark, folder).withColumn("probe_penalty", F.round("probe_penalty", 6))
    out = D.retain_diverse_probes(rows, ["item_id", "f_start", "r_end", "forward", "reverse"]).filter("decision = 'retained'")
    return out.groupBy("item_id", "forward", "reverse").agg(F.count("*").alias("retained"), F.min("probe").alias("first_probe"),
                                                           F.countDistinct("p_strand").alias("strands"))


@query("diverse_assay_beam", f"""WITH {_PROBED}, a AS (SELECT *, round(abs((f_tm + r_tm) / 2 - 40) + 1.5 * abs(f_tm - r_tm) + 0.2 * greatest(amplicon - 150, 0) + 0.35 * abs(off - 9), 6) AS cs FROM trip),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, forward, reverse, probe ORDER BY cs, f_start, r_end) AS dup FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, f_start // 12, r_end // 12, p_start // 12, amplicon // 10, dup = 1 ORDER BY cs, forward, reverse, probe) AS near, f_start // 15 AS region FROM d),
k AS (SELECT *, dup = 1 AND near <= 2 AS kept FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, kept, region ORDER BY cs, forward, reverse, probe) - 1 AS depth, min(cs) OVER (PARTITION BY item_id, kept, region) AS best FROM k),
p AS (SELECT *, CASE WHEN depth = 0 THEN 0 WHEN depth < 3 THEN 1 ELSE 2 END AS phase FROM r),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id, kept ORDER BY phase, CASE WHEN phase < 2 THEN depth END, CASE WHEN phase < 2 THEN best END, CASE WHEN phase < 2 THEN region END, cs, forward, reverse, probe) AS line FROM p)
SELECT item_id, CASE WHEN dup > 1 THEN 'exact_duplicate' WHEN NOT kept THEN 'near_duplicate_budget' WHEN line > 10 THEN 'regional_or_global_budget' ELSE 'retained' END AS decision,
  count(*)::BIGINT AS n, round(sum(cs), 3) AS score_sum FROM l GROUP BY 1, 2""")
def diverse_assay_beam(spark, folder):
    score = F.round(D.assay_score(SHORT, offset=F.col("offset")), 6)
    rows = triplets(spark, folder).withColumn("cs", score)
    out = D.retain_diverse_assays(rows, ["item_id"], limit=10, region=15, per_region=3, score="cs")
    return out.groupBy("item_id", "decision").agg(F.count("*").alias("n"), F.round(F.sum("cs"), 3).alias("score_sum"))


@query("designed_assays")
def designed_assays(spark, folder):
    """Whole design chain with the interaction gates on."""
    wins = D.enumerate_windows(spread(X.templates(spark, folder), "item_id"), ["item_id"], "t", 12, 13)
    kept = (wins.filter(D.primer_rejection(F.col("oligo"), SHORT).isNull())
            .withColumn("tm", T.melting_temperature(F.col("oligo")))
            .withColumn("runs", D.I.stable_runs(F.col("oligo"), -2.0)))
    made = D.pair_primers(kept, ["item_id"], SHORT)
    beam = D.retain_diverse_pairs(made, ["item_id"], limit=8, region=20).filter("decision = 'retained'")
    return beam.select("item_id", "f_start", "r_end", "forward", "reverse", "amplicon", "dimer", F.round("score", 6).alias("score"))


@query("oligo_lint", f"""WITH {X.ASSAYS}, o AS (SELECT item_id, forward AS oligo FROM assays), {nn_sql('o', 'item_id', 'oligo')}, {tm_sql()}
SELECT item_id, rule, status FROM (SELECT m.item_id, unnest([
  ('length', CASE WHEN length(oligo) BETWEEN 12 AND 13 THEN 'PASS' ELSE 'FAIL' END),
  ('GC%', CASE WHEN 100.0::DOUBLE * gc BETWEEN 20 AND 80 THEN 'PASS' ELSE 'FAIL' END), ('Tm', CASE WHEN tm BETWEEN 20 AND 60 THEN 'PASS' ELSE 'FAIL' END),
  ('3'' clamp', CASE WHEN length(translate(right(oligo, 5), 'AT', '')) <= 4 THEN 'PASS' ELSE 'FAIL' END), ('G-run', CASE WHEN {_GRUN} < 4 THEN 'PASS' ELSE 'FAIL' END),
  ('homopolymer', CASE WHEN {_RUN} < 4 THEN 'PASS' ELSE 'FAIL' END), ('3'' not T', CASE WHEN right(oligo, 1) <> 'T' THEN 'PASS' ELSE 'WARN' END),
  ('3'' GC clamp present', CASE WHEN length(translate(right(oligo, 5), 'AT', '')) >= 1 THEN 'PASS' ELSE 'WARN' END)]) AS r, r[1] AS rule, r[2] AS status FROM melt m JOIN o USING (item_id))""")
def oligo_lint(spark, folder):
    rows = X.assays(spark, folder).select("item_id", F.col("forward").alias("oligo"))
    out = D.lint_oligos(rows, ["item_id"], "oligo", "primer", SHORT)
    return out.filter(~F.col("rule").isin("no degenerate bases", "hairpin", "self-dimer"))


@query("oligo_quality_flags", f"""WITH {X.POOL}, o AS (SELECT id, seq AS oligo FROM pool), q AS (SELECT id, {_RUN} AS r, 100.0::DOUBLE * length(translate(oligo, 'AT', '')) / length(oligo) AS gc,
  list_max(list_transform(['AC','AG','AT','CA','CG','CT','GA','GC','GT','TA','TC','TG'], lambda p: coalesce(list_max(list_transform(regexp_extract_all(oligo, '(?:' || p || ')+'), lambda x: length(x))), 0) // 2)) AS d FROM o)
SELECT id, concat_ws(',', CASE WHEN r >= 5 THEN r || '-base run' END, CASE WHEN d >= 3 THEN d || 'x dinucleotide repeat' END, CASE WHEN gc > 72 THEN 'GC high' WHEN gc < 28 THEN 'GC low' END) AS flags,
  (CASE WHEN r >= 6 THEN 2 WHEN r = 5 THEN 0.5 ELSE 0 END + CASE WHEN d >= 4 THEN 2 WHEN d = 3 THEN 0.8 ELSE 0 END + CASE WHEN gc > 72 THEN 1.5 WHEN gc < 28 THEN 1 ELSE 0 END)::DOUBLE AS penalty FROM q""")
def oligo_quality_flags(spark, folder):
    flags, penalty = D.quality_flags(F.col("seq"))
    return X.pool(spark, folder).select("id", F.array_join(flags, ",").alias("flags"), F.round(penalty, 4).alias("penalty"))


@query("degenerate_consensus", f"""WITH {_PLACED}, b AS (SELECT item_id, role, oligo, p, w[p] AS base, count(*) AS n FROM (SELECT *, unnest(generate_series(1, 12)) AS p FROM placed WHERE neg <= 3) GROUP BY ALL),
v AS (SELECT *, sum(n) OVER (PARTITION BY item_id, role, p) AS t, row_number() OVER (PARTITION BY item_id, role, p ORDER BY n DESC, base) AS rn FROM b),
s AS (SELECT item_id, role, p, string_agg(base, '' ORDER BY base) AS k FROM v WHERE rn = 1 OR (n >= 2 AND n / t::DOUBLE >= 0.18) GROUP BY 1, 2, 3),
c(k, code) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('AG','R'),('CT','Y'),('CG','S'),('AT','W'),('GT','K'),('AC','M'),('CGT','B'),('AGT','D'),('ACT','H'),('ACG','V'),('ACGT','N'))
SELECT item_id || ':' || role AS oligo_key, string_agg(code, '' ORDER BY p) AS consensus, count(*) FILTER (length(s.k) > 1)::BIGINT AS n_degenerate FROM s JOIN c USING (k) GROUP BY 1""")
def degenerate_consensus(spark, folder):
    oligos = X.assay_oligos(spark, folder)
    near = TL.placement_tallies(oligos, X.subjects(spark, folder), least=0.75).where("family = 'base'")
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGTN"]), (F.col("i") % 5 + 1).cast("int"))
    named = oligos.select("oligo", F.concat_ws(":", "item_id", "role").alias("oligo_key"))
    votes = named.join(near.select("oligo", F.expr("cast(i div 5 as int)").alias("pos"), base.alias("base"), "n"), "oligo")
    return D.degenerate_consensus(votes, ["oligo_key"], "oligo").select("oligo_key", "consensus", "n_degenerate")


@query("closest_offtarget", f"""WITH {X.SUBJECTS}, {X.TEMPLATES}, p AS (SELECT item_id, doc_id, length(t) AS n, t, reverse(translate(t, 'ACGT', 'TGCA')) AS rc, seq,
  unnest(generate_series(1, length(seq) - length(t) + 1)) AS i FROM templates, subjects WHERE grp <> 'en' AND length(seq) >= length(t))
SELECT item_id, max(n - least(hamming(substr(seq, i, n), t), hamming(substr(seq, i, n), rc)))::BIGINT AS matches,
  min(doc_id) FILTER (hamming(substr(seq, i, n), t) = 0 OR hamming(substr(seq, i, n), rc) = 0)::BIGINT AS exact_doc FROM p GROUP BY 1""")
def closest_offtarget(spark, folder):
    """The off-target record whose best window is nearest to each assay's product."""
    other = X.subjects(spark, folder).filter("grp <> 'en'")
    near = B.nearest_sequences(X.templates(spark, folder), other, oligo_key="item_id", subject_key="doc_id", oligo="t")
    return near.groupBy("item_id").agg(F.max("matches").alias("matches"), F.min("exact").alias("exact_doc"))


@query("placement_status", f"""WITH {X.TEMPLATES}, a AS (SELECT item_id, left(t, 12) AS oligo FROM templates), w AS (SELECT item_id AS tid, s.strand, s.off AS off, substr(s.x, s.off, 12) AS w FROM (
  SELECT item_id, '+' AS strand, t AS x, unnest(generate_series(1, length(t) - 11)) AS off FROM templates UNION ALL
  SELECT item_id, '-', reverse(translate(t, 'ACGT', 'TGCA')), unnest(generate_series(1, length(t) - 11)) FROM templates) s)
SELECT a.item_id, tid, strand, hamming(w, oligo)::BIGINT AS mm, CASE WHEN right(w, 3) = right(oligo, 3) THEN 'exact' ELSE 'mismatch' END AS status, count(*)::BIGINT AS n
FROM a JOIN w ON hamming(w, oligo) <= 2 GROUP BY ALL""")
def placement_status(spark, folder):
    """All near-match placements of forward primers on every template, anchored or not."""
    oligos = X.assays(spark, folder).select("item_id", F.col("forward").alias("oligo"))
    on = spread(X.templates(spark, folder), "item_id").select(F.col("item_id").alias("tid"), F.col("t").alias("seq"))
    hits = find_sites(oligos, on, oligo_keys=["item_id"], subject_keys=["tid"], anchor=0, max_len=30)
    status = RD.placement_status(F.col("q3"), F.col("q3_definite"), F.lit(True))
    return hits.groupBy("item_id", "tid", "strand", "mm", status.alias("status")).agg(F.count("*").alias("n"))


@query("one_base_repairs", f"""WITH {X.SUBJECTS}, {X.ASSAYS}, {X.WINDOWS12} SELECT item_id, doc_id, lo::BIGINT AS lo, w AS new,
  list_min(list_filter(range(1, 13), lambda i: w[i] <> forward[i]))::BIGINT AS position FROM assays JOIN win ON strand = '+' AND hamming(w, forward) = 1""")
def one_base_repairs(spark, folder):
    oligos = X.assays(spark, folder).select("item_id", F.lit("F").alias("role"), F.col("forward").alias("oligo"))
    docs = X.subjects(spark, folder)
    out = RD.one_base_repairs(oligos, docs, ["item_id", "role"], "doc_id", max_len=30)
    return out.select("item_id", "doc_id", "lo", "new", "position")


@query("nested_outer_pairs", f"""WITH {_PRIMERS}, i AS (SELECT item_id, length(t) // 2 - 3 AS a, length(t) // 2 + 3 AS b FROM templates),
n AS (SELECT p.*, row_number() OVER (PARTITION BY item_id, strand ORDER BY round(abs(tm - 40), 6), oligo, s, e) AS rn FROM primers p JOIN i USING (item_id) WHERE (strand = '+' AND e + 2 <= a) OR (strand = '-' AND s >= b + 2))
SELECT f.item_id, f.oligo AS forward, r.oligo AS reverse, (r.e - f.s)::BIGINT AS amplicon FROM n f JOIN n r ON f.item_id = r.item_id AND f.strand = '+' AND r.strand = '-' AND f.rn <= 4 AND r.rn <= 4 AND r.e - f.s <= 75""")
def nested_outer_pairs(spark, folder):
    half = F.floor(F.length("t") / 2)
    inner = X.templates(spark, folder).select("item_id", (half - 3).alias("inner_start"), (half + 3).alias("inner_end"))
    order = [F.round(F.abs(F.col("tm") - 40), 6), F.col("oligo"), F.col("start"), F.col("end")]
    out = RD.outer_pairs(primers(spark, folder), inner, ["item_id"], gap=2, per_side=4, amp_max=75, order=order)
    return out.select("item_id", "forward", "reverse", "amplicon")


@query("region_constrained_pairs", f"""WITH {_PAIRS}, c AS (SELECT *, length(t) // 2 AS m FROM pairs JOIN templates USING (item_id))
SELECT item_id, count(*)::BIGINT AS n, min(f_start)::BIGINT AS first_start FROM c WHERE NOT (f_start < 4 AND 0 < r_end) AND f_start <= m AND r_end >= m GROUP BY 1""")
def region_constrained_pairs(spark, folder):
    """Pairs that avoid the first four bases and span the template middle."""
    tpl = X.templates(spark, folder)
    excluded = tpl.select("item_id", F.lit(0).alias("x_start"), F.lit(4).alias("x_end"))
    mid = tpl.select("item_id", F.floor(F.length("t") / 2).alias("m"))
    rows = pairs(spark, folder).join(mid, "item_id").withColumn("candidate", F.concat_ws(":", "f_start", "f_end", "r_start", "r_end"))
    out = RD.region_constraints(rows, excluded, ["item_id"], required=("m", "m"))
    return out.groupBy("item_id").agg(F.count("*").alias("n"), F.min("f_start").alias("first_start"))


@query("locked_primer_pairs", f"""WITH {_PAIRS}, k AS (SELECT item_id, min(oligo) AS keep FROM primers WHERE strand = '+' GROUP BY 1)
SELECT item_id, forward, reverse, amplicon::BIGINT AS amplicon FROM pairs JOIN k USING (item_id) WHERE forward = keep""")
def locked_primer_pairs(spark, folder):
    p = primers(spark, folder)
    locked = p.filter("strand = '+'").groupBy("item_id", "strand").agg(F.min("oligo").alias("oligo"))
    out = D.pair_primers(RD.lock_components(p, locked, ["item_id"]), ["item_id"], SHORT, dimers=False)
    return out.select("item_id", "forward", "reverse", "amplicon")


@query("synthetic_fragments", f"""WITH {X.SUBJECTS}, a AS (SELECT doc_id, seq, length(seq) AS n, length(seq) // 3 AS fs, length(seq) // 3 + 20 AS re FROM subjects WHERE length(seq) >= 60),
b AS (SELECT *, greatest(fs - 10, 0) AS s, least(re + 10, n) AS e FROM a), c AS (SELECT *, greatest(100 - (e - s), 0) AS need FROM b),
d AS (SELECT *, least(ceil(need / 2)::BIGINT, least(s, n - e)) AS bo FROM c), f AS (SELECT *, greatest(need - 2 * bo, 0) AS rest FROM d),
g AS (SELECT *, s - bo - CASE WHEN n - e > bo THEN 0 ELSE least(rest, s - bo) END AS s2, e + bo + CASE WHEN n - e > bo THEN least(rest, n - e - bo) ELSE 0 END AS e2 FROM f)
SELECT doc_id, sha256(substr(seq, s2::BIGINT + 1, (e2 - s2)::BIGINT) || left('{D.FILLER}', greatest(100 - (e2 - s2), 0)::BIGINT)) AS fragment_sha,
  greatest(e2 - s2, 100)::BIGINT AS length FROM g""")
def synthetic_fragments(spark, folder):
    rows = X.subjects(spark, folder).filter(F.length("seq") >= 60)
    third = F.floor(F.length("seq") / 3).cast("int")
    frag = D.synthetic_fragment(F.col("seq"), third, third + 20, flank=10, min_len=100)
    return rows.select("doc_id", F.sha2(frag, 256).alias("fragment_sha"), F.length(frag).alias("length"))


@query("search_window_starts", f"""WITH {X.SUBJECTS}, l AS (SELECT doc_id, greatest(length(seq) - 200, 0) AS span FROM subjects),
g AS (SELECT doc_id, span, list_sort(list_distinct(list_transform(range(0, 6), lambda i: round_even(i * span / 5::DOUBLE, 0)::BIGINT))) AS ev, generate_series(0, span, 90) AS st FROM l),
u AS (SELECT *, list_sort(list_distinct(list_concat(ev, st))) AS al FROM g)
SELECT doc_id, array_to_string(CASE WHEN span = 0 THEN [0] ELSE al END, ',') AS starts FROM u""")
def search_window_starts(spark, folder):
    rows = X.subjects(spark, folder)
    return rows.select("doc_id", F.array_join(F.transform(D.window_starts(F.length("seq"), 200, 6, 90), lambda x: x.cast("string")), ",").alias("starts"))


@query("junction_relations", """WITH j AS (SELECT conv_id, junction FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS junction,
  turn = max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE NOT l), r AS (SELECT conv_id, junction, conv_id % 50 * 4 AS o FROM j)
SELECT conv_id, max(CASE WHEN (o < junction AND junction < o + 40) OR (o + 300 < junction AND junction < o + 340) OR (o + 100 < junction AND junction < o + 160) THEN 2
  WHEN o + 40 <= junction AND junction <= o + 300 THEN 1 ELSE 0 END)::BIGINT AS level FROM r GROUP BY 1""")
def junction_relations(spark, folder):
    parts = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    j = running_offsets(parts, ["conv_id"], "turn", "n").filter(~F.col("is_last"))
    o = F.col("conv_id") % 50 * 4
    level = junction_relation(o, o + 40, o + 300, o + 340, o + 100, o + 160, F.col("junction"))
    score = F.when(level == "strong", 2).when(level == "size", 1).otherwise(0)
    return j.groupBy("conv_id").agg(F.max(score).alias("level"))


@query("shared_isoform_blocks", """WITH s AS (SELECT conv_id, turn, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM conversations), t AS (SELECT conv_id, count(DISTINCT turn) AS n, min(turn) AS f FROM s GROUP BY 1),
g AS (SELECT conv_id, turn, pos, substr(s, pos, 3) AS g FROM (SELECT *, unnest(generate_series(1, length(s) - 2)) AS pos FROM s WHERE length(s) >= 3)),
k AS (SELECT g.conv_id, g.g, any_value(f) AS f FROM (SELECT DISTINCT conv_id, turn, g FROM g) g JOIN t USING (conv_id) GROUP BY g.conv_id, g.g HAVING count(*) = any_value(n)),
i AS (SELECT g.conv_id, pos, pos - row_number() OVER (PARTITION BY g.conv_id ORDER BY pos) AS isle FROM g JOIN k ON g.conv_id = k.conv_id AND g.g = k.g AND g.turn = k.f),
r AS (SELECT conv_id, min(pos) AS st, count(*) + 2 AS n FROM i GROUP BY conv_id, isle)
SELECT conv_id, (-max((n, -st))[2])::BIGINT AS start, max((n, -st))[1]::BIGINT AS length FROM r GROUP BY 1""")
def shared_isoform_blocks(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", S.letters_only(F.col("text")).alias("s"))
    return RD.shared_blocks(rows, "conv_id", "turn", "s", 3)


@query("hard_failures", f"""WITH {X.ASSAYS}, o AS (SELECT item_id || 'f' AS k, forward AS oligo FROM assays UNION ALL SELECT item_id || 'r', reverse FROM assays), {nn_sql('o', 'k', 'oligo')}, {tm_sql()},
a AS (SELECT a.item_id, forward, reverse, probe, f.tm AS ft, r.tm AS rt, length(t) AS amp FROM assays a JOIN templates USING (item_id) JOIN melt f ON f.k = a.item_id || 'f' JOIN melt r ON r.k = a.item_id || 'r'),
e AS (SELECT item_id, unnest([CASE WHEN amp NOT BETWEEN 20 AND 75 THEN 'amplicon_length' END, CASE WHEN item_id % 4 * 0.25 < 0.9 THEN 'coverage_target' END,
  CASE WHEN probe IS NOT NULL AND item_id % 4 * 0.25 < 0.9 THEN 'coverage_probe' END,
  CASE WHEN item_id % 3 = 0 THEN 'offtarget_signal' END, CASE WHEN item_id % 3 <> 2 THEN 'offtarget_product' END,
  CASE WHEN abs(ft - rt) > 5 THEN 'tm_gap' END, CASE WHEN ft NOT BETWEEN 20 AND 60 OR rt NOT BETWEEN 20 AND 60 THEN 'primer_tm' END,
  CASE WHEN right(forward, 1) = 'T' OR right(reverse, 1) = 'T' THEN 'primer_ends_in_t' END,
  CASE WHEN greatest(length(translate(right(forward, 5), 'AT', '')), length(translate(right(reverse, 5), 'AT', ''))) > 4 THEN 'primer_gc_clamp' END,
  CASE WHEN least(length(translate(forward, 'AT', '')), length(translate(reverse, 'AT', ''))) / 12 * 100 < 20 OR greatest(length(translate(forward, 'AT', '')), length(translate(reverse, 'AT', ''))) / 12 * 100 > 80 THEN 'primer_gc' END,
  CASE WHEN regexp_matches(forward, 'GGGG') OR regexp_matches(reverse, 'GGGG') THEN 'primer_g_run' END,
  CASE WHEN regexp_matches(forward, 'AAAA|CCCC|GGGG|TTTT') OR regexp_matches(reverse, 'AAAA|CCCC|GGGG|TTTT') THEN 'primer_base_run' END]) AS x FROM a)
SELECT a.item_id, coalesce(string_agg(x, ',' ORDER BY x), '') AS failures FROM a LEFT JOIN e ON a.item_id = e.item_id AND x IS NOT NULL GROUP BY 1""")
def hard_failures(spark, folder):
    a = X.assays(spark, folder).join(X.templates(spark, folder), "item_id")
    n = F.length("t")
    signal = F.when(F.col("item_id") % 3 == 0, 1).otherwise(0)
    rows = a.withColumns({
        "f_tm": T.melting_temperature(F.col("forward")), "r_tm": T.melting_temperature(F.col("reverse")), "amplicon": n,
        "f_start": F.lit(0), "f_end": F.lit(12), "r_start": n - 12, "r_end": n, "fold": F.lit(1), "junction_level": F.lit("none"),
        "target_coverage": F.col("item_id") % 4 * 0.25, "signal_coverage": F.col("item_id") % 4 * 0.25,
        "signal_subjects": signal, "product_subjects": F.when(F.col("item_id") % 3 != 2, 1).otherwise(0)})
    return rows.select("item_id", F.array_join(E.hard_failures(SHORT, objective("discrimination")), ",").alias("failures"))


@query("assay_diagnoses", f"""WITH {_CAND} SELECT id, CASE WHEN d = '' THEN 'no_decisive_computational_fault' ELSE d END AS codes FROM (SELECT id, concat_ws(',',
  CASE WHEN NOT hard_valid THEN 'hard_requirement_failure' END, CASE WHEN triplet_penalty > 2 THEN 'primer_tm_imbalance' END, CASE WHEN worst_dimer <= -6 THEN 'dimer_risk' END,
  CASE WHEN target_coverage < 1 THEN 'target_coverage' END, CASE WHEN signal_subjects > 0 THEN 'false_positive_risk' WHEN product_subjects > 0 THEN 'offtarget_product' END,
  CASE WHEN id % 5 > 1 THEN 'multiple_forward_placements' END, CASE WHEN id % 3 > 0 THEN 'forward_target_mismatch' END, CASE WHEN id % 2 > 1 THEN 'x' END,
  CASE WHEN amplicon > 100 AND amplicon > 180 THEN 'long_amplicon' END, CASE WHEN robustness < 1 THEN 'condition_sensitivity' END,
  CASE WHEN p_retailprice / 10 NOT BETWEEN 90 AND 110 THEN 'observed_efficiency' END, CASE WHEN worst_3prime < 0.98 THEN 'standard_curve_linearity' END,
  CASE WHEN degeneracy_fold <> 1 THEN 'melt_abnormality' END, CASE WHEN panel_risk = 2 THEN 'multiplex_only_failure' END) AS d FROM cand)""")
def assay_diagnoses(spark, folder):
    rows = candidates(spark, folder).withColumns({
        "pair_tm_gap": F.col("triplet_penalty"), "forward_sites": F.col("id") % 5, "forward_min_mm": F.col("id") % 3,
        "reverse_sites": F.lit(1), "reverse_min_mm": F.lit(0), "probe_sites": F.lit(1), "efficiency": F.col("p_retailprice") / 10,
        "r2": F.col("worst_3prime"), "melt_peaks": F.col("degeneracy_fold"), "probe_signal_problem": F.lit(False),
        "multiplex_failure": F.col("panel_risk") == 2})
    return rows.select("id", F.array_join(E.diagnoses(), ",").alias("codes"))


@query("edit_metric_changes", f"""WITH {_CAND}, b AS (SELECT id, unnest([('target_coverage', target_coverage, target_coverage * 0.99, 1), ('triplet_penalty', triplet_penalty, triplet_penalty - 0.5, -1),
  ('practical_penalty', practical_penalty, practical_penalty, -1), ('amplicon', amplicon::DOUBLE, amplicon + 10.0::DOUBLE, 0), ('worst_3prime', worst_3prime, worst_3prime, 1), ('probe_identity', probe_identity, probe_identity, 1),
  ('robustness', robustness, robustness, 1), ('signal_subjects', signal_subjects::DOUBLE, signal_subjects::DOUBLE, -1), ('product_subjects', product_subjects::DOUBLE, product_subjects::DOUBLE, -1), ('worst_dimer', worst_dimer, worst_dimer + 1, 1)]) AS r FROM cand)
SELECT id, r[1] AS metric, round(r[3] - r[2], 6) AS delta, CASE WHEN round(r[3] - r[2], 6) <> 0 AND r[4] <> 0 THEN CASE WHEN (r[3] > r[2]) = (r[4] > 0) THEN 'improved' ELSE 'worsened' END
  WHEN r[2] IS DISTINCT FROM r[3] THEN 'changed' ELSE 'unchanged' END AS interpretation FROM b""")
def edit_metric_changes(spark, folder):
    before = candidates(spark, folder)
    after = before.withColumns({"target_coverage": F.col("target_coverage") * 0.99, "triplet_penalty": F.col("triplet_penalty") - 0.5,
                                "amplicon": F.col("amplicon") + 10, "worst_dimer": F.col("worst_dimer") + 1})
    return E.metric_changes(before, after, "id").select("id", "metric", "delta", "interpretation")


@query("edit_positions", f"""WITH {X.POOL} SELECT id, array_to_string(list_filter(range(1, length(seq) + 1), lambda i: seq[i] <> translate(seq, 'A', 'C')[i]), ',') AS spots FROM pool""")
def edit_positions(spark, folder):
    spots = E.edit_positions(F.col("seq"), F.translate("seq", "A", "C"))
    return X.pool(spark, folder).select("id", F.array_join(F.transform(spots, lambda x: x.cast("string")), ",").alias("spots"))
