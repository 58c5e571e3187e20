"""Queries that choose: informative cases, off-target profiles, discriminating pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import records as R
from ..operators import selection as C
from ..operators import tallies as T
from ..session import cut_to_parquet
from . import shapes as X
from .design import _PAIRS, SHORT, pairs, probes
from .registry import query
from .sites import _CALLS, _PRIMING, _SEEDED, _amplified, _calls, _states

_KNOWN = _CALLS + _SEEDED[len(_PRIMING):] + """, hitpairs AS (SELECT item_id, doc_id, bool_or(state = '3prime') AS terminal FROM why GROUP BY 1, 2),
st AS (SELECT doc_id, item_id, CASE WHEN has_probe AND ident < 85 THEN 'product_without_probe' WHEN has_probe THEN 'signal_product' ELSE 'product' END AS state FROM calls
  UNION ALL SELECT doc_id, item_id, 'no_product_terminal' FROM hitpairs p WHERE terminal AND NOT EXISTS (SELECT 1 FROM amp a WHERE a.item_id = p.item_id AND a.doc_id = p.doc_id))"""


def candidate_states(spark, folder):
    """(doc_id, item_id, state) of every candidate that amplifies a case, or fails on its primers' ends."""
    amplified = cut_to_parquet(_amplified(spark, folder, probes=True))
    calls = _calls(spark, folder, amplified)
    state = R.prediction_state(F.lit(True), F.col("probe").isNotNull(), F.col("probe_binds"))
    failed = (_states(spark, folder).groupBy("item_id", "doc_id").agg(F.bool_or(F.col("state") == "3prime").alias("terminal")).where("terminal")
              .join(amplified.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"))
    return (calls.select("doc_id", "item_id", state.alias("state"))
            .unionByName(failed.select("doc_id", "item_id", F.lit("no_product_terminal").alias("state"))))


@query("informative_cases", f"""WITH RECURSIVE {_KNOWN},
cand AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS c FROM assays),
f AS (SELECT doc_id, c, coalesce(state, 'silent') AS state FROM subjects CROSS JOIN cand LEFT JOIN st USING (doc_id, item_id)),
b AS (SELECT x.doc_id, bitstring_agg(x.c * 200 + y.c, 0, 40000) AS bits FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.c < y.c AND x.state <> y.state GROUP BY 1),
info AS (SELECT doc_id, bits, n_states, probe, terminal, CASE WHEN grp = 'en' THEN 'target' ELSE 'off_target' END AS role, src AS grp FROM b JOIN subjects USING (doc_id) JOIN
  (SELECT doc_id, count(DISTINCT state) AS n_states, bool_or(state = 'product_without_probe') AS probe, bool_or(state = 'no_product_terminal') AS terminal FROM f GROUP BY 1) USING (doc_id)),
g(round, covered, seen, picked, m) AS (
  SELECT 0, repeat('0', 40001)::BIT, []::VARCHAR[], []::BIGINT[], NULL::STRUCT(a BIGINT, b BIGINT, c INT, d INT, doc_id BIGINT, k VARCHAR, bits BIT) UNION ALL
  SELECT round + 1, covered | m.bits, list_append(seen, m.k), list_append(picked, m.doc_id), m FROM (
    SELECT round, any_value(covered) AS covered, any_value(seen) AS seen, any_value(picked) AS picked,
      min({{'a': -bit_count(bits & ~covered), 'b': -n_states, 'c': list_contains(seen, role || grp)::INT, 'd': -(role = 'off_target')::INT, 'doc_id': doc_id, 'k': role || grp, 'bits': bits}}) AS m
    FROM g, info WHERE round < 12 AND NOT list_contains(picked, doc_id) GROUP BY round) z)
SELECT round::BIGINT AS round, g.m.doc_id AS doc_id, role, grp, -g.m.a::BIGINT AS new_pairs, n_states::BIGINT AS n_states, probe AS probe_disagreement, terminal AS terminal_mismatch
FROM g JOIN info ON info.doc_id = g.m.doc_id WHERE round > 0""")
def informative_cases(spark, folder):
    cases = X.subjects(spark, folder).select("doc_id", F.when(F.col("grp") == "en", "target").otherwise("off_target").alias("role"), F.col("src").alias("grp"))
    return C.informative_cases(candidate_states(spark, folder), cases, X.assays(spark, folder), "doc_id", "item_id")


_OFF = """win2 AS (SELECT doc_id, n, strand, i AS off, substr(s, i + 1, n) AS w FROM (SELECT doc_id, n, strand, s, unnest(generate_series(0, length(s) - n)) AS i FROM (
    SELECT doc_id, '+' AS strand, seq AS s FROM subjects WHERE grp <> 'en' UNION ALL
    SELECT doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM subjects WHERE grp <> 'en') z, (VALUES (12), (13)) l(n) WHERE length(s) >= n) y),
pl AS (SELECT oligo, doc_id, min((hamming(w, oligo), strand, off, w)) AS b FROM op JOIN win2 ON n = length(oligo) GROUP BY 1, 2),
prof AS (SELECT oligo, count(*) AS n, median(100.0::DOUBLE * (length(oligo) - b[1]) / length(oligo)) AS median_ident, max(100.0::DOUBLE * (length(oligo) - b[1]) / length(oligo)) AS max_ident,
  min(b[1]) AS min_mismatch, min(hamming(right(b[4], 5), right(oligo, 5))) AS m3 FROM pl GROUP BY 1)"""


def _off_targets(spark, folder):
    return X.subjects(spark, folder).where("grp <> 'en'")


@query("offtarget_profiles", f"""WITH {X.SUBJECTS}, {X.ASSAYS}, {X.OLIGOS12}, op AS (SELECT DISTINCT oligo FROM oligos), {_OFF},
miss AS (SELECT oligo, p, round(count(*) FILTER (b[4][p] <> oligo[p]) / count(*), 3) AS f FROM (SELECT *, unnest(generate_series(1, 12)) AS p FROM pl) z GROUP BY 1, 2)
SELECT oligo, prof.n::BIGINT AS n, round(median_ident, 4) AS median_ident, round(max_ident, 4) AS max_ident, min_mismatch::BIGINT AS min_mismatch, m3::BIGINT AS min_3prime_mismatch,
  (SELECT string_agg(printf('%.3f', f), ',' ORDER BY p) FROM miss WHERE miss.oligo = prof.oligo) AS off_mismatch_frac FROM prof""")
def offtarget_profiles(spark, folder):
    out = T.discrimination_profile(T.placement_tallies(X.assay_oligos(spark, folder), _off_targets(spark, folder)))
    share = F.array_join(F.transform("off_mismatch_frac", lambda f: F.format_string("%.3f", f)), ",")
    return out.select("oligo", "n", F.round("median_ident", 4).alias("median_ident"), F.round("max_ident", 4).alias("max_ident"), "min_mismatch",
                      "min_3prime_mismatch", share.alias("off_mismatch_frac"))


_DISC = f"""{X.SUBJECTS}, {_PAIRS}, op AS (SELECT forward AS oligo FROM pairs UNION SELECT reverse FROM pairs), {_OFF},
made AS (SELECT p.* REPLACE (round(p.score, 6) AS score), coalesce(f.m3, 0) AS fb, coalesce(r.m3, 0) AS rb, round((coalesce(f.max_ident, 100) + coalesce(r.max_ident, 100)) / 2, 6) AS mean_ident
  FROM pairs p LEFT JOIN prof f ON f.oligo = p.forward LEFT JOIN prof r ON r.oligo = p.reverse),
good AS (SELECT *, fb + rb AS total_block, greatest(fb, rb) AS best_block FROM made WHERE greatest(fb, rb) >= 1),
onepair AS (SELECT *, row_number() OVER (PARTITION BY item_id, forward, reverse ORDER BY total_block DESC, best_block DESC, mean_ident, score, f_start, r_end) AS nth FROM good),
spots AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total_block DESC, best_block DESC, mean_ident, score, f_start, r_end, forward, reverse) AS place FROM onepair WHERE nth = 1)"""


def _specialists(spark, folder, want, off_targets=None):
    made = pairs(spark, folder).withColumn("score", F.round("score", 6))
    both = made.select(F.explode(F.array("forward", "reverse")).alias("oligo"))
    profile = T.discrimination_profile(T.placement_tallies(both, off_targets or _off_targets(spark, folder)))
    return C.discriminating_pairs(made, profile, ["item_id"], want=want)


@query("discriminating_pairs", f"""WITH {_DISC} SELECT item_id, place::BIGINT AS place, forward, reverse, f_start::BIGINT AS f_start, r_end::BIGINT AS r_end, total_block::BIGINT AS total_block,
  best_block::BIGINT AS best_block, round(mean_ident, 4) AS mean_ident FROM spots""")
def discriminating_pairs(spark, folder):
    out = _specialists(spark, folder, 1 << 30)
    return out.select("item_id", "place", "forward", "reverse", "f_start", "r_end", "total_block", "best_block", F.round("mean_ident", 4).alias("mean_ident"))


_NEAR = _DISC.replace("grp <> 'en'", "grp = 'fr'")


@query("specialist_triplets", f"""WITH {_NEAR}, pw AS (SELECT * FROM wins JOIN melt USING (oligo) WHERE e - s = 12 AND NOT contains(left(oligo, 3), 'G')
  AND length(oligo) - length(replace(oligo, 'C', '')) >= length(oligo) - length(replace(oligo, 'G', ''))
  AND coalesce(list_max(list_transform(regexp_extract_all(oligo, 'G+'), lambda x: length(x))), 0) < 4
  AND list_max(list_transform(regexp_extract_all(oligo, 'A+|C+|G+|T+'), lambda x: length(x))) < 4),
own AS (SELECT q.*, pw.oligo AS probe, pw.strand AS p_strand, pw.s AS p_start, row_number() OVER (PARTITION BY q.item_id, q.forward, q.reverse
    ORDER BY round(abs(pw.tm - greatest(f_tm, r_tm) - 9), 6), pw.oligo, pw.strand, pw.s) AS depth FROM spots q JOIN pw ON q.item_id = pw.item_id AND q.f_end <= pw.s AND pw.e <= q.r_start
    AND pw.tm - greatest(f_tm, r_tm) BETWEEN -30 AND 20),
line AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY place) AS pair_no FROM own WHERE depth <= 3)
SELECT item_id, turn::BIGINT AS nth, forward, reverse, probe, p_strand, p_start::BIGINT AS p_start, total_block::BIGINT AS total_block
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY depth, place) AS turn FROM line WHERE pair_no <= 8) z WHERE turn <= 6""")
def specialist_triplets(spark, folder):
    """Triplets of the pairs that exclude one near group of sequences."""
    near = X.subjects(spark, folder).where("grp = 'fr'")
    best = _specialists(spark, folder, 1 << 30, near)
    found = (D.attach_probes(best.select("item_id", "forward", "reverse", "f_start", "f_end", "r_start", "r_end", "f_tm", "r_tm"), probes(spark, folder), ["item_id"], SHORT)
             .withColumn("probe_penalty", F.round("probe_penalty", 6)).select("item_id", "forward", "reverse", "f_start", "r_end", "probe", "p_strand", "p_start", "p_end", "probe_penalty"))
    out = C.specialist_triplets(best, found, ["item_id"])
    return out.select("item_id", "nth", "forward", "reverse", "probe", "p_strand", "p_start", "total_block")
