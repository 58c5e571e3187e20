"""Oligo queries: thermodynamics, notation, degeneracy, interactions and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo as T
from ..operators import interactions as I
from ..operators import melting_range as M
from ..operators.oligo_pairs import pool_tally
from ..session import spread, table
from . import shapes as X
from .registry import query

_STEPS = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in T.STEP_TERMS.items())
_STEP_CTE = f"steps(step, h, s) AS (VALUES {_STEPS})"
_R = T.GAS


def nn_sql(source: str, key: str, seq: str) -> str:
    """CTEs that end in ``nn(key, seq, dh, ds)`` for the oligos of ``source``."""
    return f"""{_STEP_CTE}, parts AS (SELECT {key}, {seq} AS seq, unnest(generate_series(1, length({seq}) - 1)) AS i FROM {source}),
nn AS (SELECT {key}, seq, sum(h) + any_value(CASE WHEN left(seq, 1) IN ('A', 'T') THEN 2.3::DOUBLE ELSE 0.1::DOUBLE END)
    + any_value(CASE WHEN right(seq, 1) IN ('A', 'T') THEN 2.3::DOUBLE ELSE 0.1::DOUBLE END) AS dh,
  sum(s) + any_value(CASE WHEN left(seq, 1) IN ('A', 'T') THEN 4.1::DOUBLE ELSE -2.8::DOUBLE END)
    + any_value(CASE WHEN right(seq, 1) IN ('A', 'T') THEN 4.1::DOUBLE ELSE -2.8::DOUBLE END)
    + any_value(CASE WHEN seq = reverse(translate(seq, 'ACGT', 'TGCA')) THEN -1.4::DOUBLE ELSE 0::DOUBLE END) AS ds
  FROM parts JOIN steps ON step = substr(seq, i, 2) GROUP BY {key}, seq)"""


def tm_sql(source: str = "nn", extra: str = "", mv: str = "50.0", mg: str = "2.2", dna: str = "200.0") -> str:
    """``tm`` of the rows of ``source`` in the mixed-salt regime, as a CTE named ``melt``."""
    return f"""melt AS (SELECT *, 1 / (1 / (tm1 + 273.15) + a - 9.11e-6 * lg + gc * (6.26e-5 + d * lg)
    + (-4.82e-4 + 5.25e-4 * lg + g * lg * lg) / (2 * (n - 1))) - 273.15 AS tm FROM (
  SELECT *, 3.92e-5 * (0.843 - 0.352 * sqrt(mono) * lm) AS a, 1.42e-5 * (1.279 - 4.03e-3 * lm - 8.03e-3 * lm * lm) AS d,
    8.31e-5 * (0.486 - 0.258 * lm + 5.25e-3 * lm * lm * lm) AS g FROM (
  SELECT *, 1000 * dh / (ds + {_R}::DOUBLE * ln(CASE WHEN seq = reverse(translate(seq, 'ACGT', 'TGCA')) THEN 1 ELSE 0.5 END::DOUBLE
      * {dna}::DOUBLE * 1e-9)) - 273.15 AS tm1, length(translate(seq, 'AT', ''))::DOUBLE / length(seq) AS gc, length(seq) AS n,
    {mv}::DOUBLE / 1000 AS mono, ln({mv}::DOUBLE / 1000) AS lm, ln({mg}::DOUBLE / 1000) AS lg {extra} FROM {source})))"""


@query("oligo_thermodynamics", f"WITH {X.POOL}, {nn_sql('pool', 'id', 'seq')}, {tm_sql()}" + f"""
SELECT id, round(dh, 3) AS dh, round(ds, 3) AS ds, round(dh - 310.15 * ds / 1000, 6) AS dg37, round(tm, 3) AS tm,
  round(1 / (1 + exp(dh * 1000 / {_R}::DOUBLE * (1 / 333.15::DOUBLE - 1 / (tm + 273.15)))), 5) AS bound FROM melt""")
def oligo_thermodynamics(spark, folder):
    s = F.col("seq")
    dh, ds = T.duplex_sums(s)
    rows = X.pool(spark, folder).withColumns({"dh": dh, "ds": ds})
    rows = rows.withColumn("tm", T.tm_from_sums(s, F.col("dh"), F.col("ds"), T.Conditions()))
    return rows.select("id", F.round("dh", 3).alias("dh"), F.round("ds", 3).alias("ds"),
                       F.round(T.free_energy(F.col("dh"), F.col("ds")), 6).alias("dg37"), F.round("tm", 3).alias("tm"),
                       F.round(T.fraction_bound(F.col("dh"), F.col("tm"), T.Conditions()), 5).alias("bound"))


@query("reaction_condition_envelope", f"WITH {X.POOL}, {nn_sql('pool', 'id', 'seq')}, " + ", ".join(
    tm_sql(mv=mv, mg=mg, dna=dna).replace("melt AS", f"melt{i} AS") for i, (mv, mg, dna) in enumerate(
        [("50.0", "2.2", "200.0"), ("40.0", "1.5", "150.0"), ("60.0", "2.9", "250.0")])) + """,
allm AS (SELECT id, tm FROM melt0 UNION ALL SELECT id, tm FROM melt1 UNION ALL SELECT id, tm FROM melt2)
SELECT id, round(min(tm), 3) AS tm_low, round(max(tm), 3) AS tm_high,
  round(avg(CASE WHEN tm BETWEEN 45 AND 60 THEN 1 ELSE 0 END), 4) AS valid_fraction FROM allm GROUP BY id""")
def reaction_condition_envelope(spark, folder):
    from ..operators.evidence import condition_scenarios
    s = F.col("seq")
    dh, ds = T.duplex_sums(s)
    rows = X.pool(spark, folder).withColumns({"dh": dh, "ds": ds})
    rows = rows.withColumn("c", F.explode(condition_scenarios(T.Conditions())))
    cond = T.Conditions(mv=F.col("c.mv"), dv=F.col("c.dv"), dntp=F.col("c.dntp"), dna=F.col("c.dna"), anneal=F.col("c.anneal"))
    rows = rows.withColumn("tm", T.tm_from_sums(s, F.col("dh"), F.col("ds"), cond))
    return rows.groupBy("id").agg(
        F.round(F.min("tm"), 3).alias("tm_low"), F.round(F.max("tm"), 3).alias("tm_high"),
        F.round(F.avg(F.col("tm").between(45.0, 60.0).cast("int")), 4).alias("valid_fraction"))


_ORDER_SQL = """(SELECT doc_id, '/56-FAM/' || upper(w) || '+A*C /3BHQ/' AS mark, w FROM (
  SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS w FROM documents))"""


def _order_text(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    w = S.letters_only(F.col("text"))
    return docs.select("doc_id", w.alias("w")).withColumn(
        "mark", F.concat(F.lit("/56-FAM/"), F.col("w"), F.lit("+A*C /3BHQ/")))


@query("order_notation", f"""SELECT doc_id, sha256(w || 'AC') AS bare, (length(w) + 1)::BIGINT AS locked_at FROM {_ORDER_SQL}""")
def order_notation(spark, folder):
    return _order_text(spark, folder).select(
        "doc_id", F.sha2(S.strip_order_marks(F.col("mark")), 256).alias("bare"),
        S.locked_positions(F.col("mark"))[0].alias("locked_at"))


_FIRST = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in T.LOCKED_FIRST.items())
_SECOND = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in T.LOCKED_SECOND.items())


@query("locked_base_increments", f"""WITH {X.POOL}, f1(step, h, s) AS (VALUES {_FIRST}), f2(step, h, s) AS (VALUES {_SECOND}),
spots AS (SELECT id, seq, unnest(generate_series(3, length(seq), 4)) AS i FROM pool),
inc AS (SELECT id, h, s FROM spots JOIN f1 ON i < length(seq) AND step = substr(seq, i, 2)
  UNION ALL SELECT id, h, s FROM spots JOIN f2 ON i > 1 AND step = substr(seq, i - 1, 2))
SELECT id, round(sum(h) / 1000, 5) AS dh, round(sum(s), 4) AS ds FROM inc GROUP BY id""")
def locked_base_increments(spark, folder):
    """Every fourth base from the third on is locked."""
    rows = X.pool(spark, folder).withColumn("locked", F.sequence(F.lit(3), F.length("seq"), F.lit(4)))
    return rows.select("id", F.round(T.locked_increment(F.col("seq"), F.col("locked"), 0) / 1000, 5).alias("dh"),
                       F.round(T.locked_increment(F.col("seq"), F.col("locked"), 1), 4).alias("ds"))


_DEG = "translate(left(seq, 3), 'ACGT', 'RYSW') || substr(seq, 4)"


@query("degenerate_resolutions", f"""WITH {X.POOL}, codes(code, base) AS (VALUES ('R', 'A'), ('R', 'G'), ('Y', 'C'), ('Y', 'T'),
  ('S', 'C'), ('S', 'G'), ('W', 'A'), ('W', 'T')), d AS (SELECT id, {_DEG} AS oligo FROM pool),
r AS (SELECT id, a.base || b.base || c.base || substr(oligo, 4) AS seq FROM d JOIN codes a ON a.code = oligo[1]
  JOIN codes b ON b.code = oligo[2] JOIN codes c ON c.code = oligo[3]), {nn_sql('r', 'id', 'seq')}, {tm_sql()}
SELECT id, count(*)::BIGINT AS fold, round(min(tm), 3) AS tm_min, round(max(tm), 3) AS tm_max, false AS capped FROM melt GROUP BY id""")
def degenerate_resolutions(spark, folder):
    oligo = F.concat(F.translate(F.left("seq", F.lit(3)), "ACGT", "RYSW"), F.substr("seq", F.lit(4), F.lit(100)))
    out = M.resolved_range(X.pool(spark, folder).select("id", oligo.alias("oligo")), ["id"], "oligo")
    return out.select("id", "fold", F.round("tm_min", 3).alias("tm_min"), F.round("tm_max", 3).alias("tm_max"), "capped")


_WIDE = "translate(left(oligo, 6), 'ACGT', 'RYSW') || 'NN' || substr(oligo, 9)"


@query("degenerate_tm_range", f"""WITH RECURSIVE {X.ASSAYS}, o AS (SELECT DISTINCT {_WIDE} AS oligo FROM (SELECT forward AS oligo FROM assays UNION ALL SELECT reverse FROM assays) z),
codes(code, base) AS (VALUES ('R', 'A'), ('R', 'G'), ('Y', 'C'), ('Y', 'T'), ('S', 'C'), ('S', 'G'), ('W', 'A'), ('W', 'T'), ('N', 'A'), ('N', 'C'), ('N', 'G'), ('N', 'T')),
r(oligo, done, k) AS (SELECT oligo, '', 0 FROM o UNION ALL SELECT oligo, done || base, k + 1 FROM r JOIN codes ON code = oligo[k + 1] WHERE k < 8),
f AS (SELECT row_number() OVER () AS id, oligo, done || substr(oligo, 9) AS seq FROM r WHERE k = 8), {nn_sql('f', 'id', 'seq')}, {tm_sql()}
SELECT oligo, count(*)::DOUBLE AS fold, round(min(tm), 3) AS tm_min, round(max(tm), 3) AS tm_max FROM melt JOIN f USING (id) GROUP BY 1""")
def degenerate_tm_range(spark, folder):
    """Ranges of primers with a thousand forms and more each."""
    oligo = F.concat(F.translate(F.left("oligo", F.lit(6)), "ACGT", "RYSW"), F.lit("NN"), F.substr("oligo", F.lit(9), F.lit(100)))
    rows = X.assay_oligos(spark, folder).select(oligo.alias("oligo")).distinct()
    return M.tm_extremes(rows, ["oligo"], "oligo").select("oligo", "fold", F.round("tm_min", 3).alias("tm_min"), F.round("tm_max", 3).alias("tm_max"))


_RUNS = f"""{X.POOL}, {_STEP_CTE}, lens AS (SELECT id, seq, unnest(generate_series(1, length(seq) - 1)) AS i FROM pool),
spans AS (SELECT id, seq, i, unnest(generate_series(2, length(seq) - i + 1)) AS k FROM lens),
spos AS (SELECT id, i, k, substr(seq, i, k) AS run, unnest(generate_series(1, k - 1)) AS p FROM spans),
runs AS (SELECT id, i, run, (sum(round((h - 310.15::DOUBLE * s / 1000) * 1e6)::BIGINT)
    + any_value(CASE WHEN left(run, 1) IN ('A', 'T') THEN 1028385 ELSE 968420 END)
    + any_value(CASE WHEN right(run, 1) IN ('A', 'T') THEN 1028385 ELSE 968420 END))::DOUBLE / 1e6 AS dg
  FROM spos JOIN steps ON step = substr(run, p, 2) GROUP BY id, i, run)"""


@query("cross_dimer_pairs", f"""WITH {_RUNS}, q AS (SELECT DISTINCT id, run, dg FROM runs WHERE dg <= -6),
m AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, min(a.dg) AS dg FROM q a
  JOIN q b ON a.run = reverse(translate(b.run, 'ACGT', 'TGCA')) AND a.id <> b.id GROUP BY 1, 2)
SELECT a, b, round(dg, 6) AS dg FROM m""")
def cross_dimer_pairs(spark, folder):
    pool = X.pool(spark, folder)
    return I.interacting_pairs(pool, pool, "id", "seq", -6.0).select("a", "b", F.round("dg", 6).alias("dg"))


@query("panel_interactions", f"""WITH {_RUNS}, q AS (SELECT DISTINCT id, id % 7 AS assay, run, dg FROM runs WHERE dg <= -7),
m AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, min(a.dg) AS dg FROM q a
  JOIN q b ON a.run = reverse(translate(b.run, 'ACGT', 'TGCA')) AND a.assay <> b.assay GROUP BY 1, 2)
SELECT a, count(*)::BIGINT AS partners, round(min(dg), 6) AS worst_dg FROM m GROUP BY a""")
def panel_interactions(spark, folder):
    pool = X.pool(spark, folder).withColumn("assay", F.col("id") % 7)
    met = pool_tally(pool, "id", "seq", -7.0, group="assay")
    return met.select(F.col("id").alias("a"), "partners", F.round("dg", 6).alias("worst_dg"))


_EDGES = f"""{_RUNS}, q AS (SELECT DISTINCT id, run, dg FROM runs WHERE dg < -9),
edges AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(dg) AS dg FROM (
  SELECT a.id AS x, b.id AS y, a.dg FROM q a JOIN q b ON a.run = reverse(translate(b.run, 'ACGT', 'TGCA')) AND a.id <> b.id
  UNION ALL SELECT a.id, b.id, a.dg FROM q a JOIN q b ON a.run = b.run AND a.id <> b.id) GROUP BY 1, 2)"""


@query("confusability_edges", f"WITH {_EDGES} SELECT a, b, round(dg, 6) AS dg FROM edges")
def confusability_edges(spark, folder):
    return I.confusability_edges(X.pool(spark, folder), "id", "seq", -9.0).select("a", "b", F.round("dg", 6).alias("dg"))


@query("independent_panel")
def independent_panel(spark, folder):
    """A maximal conflict-free panel: no edge inside, and no oligo left out could join."""
    return I.independent_oligos(X.pool(spark, folder), "id", "seq", -9.0)


@query("self_structure_filter", f"""WITH {_RUNS}, s AS (SELECT r.id, min(dg) AS dg FROM runs r JOIN pool p USING (id)
  WHERE contains(reverse(translate(p.seq, 'ACGT', 'TGCA')), run) AND dg <= -2 GROUP BY 1)
SELECT pool.id, round(coalesce(s.dg, 0), 6) AS self_dg, coalesce(s.dg, 0) >= -9 AS kept FROM pool LEFT JOIN s USING (id)""")
def self_structure_filter(spark, folder):
    rows = X.pool(spark, folder).withColumn("dg", I.self_dimer_energies(F.col("seq"), -2.0))
    return rows.select("id", F.round("dg", 6).alias("self_dg"), (F.col("dg") >= -9.0).alias("kept"))


@query("hairpin_energies", f"""WITH {_RUNS}, s AS (SELECT r.id, min(dg) AS dg FROM runs r JOIN pool p USING (id)
  WHERE dg <= -1 AND contains(substr(p.seq, i + length(run) + 3), reverse(translate(run, 'ACGT', 'TGCA'))) GROUP BY 1)
SELECT pool.id, round(coalesce(s.dg, 0), 6) AS hairpin_dg FROM pool LEFT JOIN s USING (id)""")
def hairpin_energies(spark, folder):
    return X.pool(spark, folder).select("id", F.round(I.hairpin_energies(F.col("seq"), -1.0), 6).alias("hairpin_dg"))


@query("pool_duplicates", f"""WITH {X.TILED} SELECT seq, count(*)::BIGINT AS n,
  string_agg(DISTINCT src, ',' ORDER BY src) AS names FROM tiles GROUP BY 1 HAVING count(*) > 1""")
def pool_duplicates(spark, folder):
    rows = X.tiles(spark, folder)
    return (rows.groupBy("seq").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("names"))
            .filter("n > 1"))


@query("product_melt_overlaps", f"""WITH {X.TEMPLATES}, m AS (SELECT item_id, 81.5::DOUBLE + 16.6::DOUBLE * log10((50 + 120 * sqrt(2.2::DOUBLE)) / 1000)
  + 41.0::DOUBLE * length(translate(t, 'AT', '')) / length(t) - 600.0::DOUBLE / length(t) AS tm FROM templates)
SELECT a.item_id AS a, b.item_id AS b, round(abs(a.tm - b.tm), 4) AS delta FROM m a JOIN m b ON a.item_id < b.item_id AND abs(a.tm - b.tm) < 2""")
def product_melt_overlaps(spark, folder):
    rows = X.templates(spark, folder).withColumn("tm", T.amplicon_tm(F.col("t")))
    return I.melt_overlaps(rows, "item_id", "tm", 2.0).withColumn("delta", F.round("delta", 4))


@query("dye_collisions", """SELECT upper(p_type) AS channel, count(DISTINCT p_brand)::BIGINT AS n_assays FROM part
WHERE trim(p_type) <> '' GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def dye_collisions(spark, folder):
    return I.dye_collisions(table(spark, folder, "part").select("p_type", "p_brand"), "p_type", "p_brand")
