"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns give candidate spans. Their values are hashed and counted by distinct repositories and owners over the
whole corpus: a value held by many owners is a copied example, one held by few looks live. Live values are then looked
for as bare tokens, so a leaked credential is also found where no keyword stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from ..session import cut_lineage, table

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: kind, pattern, group that holds the value. A longer run than the least length is the same leftmost match, so the
#: bounds of access and hex stand in the pattern; that of assign is checked after matching. A bare token is a whole run of
#: the letters of an assign value but for `=`, with a digit in it; runs are entered at their start alone, so the search is
#: linear in runs of any length.
KINDS = (("assign", ASSIGN, 2), ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "[0-9a-f]{24,}", 0),
         ("token", "(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{6,}+", 0))
BASE = 3


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of a pattern and the code points between them; null where there is none."""
    found = text.rlike(pattern)
    return (F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            F.when(found, F.transform(F.split(text, pattern, -1), F.length)))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str, *, copied_from: int = 3) -> DataFrame:
    """One row per input row: id, repo, owner, digest (md5 of the text) and `spans`, an array of (start, kind_no, kind, end, value_sha, repos,
    owners, live) ordered by start, then kind. Positions are code points, end exclusive.

    kind_no below 3: base spans (assign, access, hex), leftmost non-overlapping per kind. `token`: a bare token that equals,
    dots and `=` at the end aside, the value of a base span that is live, and lies outside every base span of its text; it
    has at least six characters, a letter and a digit. Values without a digit are words too and are not looked for bare,
    nor are values with `=` inside. live: fewer than `copied_from` owners hold the value. Null texts are empty; null repositories and owners each count as one. Repeated rows stay
    separate rows. Empty input: no rows. Extra columns are not read.

    Skew: a value in a third of all rows is first reduced to one row per (value, repository, owner) by partial
    aggregation; the joins on the value have no hint, so AQE splits hot values.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for no, (_, pattern, _) in enumerate(KINDS):
        m, g = _pieces(text, pattern)
        parts.append(F.struct(F.lit(no).alias("no"), m.alias("m"), g.alias("g")))
    raw = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(repo_col).alias("repo"),
                      F.col(owner_col).alias("owner"), F.md5(text).alias("digest"), F.filter(F.array(*parts), lambda p: p["m"].isNotNull()).alias("parts"))
    # A bare token is worth keeping only if it could be a credential: letters and digits mixed.
    row = ["rid", "id", "repo", "owner", "digest"]
    rows = (raw.select(*row, F.explode_outer("parts").alias("p"))
            .select(*row, F.col("p.no").alias("no"),
                    F.explode_outer(F.arrays_zip(F.col("p.m").alias("m"), F.slice(F.col("p.g"), 1, F.size("p.m")).alias("g"),
                                                 F.sequence(F.lit(1), F.size("p.m")).alias("at"))).alias("x"))
            .select(*row, "no", F.col("x.m").alias("m"), F.col("x.g").alias("g"), F.col("x.at").alias("at")))
    # Written once: row ids and positions below all come from the same pass over the texts.
    hits = cut_lineage(rows)
    order = Window.partitionBy("rid", "no").orderBy("at")
    length = F.length("m")
    ends = F.sum(F.col("g") + length).over(order)
    kind = F.element_at(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("no") + 1)
    value = F.when(F.col("no") == 0, F.regexp_extract("m", ASSIGN, 2)).otherwise(F.col("m"))
    core = F.regexp_replace("value", "[.=]+$", "")
    bare = F.when(F.col("no") < BASE, F.col("end")).otherwise(F.col("start") + F.length("core"))
    placed = (hits.where(F.col("no").isNotNull())
              .withColumns({"end": ends.cast("long"), "start": (ends - length).cast("long"), "kind": kind, "value": value}).withColumn("core", core)
              .where((F.col("no") != 0) | (F.length("value") >= 6))
              .where((F.col("no") < BASE) | ((F.length("core") >= 6) & F.col("core").rlike("[0-9]") & F.col("core").rlike("[A-Za-z]")))
              .select("rid", "repo", "owner", "no", "kind", "start", bare.cast("long").alias("end"), F.sha2("value", 256).alias("sha"),
                      F.sha2("core", 256).alias("core_sha")))
    base = placed.where(F.col("no") < BASE)
    holders = base.groupBy("sha", "repo", "owner").agg(F.lit(1).alias("one"))
    by_owner = holders.groupBy("sha", "owner").agg(F.count("*").alias("pairs"))
    owned = (holders.groupBy("sha", "repo").agg(F.lit(1).alias("x")).groupBy("sha").agg(F.count("*").alias("repos"))
             .join(by_owner.groupBy("sha").agg(F.count("*").alias("owners")), "sha")
             .withColumn("live", F.col("owners") < copied_from))
    spans = F.struct("start", F.col("no").alias("kind_no"), "kind", "end", F.col("sha").alias("value_sha"), "repos", "owners", "live")
    # Values that differ in dots or padding at their end are looked for together.
    sought = (base.select("sha", "core_sha").distinct().join(owned.where("live"), "sha").groupBy("core_sha")
              .agg(F.max("repos").alias("repos"), F.max("owners").alias("owners"), F.lit(True).alias("live")))
    found = (base.join(owned, "sha").select("rid", spans.alias("span"))
             .unionByName(placed.where(F.col("no") == BASE).join(sought, "core_sha").select("rid", spans.alias("span"))))
    # One list per row of the input: base spans and bare tokens of live values.
    lists = found.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("all"))
    kept = F.filter("all", lambda t: (t["kind_no"] < BASE) | ~F.exists(
        F.filter("all", lambda b: b["kind_no"] < BASE), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    heads = hits.groupBy("rid").agg(F.first("id").alias("id"), F.first("repo").alias("repo"), F.first("owner").alias("owner"), F.first("digest").alias("digest"))
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value_sha:string,"
                  "repos:bigint,owners:bigint,live:boolean>>)")
    return (heads.join(lists.withColumn("spans", kept), "rid", "left")
            .select(F.col("id").alias(id_col), "rid", "repo", "owner", "digest",
                    F.coalesce("spans", none).alias("spans")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str, length_col: str, **options) -> DataFrame:
    """All rows and columns of docs; live spans of the text are replaced by [kind], its length by the new one.

    Copied examples stay. Texts without live spans, null texts and their lengths are unchanged.
    """
    found = scan(docs, id_col, text_col, repo_col, owner_col, **options)
    dig, listed, fresh = tx.fresh(docs.columns, "_digest", "_spans", "_new")
    # Where a span stands depends on the text alone.
    live = cut_lineage(found.select(F.col("digest").alias(dig), F.filter("spans", lambda s: s["live"]).alias(listed))
                       .where(F.size(listed) > 0).dropDuplicates([dig]))
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(listed, start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                       F.lit("["), s["kind"], F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2 ** 31 - 1))))
    joined = docs.join(live, F.md5(text) == F.col(dig), "left")
    new = joined.withColumn(fresh, F.when(F.col(listed).isNotNull(), done))
    return new.select(*[F.coalesce(F.col(fresh), text).alias(c) if c == text_col else
                        F.when(F.col(fresh).isNotNull(), F.length(fresh).cast(k)).otherwise(F.col(c)).alias(c) if c == length_col else F.col(c)
                        for c, k in docs.dtypes])


def op3_secret_ownership(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = scan(docs, "doc_id", "text", repo_col="source", owner_col="source")
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
p(no, kind, pat) AS (VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]{16,}'), (2, 'hex', '[0-9a-f]{24,}'), (3, 'token', '[A-Za-z0-9+/_.-]{6,}')),
x AS (SELECT rid, no, kind, pat, unnest(range(1, len(m) + 1)) AS pos, m, g FROM (
  SELECT rid, 0 AS no, 'assign' AS kind, (SELECT pat FROM p WHERE no = 0) AS pat, regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
    string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT rid, 1, 'access', '', regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), string_split_regex(t, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL SELECT rid, 2, 'hex', '', regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT rid, 3, 'token', '', regexp_extract_all(t, '[A-Za-z0-9+/_.-]{6,}'), string_split_regex(t, '[A-Za-z0-9+/_.-]{6,}') FROM d) z),
y AS (SELECT rid, no, kind, m[pos] AS v, sum(length(g[pos]) + length(m[pos])) OVER (PARTITION BY rid, no ORDER BY pos)::BIGINT AS e,
        CASE WHEN no = 0 THEN regexp_extract(m[pos], pat, 2) ELSE m[pos] END AS value FROM x),
f AS (SELECT y.* REPLACE (CASE WHEN no < 3 THEN e ELSE e - length(v) + length(core) END AS e), e - length(v) AS s, d.source
        FROM (SELECT *, regexp_replace(value, '[.=]+$', '') AS core FROM y) y JOIN d USING (rid) WHERE (no <> 0 OR length(value) >= 6)
        AND (no < 3 OR (length(core) >= 6 AND regexp_matches(core, '[0-9]') AND regexp_matches(core, '[A-Za-z]')))),
o AS (SELECT value, any_value(core) AS core, count(DISTINCT coalesce('+' || source, '-')) AS owners FROM f WHERE no < 3 GROUP BY value),
k AS (SELECT f.*, owners FROM f JOIN o USING (value) WHERE no < 3 UNION ALL SELECT f.*, 1 AS owners FROM f WHERE no = 3 AND core IN (SELECT core FROM o WHERE owners < 3)
        AND NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = f.rid AND b.no < 3 AND b.s < f.e AND f.s < b.e)),
a AS (SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans, count(*) FILTER (owners < 3) AS n_live FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN a USING (rid)
"""
