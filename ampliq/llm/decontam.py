"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of `window` consecutive words keeps the least of its k-word hashes. Equal windows keep the same hash, so
any shared span of a window's length or more is found by an equality join on kept hashes; the hits are then
extended to all exact windows of the documents found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII. Null: no words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row although a lambda inside body refers to it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """Hashes of all n-word runs, in order."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
                  ).otherwise(F.expr("cast(array() as array<bigint>)"))


def least_of(hashes: Column, n: int) -> Column:
    """Distinct minima of all runs of n hashes."""
    last = F.size(hashes) - n
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.least(*[F.get(hashes, i + j) for j in range(n)]) if n > 1 else F.get(hashes, i)))
    ).otherwise(F.expr("cast(array() as array<bigint>)"))


def runs(words: Column, n: int) -> Column:
    """All n-word runs as texts; words hold no spaces."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.array_join(F.slice(words, i + 1, n), " "))
                  ).otherwise(F.expr("cast(array() as array<string>)"))


def _near(df: DataFrame, rows: int, bound: int = 500_000) -> DataFrame:
    """Broadcast a counted side while it is small; beyond the bound the join shuffles."""
    return F.broadcast(df) if rows <= bound else df


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, *,
                  window: int = 10, k: int = 5) -> DataFrame:
    """One row per input row: id, digest, n_words, n_hit (words inside a benchmark window), item_ids (sorted strings).

    Items of fewer than `window` words are one window each; items without words have none. Null texts have no
    words; null item ids count towards n_hit but are not listed. Repeated rows and copies get equal results: texts are
    searched once per digest. Empty inputs give no rows, or rows without hits. Extra columns are not read.

    Only texts that share a kept hash with an item are searched word by word. Sides that come from the benchmark are
    broadcast up to a counted bound and shuffled beyond it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(text)
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), key.alias("digest"),
                                   F.size(words_of(text)).cast("long").alias("n_words")))
    wi = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w"))
    spans = F.least(F.size("w"), F.lit(window))
    wi = cut_lineage(wi.where(F.size("w") > 0).withColumn("span", spans))
    lengths = sorted(r["span"] for r in wi.select("span").distinct().collect())  # at most `window` values

    def keep(words: Column, n: int) -> Column:
        size = min(k, n)
        return let(grams(words, size), lambda g: least_of(g, n - size + 1))

    def pick(make) -> Column:
        out = F.expr("cast(array() as array<string>)") if make is runs else F.expr("cast(array() as array<bigint>)")
        for n in lengths:
            out = F.when(F.col("span") == n, make(F.col("w"), n)).otherwise(out)
        return out

    marks = wi.select(F.explode(pick(keep)).alias("mark")).distinct()
    n_marks = marks.count()
    listed = cut_lineage(wi.select("item", F.col("span").alias("len"), F.explode(pick(runs)).alias("win")).distinct())
    wins = listed.select("win", "len").distinct()
    n_wins = wins.count()
    w = words_of(text)
    kept = F.array_distinct(F.concat(*[keep(F.col("w"), n) for n in lengths])) if lengths else F.expr("cast(array() as array<bigint>)")
    suspects = (docs.select(key.alias("digest"), w.alias("w")).select("digest", F.explode(kept).alias("mark"))
                .join(_near(marks, n_marks), "mark", "left_semi").select("digest").distinct())
    suspects = cut_lineage(suspects)
    n_suspects = suspects.count()
    searched = (docs.select(key.alias("digest"), text.alias("t")).join(_near(suspects, n_suspects), "digest", "left_semi")
                .groupBy("digest").agg(F.first("t").alias("t")).select("digest", words_of(F.col("t")).alias("w")))
    found = None
    for n in lengths:
        at = (searched.select("digest", F.posexplode(runs(F.col("w"), n)).alias("pos", "win"))
              .join(_near(wins.where(F.col("len") == n).select("win"), n_wins), "win").withColumn("len", F.lit(n)))
        found = at if found is None else found.unionByName(at)
    if found is None:
        return rows.select(F.col("id").alias(id_col), "digest", "n_words", F.lit(0).cast("long").alias("n_hit"),
                           F.expr("cast(array() as array<string>)").alias("item_ids"))
    found = cut_lineage(found)
    hit = (found.select("digest", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("word"))
           .distinct().groupBy("digest").agg(F.count("*").alias("n_hit")))
    named = (found.select("digest", "win").distinct().join(_near(listed.select("win", "item"), n_wins), "win")
             .groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    per_text = hit.join(named, "digest", "left")
    return (rows.join(per_text, "digest", "left")
            .select(F.col("id").alias(id_col), "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids")))


def op10_winnowing(spark, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
it AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark) z WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM it) z),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM low, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) z),
hit AS (SELECT DISTINCT rid, dw.n, p, dw.s FROM dw SEMI JOIN win ON dw.s = win.s AND dw.n = win.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) z GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i
    FROM hit JOIN win USING (s) WHERE item_id IS NOT NULL) z GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN cov USING (rid) LEFT JOIN ids USING (rid)
"""
