"""Assay-shaped views of the driver tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..session import spread, table


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return (spread(docs, "doc_id")
            .select("doc_id", F.col("lang").alias("grp"), F.col("source").alias("src"),
                    S.letters_only(F.col("text")).alias("seq"))
            .filter(F.length("seq") >= 24))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return items.select("item_id", S.letters_only(F.col("text")).alias("t")).filter(F.length("t") >= 24)


def assays(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("t")
    return templates(spark, folder).select(
        "item_id", F.left("t", F.lit(12)).alias("forward"),
        S.revcomp(F.right("t", F.lit(12))).alias("reverse"),
        F.when(n - 24 >= 8, F.substr("t", F.lit(13), n - 24)).alias("probe"))


def assay_oligos(spark: SparkSession, folder: str, with_probe: bool = False) -> DataFrame:
    roles = [("F", "forward"), ("R", "reverse")] + ([("P", "probe")] if with_probe else [])
    return (assays(spark, folder)
            .select("item_id", F.explode(F.array(*[
                F.struct(F.lit(r).alias("role"), F.col(c).alias("oligo")) for r, c in roles])).alias("o"))
            .select("item_id", "o.role", "o.oligo").filter("oligo is not null"))


#: Tiles of a subject get ids doc_id * TILES + number.
TILES = 1 << 20


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject cut into 20-letter oligos; the last one takes the remainder, so no letter is left out."""
    n = F.floor(F.length("seq") / 20).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (F.col("doc_id") * TILES + i).alias("id"), F.substr("seq", i * 20 + 1, F.when(i == n - 1, F.lit(40)).otherwise(F.lit(20))).alias("seq")))
    return subjects(spark, folder).select("src", F.explode(cut).alias("t")).select("t.id", "t.seq", "src")


def pool(spark: SparkSession, folder: str) -> DataFrame:
    distinct = tiles(spark, folder).groupBy("seq").agg(F.min("id").alias("id"))
    # Few bytes but much work per oligo: keep the tasks that AQE would merge by size.
    return distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


SUBJECTS = """subjects AS (
  SELECT * FROM (SELECT doc_id, lang AS grp, source AS src,
    regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents) WHERE length(seq) >= 24)"""

TEMPLATES = """templates AS (
  SELECT * FROM (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS t FROM benchmark)
  WHERE length(t) >= 24)"""

ASSAYS = TEMPLATES + """, assays AS (
  SELECT item_id, left(t, 12) AS forward, reverse(translate(right(t, 12), 'ACGT', 'TGCA')) AS reverse,
    CASE WHEN length(t) - 24 >= 8 THEN substr(t, 13, length(t) - 24) END AS probe FROM templates)"""

TILED = SUBJECTS + f""", tiles AS (
  SELECT doc_id * {TILES} + i AS id, src, substr(seq, i * 20 + 1, CASE WHEN i = length(seq) // 20 - 1 THEN 40 ELSE 20 END) AS seq
  FROM (SELECT *, unnest(range(0, length(seq) // 20)) AS i FROM subjects) z)"""

POOL = TILED + """, pool AS (SELECT seq, min(id) AS id FROM tiles GROUP BY seq)"""

# All 12-base windows of every subject in oligo orientation, with the plus-strand start.
WINDOWS12 = """win AS (
  SELECT doc_id, '+' AS strand, i - 1 AS lo, substr(seq, i, 12) AS w, i - 1 AS off FROM
    (SELECT doc_id, seq, unnest(generate_series(1, length(seq) - 11)) AS i FROM subjects)
  UNION ALL
  SELECT doc_id, '-' AS strand, length(seq) - i - 11 AS lo, substr(rc, i, 12) AS w, i - 1 AS off FROM
    (SELECT doc_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc,
      unnest(generate_series(1, length(seq) - 11)) AS i FROM subjects))"""

OLIGOS12 = """oligos AS (
  SELECT item_id, 'F' AS role, forward AS oligo FROM assays UNION ALL
  SELECT item_id, 'R' AS role, reverse AS oligo FROM assays)"""
