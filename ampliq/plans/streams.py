"""Streaming queries: the document table arrives as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..session import table
from ..streaming import drift as SD
from . import shapes as X
from .registry import query
from .sites import _CALLS

_FIRST = _CALLS + """, f AS (SELECT doc_id, sha256(seq) AS sha, grp, make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_minutes((doc_id * 7)::BIGINT) AS arrived,
    row_number() OVER (PARTITION BY seq ORDER BY doc_id) AS rn FROM subjects), fresh AS (SELECT * FROM f WHERE rn = 1)"""


def _run_monitor(spark, folder):
    schema = table(spark, folder, "documents").schema
    # The table may be one file or a folder of files of any name; a source takes a single file only by a pattern.
    raw = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/documents.parque[t]")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420)
    arriving = raw.select("doc_id", F.col("lang").alias("grp"), S.letters_only(F.col("text")).alias("seq"), start.alias("arrived_at"),
                          F.when(F.col("lang") == "en", "target").otherwise("off_target").alias("role")).filter(F.length("seq") >= 24)
    place = SD.work_folder(spark, "drift")
    SD.monitor(SD.arriving_sequences(arriving), X.assays(spark, folder), place, assay="item_id", record="doc_id",
               min_product=20, max_len=30).awaitTermination()
    return place


@query("streamed_drift_reasons", f"""WITH {_FIRST}, r AS (SELECT item_id, CASE WHEN grp = 'en' AND c.doc_id IS NULL THEN 'new_target_lost_coherent_product'
  WHEN grp = 'en' AND has_probe AND ident < 85 THEN 'new_target_lost_probe_recognition'
  WHEN grp <> 'en' AND c.doc_id IS NOT NULL AND (NOT has_probe OR ident >= 85) THEN 'new_signal_generating_off_target' END AS code
  FROM fresh f CROSS JOIN assays a LEFT JOIN calls c USING (item_id, doc_id))
SELECT item_id, code, count(*)::BIGINT AS n FROM r WHERE code IS NOT NULL GROUP BY 1, 2""")
def streamed_drift_reasons(spark, folder):
    place = _run_monitor(spark, folder)
    return spark.read.parquet(f"{place}/reasons").groupBy("item_id", "code").agg(F.count("*").alias("n"))


@query("streamed_window_counts", f"""WITH {_FIRST}
SELECT strftime(date_trunc('day', arrived), '%Y-%m-%d') AS day, item_id, grp, count(*)::BIGINT AS coherent_products,
  count(*) FILTER (NOT has_probe OR ident >= 85)::BIGINT AS signal_products FROM calls JOIN fresh USING (doc_id) GROUP BY 1, 2, 3""")
def streamed_window_counts(spark, folder):
    place = _run_monitor(spark, folder)
    calls = spark.readStream.schema(spark.read.parquet(f"{place}/calls").schema).parquet(f"{place}/calls")
    keys = ["window_start", "item_id", "grp"]
    SD.write_counts(SD.rolling_counts(calls, assay="item_id"), place, keys).awaitTermination()
    out = SD.latest_counts(spark, place, keys)
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


_ARRIVED = f"""{X.SUBJECTS}, parts AS (SELECT doc_id, grp, seq, doc_id % 8 AS part, make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_minutes((doc_id * 29)::BIGINT) AS arrived FROM subjects),
firsts AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY part, arrived, doc_id) AS nth FROM parts)"""


def _first_arrivals(spark, folder):
    """The documents arrive in eight deliveries, each of any number of files; each spans all days, so most rows of a later one are late.

    A run of the stream takes all that has arrived, so a delivery is a batch. The rows are read and cut once, before the first.
    """
    place = SD.work_folder(spark, "arrivals")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1740)
    rows = X.subjects(spark, folder).select("doc_id", "grp", "seq", start.alias("arrived_at"), (F.col("doc_id") % 8).alias("part"))
    rows.write.partitionBy("part").parquet(f"{place}/out")
    waiting = spark.read.schema(rows.schema).option("basePath", f"{place}/out").parquet(f"{place}/out")
    for part in range(8):
        waiting.where(F.col("part") == part).write.mode("append").parquet(f"{place}/in")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        SD.first_arrivals(SD.arriving_sequences(arrived), place, record="doc_id").awaitTermination()
    return place


@query("streamed_first_arrivals", f"""WITH {_ARRIVED} SELECT part AS batch, grp, count(*)::BIGINT AS n, min(doc_id)::BIGINT AS first_doc FROM firsts WHERE nth = 1 GROUP BY 1, 2""")
def streamed_first_arrivals(spark, folder):
    """How many sequences each arriving file brings that no earlier file held."""
    fresh = spark.read.parquet(f"{_first_arrivals(spark, folder)}/fresh")
    return fresh.groupBy("batch", "grp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_LATE = """marks AS (SELECT part, max(arrived) AS top FROM firsts WHERE nth = 1 GROUP BY 1),
taken AS (SELECT f.*, date_trunc('day', arrived) AS day, (SELECT max(top) - INTERVAL 2 DAY FROM marks m WHERE m.part < f.part - 1) AS mark FROM firsts f WHERE nth = 1)"""


@query("streamed_late_arrivals", f"""WITH {_ARRIVED}, {_LATE} SELECT strftime(day, '%Y-%m-%d') AS day, grp, count(*)::BIGINT AS n FROM taken
WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def streamed_late_arrivals(spark, folder):
    """New sequences per day and group; rows that come after the watermark has passed their day are not counted."""
    place = _first_arrivals(spark, folder)
    fresh = spark.read.parquet(f"{place}/fresh").withColumn("grp", F.coalesce("grp", F.lit("")))
    stream = SD.tallied_batches(fresh, place, 8, ["grp"], "1 day")
    counts = (stream.withWatermark("arrived_at", "2 days").groupBy(F.window("arrived_at", "1 day").alias("w"), "grp")
              .agg(F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "grp", "n"))
    keys = ["window_start", "grp"]
    SD.write_counts(counts, place, keys).awaitTermination()
    out = SD.latest_counts(spark, place, keys)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.nullif("grp", F.lit("")).alias("grp"), "n")
