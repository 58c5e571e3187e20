"""Drift monitoring on arriving sequences with Structured Streaming.

Each micro-batch is cleaned, hashed, reduced to sequences never seen before and scanned against
the registered assays. Every output of a batch lives in its own ``batch=N`` folder that a replay
overwrites, and a batch only looks at folders of earlier batches, so a restarted or retried batch
leaves the same tables behind.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators.corpus import keep_first, split_records

SEEN = "sequence_sha256 string, arrived_at timestamp"
#: Leading hex digits of a hash that name its bucket of the seen table.
PREFIX = 2


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place the cluster names; a local one only in a single-process session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp")


def arriving_sequences(raw: DataFrame, *, watermark: str | None = None, seq: str = "seq") -> DataFrame:
    """Accepted, hashed records of a stream; a watermark adds the bounded-state duplicate filter."""
    accepted, _ = split_records(raw, seq)
    if watermark is None:
        return accepted
    return accepted.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["sequence_sha256"])


def unseen(batch: DataFrame, batch_id: int, folder: str, record: str) -> DataFrame:
    """Rows of a batch whose sequence no earlier batch held, the first arrival of each.

    ``folder/seen`` keeps hashes by prefix, so a batch reads only the prefixes it brings. Only batches before this one
    count, so a replay of the batch finds the same rows.
    """
    spark = batch.sparkSession
    first = keep_first(batch, ["sequence_sha256"], [F.col("arrived_at"), F.col(record)])
    if batch_id == 0:
        return first
    touched = [r[0] for r in first.select(F.left("sequence_sha256", F.lit(PREFIX))).distinct().collect()]  # at most 16 ** PREFIX
    path = f"{folder}/seen"
    known = (spark.read.schema(f"{SEEN}, prefix string, batch long").option("basePath", path).parquet(path)
             .where(F.col("prefix").isin(touched) & (F.col("batch") < batch_id)))
    return first.join(known.select("sequence_sha256"), "sequence_sha256", "left_anti")


def remember(new: DataFrame, batch_id: int, folder: str) -> None:
    """Add the hashes of a batch; writing the batch again replaces its own files alone."""
    rows = new.select("sequence_sha256", "arrived_at", F.left("sequence_sha256", F.lit(PREFIX)).alias("prefix"), F.lit(batch_id).cast("long").alias("batch"))
    (rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("prefix", "batch").parquet(f"{folder}/seen"))


def first_arrivals(stream: DataFrame, folder: str, *, record: str, available_now: bool = True):
    """Write the rows of a stream whose sequence never arrived before to ``folder/fresh``, a folder per batch.

    Exact over any number of batches, whatever their arrival times; a watermark is only needed by what counts on top of it.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        unseen(batch, batch_id, folder, record).write.mode("overwrite").parquet(f"{folder}/fresh/batch={batch_id}")
        remember(batch.sparkSession.read.parquet(f"{folder}/fresh/batch={batch_id}"), batch_id, folder)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def monitor(stream: DataFrame, assays: DataFrame, folder: str, *, assay: str, record: str, min_product: int = 40,
            max_len: int = 60, available_now: bool = True):
    """Start the monitor: writes ``seen``, ``calls`` and ``reasons`` under ``folder``.

    The stream carries ``record, seq, role, grp, arrived_at, sequence_sha256``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = unseen(batch.select("sequence_sha256", record, "seq", "role", "grp", "arrived_at"), batch_id, folder, record)
        here = f"batch={batch_id}"
        # The new records are written first and read back: one scan feeds every output.
        fresh.write.mode("overwrite").parquet(f"{folder}/fresh/{here}")
        new = spark.read.parquet(f"{folder}/fresh/{here}")
        calls = D.scan_assays(assays, new, assay=assay, record=record, min_product=min_product, max_len=max_len)
        tagged = calls.join(new.select(record, "role", "grp", "arrived_at", "sequence_sha256"), record)
        tagged.write.mode("overwrite").parquet(f"{folder}/calls/{here}")
        made = spark.read.parquet(f"{folder}/calls/{here}").select(assay, record, "coherent", "signal")
        D.drift_reasons(assays, new, made, assay=assay, record=record).write.mode("overwrite").parquet(f"{folder}/reasons/{here}")
        remember(new, batch_id, folder)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rolling_counts(calls: DataFrame, *, assay: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling-window product counts per assay and group; rows later than ``late`` miss the window."""
    return (calls.withWatermark("arrived_at", late)
            .groupBy(F.window("arrived_at", width).alias("w"), assay, "grp")
            .agg(F.count("*").alias("coherent_products"), F.count_if("signal").alias("signal_products"))
            .select(F.col("w.start").alias("window_start"), assay, "grp", "coherent_products", "signal_products"))


def tallied_batches(rows: DataFrame, folder: str, batches: int, keys: list[str], width: str) -> DataFrame:
    """A stream of counts ``n`` per window and key of finished batches, one micro-batch per batch however many files it has.

    ``rows`` carry ``arrived_at`` and ``batch``. The latest time of a window and key stands for its rows: it falls into the
    same window and moves a watermark as far as they do. The counts of a batch are one file, since files are what a trigger
    limits.
    """
    spark, path = rows.sparkSession, f"{folder}/tallied"
    tallied = None
    for batch in range(batches):
        tallied = (rows.where(F.col("batch") == batch).groupBy(F.window("arrived_at", width).alias("w"), *keys)
                   .agg(F.count("*").alias("n"), F.max("arrived_at").alias("arrived_at")).drop("w"))
        tallied.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(tallied.schema).option("maxFilesPerTrigger", 1).parquet(path)


def write_counts(counts: DataFrame, folder: str, keys: list[str]):
    """Run the windowed counts in update mode; ``latest_counts`` reads the newest value per key."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return (counts.writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", f"{folder}/counts-checkpoint").trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    table = spark.read.parquet(f"{folder}/counts")
    values = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
