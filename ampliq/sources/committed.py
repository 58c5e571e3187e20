"""Append-once tables: writers stage their rows anywhere and make them visible by one atomic rename.

A table folder holds ``data/batch=<name>/bucket=<prefix>`` and ``log/<number>``. A log entry names the batch it commits. Two
writers race for the next number; the rename fails for one of them, which then takes the number after. A batch that is
written again after a failure, or twice by a retry, is committed once. Readers see batches that are in the log, and of rows
with equal keys the one of the earliest entry.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading characters of a fingerprint that name its bucket.
PREFIX = 2


class _Files:
    """The file system of a folder, through Spark's Hadoop configuration."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(folder).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def move(self, source: str, target: str) -> bool:
        """Rename without overwriting; False if the target is there already."""
        target = self.path(target)
        if self.fs.exists(target):
            return False
        self.fs.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.conf).getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.path(source), target, none)
        except Exception:  # noqa: BLE001 - lost the race, unless the target is still not there
            if not self.fs.exists(target):
                raise
            return False
        return True

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        return text

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def log(spark: SparkSession, folder: str) -> list[str]:
    """Committed batches, earliest first."""
    files = _Files(spark, folder)
    return [files.read(f"{folder}/log/{n}") for n in files.names(f"{folder}/log") if n.isdigit()]


def stage(rows: DataFrame, folder: str, batch: str, key: str = "fingerprint") -> None:
    """Write one row per key as an uncommitted batch; writing it again replaces it. A committed batch is left as it is."""
    if batch in log(rows.sparkSession, folder):
        return
    (rows.dropDuplicates([key]).withColumn("bucket", F.left(F.col(key).cast("string"), F.lit(PREFIX)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/batch={batch}"))


def commit(spark: SparkSession, folder: str, batch: str) -> bool:
    """Make a staged batch visible; False if it was already."""
    files = _Files(spark, folder)
    while True:
        known = files.names(f"{folder}/log")
        if batch in log(spark, folder):
            return False
        draft = f"{folder}/draft/{batch}-{os.urandom(6).hex()}"
        files.write(draft, batch)
        number = 1 + max((int(n) for n in known if n.isdigit()), default=0)
        if files.move(draft, f"{folder}/log/{number:012d}"):
            return True
        files.drop(draft)


def visible(spark: SparkSession, folder: str, schema: str, key: str = "fingerprint", *, buckets: list[str] | None = None) -> DataFrame:
    """Committed rows with their ``batch``, one per key: that of the earliest committed batch. ``buckets`` reads only those."""
    batches = log(spark, folder)
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch string")
    table = (spark.read.schema(f"{schema}, batch string, bucket string").option("basePath", f"{folder}/data")
             .parquet(*[f"{folder}/data/batch={b}" for b in batches]))
    if buckets is not None:
        table = table.where(F.col("bucket").isin(buckets))
    order = spark.createDataFrame(list(enumerate(batches)), "entry int, batch string")
    names = [c for c in table.columns if c not in ("bucket", key)]
    return (table.join(order, "batch").groupBy(key).agg(F.min_by(F.struct(*names), "entry").alias("row")).select(key, "row.*"))


def append(rows: DataFrame, folder: str, batch: str, key: str = "fingerprint") -> bool:
    """Append rows whose key the table does not show yet, under a batch name the caller keeps for retries.

    Only the buckets of the arriving keys are looked at. A key that another writer commits in between is written twice and
    shown once.
    """
    spark = rows.sparkSession
    if batch in log(spark, folder):
        return False
    arriving = rows.dropDuplicates([key])
    touched = [r[0] for r in arriving.select(F.left(F.col(key).cast("string"), F.lit(PREFIX))).distinct().collect()]  # at most all prefixes
    fields = [f for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    known = visible(spark, folder, schema, key, buckets=touched)
    stage(arriving.join(known.select(key), key, "left_anti"), folder, batch, key)
    return commit(spark, folder, batch)


def write_snapshot(records: DataFrame, folder: str, snapshot_id: str) -> bool:
    """An immutable snapshot folder named by its content, put in place by one rename; False if it is there already.

    Whoever writes the same id a second time, at once or after a failure, leaves the first one untouched.
    """
    spark = records.sparkSession
    files, target = _Files(spark, folder), f"{folder.rstrip('/')}/snapshot_id={snapshot_id}"
    if files.fs.exists(files.path(target)):
        return False
    draft = f"{folder.rstrip('/')}/_draft-{snapshot_id}-{os.urandom(6).hex()}"
    records.write.parquet(draft)
    done = files.move(draft, target)
    if not done:
        files.drop(draft)
    return done
