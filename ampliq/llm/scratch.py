"""Giving back the disk of steps that nothing reads any more."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession


def forget(*tables: DataFrame) -> None:
    """Delete the checkpoint files of tables made by cut_lineage. What is still to be computed must not read them."""
    for table in tables:
        written = table._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if written.isDefined():
            jvm = table.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps now; it acts when the driver collects garbage, which a driver
    with much memory does too seldom for a job of a hundred small shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
