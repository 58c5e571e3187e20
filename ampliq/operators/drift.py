"""Drift of registered assays between sequence snapshots, and the records it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import product_scan as A

# Assay ids that travel together in one row.
BLOCK = 1024


def scan_assays(assays: DataFrame, records: DataFrame, *, assay: str, record: str, min_product: int = 40,
                max_product: int = 3000, min_ident: float = 85.0, max_len: int = 60) -> DataFrame:
    """Coherent and signal products of every assay on every record that yields one."""
    made = A.amplified(assays, records, [assay], [record], min_product=min_product, max_product=max_product, max_len=max_len)
    judged = A.judged(made, assays, [assay], min_ident)
    return judged.select(assay, record, F.lit(True).alias("coherent"), "signal", F.col("product"), "probe_ident")


def reason_code(role: Column, coherent: Column, signal: Column) -> Column:
    return (F.when((role == "target") & ~coherent, "new_target_lost_coherent_product")
            .when((role == "target") & coherent & ~signal, "new_target_lost_probe_recognition")
            .when((role == "off_target") & signal, "new_signal_generating_off_target"))


def new_records(base: DataFrame, current: DataFrame, key: str = "sequence_sha256") -> DataFrame:
    """Current records whose sequence the baseline does not hold."""
    return current.join(base.select(key).distinct(), key, "left_anti")


def drift_reasons(assays: DataFrame, fresh: DataFrame, calls: DataFrame, *, assay: str, record: str) -> DataFrame:
    """Every (assay, new record) with a reason; a target without a product is found by absence.

    A new target record owes a product to every registered assay, so the report holds one row per
    missing one by definition. Assay ids travel in bounded blocks and only the missing ones are
    unfolded; the count form is ``drift_counts``.
    """
    seen = calls.join(fresh.select(record, "role", "sequence_sha256"), record)
    found = seen.withColumn("code", reason_code(F.col("role"), F.lit(True), F.col("signal")))
    targets = fresh.filter("role = 'target'").select(record, "sequence_sha256", "role")
    n_blocks = assays.select(assay).distinct().agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64(assay), F.greatest("n_blocks", F.lit(1))).cast("int")
    blocks = (assays.select(assay).distinct().join(n_blocks).withColumn("block", block)
              .groupBy("block").agg(F.collect_list(assay).alias("ids")))
    got = (calls.join(targets.select(record), record).join(n_blocks).withColumn("block", block)
           .groupBy(record, "block").agg(F.collect_list(assay).alias("got")))
    asked = targets.join(n_blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    missing = F.when(F.col("got").isNull(), F.col("ids")).otherwise(F.array_except("ids", "got"))
    lost = (asked.join(blocks, "block").join(got, [record, "block"], "left").withColumn(assay, F.explode(missing))
            .withColumn("code", reason_code(F.col("role"), F.lit(False), F.lit(False))))
    cols = [assay, record, "sequence_sha256", "role", "code"]
    return found.filter("code is not null").select(*cols).unionByName(lost.select(*cols))


def drift_counts(assays: DataFrame, fresh: DataFrame, calls: DataFrame, *, assay: str, record: str) -> DataFrame:
    """Reason counts per assay; absent products are the remainder, so no pair is formed for them."""
    new = fresh.groupBy("role").agg(F.count("*").alias("n"))
    n_of = {role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0)) for role in ("target", "off_target")}
    sizes = new.agg(n_of["target"].alias("n_target"), n_of["off_target"].alias("n_off"))
    seen = calls.join(fresh.select(record, "role"), record).groupBy(assay).agg(
        F.count_if(F.col("role") == "target").alias("target_products"),
        F.count_if((F.col("role") == "target") & ~F.col("signal")).alias("lost_probe"),
        F.count_if((F.col("role") == "off_target") & F.col("signal")).alias("off_signal"))
    out = assays.select(assay).distinct().join(seen, assay, "left").join(sizes)
    zero = F.lit(0)
    return out.select(assay, "n_target", "n_off", (F.col("n_target") - F.coalesce("target_products", zero)).alias("lost_product"),
                      F.coalesce("lost_probe", zero).alias("lost_probe"), F.coalesce("off_signal", zero).alias("off_signal"))


def vulnerability_records(reasons: DataFrame, *, assay: str, scan_id: str, year: int) -> DataFrame:
    """One record per reason fingerprint with a readable id."""
    finger = F.sha2(F.concat_ws("|", F.lit(scan_id), F.col(assay).cast("string"), "code", "sequence_sha256"), 256)
    out = reasons.withColumn("fingerprint", finger).dropDuplicates(["fingerprint"])
    return out.withColumn("record_id", F.concat(F.lit(f"VR-{year:04d}-"), F.upper(F.left("fingerprint", F.lit(12)))))
