"""Sequence corpora: acceptance, content hashes, duplicates, snapshots and their deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S


def acceptance_reasons(seq: Column, max_length: int | None = None) -> Column:
    """All reasons a cleaned record is rejected, in a fixed order."""
    checks = [
        F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, F.lit("empty_sequence")),
        F.when(seq.rlike(f"[^{S.IUPAC_LETTERS}]"), F.lit("invalid_alphabet")),
    ]
    if max_length is not None:
        checks.append(F.when(F.length(seq) > max_length, F.lit("record_too_long")))
    return F.array_compact(F.array(*checks))


def _judged(records: DataFrame, seq: str, max_length: int | None) -> DataFrame:
    dna = F.translate(F.regexp_replace(F.upper(F.col(seq)), r"\s+", ""), "U", "T")
    return (records.withColumn(seq, dna)
            .withColumn("reasons", acceptance_reasons(F.col(seq), max_length))
            .withColumn("length", F.coalesce(F.length(seq), F.lit(0))))


def split_records(records: DataFrame, seq: str = "seq", max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted records with their content hash, and rejects with reasons."""
    judged = _judged(records, seq, max_length)
    accepted = (judged.filter(F.size("reasons") == 0).drop("reasons")
                .withColumn("sequence_sha256", F.sha2(F.col(seq), 256)))
    return accepted, judged.filter(F.size("reasons") > 0).drop(seq)


def mark_duplicates(accepted: DataFrame, order: str, record_id: str, *scope: str) -> DataFrame:
    """Keep-first disposition per content hash.

    The first record per hash is found by a map-side combined aggregate, so a sequence that
    fills a third of the corpus shuffles as one partial row per task instead of as one group.
    """
    keys = [*scope, "sequence_sha256"]
    first = (accepted.groupBy(*keys)
             .agg(F.min(F.struct(F.col(order).alias("o"), F.col(record_id).alias("r"))).alias("first")))
    joined = accepted.join(first, keys, "left")
    is_first = F.col(order) == F.col("first.o")
    return (joined
            .withColumn("disposition", F.when(is_first, "accepted_unique").otherwise("accepted_duplicate"))
            .withColumn("duplicate_of", F.when(~is_first, F.col("first.r")))
            .drop("first"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, found by a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])).alias("row"))
    return picked.select(*keys, "row.*").select(*df.columns)


def snapshot_metrics(records: DataFrame, order: str, group: str = "grp", seq: str = "seq") -> DataFrame:
    """One row of corpus counts plus the unique-record count per group.

    Records are read once: they are counted per sequence and ``order``, then per sequence, then per group. The records of the
    least ``order`` of a sequence are its unique ones, the later ones are duplicates.
    """
    ok = F.size("reasons") == 0
    judged = _judged(records, seq, None).select(
        F.when(ok, F.unhex(F.sha2(F.col(seq), 256))).alias("key"), F.when(ok, F.col(order)).alias("order"),
        F.when(ok, F.coalesce(F.col(group).cast("string"), F.lit("ungrouped"))).alias("g"), F.when(ok, F.col("length")).alias("length"))
    # Copies meet in the tasks before any shuffle; all rejects are one row.
    rows = judged.groupBy("key", "order", "g").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    placed = rows.groupBy("key", "order").agg(F.sum("n").alias("n"), F.max("length").alias("length"), F.collect_list(F.struct("g", "n")).alias("groups"))
    known = F.col("order").isNotNull()
    each = placed.groupBy("key").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("ordered"), F.max("length").alias("length"),
        F.min_by(F.when(known, F.col("groups")), F.when(known, F.col("order"))).alias("first"))
    spread = each.select("key", "n", "ordered", "length", F.posexplode_outer("first"))
    head, accepted = F.coalesce("pos", F.lit(0)) == 0, F.col("key").isNotNull()
    totals = spread.groupBy(F.col("col.g").alias("g")).agg(
        F.sum(F.when(accepted & head, F.col("n"))).alias("raw"), F.sum("col.n").alias("unique"),
        F.sum(F.when(accepted & head, F.col("n") * F.col("length"))).alias("raw_bases"), F.sum(F.col("col.n") * F.col("length")).alias("unique_bases"),
        F.sum(F.when(accepted & head, F.col("ordered"))).alias("ordered"), F.sum(F.when(~accepted, F.col("n"))).alias("rejected"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return totals.agg(
        total("raw").alias("raw_record_count"), total("unique").alias("unique_sequence_count"), F.sum("raw_bases").alias("raw_total_bases"),
        F.sum("unique_bases").alias("unique_total_bases"), (total("ordered") - total("unique")).alias("exact_duplicate_count"),
        total("rejected").alias("rejected_record_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("unique") > 0, F.struct("g", F.col("unique").alias("n")))))).alias("group_counts"))


def snapshot_delta(base: DataFrame, follow: DataFrame, record_id: str, key: str = "sequence_sha256") -> DataFrame:
    """Added, removed and unchanged unique sequences between two snapshots."""
    def firsts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.min(record_id).alias(name))

    both = firsts(base, "base_record").join(firsts(follow, "follow_record"), key, "full")
    change = (F.when(F.col("base_record").isNull(), "added")
              .when(F.col("follow_record").isNull(), "removed").otherwise("unchanged"))
    return both.withColumn("change", change)


def corpus_hash(df: DataFrame, keys: list[str], order: str, seq: str) -> DataFrame:
    """Order-free content address of a sequence set: hash of its sorted row hashes.

    Row hashes are summed per 16-bit prefix first, so no task ever holds a whole corpus.
    """
    row = F.sha2(F.concat_ws(":", F.col(order).cast("string"), F.col(seq)), 256)
    buckets = (df.select(*keys, row.alias("h"))
               .groupBy(*keys, F.substring("h", 1, 2).alias("prefix"))
               .agg(F.count("*").alias("n"),
                    *[F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
                      for i in range(8)]))
    digest = F.sha2(F.concat_ws(",", "prefix", "n", *[f"s{i}" for i in range(8)]), 256)
    return (buckets.withColumn("d", digest).groupBy(*keys)
            .agg(F.sum("n").alias("n_sequences"),
                 F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("corpus_sha256")))


def metadata_groups(records: DataFrame, metadata: DataFrame, record_id: str) -> DataFrame:
    """Left join record metadata; a record without metadata keeps an empty map."""
    fields = [c for c in metadata.columns if c != record_id]
    entries = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]),
                                F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    packed = metadata.select(record_id, entries.alias("metadata"))
    empty = F.create_map().cast("map<string,string>")
    return (records.join(packed, record_id, "left")
            .withColumn("metadata", F.coalesce("metadata", empty)))


def running_offsets(parts: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Cumulative part ends per key; every end but the last is a junction."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = Window.partitionBy(*keys)
    return (parts.withColumn("junction", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("is_last", F.col(order) == F.max(order).over(last)))
