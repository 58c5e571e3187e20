"""How many products an assay makes on a subject and how many hold its probe, without listing a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .products import STRETCH


def product_tallies(primers: DataFrame, probes: DataFrame, keys: list[str], *, min_product: int = 40, max_product: int = 3000,
                    require_3prime: bool = True) -> DataFrame:
    """(keys, n_products, n_binding) of the any-primer product model, for keys with a product.

    ``primers``: keys, strand, lo, hi, q3 and flen, rlen, the lengths of the assay's primers, which are the lengths a right
    hit can have. ``probes``: keys, lo, hi, flen, rlen; a product binds when it holds one whole.

    Hits of one stretch of a subject and one length of right hit meet in one partition. There a left hit admits right ends
    from ``near`` (long enough, beyond the left primer) to ``far`` (short enough), and with a probe from the least end of
    those probe hits that start inside. Both are answered by running counts over sorted ends, so the work is a sort of the
    hits however many products they form. An assay without probe hits binds nothing; nulls in positions match nothing.
    """
    hits = primers.filter("q3") if require_3prime else primers
    width = max(STRETCH, max_product)
    lengths = "array_distinct(array(flen, rlen))"
    # A left hit lies in one stretch; what it may look for also goes to the stretch before.
    left = hits.filter("strand = '+'").select(
        *keys, F.expr(f"explode({lengths})").alias("n"), F.expr(f"floor(lo / {width})").alias("part"), F.col("lo").alias("pos"),
        F.lit(1).alias("kind"), F.col("lo").alias("start"), F.col("hi").alias("stop"))
    right = hits.filter("strand = '-'").select(
        *keys, (F.col("hi") - F.col("lo") + 1).alias("n"),
        F.expr(f"explode(sequence(floor((hi + 1 - {max_product}) / {width}), floor((hi + 1 - {min_product}) / {width})))").alias("part"),
        F.col("hi").alias("pos"), F.lit(2).alias("kind"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
    inside = probes.filter(F.col("hi") - F.col("lo") < max_product).select(
        *keys, "lo", "hi", F.expr(f"explode({lengths})").alias("n"))
    inside = inside.select(
        *keys, "n", F.expr(f"explode(sequence(floor((hi + 1 - {max_product}) / {width}), floor(lo / {width})))").alias("part"),
        F.col("lo").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("start"), F.col("hi").alias("stop"))

    place = Window.partitionBy(*keys, "n", "part")
    upto = lambda *order: place.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Probe hits (0) come before left hits (1) of the same start: they lie inside.
    met = left.unionByName(right).unionByName(inside).withColumn(
        "probe_end", F.min(F.when(F.col("kind") == 0, F.col("stop"))).over(upto(F.desc("pos"), "kind")))
    marks = (met.filter("kind > 0")
             .withColumn("near", F.greatest(F.col("start") + (min_product - 1), F.col("start"), F.col("stop") - 6 + F.col("n")))
             .withColumn("far", F.col("start") + (max_product - 1))
             .withColumn("bound", F.when(F.col("probe_end").isNotNull(), F.greatest("near", "probe_end")))
             .select(*keys, "n", "part", F.expr("""explode(CASE WHEN kind = 2 THEN array(struct(pos AS at, 0 AS turn, 0 AS one, 0 AS two))
        WHEN near > far THEN array()
        WHEN bound <= far THEN array(struct(far AS at, -1 AS turn, -1 AS one, -1 AS two), struct(near AS at, 1 AS turn, 1 AS one, 0 AS two),
                                     struct(bound AS at, 1 AS turn, 0 AS one, 1 AS two))
        ELSE array(struct(far AS at, -1 AS turn, -1 AS one, 0 AS two), struct(near AS at, 1 AS turn, 1 AS one, 0 AS two)) END)""").alias("m"))
             .select(*keys, "n", "part", "m.*"))
    # Ends at the far mark count as inside, so the mark comes first; ends at the near mark do too, so it comes last.
    ends = F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).over(upto(F.desc("at"), "turn"))
    return (marks.withColumn("ends", ends).groupBy(*keys)
            .agg(F.sum(F.col("one") * F.col("ends")).alias("n_products"), F.sum(F.col("two") * F.col("ends")).alias("n_binding"))
            .filter("n_products > 0"))


def subject_coverage(tallies: DataFrame, subjects: DataFrame, assay_keys: list[str]) -> DataFrame:
    """Subjects with a product and with a probe-holding product per assay, and their shares of all subjects."""
    counted = tallies.groupBy(*assay_keys).agg(F.count("*").alias("product_subjects"), F.count_if(F.col("n_binding") > 0).alias("signal_subjects"))
    return (counted.join(subjects.agg(F.count("*").alias("n")))
            .withColumn("product_fraction", F.col("product_subjects") / F.col("n"))
            .withColumn("signal_fraction", F.col("signal_subjects") / F.col("n")))
