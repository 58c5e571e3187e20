"""Relative expression and reference-gene stability from a long Cq table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .stats import geometric_mean

# Cell texts that mean "not measured" in a wide Cq table.
MISSING_CQ = ["", "na", "nan", "-", "undetermined", "und", "none"]


def measured(cell: Column) -> Column:
    """Cq text to number; not-measured marks and unreadable text are null, never zero."""
    text = F.lower(F.trim(cell.cast("string")))
    value = text.try_cast("double")
    return F.when(~text.isin(*MISSING_CQ) & ~F.isnan(value), value)


def wide_to_long(table: DataFrame, ids: list[str]) -> DataFrame:
    """Sample-per-row table with one column per gene to (ids, gene, cq)."""
    genes = [c for c in table.columns if c not in ids]
    text = table.select(*ids, *[F.col(g).cast("string").alias(g) for g in genes])
    long = text.unpivot(ids, genes, "gene", "cell")
    return long.select(*ids, "gene", measured(F.col("cell")).alias("cq"))


def amplification_factor(percent: Column) -> Column:
    return 1.0 + F.coalesce(percent, F.lit(100.0)) / 100.0


def relative_quantities(cq: DataFrame, refs: list[str], keys: list[str], *, sample: str = "sample",
                        group: str = "grp", efficiencies: dict[str, float] | None = None) -> DataFrame:
    """dCq and efficiency-corrected quantity per sample and target.

    The reference genes of a sample are folded into one row by an aggregate and joined back; a
    sample that lacks any reference gene is left out whole.
    """
    eff = F.lit(100.0)
    for gene, percent in (efficiencies or {}).items():
        eff = F.when(F.col("gene") == gene, F.lit(float(percent))).otherwise(eff)
    rows = cq.filter(F.col("cq").isNotNull()).withColumn("factor", amplification_factor(eff))
    rows = rows.withColumn("lnq", -F.col("cq") * F.log("factor"))
    is_ref = F.col("gene").isin(*refs)
    ref = (rows.filter(is_ref).groupBy(*keys, sample, group)
           .agg(F.countDistinct("gene").alias("n_refs"), F.avg("cq").alias("ref_mean"), F.avg("lnq").alias("ref_lnq"))
           .filter(F.col("n_refs") == len(set(refs))))
    return (rows.filter(~is_ref).join(ref, [*keys, sample, group])
            .select(*keys, sample, group, F.col("gene").alias("target"),
                    (F.col("cq") - F.col("ref_mean")).alias("dcq"), (F.col("lnq") - F.col("ref_lnq")).alias("lnq")))


def fold_changes(quantities: DataFrame, keys: list[str], control: str, *, group: str = "grp") -> DataFrame:
    """Livak and efficiency-corrected fold change of each group against the control group."""
    groups = quantities.groupBy(*keys, "target", group).agg(
        F.count("*").alias("n"), F.avg("dcq").alias("mean_dcq"),
        F.when(F.count("*") > 1, F.stddev_samp("dcq")).otherwise(F.lit(0.0)).alias("sd_dcq"),
        F.avg("lnq").alias("mean_lnq"))
    ctrl = groups.filter(F.col(group) == F.lit(control)).select(
        *keys, "target", F.col("mean_dcq").alias("ctrl_dcq"), F.col("mean_lnq").alias("ctrl_lnq"))
    ddcq = F.col("mean_dcq") - F.col("ctrl_dcq")
    return (groups.join(ctrl, [*keys, "target"]).withColumn("ddcq", ddcq)
            .withColumn("fold_livak", F.pow(F.lit(2.0), -F.col("ddcq")))
            .withColumn("fold_low", F.pow(F.lit(2.0), -(F.col("ddcq") + F.col("sd_dcq"))))
            .withColumn("fold_high", F.pow(F.lit(2.0), -(F.col("ddcq") - F.col("sd_dcq"))))
            .withColumn("log2_fold", -F.col("ddcq"))
            .withColumn("fold_pfaffl", F.exp(F.col("mean_lnq") - F.col("ctrl_lnq")))
            .withColumn("low_n", F.col("n") < 3)
            .drop("ctrl_dcq", "ctrl_lnq", "mean_lnq"))


def complete_samples(cq: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """Keep samples that measured every gene of their study."""
    genes = cq.filter("cq is not null").groupBy(*keys).agg(F.countDistinct("gene").alias("genes"))
    per = cq.filter("cq is not null").groupBy(*keys, sample).agg(F.countDistinct("gene").alias("k"))
    joined = per.join(genes, keys) if keys else per.crossJoin(genes)
    full = joined.filter("k = genes").select(*keys, sample)
    return cq.join(full, [*keys, sample], "left_semi")


def pairwise_variation(cq: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """Sample sd of the log2 expression ratio of every ordered gene pair of a study.

    Each sample becomes one gene-to-value array before genes are paired, so no table is joined
    to itself; pairs per sample are bounded by the square of the study's gene count.
    """
    packed = cq.groupBy(*keys, sample).agg(F.collect_list(F.struct("gene", "lq")).alias("g"))
    pairs = packed.select(*keys, F.explode("g").alias("a"), "g").select(
        *keys, "a", F.explode(F.filter("g", lambda b: b["gene"] != F.col("a.gene"))).alias("b"))
    return pairs.groupBy(*keys, F.col("a.gene").alias("gene"), F.col("b.gene").alias("other")).agg(
        F.coalesce(F.stddev_samp(F.col("a.lq") - F.col("b.lq")), F.lit(0.0)).alias("v"))


def log2_quantity(cq: Column, efficiency: Column | float = 1.0) -> Column:
    """log2 of a relative quantity; the per-gene constant cancels in every ratio spread."""
    factor = 1.0 + (efficiency if isinstance(efficiency, Column) else F.lit(float(efficiency)))
    return -cq * F.log2(factor)


def stability_ranking(variation: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the least stable gene (ties: larger name) until two remain.

    ``rank`` 1 is the tied final pair; ``m`` is the gene's M value when it left. Each round is one
    small aggregate over all studies at once, two fewer rounds than the largest study has genes.
    """
    remaining = cut_lineage(variation)
    done = None
    genes = 1 + (remaining.groupBy(*keys, "gene").count().agg(F.max("count")).first()[0] or 0)
    for round_no in range(max(genes - 2, 0)):
        m = remaining.groupBy(*keys, "gene").agg(F.avg("v").alias("m"), F.count("*").alias("others"))
        # The losers are a few rows per study; writing them out keeps every round's plan flat.
        worst = cut_lineage(
            m.filter("others >= 2").groupBy(*keys)
            .agg(F.max(F.struct("m", "gene")).alias("w"), F.max("others").alias("others"))
            .select(*keys, F.col("w.gene").alias("gene"), F.col("w.m").alias("m"),
                    (F.col("others") + 1).alias("place")))
        done = worst if done is None else done.unionByName(worst)
        for side in ("gene", "other"):
            remaining = remaining.join(worst.select(*keys, F.col("gene").alias(side)), [*keys, side], "left_anti")
        if round_no % 4 == 3:
            remaining = cut_lineage(remaining)
    final = remaining.groupBy(*keys, "gene").agg(F.avg("v").alias("m")).withColumn("place", F.lit(1).cast("bigint"))
    return final if done is None else done.unionByName(final)


def panel_size_variation(cq: DataFrame, ranking: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """V(n/n+1): sd over samples of the log2 ratio of successive normalisation factors."""
    rank = Window.partitionBy(*keys).orderBy("place", "gene")
    placed = ranking.withColumn("ix", F.row_number().over(rank)).select(*keys, "gene", "ix")
    run = Window.partitionBy(*keys, sample).orderBy("ix")
    nf = (cq.join(placed, [*keys, "gene"])
          .withColumn("nf", F.avg("lq").over(run.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("next_nf", F.lead("nf").over(run)))
    return (nf.filter((F.col("ix") >= 2) & F.col("next_nf").isNotNull()).groupBy(*keys, F.col("ix").alias("n"))
            .agg(F.stddev_samp(F.col("nf") - F.col("next_nf")).alias("v")))


def gene_dispersion(cq: DataFrame, keys: list[str]) -> DataFrame:
    out = cq.filter("cq is not null").groupBy(*keys, "gene").agg(
        F.avg("cq").alias("cq_mean"), F.stddev_samp("cq").alias("cq_sd"), geometric_mean(F.col("cq")).alias("cq_gm"))
    return (out.withColumn("cq_cv", 100.0 * F.col("cq_sd") / F.col("cq_mean"))
            .withColumn("screen", F.when(F.col("cq_sd") > 1.0, "review (SD > 1 Cq)").otherwise("within 1 Cq")))
