"""Explained rankings of runs larger than a task: no window spans a run.

Candidates are range partitioned on run and sort key, so each slice is a stretch of the order. Rules that look at the next
rank see it inside the slice; at its end they see the first row of the next slice, of which there is one per slice. Ranks and
bands are counted inside a slice and shifted by the totals of the slices before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as R
from ..session import cut_lineage

OPEN = ("near-equivalent alternatives", "insufficient evidence to distinguish")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys with nulls equal; the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def neighbours(candidates: DataFrame, run: list[str], ties: list[str], fields: list[str], slices: int | None = None) -> DataFrame:
    """Rows with ``slice``, ``rank`` and ``nx``, a struct of the fields of the next rank (null for the last of a run).

    Order: rank_key, then ties, which should tell all rows apart. A run that fills the table is spread over all slices.
    """
    order = [*run, "rank_key", *ties]
    n = slices or int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(candidates.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy(*run, "slice").orderBy("rank_key", *ties)
    rows = cut.withColumns({"__local": F.row_number().over(inside), "nx": F.lead(F.struct(*fields)).over(inside)})
    # One row per slice and run in it: at most slices plus runs rows, ordered by slice.
    heads = cut.groupBy(*run, "slice").agg(F.count("*").alias("__size"), F.min_by(F.struct(*fields), F.struct("rank_key", *ties)).alias("__head"))
    along = Window.partitionBy(*run).orderBy("slice")
    edges = heads.select(*run, "slice", F.coalesce(F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                         F.lead("__head").over(along).alias("__after"))
    joined = _same(rows, edges, [*run, "slice"])
    return (joined.withColumns({"rank": F.col("__before") + F.col("__local"), "nx": F.coalesce("nx", "__after")})
            .drop("__local", "__before", "__after"))


def bands(rows: DataFrame, run: list[str]) -> DataFrame:
    """Number the runs of neighbours that cannot be told apart (needs slice, rank, preference; rows written once)."""
    closed = F.when(F.col("preference").isin(*OPEN), 0).otherwise(1)
    along = Window.partitionBy(*run).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy(*run, "slice").agg(F.sum(closed).alias("__n"))
              .select(*run, "slice", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before")))
    inside = Window.partitionBy(*run, "slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    # A new band starts after every rank that is told from its next.
    local = rows.withColumn("__local", F.coalesce(F.sum(closed).over(inside), F.lit(0)))
    return _same(local, before, [*run, "slice"]).withColumn("band", F.col("__before") + F.col("__local") + 1).drop("__before", "__local")


def triggers() -> Column:
    """Codes under which the next rank could win: those of the neighbour rule, unverified junctions, a shared band, and new
    bench evidence where nothing else applies."""
    nx = lambda f: F.col(f"nx.{f}")
    more = F.array_compact(F.array(F.when(~F.col("junction") | ~nx("junction"), "junction_verified"),
                                   F.when(F.col("preference").isin(*OPEN), "same_band")))
    codes = F.concat("triggers", more)
    return (F.when(F.col("nx").isNull(), F.col("triggers"))
            .otherwise(F.when(F.size(codes) == 0, F.array(F.lit("new_bench_evidence"))).otherwise(codes)))


def strengths(has_probe: Column) -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c("target_coverage") >= 0.999, F.when(has_probe, "all_targets_with_probe").otherwise("all_targets")),
        F.when(c("offtarget_epcr") & (c("signal_subjects") == 0), "no_offtarget_signal"),
        F.when(c("robustness") >= 1.0, "all_conditions")))


def weaknesses() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when((c("target_coverage") < 0.999) & (c("target_coverage") > 0), "targets_missed"),
        F.when(~c("offtarget_epcr"), "exclusivity_unresolved").when(c("signal_subjects") > 0, "offtarget_signal"),
        F.when(c("robustness") < 1.0, "conditions_failed"), F.when(c("n_failures") > 0, "hard_failures")))


def explained(candidates: DataFrame, run: list[str], ties: list[str], *, has_probe: Column, objective: str = "balanced",
              slices: int | None = None) -> DataFrame:
    """Rank, decisive component, preference to the next rank, band, triggers, strengths and weaknesses of every candidate.

    candidates carry rank_key and the evidence columns. Equal to the window forms in ranking on any run that fits those.
    """
    fields = [*R.NEIGHBOUR_FIELDS, "junction", "rank_key"]
    rows = neighbours(candidates.withColumn("missing", R.missing_required()), run, ties, fields, slices)
    rows = R.decisive_component(rows.withColumn("__next", F.col("nx.rank_key")), run, objective)
    rows = cut_lineage(R.reversal_triggers(R.preference_states(rows, run)))
    return (bands(rows, run).withColumn("triggers", triggers()).withColumns({"strengths": strengths(has_probe), "weaknesses": weaknesses()}))
