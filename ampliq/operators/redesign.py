"""Manual assays: placement status, one-base repairs, nested and constrained redesign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sites import find_sites


def placement_status(q3: Column, q3_definite: Column, is_primer: Column) -> Column:
    return (F.when(~is_primer, "not_applicable").when(q3 & q3_definite, "exact")
            .when(q3, "possible_ambiguous").otherwise("mismatch"))


def one_base_repairs(oligos: DataFrame, templates: DataFrame, oligo_keys: list[str], template_key: str, *,
                     seq: str = "seq", max_len: int = 60) -> DataFrame:
    """Substitutions that turn a single-mismatch placement into an exact one.

    ``oligos`` carry ``role`` and ``oligo``. Forward ones count on the plus strand, reverse ones on the minus strand, probes on
    both; placements over ambiguous bases are left out. The letters of a site come with it, so no sequence is joined.
    """
    on = F.when(F.col("role") == "F", "+").when(F.col("role") == "R", "-").when(F.col("role") == "P", "+-").otherwise("")
    hits = find_sites(oligos.withColumn("__way", on), templates, oligo_keys=oligo_keys, subject_keys=[template_key], seq=seq, anchor=0, max_mm=1,
                      max_len=max_len, strand_of_oligo="__way", site=True)
    single = hits.filter((F.col("mm") == 1) & (F.col("ambiguous_bases") == 0))
    out = single.join(oligos, oligo_keys).withColumn("new", F.col("site")).filter(~F.col("new").rlike("[^ACGT]"))
    spot = F.filter(F.sequence(F.lit(1), F.col("olen")),
                    lambda i: F.substr(F.col("oligo"), i, F.lit(1)) != F.substr(F.col("new"), i, F.lit(1)))
    out = out.withColumn("position", F.get(spot, F.lit(0)))
    return out.select(*oligo_keys, template_key, "strand", "lo", F.col("oligo").alias("old"), "new", "position",
                      (F.col("olen") - F.col("position")).alias("three_prime_distance"))


def outer_pairs(primers: DataFrame, inner: DataFrame, keys: list[str], *, gap: int, per_side: int,
                amp_max: int, order: list[Column]) -> DataFrame:
    """Nested outer pairs: each side lies at least ``gap`` outside the inner product.

    ``inner`` carries ``inner_start, inner_end``; each side keeps its best ``per_side`` primers
    before the sides meet.
    """
    w = Window.partitionBy(*keys, "strand").orderBy(*order)
    near = primers.join(inner, keys).filter(
        ((F.col("strand") == "+") & (F.col("end") + gap <= F.col("inner_start")))
        | ((F.col("strand") == "-") & (F.col("start") >= F.col("inner_end") + gap)))
    kept = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_side)
    f = kept.filter("strand = '+'").select(*keys, F.col("start").alias("f_start"), F.col("oligo").alias("forward"), F.col("tm").alias("f_tm"))
    r = kept.filter("strand = '-'").select(*keys, F.col("end").alias("r_end"), F.col("oligo").alias("reverse"), F.col("tm").alias("r_tm"))
    return (f.join(r, keys).withColumn("amplicon", F.col("r_end") - F.col("f_start"))
            .filter(F.col("amplicon") <= amp_max).withColumn("tm_gap", F.abs(F.col("f_tm") - F.col("r_tm"))))


def region_constraints(candidates: DataFrame, excluded: DataFrame, keys: list[str], *, required: tuple[str, str] | None = None,
                       max_shift: int | None = None) -> DataFrame:
    """Drop candidates that touch an excluded interval, miss a required one or move too far."""
    hit = candidates.select(*keys, "candidate", "f_start", "r_end").join(excluded, keys).filter(
        (F.col("f_start") < F.col("x_end")) & (F.col("x_start") < F.col("r_end"))).select(*keys, "candidate").distinct()
    out = candidates.join(hit, [*keys, "candidate"], "left_anti")
    if required:
        out = out.filter((F.col("f_start") <= F.col(required[0])) & (F.col("r_end") >= F.col(required[1])))
    if max_shift is not None:
        out = out.filter(F.abs(F.col("shift")) <= max_shift)
    return out


def lock_components(primers: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only the locked oligo on a locked side; unlocked sides stay whole."""
    marked = primers.join(locked.select(*keys, "strand", F.col("oligo").alias("keep")), [*keys, "strand"], "left")
    return marked.filter(F.col("keep").isNull() | (F.col("keep") == F.col("oligo"))).drop("keep")


def shared_blocks(isoforms: DataFrame, key: str, isoform: str, seq: str, k: int) -> DataFrame:
    """Longest block per key whose k-mers occur in every isoform, on the first isoform's axis."""
    starts = F.sequence(F.lit(1), F.length(seq) - k + 1)
    grams = (isoforms.filter(F.length(seq) >= k).select(key, isoform, F.col(seq).alias("s"), F.explode(starts).alias("at"))
             .select(key, isoform, "at", F.substr("s", F.col("at"), F.lit(k)).alias("__g")))
    total = isoforms.groupBy(key).agg(F.countDistinct(isoform).alias("__n"), F.min(isoform).alias("__first"))
    shared = (grams.select(key, isoform, "__g").distinct().groupBy(key, "__g").agg(F.count("*").alias("__m"))
              .join(total, key).filter("__m = __n").select(key, "__g", "__first"))
    w = Window.partitionBy(key).orderBy("at")
    spots = grams.join(shared, [key, "__g"]).filter(F.col(isoform) == F.col("__first")).select(key, "at")
    islands = spots.withColumn("isle", F.col("at") - F.row_number().over(w))
    runs = islands.groupBy(key, "isle").agg(F.min("at").alias("start"), (F.count("*") + k - 1).alias("length"))
    best = runs.groupBy(key).agg(F.max(F.struct("length", (-F.col("start")).alias("neg"))).alias("b"))
    return best.select(key, (-F.col("b.neg")).alias("start"), F.col("b.length").alias("length"))
