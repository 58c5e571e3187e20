"""PCR from the one best placement of each primer on each sequence, and exact locations of oligos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .placement import best_placements
from .products import best_window_matches
from ..functions import seq as S


def single_placement_products(assays: DataFrame, subjects: DataFrame, *, assay: str, subject: str, min_product: int = 40, max_product: int = 3000,
                              min_ident: float = 0.75, probe_ident: float = 0.80) -> DataFrame:
    """At most one product per assay and sequence: size, span (1-based, inclusive), left primer and whether the probe lies in it.

    Each primer counts where it fits best, on either strand, if at least ``min_ident`` of it matches and its last base does.
    A product needs one primer on each strand, facing each other. ``probe_binds`` is null without a probe. Assays carry
    forward, reverse, probe; sequences that no primer fits have no row. The two hits of an assay meet on (assay, sequence):
    a row each, never a list of pairs.
    """
    oligos = assays.select(assay, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("oligo")) for r, c in (("F", "forward"), ("R", "reverse"))])).alias("o")) \
        .select(F.to_json(F.struct(assay, "o.role")).alias("__key"), assay, "o.role", "o.oligo").where("oligo is not null and oligo <> ''")
    placed = best_placements(oligos, subjects, oligo_key="__key", subject_key=subject, least=min_ident)
    n, i = F.length("oligo"), F.col("offset")
    ends = F.substr("window", n, F.lit(1))
    fits = (ends == "N") | F.array_contains(S.base_set(F.substr("oligo", n, F.lit(1))), ends)
    lengths = subjects.select(subject, F.length("seq").alias("__n"))
    lo = F.when(F.col("strand") == "+", i + 1).otherwise(F.col("__n") - (i + n) + 1)
    hits = (placed.where((F.col("ident") >= min_ident) & fits).join(oligos.select("__key", assay, "role"), "__key").join(lengths, subject)
            .select(assay, subject, "strand", F.struct("role", lo.alias("lo"), (lo + n - 1).alias("hi")).alias("hit")))
    pairs = (hits.groupBy(assay, subject).pivot("strand", ["+", "-"]).agg(F.first("hit"))
             .select(assay, subject, F.col("+").alias("p"), F.col("-").alias("m")).where("p is not null and m is not null"))
    size = F.col("m.hi") - F.col("p.lo") + 1
    facing = (F.col("p.lo") <= F.col("m.hi")) & (F.col("p.hi") <= F.col("m.lo") + 5)
    made = pairs.where(facing & size.between(min_product, max_product)).select(
        assay, subject, size.alias("size"), F.col("p.lo").alias("span_lo"), F.col("m.hi").alias("span_hi"), F.col("p.role").alias("left_primer"))
    probes = assays.select(assay, "probe")
    text = F.regexp_replace(F.translate(F.upper("seq"), "U", "T"), "[^ACGT]", "N")
    segment = F.substr(text, F.col("span_lo").cast("int"), F.col("size").cast("int"))
    rows = made.join(probes, assay).join(subjects.select(subject, "seq"), subject).withColumn("segment", segment).drop("seq")
    ident = best_window_matches(F.col("segment"), F.col("probe")) / F.length("probe")
    return (rows.withColumn("probe_binds", F.when(F.length("probe") > 0, ident >= probe_ident))
            .select(assay, subject, "size", "span_lo", "span_hi", "left_primer", "probe_binds"))


def locate(oligo: Column, seq: Column) -> Column:
    """0-based start of the first exact match of an oligo with ambiguity letters; null if there is none or either is empty."""
    letters = F.translate(F.upper(oligo), "U", "T")
    # Each letter becomes the class of its bases; letters without bases stand for themselves.
    pattern = letters
    for code, bases in S.IUPAC_SETS.items():
        if len(bases) > 1:
            pattern = F.replace(pattern, F.lit(code), F.lit(code.lower()))
    for code, bases in S.IUPAC_SETS.items():
        if len(bases) > 1:
            pattern = F.replace(pattern, F.lit(code.lower()), F.lit(f"[{''.join(sorted(bases))}]"))
    at = F.regexp_instr(F.translate(F.upper(seq), "U", "T"), pattern)
    return F.when((F.length(oligo) > 0) & (F.length(seq) > 0) & (at > 0), at - 1)


def probe_span(template: Column, probe: Column, strand: Column, f_end: Column, r_start: Column) -> tuple[Column, Column]:
    """Start and end (half-open) of a probe in its template: between the primers if it lies there, else anywhere."""
    text = F.upper(template)
    needle = F.when(F.coalesce(strand, F.lit("+")) == "+", F.upper(probe)).otherwise(S.revcomp(F.upper(probe)))
    between = F.instr(F.substr(text, f_end + 1, F.greatest(r_start - f_end, F.lit(0))), needle)
    anywhere = F.instr(text, needle)
    start = F.when(F.length(probe) > 0, F.when(between > 0, f_end + between - 1).when(anywhere > 0, anywhere - 1))
    return start, start + F.length(probe)
