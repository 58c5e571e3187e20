"""Evidence per candidate assay: robustness, hard failures, penalties and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import thermo as T


def condition_scenarios(base: T.Conditions) -> Column:
    """Nominal, low-stability and high-stability reaction conditions as an array of structs."""
    mv, dv, dntp, dna, anneal = (base.column(n) for n in ("mv", "dv", "dntp", "dna", "anneal"))

    def row(name: str, *values: Column) -> Column:
        fields = ("mv", "dv", "dntp", "dna", "anneal")
        return F.struct(F.lit(name).alias("name"), *[v.alias(f) for f, v in zip(fields, values)])

    zero = F.lit(0.0)
    return F.array(
        row("nominal", mv, dv, dntp, dna, anneal),
        row("low-stability", F.greatest(zero, mv * 0.8), F.greatest(zero, dv - 0.5),
            F.least(dntp + 0.2, F.greatest(zero, dv - 0.55)), F.greatest(F.lit(1e-6), dna * 0.75), anneal - 2),
        row("high-stability", mv * 1.2, dv + 0.5, F.greatest(zero, dntp - 0.2), dna * 1.25, anneal + 2))


def hard_failures(c: dict, objective: dict) -> Column:
    """Every hard requirement a candidate misses, sorted and distinct.

    Reads ``forward, reverse, probe, f_tm, r_tm, p_tm, amplicon, f_start, f_end, r_start, r_end,
    target_coverage, signal_coverage, signal_subjects, product_subjects, junction_level, fold``.
    """
    from ..functions import seq as S

    col = F.col
    synth = F.concat(col("forward"), col("reverse"), F.coalesce(col("probe"), F.lit("")))
    has_probe = col("probe").isNotNull()

    def primer(name: str, tm: str) -> list[Column]:
        s = col(name)
        out = [F.when(~F.length(s).between(c["len_min"], c["len_max"]), "primer_length"),
               F.when(~S.gc_percent(s).between(c["gc_min"], c["gc_max"]), "primer_gc"),
               F.when(~col(tm).between(c["tm_min"], c["tm_max"]), "primer_tm"),
               F.when(S.last5_gc(s) > c["max_3prime_gc"], "primer_gc_clamp"),
               F.when(S.longest_run(s, "G") >= c["max_g_run"], "primer_g_run"),
               F.when(S.longest_run(s) >= c["max_any_run"], "primer_base_run")]
        if c["no_three_prime_t"]:
            out.append(F.when(F.right(s, F.lit(1)) == "T", "primer_ends_in_t"))
        return out

    checks = [
        F.when(synth.rlike(f"[^{S.IUPAC_LETTERS}]"), "invalid_base"),
        F.when(F.instr(synth, "N") > 0, "unresolved_n"),
        F.when(~((col("f_start") < col("f_end")) & (col("f_end") <= col("r_start")) & (col("r_start") < col("r_end"))),
               "geometry"),
        F.when(~col("amplicon").between(c["amp_min"], c["amp_max"]), "amplicon_length"),
        F.when(F.coalesce(F.when(has_probe, col("signal_coverage")).otherwise(col("target_coverage")), F.lit(-1.0)) + 1e-12
               < objective["min_target_coverage"], "coverage_target"),
        F.when(has_probe & (F.coalesce(col("signal_coverage"), F.lit(0.0)) + 1e-12 < objective["min_probe_coverage"]),
               "coverage_probe"),
        F.when(col("fold") > objective["max_degeneracy_fold"], "degeneracy"),
        F.when(F.abs(col("f_tm") - col("r_tm")) > c["pair_tm_gap_max"], "tm_gap"),
        *primer("forward", "f_tm"), *primer("reverse", "r_tm")]
    if objective["require_no_signal_offtargets"]:
        checks.append(F.when(col("signal_subjects") > 0, "offtarget_signal"))
    if objective["require_no_product_offtargets"]:
        checks.append(F.when(col("product_subjects") > 0, "offtarget_product"))
    if objective["require_junction"]:
        checks.append(F.when(F.coalesce(col("junction_level"), F.lit("none")) != "strong", "junction_absent"))
    if not c["no_probe"]:
        checks.append(F.when(~has_probe, "probe_absent"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*checks))))


def triplet_penalty(tm_gap: Column, dimer: Column, offset: Column | None, c: dict) -> Column:
    out = F.abs(F.coalesce(tm_gap, F.lit(0.0))) + F.greatest(F.lit(0.0), -5.5 - dimer) * 2.0
    if offset is not None:
        best = min(max(c["probe_offset_min"], 9.0), c["probe_offset_max"])
        out = out + F.coalesce(0.35 * F.abs(offset - best), F.lit(0.0))
    return out


def practical_penalty(amplicon: Column, fold: Column, preferred: int) -> Column:
    return F.abs(amplicon - preferred) / 25.0 + F.greatest(F.lit(0), fold - 1) / 16.0


def panel_risk(three_prime: Column, cross: Column, melt: Column) -> Column:
    return F.when(three_prime, 2).when(cross | melt, 1).otherwise(0)


def use_degenerate(gain: Column, signal_ok: Column, product_ok: Column, fold: Column, n_targets: Column, objective: dict) -> Column:
    """Whether the degenerate pool replaces the base oligos."""
    exclusive = signal_ok & (product_ok if objective["require_no_product_offtargets"] else F.lit(True))
    return (gain > 1e-12) & exclusive & (fold <= objective["max_degeneracy_fold"]) & (n_targets > 1)


def preliminary_score(worst3_f: Column, worst3_r: Column, probe_mean: Column, max_idents: Column, blocks: Column,
                      dimer: Column) -> Column:
    """Conservation minus off-target identity plus 3' blocking, less a dimer penalty."""
    n = F.size(max_idents)
    mean_ident = F.when(n > 0, F.aggregate(max_idents, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    capped = F.transform(blocks, lambda b: F.least(b, F.lit(3)).cast("double"))
    block = F.when(F.size(capped) > 0, 9.0 * F.aggregate(capped, F.lit(0.0), lambda a, x: a + x)
                   + 5.0 * F.array_max(capped)).otherwise(F.lit(0.0))
    return ((worst3_f + worst3_r) / 2 + F.coalesce(probe_mean, F.lit(0.0)) - mean_ident + block
            - 4.0 * F.greatest(F.lit(0.0), -5.5 - dimer))


def diagnoses() -> Column:
    """Fault codes of an assay from its evidence and, where given, observed run data."""
    c = F.col
    codes = F.array_compact(F.array(
        F.when(~c("hard_valid"), "hard_requirement_failure"),
        F.when(F.abs(c("pair_tm_gap")) > 2.0, "primer_tm_imbalance"),
        F.when(c("worst_dimer") <= -6.0, "dimer_risk"),
        F.when(c("target_coverage") < 1.0, "target_coverage"),
        F.when(c("signal_subjects") > 0, "false_positive_risk").when(c("product_subjects") > 0, "offtarget_product"),
        F.when(c("forward_sites") > 1, "multiple_forward_placements"),
        F.when(c("forward_min_mm") > 0, "forward_target_mismatch"),
        F.when(c("reverse_sites") > 1, "multiple_reverse_placements"),
        F.when(c("reverse_min_mm") > 0, "reverse_target_mismatch"),
        F.when(c("probe_sites") > 1, "multiple_probe_placements"),
        F.when(c("amplicon") > 180, "long_amplicon"),
        F.when(c("robustness") < 1.0, "condition_sensitivity"),
        F.when(~c("efficiency").between(90, 110), "observed_efficiency"),
        F.when(c("r2") < 0.98, "standard_curve_linearity"),
        F.when(c("melt_peaks") != 1, "melt_abnormality"),
        F.when(c("probe_signal_problem"), "probe_signal_problem"),
        F.when(c("multiplex_failure"), "multiplex_only_failure")))
    return F.when(F.size(codes) == 0, F.array(F.lit("no_decisive_computational_fault"))).otherwise(codes)


# Metrics of an edit comparison and whether more is better (None: neither).
METRIC_DIRECTION = {"target_coverage": True, "worst_3prime": True, "probe_identity": True, "robustness": True,
                    "signal_subjects": False, "product_subjects": False, "triplet_penalty": False,
                    "practical_penalty": False, "worst_dimer": True, "amplicon": None}


def metric_changes(before, after, key: str):
    """Long table of metric before, after, delta and direction for two versions of each assay."""
    a = before.select(key, *[F.col(m).cast("double").alias(m) for m in METRIC_DIRECTION]).unpivot(
        [key], list(METRIC_DIRECTION), "metric", "before")
    b = after.select(key, *[F.col(m).cast("double").alias(m) for m in METRIC_DIRECTION]).unpivot(
        [key], list(METRIC_DIRECTION), "metric", "after")
    better = F.lit(None).cast("boolean")
    for name, up in METRIC_DIRECTION.items():
        if up is not None:
            better = F.when(F.col("metric") == name, (F.col("delta") > 0) == F.lit(up)).otherwise(better)
    both = a.join(b, [key, "metric"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    state = (F.when(F.col("delta").isNotNull() & (F.col("delta") != 0) & better, "improved")
             .when(F.col("delta").isNotNull() & (F.col("delta") != 0) & ~better, "worsened")
             .when(changed, "changed").otherwise("unchanged"))
    return both.withColumn("interpretation", state)


def edit_positions(old: Column, new: Column) -> Column:
    """1-based positions that differ between two oligos of one length; null when lengths differ."""
    spots = F.filter(F.sequence(F.lit(1), F.length(old)),
                     lambda i: F.substr(old, i, F.lit(1)) != F.substr(new, i, F.lit(1)))
    return F.when(F.length(old) == F.length(new), spots)
