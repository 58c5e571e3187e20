"""Bench records: feedback datasets, validation plans and results, contracts, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import unit_interval_hash

# Allowed states of feedback and plate records.
STATUSES = ["untested", "success", "failed", "partial", "retired"]
LABELLED = ["success", "failed", "partial"]
DESIGNATIONS = ["none", "locked", "preferred", "experimental", "previously_ordered", "previously_validated",
                "failed_at_bench", "retired"]
SIGNALS = ["poor", "weak", "acceptable", "good", "strong", "not_measured"]
OBSERVED = ["amplified", "not_amplified", "missing", "invalid"]


def candidate_id(forward: Column, reverse: Column, probe: Column) -> Column:
    return F.concat(F.lit("cand_"), F.left(F.sha2(F.concat_ws("|", forward, reverse, F.coalesce(probe, F.lit(""))), 256), F.lit(20)))


def content_hash(columns: list[str]) -> Column:
    """sha256 of the row as JSON with sorted keys, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def feedback_error(r: DataFrame) -> Column:
    """First reason a feedback record is unusable, null when it is fine."""
    def outside(name: str, lo: float, hi: float) -> Column:
        text = F.col(name).cast("string")
        number = text.try_cast("double")
        given = text.isNotNull() & (F.trim(text) != "")
        return (F.when(given & number.isNull(), f"{name}_not_numeric")
                .when(given & F.isnan(number), f"{name}_not_finite")
                .when(given & ~number.between(lo, hi), f"{name}_out_of_range"))

    present = set(r.columns)
    checks = [F.when(~F.lower(F.trim("status")).isin(*STATUSES), "status_unknown")]
    if "designation" in present:
        checks.append(F.when(~F.lower(F.trim("designation")).isin(*DESIGNATIONS), "designation_unknown"))
    if "probe_signal_quality" in present:
        checks.append(F.when(~F.lower(F.trim("probe_signal_quality")).isin(*SIGNALS, ""), "probe_signal_quality_unknown"))
    limits = {"efficiency": (0, 300), "r2": (0, 1), "replicate_cv": (0, 500), "cq_at_declared_input": (0, 100)}
    checks += [outside(n, *v) for n, v in limits.items() if n in present]
    for n in ("nonspecific_products", "melt_peak_count"):
        if n in present:
            value = F.col(n).cast("string").try_cast("double")
            checks.append(F.when(F.col(n).isNotNull() & (value.isNull() | (value < 0) | (value != F.floor(value))),
                                 f"{n}_not_a_count"))
    labelled = F.lower(F.trim("status")).isin(*LABELLED)
    checks.append(F.when(labelled & (F.coalesce(F.trim(F.col("assay_id").cast("string")), F.lit("")) == ""), "assay_missing"))
    return F.coalesce(*checks)


def dataset_status(records: DataFrame, hash_columns: list[str]) -> DataFrame:
    """Counts of input, unique, duplicate, rejected and labelled records and their completeness.

    Duplicates fold by content hash in a combinable aggregate before anything is counted.
    """
    judged = records.withColumn("error", feedback_error(records))
    ok = judged.filter("error is null").withColumn("record_sha256", content_hash(hash_columns))
    unique = ok.groupBy("record_sha256").agg(
        F.count("*").alias("copies"), F.first("status").alias("status"), F.first("efficiency").alias("efficiency"),
        F.first("r2").alias("r2"), F.first("target_group").alias("target_group"))
    label = F.col("status").isin(*LABELLED)
    body = unique.agg(
        F.sum("copies").alias("n_normalized"), F.count("*").alias("n_unique"), F.sum(F.col("copies") - 1).alias("n_duplicates"),
        F.count_if(label).alias("n_labeled"), F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "partial").alias("n_partial"),
        F.count_if(label & F.col("target_group").isNull()).alias("missing_group"),
        (F.count_if(label & F.col("efficiency").isNotNull()) / F.count_if(label)).alias("efficiency_complete"))
    return body.join(judged.agg(F.count_if(F.col("error").isNotNull()).alias("n_rejected")))


def outcome_conflicts(records: DataFrame, identity: list[str]) -> DataFrame:
    """Identities whose labelled outcomes disagree."""
    return (records.filter(F.col("status").isin(*LABELLED)).groupBy(*identity)
            .agg(F.array_sort(F.collect_set("status")).alias("outcomes")).filter(F.size("outcomes") > 1))


def assay_evidence(records: DataFrame, assay: str, context: list[str]) -> DataFrame:
    """Local evidence per assay: state, success share and exact medians.

    Medians run on per-value tallies, so the records of one assay are never gathered.
    """
    s, f = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    base = records.groupBy(assay).agg(
        F.count("*").alias("n_records"), F.count_if(F.col("status").isin(*LABELLED)).alias("n_labeled"), s.alias("n_success"),
        f.alias("n_failed"), F.countDistinct(*context).alias("n_contexts"))
    for col in ("efficiency", "r2"):
        tally = records.filter(F.col(col).isNotNull()).groupBy(assay, col).agg(F.count("*").alias("w"))
        mid = tally.groupBy(assay).agg(F.expr(f"percentile({col}, 0.5, w)").alias(f"median_{col}"))
        base = base.join(mid, assay, "left")
    decisive = F.col("n_success") + F.col("n_failed")
    state = (F.when(decisive < 2, "insufficient_local_evidence")
             .when((F.col("n_success") > 0) & (F.col("n_failed") > 0), "mixed_local_evidence")
             .when(F.col("n_success") > 0, "consistent_local_success").otherwise("consistent_local_failure"))
    return (base.withColumn("evidence_state", state)
            .withColumn("success_fraction", F.col("n_success") / F.when(decisive > 0, decisive)))


def pairwise_votes(records: DataFrame, context: list[str], assay: str) -> DataFrame:
    """Assay pairs with opposite unanimous outcomes in one context, and their votes."""
    clear = (records.filter(F.col("status").isin("success", "failed")).groupBy(*context, assay)
             .agg(F.countDistinct("status").alias("k"), F.min("status").alias("outcome")).filter("k = 1"))
    won = clear.filter("outcome = 'success'").select(*context, F.col(assay).alias("w"))
    lost = clear.filter("outcome = 'failed'").select(*context, F.col(assay).alias("l"))
    votes = won.join(lost, context).select(F.least("w", "l").alias("a"), F.greatest("w", "l").alias("b"), "w")
    per = votes.groupBy("a", "b").agg(F.count("*").alias("n_contexts"), F.count_if(F.col("w") == F.col("a")).alias("for_a"))
    clash = (F.col("for_a") > 0) & (F.col("for_a") < F.col("n_contexts"))
    return (per.withColumn("conflict", clash)
            .withColumn("preferred", F.when(clash, None).when(F.col("for_a") > 0, F.col("a")).otherwise(F.col("b"))))


def calibration_gate(records: DataFrame, rejects: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """Whether the dataset could support a learned ranker, with a code for every unmet requirement.

    Equal records count once. ``rejects`` are records that validation refused, ``conflicts`` contexts with opposite
    outcomes; one row of either keeps the gate shut. A dataset without ``ranker_version`` is unversioned.
    """
    records = records.distinct()
    if "ranker_version" not in records.columns:
        records = records.withColumn("ranker_version", F.lit(None).cast("string"))
    label = F.col("status").isin(*LABELLED)

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""

    row = records.agg(
        F.count_if(label).alias("n_labeled"), F.countDistinct(F.when(~blank("target_group"), F.col("target_group"))).alias("n_groups"),
        F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(label & blank("target_group")).alias("no_group"), F.count_if(label & blank("ranker_version")).alias("no_version"))
    for name, other in (("n_conflicts", conflicts), ("n_rejected", rejects)):
        row = row.withColumn(name, F.lit(0).cast("long")) if other is None else row.crossJoin(other.agg(F.count("*").alias(name)))
    decisive = F.col("n_success") + F.col("n_failed")
    minority = F.coalesce(F.least("n_success", "n_failed") / F.when(decisive > 0, decisive), F.lit(0.0))
    row = row.withColumn("minority_fraction", minority)
    unmet = F.array_compact(F.array(
        F.when(F.col("n_labeled") < 100, "few_labeled"), F.when(F.col("n_groups") < 10, "few_groups"),
        F.when((F.col("n_success") < 25) | (F.col("n_failed") < 25), "few_of_one_outcome"), F.when(F.col("minority_fraction") < 0.20, "imbalanced"),
        F.when(F.col("no_group") > 0, "group_missing"), F.when(F.col("no_version") > 0, "version_missing"),
        F.when(F.col("n_conflicts") > 0, "conflicts"), F.when(F.col("n_rejected") > 0, "rejects")))
    return row.withColumn("unmet", unmet).withColumn("allowed", F.size("unmet") == 0)


def split_by_group(records: DataFrame, group: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Deterministic split in which a whole target group lands in one part."""
    u = unit_interval_hash(F.col(group).cast("string"))
    part = F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")
    return records.withColumn("dataset_split", part)


def prediction_state(amplifies: Column, has_probe: Column, probe_binds: Column) -> Column:
    return (F.when(~amplifies, "no_product").when(has_probe & ~F.coalesce(probe_binds, F.lit(False)), "product_without_probe")
            .when(has_probe, "signal_product").otherwise("product"))


def case_disagreements(states: DataFrame, case: str, candidate: str, total: Column | DataFrame) -> DataFrame:
    """Per case: how many candidate pairs differ in modelled state, from state counts alone.

    ``states`` holds only the pairs that do amplify; all other candidates of the panel are in the
    state no_product, so their number is the panel size minus the rows seen.
    """
    per = states.groupBy(case, "state").agg(F.count("*").alias("n"))
    agg = per.groupBy(case).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    full = agg.join(total)
    silent = F.col("panel") - F.col("seen")
    same = F.col("sq") + silent * silent
    return (full.withColumn("n_states", F.col("kinds") + F.when(silent > 0, 1).otherwise(0))
            .withColumn("n_distinguished", ((F.col("panel") * F.col("panel") - same) / 2).cast("long"))
            .select(case, "n_states", "n_distinguished"))


def well_table(spark, plate_format: int = 96) -> DataFrame:
    """Wells in column-major order with an edge flag."""
    n_rows, n_cols = (8, 12) if plate_format == 96 else (16, 24)
    ids = spark.range(n_rows * n_cols)
    row, col = F.col("id") % n_rows, F.floor(F.col("id") / n_rows) + 1
    name = F.concat(F.char(65 + row), col.cast("string"))
    edge = row.isin(0, n_rows - 1) | col.isin(1, n_cols)
    return ids.select(F.col("id").alias("slot"), name.alias("well"), edge.alias("edge_well"))


def plate_entries(candidates: DataFrame, cases: DataFrame, candidate: str, case: str, replicates: int, seed: int,
                  keys: list[str]) -> DataFrame:
    """Planned test wells of each plan: one block per case and replicate, candidates rotated inside it.

    Blocks are ordered by a seeded hash, so the layout is reproducible and spreads over plates.
    """
    by = Window.partitionBy(*keys)
    cand = candidates.withColumn("ci", F.row_number().over(by.orderBy(candidate)) - 1).withColumn("nc", F.count("*").over(by))
    cs = cases.withColumn("si", F.row_number().over(by.orderBy(case)) - 1)
    reps = cs.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = reps.join(cand, keys)
    turn = F.pmod(F.col("ci") - F.col("si") - F.col("replicate") + 1, F.col("nc"))
    block = F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys, case, "replicate"), 256)
    order = Window.partitionBy(*keys).orderBy("block", "turn")
    return (rows.withColumn("turn", turn).withColumn("block", block)
            .withColumn("slot", F.row_number().over(order) - 1).drop("si", "ci", "nc"))


def check_results(results: DataFrame, wells: DataFrame, keys: list[str]) -> DataFrame:
    """Plate results joined to the plan, each with its first error or null."""
    cleaned = results.withColumn("well", F.upper(F.trim("well"))).withColumn(
        "observed", F.regexp_replace(F.lower(F.trim(F.coalesce("observed", F.lit("missing")))), " ", "_"))
    known = wells.select(*keys, "well", F.lit(True).alias("planned"))
    joined = cleaned.join(known, [*keys, "well"], "left")
    nth = F.row_number().over(Window.partitionBy(*keys, "well").orderBy("line"))
    error = (F.when(F.col("planned").isNull(), "unknown well").when(nth > 1, "duplicate well")
             .when(~F.col("observed").isin(*OBSERVED), "observed state is not allowed")
             .when(F.col("cq").isNotNull() & ~F.col("cq").between(0, 80), "cq is outside the permitted range")
             .when(F.col("efficiency").isNotNull() & ~F.col("efficiency").between(0, 300), "efficiency is outside the permitted range"))
    return joined.withColumn("error", error).drop("planned")


def interpret_replicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replicate aggregate and agreement with the predicted state per candidate and case."""
    seen = F.col("observed").isin("amplified", "not_amplified")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_replicates"), F.count_if(seen).alias("n_observed"),
        F.count_if(F.col("observed") == "amplified").alias("n_amplified"),
        F.count_if(F.col("observed") == "not_amplified").alias("n_not"),
        F.avg("cq").alias("mean_cq"), F.when(F.count("cq") > 1, F.stddev_samp("cq")).alias("cq_sd"),
        F.min("expected").alias("expected"))
    wants = F.col("expected").isin("product", "signal_product")
    agrees = F.when(wants, F.col("n_amplified") == F.col("n_observed")).otherwise(F.col("n_not") == F.col("n_observed"))
    state = (F.when(F.col("n_observed") == 0, "missing").when(agrees, "supported")
             .when((F.col("n_amplified") > 0) & (F.col("n_not") > 0), "mixed").otherwise("contradicted"))
    return out.withColumn("agreement", state)


def readiness(checks: DataFrame, assay: str) -> DataFrame:
    """Roll named checks (status pass, warn, review, fail, na) up to one state per assay."""
    need = ["efficiency", "linearity", "slope", "lod", "single_product"]
    out = checks.groupBy(assay).agg(
        F.bool_or(F.col("status") == "fail").alias("failed"),
        F.bool_or(F.col("status").isin("warn", "review")).alias("soft"),
        F.count_if((F.col("status") == "na") & F.col("check").isin(*need)).alias("n_missing"))
    state = (F.when(F.col("failed"), "fail").when(F.col("n_missing") > 0, "incomplete").when(F.col("soft"), "review").otherwise("pass"))
    return out.withColumn("state", state).drop("failed", "soft")


def drift_state(complete: Column, n_current: Column, off_signal: Column, dropout: Column, added: Column) -> Column:
    """Ordered worst-of state of a drift scan."""
    return (F.when(~complete, "Scan incomplete").when(n_current == 0, "Evidence insufficient")
            .when(off_signal, "Possible signal-generating off-target").when(dropout, "Possible target dropout")
            .when(added > 0, "Stable with new variation").otherwise("Stable"))


def context_differences(manifests: DataFrame, left: str, right: str, run: str = "run") -> DataFrame:
    """Fields whose value differs between two run manifests (long form run, field, value)."""
    a = manifests.filter(F.col(run) == left).select("field", F.col("value").alias("left"))
    b = manifests.filter(F.col(run) == right).select("field", F.col("value").alias("right"))
    return a.join(b, "field", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def reproducibility_state(manifests_match: Column, context_match: Column, same_set: Column, same_order: Column,
                          has_differences: Column) -> Column:
    return (F.when(manifests_match & ~(same_set & same_order), "critical_non_reproducibility")
            .when(context_match & same_set & ~same_order, "unexplained_order_change")
            .when(context_match & same_order, "reproduced")
            .when(has_differences, "context_changed").otherwise("insufficient_provenance"))


def contract_state(c: dict[str, Column]) -> Column:
    """Comparison state of two design contracts from named boolean checks."""
    base = c["same_context"] & c["same_search"]
    return (F.when(~c["valid"], "invalid_contract").when(base & c["same_result"], "equivalent_reproduction")
            .when(base & c["same_winner"], "winner_equivalent_with_declared_result_set_difference")
            .when(base, "configuration_equivalent_result_drift")
            .when(c["same_policy"] & c["same_engine"] & c["same_profile"] & c["same_objective"],
                  "scientifically_comparable_with_declared_context_difference")
            .otherwise("not_directly_comparable"))


def objective_prerequisites(objective: Column, n_targets: Column, n_off: Column, n_panel: Column, n_junctions: Column) -> Column:
    """Evidence an objective needs that a run did not declare."""
    return F.array_compact(F.array(
        F.when(objective.isin("discrimination", "confirmatory") & (n_off < 1), "off_target_corpus"),
        F.when((objective == "broad_inclusivity") & (n_targets < 2), "several_targets"),
        F.when((objective == "multiplex") & (n_panel < 1), "panel"),
        F.when((objective == "transcript_specific") & (n_junctions < 1), "junction_coordinates")))
