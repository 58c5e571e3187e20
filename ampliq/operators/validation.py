"""What a validation run is asked to work on: candidates, cases, reaction conditions, and what changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import keep_first
from ..functions import seq as S

# Roles, their aliases, kinds of material and physical ranges of reaction conditions.
ROLES = ["target", "off_target"]
ROLE_ALIASES = ["near_neighbor", "near_neighbour", "offtarget"]
MATERIALS = ["natural", "synthetic", "computational"]
CONDITION_RANGES = {"mv": (0.0, 2000.0), "dv": (0.0, 200.0), "dntp": (0.0, 100.0), "dna": (1e-6, 1e6), "anneal": (30.0, 85.0)}


def bare_letters(col: Column) -> Column:
    """Upper-case nucleotide letters only; U counts as T, null as nothing."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(col, F.lit(""))), "U", "T"), f"[^{S.IUPAC_LETTERS}]", "")


def validate_candidates(rows: DataFrame, plan: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of a validation plan and rejects with their first error.

    ``rows``: plan, order (place in the submission), candidate_id, forward, reverse, probe, chemistry. A candidate without id is
    named after its place. Of candidates with equal oligos and chemistry the first is kept and the others are no error.
    ``candidate_id_repeated``: a kept candidate shares its id with an earlier kept one. A plan with fewer than two
    candidates is rejected whole (``too_few_candidates``).
    """
    named = rows.withColumns({
        "forward": bare_letters(F.col("forward")), "reverse": bare_letters(F.col("reverse")), "probe": bare_letters(F.col("probe")),
        "chemistry": F.coalesce(F.nullif(F.trim("chemistry"), F.lit("")), F.lit("unspecified")),
        "candidate_id": F.coalesce(F.nullif(F.trim(F.col("candidate_id").cast("string")), F.lit("")), F.concat(F.lit("candidate-"), F.col(order).cast("string")))})
    named = named.withColumn("identity_sha256", F.sha2(F.concat_ws("|", "forward", "reverse", "probe", "chemistry"), 256))
    whole = (F.col("forward") != "") & (F.col("reverse") != "")
    first = keep_first(named.where(whole), [*plan, "identity_sha256"], [F.col(order)])
    # The order of a submission tells candidates of one id apart: an aggregate, however many share it.
    owner = first.groupBy(*plan, "candidate_id").agg(F.min(order).alias("__owner"))
    judged = first.join(owner, [*plan, "candidate_id"]).withColumn("error", F.when(F.col(order) != F.col("__owner"), "candidate_id_repeated")).drop("__owner")
    sizes = judged.where("error is null").groupBy(*plan).agg(F.count("*").alias("__n"))
    judged = (judged.join(sizes, plan, "left")
              .withColumn("error", F.coalesce("error", F.when(F.coalesce("__n", F.lit(0)) < 2, "too_few_candidates"))).drop("__n"))
    lacking = named.where(~whole).withColumn("error", F.lit("primer_missing"))
    good = judged.where("error is null").drop("error").withColumn("probe", F.nullif("probe", F.lit("")))
    return good, judged.where("error is not null").unionByName(lacking)


def validate_cases(rows: DataFrame, plan: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Cases of a validation plan with cleaned sequence, role, group, material and content hash, and rejects with their first
    error.

    ``rows``: plan, order, case_id, role, grp, material, sequence. Null role, group and material are target, ungrouped and
    natural. A case without id is named after its place. Of equal ids the first stands, the others are rejected.
    """
    role = F.translate(F.lower(F.coalesce("role", F.lit("target"))), "-", "_")
    cleaned = rows.withColumns({
        "case_id": F.coalesce(F.nullif(F.trim(F.col("case_id").cast("string")), F.lit("")), F.concat(F.lit("case-"), F.col(order).cast("string"))),
        "role": F.when(role.isin(*ROLE_ALIASES), "off_target").otherwise(role), "grp": F.coalesce("grp", F.lit("ungrouped")),
        "material": F.lower(F.coalesce("material", F.lit("natural"))), "sequence": bare_letters(F.col("sequence"))})
    owner = cleaned.groupBy(*plan, "case_id").agg(F.min(order).alias("__owner"))
    error = (F.when(F.col(order) != F.col("__owner"), "case_id_repeated").when(F.col("sequence") == "", "sequence_missing")
             .when(~F.col("role").isin(*ROLES), "role_unknown").when(~F.col("material").isin(*MATERIALS), "material_unknown"))
    judged = cleaned.join(owner, [*plan, "case_id"]).withColumn("error", error).drop("__owner")
    good = judged.where("error is null").drop("error").withColumn("sequence_sha256", F.sha2("sequence", 256))
    return good, judged.where("error is not null").drop("sequence")


def condition_errors(rows: DataFrame) -> DataFrame:
    """Rows of text or numbers (mv, dv, dntp, dna, anneal) with ``error``, the first thing that makes them unusable, and
    ``warning``, no free magnesium. Nulls take the defaults of the reaction and are not judged."""
    error = F.lit(None).cast("string")
    for name, (low, high) in reversed(CONDITION_RANGES.items()):
        text = F.trim(F.col(name).cast("string"))
        number = text.try_cast("double")
        own = (F.when(text.isNotNull() & number.isNull(), f"{name}_not_numeric")
               .when(F.isnan(number) | (F.abs(number) == float("inf")), f"{name}_not_finite")
               .when(~number.between(low, high), f"{name}_out_of_range"))
        error = F.coalesce(own, error)
    value = lambda name, default: F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(default))
    error = F.coalesce(error, F.when(value("mv", 50.0) + value("dv", 3.0) <= 0, "no_salt"))
    warning = F.when(error.isNull() & (value("dntp", 0.8) >= value("dv", 3.0)), "no_free_magnesium")
    return rows.withColumns({"error": error, "warning": warning})


EVIDENCE = ["target_coverage", "worst_3prime", "probe_identity", "signal_subjects", "product_subjects", "robustness", "triplet_penalty",
            "practical_penalty", "degeneracy_fold", "panel_risk", "amplicon"]


def candidate_changes(left: DataFrame, right: DataFrame, keys: list[str], *, evidence: list[str] = EVIDENCE) -> DataFrame:
    """Per candidate of both runs: rank shift, failures and finalist categories added and removed, numeric deltas (right less
    left, null where either is missing or not finite).

    Both sides carry rank, hard_valid, the arrays failures and categories, and the evidence columns. One equi-join.
    """
    both = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l")).join(
        right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r")), keys)

    def less(a: str, b: str, name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.array_sort(F.array_except(F.coalesce(F.col(f"{a}.{name}"), empty), F.coalesce(F.col(f"{b}.{name}"), empty)))

    def delta(name: str) -> Column:
        a, b = (F.col(f"{s}.{name}").cast("double") for s in "lr")
        finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(finite(a) & finite(b), F.round(b - a, 6)).alias(f"{name}_delta")

    return both.select(*keys, (F.col("l.rank") - F.col("r.rank")).alias("rank_shift"), (F.col("l.hard_valid") != F.col("r.hard_valid")).alias("validity_changed"),
                       less("r", "l", "failures").alias("failures_added"), less("l", "r", "failures").alias("failures_removed"),
                       less("r", "l", "categories").alias("categories_added"), less("l", "r", "categories").alias("categories_removed"),
                       *[delta(e) for e in evidence])
