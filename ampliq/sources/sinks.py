"""Writers: immutable snapshots, order sheets, fragments, plate sheets, reports, vulnerability records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import committed
from .committed import write_snapshot  # noqa: F401

# Synthesis scale and purification per oligo kind.
ORDER_KINDS = {"primer": ("25nm", "STD"), "probe_zen": ("100nm", "HPLC"), "probe_lna": ("100nm", "HPLC")}


def safe_cell(col: Column) -> Column:
    """Quote text a spreadsheet would run as a formula."""
    return F.when(F.left(col, F.lit(1)).isin("=", "+", "-", "@"), F.concat(F.lit("'"), col)).otherwise(col)


def order_rows(oligos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order sheet rows and rejects from ``name, seq, kind``."""
    raw = F.upper(F.regexp_replace("seq", r"\s+", ""))
    bare = F.translate(raw, "+*", "")
    error = (F.when(~F.col("kind").isin(*ORDER_KINDS), "unsupported kind").when(raw == "", "empty oligo sequence")
             .when(raw.contains("/"), "modification codes are not accepted")
             .when(raw.contains("+") & (F.col("kind") != "probe_lna"), "locked bases need kind probe_lna")
             .when(raw.rlike(r"\+([^ACGT]|$)") | raw.rlike(r"(^\*)|(\*$)|(\*[+*])"), "misplaced + or *")
             .when(bare.rlike("[^ACGTRYSWKMBDHVN]"), "invalid oligo character")
             .when(~F.length(bare).between(6, 120), "oligo backbone length"))
    judged = oligos.withColumn("raw", raw).withColumn("error", error)
    scale, purity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (s, p) in ORDER_KINDS.items():
        scale = F.when(F.col("kind") == kind, F.lit(s)).otherwise(scale)
        purity = F.when(F.col("kind") == kind, F.lit(p)).otherwise(purity)
    wrapped = F.when(F.col("kind") == "primer", F.col("raw")).otherwise(F.concat(F.lit("/56-FAM/"), "raw", F.lit("/3IABkFQ/")))
    name = safe_cell(F.trim(F.regexp_replace("name", r"\s+", " ")))
    good = judged.filter("error is null").select(name.alias("Name"), wrapped.alias("Sequence"), scale.alias("Scale"), purity.alias("Purification"))
    return good, judged.filter("error is not null").drop("raw")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def fragment_lines(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragment records as FASTA text, names in safe letters only, and the rows with unresolved, invalid or no bases."""
    seq = F.upper(F.regexp_replace("seq", r"\s+", ""))
    fine = F.coalesce(seq.rlike("^[ACGT]+$"), F.lit(False))
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), "[^A-Za-z0-9_.+-]+", "_"))
    return (blocks.where(fine).select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value")),
            blocks.where(~fine).withColumn("error", F.lit("fragment holds unresolved or invalid bases")))


# Columns of a plate sheet, in order.
PLATE_FIELDS = ["well", "well_type", "candidate_id", "case_id", "case_role", "replicate", "expected", "observed", "cq",
                "efficiency", "melt_abnormal", "unexpected_product", "probe_signal", "notes"]


def plate_sheet(wells: DataFrame) -> DataFrame:
    return wells.select(*[(safe_cell(F.col(f).cast("string")) if f in wells.columns else F.lit(None).cast("string")).alias(f)
                          for f in PLATE_FIELDS])


# Columns of a panel report, in order.
REPORT_FIELDS = ["name", "gene", "organism", "chemistry", "forward", "reverse", "probe", "amplicon_nt", "fwd_tm", "rev_tm", "probe_tm",
                 "specificity", "intron", "efficiency_pct", "r2", "validated_lod95", "lowest_fully_detected", "engine_version", "ranker_version",
                 "design_run_id", "manifest_sha256", "manifest_state", "objective", "candidate_rank", "preference_state", "evidence_state",
                 "rank_reversal_summary", "rank_reversal_scenarios_json", "source_workflow", "thermodynamic_conditions"]


def panel_report(assays: DataFrame, *evidence: DataFrame, key: str = "assay_id") -> DataFrame:
    """One wide row per assay from joined evidence tables; absent fields stay empty."""
    wide = assays
    for table in evidence:
        wide = wide.join(table, key, "left")
    return wide.select(key, *[(safe_cell(F.col(f).cast("string")) if f in wide.columns else F.lit(None).cast("string")).alias(f)
                              for f in REPORT_FIELDS])


def append_vulnerability_records(records: DataFrame, path: str, batch: str) -> bool:
    """Append records whose fingerprint the table does not hold yet; a retry under the same batch name changes nothing."""
    return committed.append(records, path, batch)
