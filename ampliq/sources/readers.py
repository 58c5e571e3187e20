"""Readers that turn assay files into tables. Every reader is lazy and splits across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as S
from ..operators.expression import measured, wide_to_long


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``>`` header: record_id (first token), header, seq (letters only, upper).

    Records are split on the header mark, so a file is read in parallel; compressed files go
    through the codec. Text without a header is one record per file named record-1.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return raw.select("source_file", *_fasta_fields(F.col("value"))).filter("record_id is not null or length(seq) > 0")


def _fasta_fields(value: Column) -> list[Column]:
    text = F.regexp_replace(value, r"\r", "")
    marked = text.startswith(">")
    body = F.regexp_replace(text, r"^>", "")
    # Only the first record of a file still starts with its mark; the others were cut at it.
    first_line = F.split_part(body, F.lit("\n"), F.lit(1))
    bare = ~marked & first_line.rlike(r"^[A-Za-z\s\-.*]*$") & ~body.contains("\n") & first_line.rlike(r"^[ACGTUNacgtun\s]{12,}$")
    header = F.when(bare, F.lit("record-1")).otherwise(F.trim(first_line))
    rest = F.when(bare, body).otherwise(F.regexp_replace(body, r"^[^\n]*\n?", ""))
    return [F.split_part(header, F.lit(" "), F.lit(1)).alias("record_id"), header.alias("header"),
            F.upper(F.regexp_replace(rest, "[^A-Za-z]", "")).alias("seq")]


def read_metadata(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Record metadata; the key is the first of record_id, id, accession that is present."""
    table = spark.read.csv(path, header=True, sep=sep)
    keys = [c for c in ("record_id", "id", "accession") if c in table.columns]
    if not keys:
        raise ValueError("metadata needs a record_id, id or accession column")
    key = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in keys])
    return table.withColumn("record_id", key).filter("record_id is not null")


def read_cq_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide table (sample, group, gene columns) to long; not-measured marks become null."""
    table = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = table.columns
    if len(names) < 3 or names[0].lower() not in ("sample", "id", "name") or names[1].lower() not in ("group", "condition", "treatment"):
        raise ValueError("a wide Cq table starts with a sample and a group column and has at least one gene column")
    ready = table.withColumnsRenamed({names[0]: "sample", names[1]: "grp"}).filter("sample is not null and sample <> ''")
    return wide_to_long(ready, ["sample", "grp"])


def read_gene_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gene-per-row Cq matrix to long rows, and a table of problems."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    parts = lines.select(F.split(F.regexp_replace("v", ",", " "), r"\s+").alias("p"))
    long = parts.select(F.col("p")[0].alias("gene"), F.size("p").alias("width"),
                        F.posexplode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("sample", "cell"))
    long = long.withColumn("cq", F.col("cell").try_cast("double"))
    bad_cell = long.filter(F.col("cq").isNull() | F.isnan("cq") | (F.col("cq") <= 0) | (F.col("cq") > 50)).select(
        "gene", F.lit("Cq values should be numbers in (0, 50]").alias("problem")).distinct()
    genes = parts.groupBy(F.col("p")[0].alias("gene")).agg(F.count("*").alias("n"), F.min(F.size("p")).alias("width"))
    twice = genes.filter("n > 1").select("gene", F.lit("duplicate gene").alias("problem"))
    common = genes.groupBy("width").agg(F.count("*").alias("k")).agg(F.max_by("width", F.struct("k", "width")).alias("usual"))
    uneven = genes.join(common).filter("width <> usual").select("gene", F.lit("unequal number of Cq values").alias("problem"))
    return long.select("gene", "sample", "cq"), bad_cell.unionByName(twice).unionByName(uneven)


# Fields of a feedback record.
FEEDBACK = T.StructType([T.StructField(n, T.StringType()) for n in (
    "assay_id", "target_group", "design_run_id", "status", "designation", "ranker_version", "objective", "input_hash", "conditions",
    "efficiency", "r2", "replicate_cv", "cq_at_declared_input", "lod_observation", "nonspecific_products", "product_identity_method",
    "melt_peak_count", "melt_peaks", "probe_signal_quality", "multiplex_failure", "notes")])


def read_feedback(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Feedback records from a JSON array, ``{"records": [...]}`` documents or CSV."""
    if kind == "csv":
        table = spark.read.csv(path, header=True)
        return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None).cast("string")).alias(f.name) for f in FEEDBACK])
    wrapped = T.StructType([T.StructField("records", T.ArrayType(FEEDBACK)), *FEEDBACK.fields])
    docs = spark.read.schema(wrapped).json(path, multiLine=True)
    flat = F.struct(*[F.col(f.name) for f in FEEDBACK])
    return docs.select(F.explode(F.coalesce("records", F.array(flat))).alias("r")).select("r.*")


# Where exported runs keep their candidates.
_RUN_FIELDS = ["candidates", "ranked_candidates", "finalists", "results", "rows", "designs"]


def read_ranked_runs(spark: SparkSession, path: str) -> DataFrame:
    """Ranked candidates of run files: the first candidate array present, deduplicated keep-first."""
    from ..operators.corpus import keep_first
    from ..operators.records import candidate_id

    item = f"struct<assay:struct<{_ddl('forward reverse probe')}>,forward:string,reverse:string,probe:string,rank:int,candidate_rank:int>"
    schema = "run_id string, " + ", ".join(f"{f} array<{item}>" for f in _RUN_FIELDS)
    docs = spark.read.schema(schema).json(path, multiLine=True).withColumn("run_file", F.col("_metadata.file_path"))
    rows = docs.select(F.coalesce("run_id", "run_file").alias("run"), F.posexplode(F.coalesce(*_RUN_FIELDS)).alias("ix", "c"))
    part = {n: F.upper(F.coalesce(F.col(f"c.assay.{n}"), F.col(f"c.{n}"))) for n in ("forward", "reverse", "probe")}
    flat = rows.select("run", "ix", *[v.alias(k) for k, v in part.items()],
                       F.coalesce("c.rank", "c.candidate_rank", F.col("ix") + 1).alias("given_rank"))
    flat = flat.filter("forward is not null and reverse is not null").withColumn(
        "candidate_id", candidate_id(F.col("forward"), F.col("reverse"), F.col("probe")))
    first = keep_first(flat, ["run", "candidate_id"], [F.col("ix")])
    w = Window.partitionBy("run").orderBy("given_rank", "candidate_id")
    return first.withColumn("rank", F.row_number().over(w)).drop("ix")


def _ddl(names: str) -> str:
    return ",".join(f"{n}:string" for n in names.split())


# Component roles of an assay registry and the short names they may arrive under.
ROLES = ["forward_primer", "reverse_primer", "probe", "alternate_primer", "internal_control_primer", "internal_control_probe"]
ROLE_ALIASES = {"forward": "forward_primer", "reverse": "reverse_primer"}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Assay registry documents to one row per component; the older flat shape is migrated."""
    comp = f"struct<{_ddl('component_id role sequence order_sequence dye channel quencher notes')}>"
    assay = f"struct<{_ddl('assay_id id name assay_type chemistry forward reverse probe')},components:array<{comp}>>"
    schema = f"portfolio_name string, name string, portfolio_version string, assays array<{assay}>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    a = docs.select(F.coalesce("portfolio_name", "name").alias("portfolio"), F.posexplode("assays").alias("ai", "a"))

    def legacy(role: str, field: str) -> Column:
        empty = [F.lit(None).cast("string").alias(n) for n in ("dye", "channel", "quencher", "notes")]
        return F.when(F.col(f"a.{field}").isNotNull(), F.struct(
            F.lit(None).cast("string").alias("component_id"), F.lit(role).alias("role"), F.col(f"a.{field}").alias("sequence"),
            F.lit(None).cast("string").alias("order_sequence"), *empty))

    old = F.array_compact(F.array(legacy("forward_primer", "forward"), legacy("reverse_primer", "reverse"), legacy("probe", "probe")))
    parts = a.select("portfolio", F.coalesce("a.assay_id", "a.id", F.concat(F.lit("assay-"), F.col("ai") + 1)).alias("assay_id"),
                     F.posexplode(F.coalesce("a.components", old)).alias("ci", "c"))
    return component_rows(parts.select("portfolio", "assay_id", "ci", "c.*"))


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.csv(path, header=True).withColumnRenamed("portfolio_name", "portfolio")
    return component_rows(table.withColumn("ci", F.lit(0)).withColumn("sequence", F.lit(None).cast("string")))


def component_rows(parts: DataFrame) -> DataFrame:
    role = F.regexp_replace(F.lower(F.trim("role")), " ", "_")
    for short, full in ROLE_ALIASES.items():
        role = F.when(role == short, F.lit(full)).otherwise(role)
    order = F.trim(F.coalesce("order_sequence", "sequence"))
    bare = F.regexp_replace(F.translate(F.upper(S.strip_order_marks(order)), "U", "T"), f"[^{S.IUPAC_LETTERS}]", "")
    out = parts.withColumn("role", role).withColumn("order_sequence", order).withColumn("sequence", bare)
    error = (F.when(~F.col("role").isin(*ROLES), "unsupported role").when(F.col("sequence") == "", "no usable nucleotide sequence")
             .when(F.length("sequence") > 200, "exceeds 200 bases"))
    ident = F.coalesce("component_id", F.concat_ws("-", "assay_id", "role", (F.col("ci") + 1).cast("string")))
    return out.withColumn("component_id", ident).withColumn("error", error).select(
        "portfolio", "assay_id", "component_id", "role", "sequence", "order_sequence", "error")


def registry_problems(components: DataFrame) -> DataFrame:
    """Assays that lack a forward or a reverse primer."""
    roles = components.groupBy("assay_id").agg(F.collect_set("role").alias("roles"))
    missing = F.array_except(F.array(F.lit("forward_primer"), F.lit("reverse_primer")), "roles")
    return roles.filter(F.size(missing) > 0).select("assay_id", F.array_join(missing, ",").alias("missing"))


def registered_triplets(components: DataFrame) -> DataFrame:
    """First forward primer, reverse primer and probe of every assay."""
    def first(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col("sequence")), F.when(F.col("role") == role, F.col("component_id")))

    return components.filter("error is null").groupBy("assay_id").agg(
        first("forward_primer").alias("forward"), first("reverse_primer").alias("reverse"), first("probe").alias("probe"))


def read_oligo_pool(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pool lines: ``name,seq``, ``name<tab>seq``, ``name seq`` or a bare sequence."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''")
    cut = F.when(F.col("v").contains(","), F.split("v", ",", 2)).when(F.col("v").contains("\t"), F.split("v", "\t", 2)).otherwise(F.split("v", r"\s+"))
    p = lines.withColumn("p", F.transform(cut, F.trim))
    spaced = ~F.col("v").contains(",") & ~F.col("v").contains("\t")
    pair = (F.size("p") == 2) & (F.get("p", F.lit(1)) != "") & (~spaced | (F.length(F.get("p", F.lit(1))) >= F.length(F.col("p")[0])))
    return p.select(F.when(pair & (F.col("p")[0] != ""), F.col("p")[0]).alias("name"), F.when(pair, F.get("p", F.lit(1))).otherwise(F.col("v")).alias("seq"))


def split_exons(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """Exon-marked text ``A|B|C`` to one row per exon with cleaned sequence and its length."""
    parts = transcripts.select(key, F.posexplode(F.split(text, r"\|")).alias("exon", "raw"))
    clean, _ = S.clean_sequence(F.col("raw"))
    return parts.select(key, "exon", F.coalesce(clean, F.lit("")).alias("seq")).withColumn("length", F.length("seq"))


def read_plate_results(spark: SparkSession, path: str) -> DataFrame:
    """Plate result lines with a line number per file order; numbers that do not parse are null."""
    fields = ["well", "observed", "cq", "efficiency", "melt_abnormal", "unexpected_product", "probe_signal", "notes"]
    table = spark.read.csv(path, header=True)
    have = [(F.col(f) if f in table.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    out = table.select(*have, F.monotonically_increasing_id().alias("line"))
    for f in ("cq", "efficiency"):
        out = out.withColumn(f, measured(F.col(f)))
    for f in ("melt_abnormal", "unexpected_product"):
        out = out.withColumn(f, F.coalesce(F.lower(f).isin("1", "true", "yes"), F.lit(False)))
    return out


def canonical_markers(queries: DataFrame, synonyms: DataFrame, text: str) -> DataFrame:
    """Attach the canonical marker to query text through a synonym dimension (form, marker).

    Words of a query are exploded and joined on the exact form, so the dimension may grow.
    """
    words = queries.withColumn("form", F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9]+"))))
    return words.join(synonyms.select(F.lower("form").alias("form"), "marker"), "form").drop("form").distinct()
