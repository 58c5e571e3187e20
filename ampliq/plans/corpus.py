"""Corpus queries: cleaning, acceptance, duplicates, metrics, snapshots and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo as T
from ..operators import corpus as C
from ..session import spread, table
from . import shapes as X
from .registry import query

_HASHED = X.SUBJECTS + """, hashed AS (
  SELECT *, sha256(seq) AS sha, min(doc_id) OVER (PARTITION BY seq) AS first_id FROM subjects)"""


@query("subject_properties", f"""WITH {X.SUBJECTS}
SELECT doc_id, length(seq)::BIGINT AS length, sha256(seq) AS sha,
  round(100.0::DOUBLE * length(translate(seq, 'AT', '')) / length(seq), 4) AS gc,
  length(translate(right(seq, 5), 'AT', ''))::BIGINT AS last5_gc,
  list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x)))::BIGINT AS longest_run,
  coalesce(list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), 0)::BIGINT AS g_run,
  sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_sha,
  round(81.5::DOUBLE + 16.6::DOUBLE * log10((50 + 120 * sqrt(2.2::DOUBLE)) / 1000)
    + 0.41::DOUBLE * 100 * length(translate(seq, 'AT', '')) / length(seq) - 600.0::DOUBLE / length(seq), 4) AS melt
FROM subjects""")
def subject_properties(spark, folder):
    s = F.col("seq")
    return X.subjects(spark, folder).select(
        "doc_id", F.length(s).alias("length"), F.sha2(s, 256).alias("sha"),
        F.round(S.gc_percent(s), 4).alias("gc"), S.last5_gc(s).alias("last5_gc"),
        S.longest_run(s).alias("longest_run"), S.longest_run(s, "G").alias("g_run"),
        F.sha2(S.revcomp(s), 256).alias("rc_sha"), F.round(T.amplicon_tm(s), 4).alias("melt"))


@query("sequence_cleaning", """SELECT doc_id, CASE
    WHEN trim(text) = '' THEN 'empty sequence'
    WHEN length(bad) > 0 THEN 'invalid character(s): ' || array_to_string(list_sort(list_distinct(string_split(bad, ''))), ' ')
    WHEN packed = '' THEN 'no sequence left after cleaning' END AS error,
  CASE WHEN length(bad) = 0 AND packed <> '' THEN sha256(translate(packed, 'U', 'T')) END AS clean_sha
FROM (SELECT doc_id, text, packed, regexp_replace(packed, '[ACGTRYSWKMBDHVNU]', '', 'g') AS bad FROM (
  SELECT doc_id, text, upper(regexp_replace(regexp_replace(left_part, '[\\s\\d.\\-]', '', 'g'), '[^\\x00-\\x7F]', '', 'g')) AS packed
  FROM (SELECT doc_id, text, text AS left_part FROM documents)))""")
def sequence_cleaning(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    made = docs.select("doc_id", S.cleaned(F.regexp_replace("text", r"[^\x00-\x7F]", "")).alias("made"))
    return made.select("doc_id", "made.error", F.sha2("made.clean", 256).alias("clean_sha"))


@query("record_acceptance", """WITH r AS (
  SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents),
judged AS (SELECT doc_id, length(seq) AS n, concat_ws(',',
    CASE WHEN length(seq) = 0 THEN 'empty_sequence' END,
    CASE WHEN regexp_matches(translate(seq, 'U', 'T'), '[^ACGTRYSWKMBDHVN]') THEN 'invalid_alphabet' END,
    CASE WHEN length(seq) > 2000 THEN 'record_too_long' END) AS reasons FROM r)
SELECT reasons, count(*)::BIGINT AS records, sum(n)::BIGINT AS bases FROM judged WHERE reasons <> '' GROUP BY reasons""")
def record_acceptance(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    records = docs.select("doc_id", S.letters_only(F.col("text"), "A-Z").alias("seq"))
    _, rejected = C.split_records(records, max_length=2000)
    return (rejected.groupBy(F.array_join("reasons", ",").alias("reasons"))
            .agg(F.count("*").alias("records"), F.sum("length").alias("bases")))


@query("duplicate_records", f"""WITH {_HASHED}
SELECT doc_id, sha, CASE WHEN doc_id = first_id THEN 'accepted_unique' ELSE 'accepted_duplicate' END AS disposition,
  CASE WHEN doc_id <> first_id THEN first_id END AS duplicate_of FROM hashed""")
def duplicate_records(spark, folder):
    accepted, _ = C.split_records(X.subjects(spark, folder))
    marked = C.mark_duplicates(accepted, "doc_id", "doc_id")
    return marked.select("doc_id", F.col("sequence_sha256").alias("sha"), "disposition", "duplicate_of")


@query("snapshot_metrics", f"""WITH {_HASHED}
SELECT count(*)::BIGINT AS raw_record_count, count(*) FILTER (doc_id = first_id)::BIGINT AS unique_sequence_count,
  sum(length(seq))::BIGINT AS raw_total_bases, (sum(length(seq)) FILTER (doc_id = first_id))::BIGINT AS unique_total_bases,
  count(*) FILTER (doc_id <> first_id)::BIGINT AS exact_duplicate_count, 0::BIGINT AS rejected_record_count,
  (SELECT string_agg(g || '=' || n, ',' ORDER BY g) FROM
    (SELECT grp AS g, count(*) AS n FROM hashed WHERE doc_id = first_id GROUP BY grp)) AS group_counts
FROM hashed""")
def snapshot_metrics(spark, folder):
    out = C.snapshot_metrics(X.subjects(spark, folder), "doc_id")
    flat = F.array_join(F.transform(F.map_entries("group_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("group_counts", flat)


@query("snapshot_delta", f"""WITH {X.SUBJECTS},
b AS (SELECT sha256(seq) AS sha, min(doc_id) AS base_record FROM subjects WHERE doc_id % 10 < 8 GROUP BY 1),
n AS (SELECT sha256(seq) AS sha, min(doc_id) AS follow_record FROM subjects WHERE doc_id % 10 >= 1 GROUP BY 1)
SELECT coalesce(b.sha, n.sha) AS sha, base_record, follow_record, CASE WHEN b.sha IS NULL THEN 'added'
  WHEN n.sha IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM b FULL JOIN n ON b.sha = n.sha""")
def snapshot_delta(spark, folder):
    hashed = X.subjects(spark, folder).select("doc_id", F.sha2("seq", 256).alias("sha"))
    # Two corpus versions that overlap, as two dated releases of one source do.
    base, follow = hashed.filter("doc_id % 10 < 8"), hashed.filter("doc_id % 10 >= 1")
    return C.snapshot_delta(base, follow, "doc_id", "sha")


@query("corpus_content_hash", f"""WITH {X.SUBJECTS},
h AS (SELECT grp, sha256(doc_id || ':' || seq) AS h FROM subjects),
p AS (SELECT grp, h[1:2] AS prefix, count(*) AS n, {', '.join(
    f"sum(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT) AS s{i}" for i in range(8))} FROM h GROUP BY 1, 2)
SELECT grp, sum(n)::BIGINT AS n_sequences, sha256(string_agg(d, chr(10) ORDER BY d)) AS corpus_sha256 FROM
  (SELECT grp, n, sha256(concat_ws(',', prefix, n, s0, s1, s2, s3, s4, s5, s6, s7)) AS d FROM p) GROUP BY grp""")
def corpus_content_hash(spark, folder):
    return C.corpus_hash(X.subjects(spark, folder), ["grp"], "doc_id", "seq")


@query("representative_sequence", f"""WITH {X.SUBJECTS}, s AS (SELECT *, length(seq) AS n FROM subjects)
SELECT grp, coalesce(arg_min(doc_id, (-n, doc_id)) FILTER (n <= 12000), arg_min(doc_id, (n, doc_id))) AS doc_id,
  coalesce(max(n) FILTER (n <= 12000), min(n))::BIGINT AS length FROM s GROUP BY grp""")
def representative_sequence(spark, folder):
    """Longest sequence up to 12 000 bases, else the shortest one."""
    n = F.length("seq")
    rows = X.subjects(spark, folder).select("grp", "doc_id", n.alias("n"))
    fits = F.min(F.when(F.col("n") <= 12000, F.struct((-F.col("n")).alias("k"), "doc_id", "n")))
    short = F.min(F.struct(F.col("n").alias("k"), "doc_id", "n"))
    return (rows.groupBy("grp").agg(F.coalesce(fits, short).alias("r"))
            .select("grp", "r.doc_id", F.col("r.n").alias("length")))


@query("sequence_length_stats", f"""WITH {X.SUBJECTS}
SELECT grp, count(*)::BIGINT AS n, min(length(seq))::BIGINT AS shortest, max(length(seq))::BIGINT AS longest,
  list_sort(list(length(seq)))[(count(*) // 2 + 1)::BIGINT]::BIGINT AS upper_median FROM subjects GROUP BY grp""")
def sequence_length_stats(spark, folder):
    tally = X.subjects(spark, folder).groupBy("grp", F.length("seq").alias("len")).agg(F.count("*").alias("n"))
    from ..operators.stats import upper_median_of_tally
    return upper_median_of_tally(tally, ["grp"], "len", "n").select(
        "grp", "n", "shortest", "longest", "upper_median")


@query("record_metadata", """SELECT d.doc_id, coalesce('quality=' || l.quality || ';toxic=' || l.toxic, '') AS metadata
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def record_metadata(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    joined = C.metadata_groups(docs, table(spark, folder, "labels"), "doc_id")
    flat = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return joined.select("doc_id", flat.alias("metadata"))


@query("exon_junctions", """SELECT conv_id, turn, junction FROM (
  SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS junction,
    turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations) WHERE NOT is_last""")
def exon_junctions(spark, folder):
    """Ordered parts of one transcript per key: cumulative lengths are the junction positions."""
    parts = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return C.running_offsets(parts, ["conv_id"], "turn", "n").filter(~F.col("is_last")).select(
        "conv_id", "turn", "junction")


@query("preferred_chemistry_order", f"""WITH {X.SUBJECTS}, g AS (
  SELECT doc_id, 100.0::DOUBLE * length(translate(seq, 'AT', '')) / length(seq) AS gc FROM subjects)
SELECT doc_id, CASE WHEN gc < 40 THEN 'parasite_mtdna' WHEN gc > 62 THEN 'gc_rich' ELSE 'idt_taqman' END AS first_choice
FROM g""")
def preferred_chemistry_order(spark, folder):
    from ..operators.design import chemistry_order
    return X.subjects(spark, folder).select("doc_id", chemistry_order(F.col("seq"))[0].alias("first_choice"))
