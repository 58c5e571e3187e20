"""Training corpus from `documents`: language, near duplicates, benchmark leaks, secrets, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm import decontam, langid, mixing, ngram_join, secrets
from ampliq.llm import text as tx
from ampliq.llm.scratch import forget, tidy
from ampliq.session import cut_lineage, table

#: Least pooled probability of the most likely language.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) and texts of no clear language go; a missing language is filled in.

    Rows are judged one by one, so equal rows and null ids fare alike. No rows or no known language: everything goes.
    """
    named_by, sure = tx.fresh(docs.columns, "_lang_pred", "_lang_score")
    net = langid.fit(docs, "doc_id", "text", "lang", ~langid.held_out(F.col("doc_id"), 5))
    named = langid.label(docs, "text", net, lang=named_by, score=sure)
    return (named.where((F.col(named_by) != "und") & (F.col(sure) >= SURE))
            .withColumn("lang", F.coalesce(F.col("lang"), F.col(named_by))).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, null last; of equal rows one. Texts without words
    are copies of nothing and stay."""
    return ngram_join.first_of_each(docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Texts are judged, so equal texts go together; null ones stay."""
    leak, = tx.fresh(docs.columns, "_digest")
    found = decontam.contamination(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    dirty = found.where("n_hit > 0").select(F.col("digest").alias(leak)).distinct()
    return docs.join(dirty, F.md5(F.coalesce("text", F.lit(""))) == F.col(leak), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the text; every row stays, null texts as they are."""
    return secrets.redact(docs, "doc_id", "text", "source", "source", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each; texts without words are not taken. Null sources
    are a source of their own."""
    mixed = mixing.mix(docs, "doc_id", "text", F.array("source"))
    return mixed.where("taken > 0").select("doc_id", F.col("sources")[0].alias("source"), "size",
                                           F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("redact_secrets", redact_secrets), ("mix", mix)]

#: A recurrent network has no SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
            if before is not None:
                forget(before)
            before = docs
            tidy(spark)
    return docs
