"""Pipeline stages on awkward and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import texts as X
from ampliq.llm import langid, ngram_join, secrets

FOLDER = "/root/testdata/sf0.001"
OURS = ["_letters", "_id", "_digest", "_stays", "_n", "_k", "_spans", "_NEW", "_lang_pred", "_lang_score", "_digest_"]


def clashing(spark, rows):
    return X.table(spark, rows).withColumns({name: F.lit("mine") for name in OURS})


@pytest.mark.parametrize("rows", [X.awkward(), []], ids=["awkward", "empty"])
def test_stages_keep_columns_that_clash(spark, rows):
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) <= len(rows) and all(r[c] == "mine" for r in got for c in OURS)
        if name == "redact_secrets":
            assert len(got) == len(rows)
        if name == "near_duplicates" and rows:
            texts = [r["text"] for r in got]
            assert texts.count(None) == sum(t is None for _, t, *_ in rows) and len(got) < len(rows)
    mixed = corpus_pipeline.mix(spark, docs, FOLDER).collect()
    assert all(r["taken"] > 0 for r in mixed) and bool(mixed) == bool(rows)


def test_operators_keep_columns_that_clash(spark):
    docs = clashing(spark, X.awkward())
    assert langid.label(docs, "text", langid.Net([], {})).drop("lang_pred", "score").columns == docs.drop("score").columns
    assert ngram_join.first_of_each(docs, "doc_id", "text").columns == docs.columns
    assert secrets.redact(docs, "doc_id", "text", "source", "source", "n_chars").columns == docs.columns
