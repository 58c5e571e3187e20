"""Gates over batches of windows against the same gates as column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from ampliq.functions import thermo as T
from ampliq.operators import design as D
from ampliq.operators import window_gates as W
from ampliq.plans.design import SHORT
from ampliq.sources.profiles import chemistry

WIDE = chemistry("parasite_sybr", gc_min=30.0, gc_max=60.0, tm_min=30.0, tm_max=46.0, max_any_run=3, max_g_run=2, len_min=12, len_max=13)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(11)
    word = lambda n, of="ACGT": "".join(rnd.choice(of) for _ in range(n))
    rows = [(f"g{i % 3}" if i % 5 else None, i % 2, word(rnd.choice([11, 12, 13, 40, 300]), rnd.choice(["ACGT", "AATTC", "GGCA"]))) for i in range(60)]
    rows += [("g1", 0, "ACGTNACGTACCGGTRYACGTTGCAacgtACCATGGCTAAC"), ("g1", 0, ""), ("g2", 1, None), ("g2", 1, "GAATTCGAATTC" * 3), ("g2", 0, "N" * 15)]
    return spark.createDataFrame(rows, "grp string, half int, t string").repartition(3).cache()


@pytest.mark.parametrize("c, low, high, whole, letters, cond", [
    (SHORT, 12, 13, 1 << 16, 1 << 18, T.Conditions()), (WIDE, 11, 14, 37, 100, T.Conditions()), (WIDE, 4, 6, 20, 50, T.Conditions()),
    (WIDE, 12, 12, 1 << 16, 1 << 18, T.Conditions(dv=0.0)), (WIDE, 12, 12, 1 << 16, 1 << 18, T.Conditions(mv=0.0)),
    (WIDE, 12, 12, 1 << 16, 1 << 18, T.Conditions(mv=0.0, dv=0.5)), (WIDE, 13, 13, 1 << 16, 1 << 18, T.Conditions(mv=1.0, dv=9.0))])
def test_attrition_of_batches(table, monkeypatch, c, low, high, whole, letters, cond):
    monkeypatch.setattr(W, "WHOLE", whole)
    monkeypatch.setattr(W, "LETTERS", letters)
    wins = D.enumerate_windows(table, ["grp", "half"], "t", low, high)
    gated = wins.withColumn("rejection", D.primer_rejection(F.col("oligo"), c, cond=cond, structure=False))
    want = {tuple(r) for r in D.attrition(gated, ["grp", "half", "strand"]).collect()}
    made = W.window_attrition(table, ["grp", "half"], "t", low, high, c, cond)
    assert made.columns == ["grp", "half", "strand", "outcome", "n"]
    # Windows are no rows: sequences go in, counts come out.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow") and plan.count("Generate") == 1 and "ArrowEvalPython" not in plan
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(want) > 5 and set(rows) == want
