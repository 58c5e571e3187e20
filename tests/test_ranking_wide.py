"""Explained rankings over slices against the window forms."""

import random

import pytest
from pyspark.sql import functions as F

from ampliq.operators import ranking as R
from ampliq.operators import ranking_wide as RW

TIES = ["f_start", "forward", "reverse", "id"]


def evidence(spark, n, runs, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # The first run holds most rows; values repeat so that neighbours tie.
        rows.append((rnd.choice(runs) if rnd.random() < .4 else runs[0], i, rnd.random() < .9, rnd.randrange(2), rnd.randrange(2), rnd.randrange(3), rnd.choice([1.0, .98, .9]),
                     rnd.choice([1.0, .9]), rnd.choice([None, .9]), rnd.choice([1.0, .66]), rnd.choice([.1, .5, 3.0]), -1.0, rnd.choice([.1, .4]), 1, rnd.randrange(2),
                     "none", rnd.randrange(5), "F%d" % rnd.randrange(3), "R", rnd.random() < .8, rnd.random() < .8, rnd.random() < .8))
    schema = ("run string, id int, hard_valid boolean, n_failures int, signal_subjects int, product_subjects int, target_coverage double, worst_3prime double, probe_identity double, "
              "robustness double, triplet_penalty double, worst_dimer double, practical_penalty double, degeneracy_fold int, panel_risk int, junction_level string, f_start int, "
              "forward string, reverse string, offtarget_epcr boolean, panel boolean, junction boolean")
    return R.keyed(spark.createDataFrame(rows, schema).withColumns(
        {"objective": F.lit("balanced"), "target_epcr": F.lit(True), "condition_robustness": F.lit(True)}))


@pytest.mark.parametrize("n,slices", [(300, 7), (40, 60), (1, 5)])
def test_slices_equal_windows(spark, n, slices):
    rows = evidence(spark, n, ["a", "b", "c"], n).cache()
    wide = RW.explained(rows, ["run"], TIES, has_probe=F.col("probe_identity").isNotNull(), slices=slices)
    narrow = R.rank_bands(R.preference_states(R.decisive_component(R.ranked(rows, ["run"], TIES), ["run"], "balanced"), ["run"]), ["run"])
    narrow = R.reversal_triggers(narrow)
    fields = ["id", "rank", "decisive", "preference", "band"]
    assert sorted(wide.select(*fields).collect(), key=lambda r: r["id"]) == sorted(narrow.select(*fields).collect(), key=lambda r: r["id"])
    old = {r["id"]: r["triggers"] for r in narrow.select("id", "triggers").collect()}
    for r in wide.select("id", "triggers", "preference", "junction", F.col("nx").isNull().alias("last"), F.col("nx.junction").alias("nj"), "strengths", "weaknesses",
                         "target_coverage", "offtarget_epcr", "signal_subjects").collect():
        want = list(old[r["id"]])
        if not r["last"]:
            want += ["junction_verified"] * (not r["junction"] or not r["nj"]) + ["same_band"] * (r["preference"] in RW.OPEN)
        assert r["triggers"] == (want or ["new_bench_evidence"])
        assert ("targets_missed" in r["weaknesses"]) == (r["target_coverage"] < .999)
        assert ("no_offtarget_signal" in r["strengths"]) == (r["offtarget_epcr"] and not r["signal_subjects"])


def test_null_runs_are_a_run(spark):
    rows = evidence(spark, 50, [None, "b"], 4)
    got = RW.explained(rows, ["run"], TIES, has_probe=F.lit(False), slices=6).select("run", "rank").collect()
    for run in (None, "b"):
        ranks = sorted(r["rank"] for r in got if r["run"] == run)
        assert ranks == list(range(1, len(ranks) + 1)) and ranks
