"""Whole batches of oligos at once: the same sums and ranges as one by one."""

import random

from pyspark.sql import functions as F

from ampliq.functions import thermo as T
from ampliq.operators import melting_range as M


def test_batch_sums_equal_the_columns(spark):
    rnd = random.Random(2)
    texts = [None, "", "A", "AC", "ACGT", "AAAA", "ACNGT", "acgt", "AC\u00c4T"] + ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(2, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string").repartition(2)
    dh, ds = T.duplex_sums(F.col("s"))
    for r in df.select("s", dh.alias("dh"), ds.alias("ds"), T.enthalpy(F.col("s")).alias("h"), T.entropy(F.col("s")).alias("e")).collect():
        assert (r.dh, r.ds) == (r.h, r.e), r


def test_forms_are_listed_by_pattern_not_by_oligo(monkeypatch):
    rnd = random.Random(4)
    oligos = ["".join(rnd.choice(x) for x in ["RYSW"] * 3 + ["ACGT"] * 17) for _ in range(300)] + ["NN" + "ACGTTGCA", None, "AZ", "A", "acgu"]
    calls = []
    monkeypatch.setattr(M, "_listed", lambda *a, one=M._listed: calls.append(1) or one(*a))
    got = M.extremes(oligos, T.Conditions())
    assert len(calls) <= 4
    for k, oligo in enumerate(oligos):
        alone = M.extremes([oligo], T.Conditions())[0]
        assert ((got[k] == alone) | ((got[k] != got[k]) & (alone != alone))).all()
    assert got[-5][0] == 16 and got[-1][0] == 1 and (got[-4:-1, 1] != got[-4:-1, 1]).all()
