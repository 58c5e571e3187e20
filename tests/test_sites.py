import random

import pytest
from pyspark.sql import functions as F

from ampliq.functions import seq as S
from ampliq.operators import placement as B
from ampliq.operators import products as P
from ampliq.operators.sites import find_sites

COMP = dict(zip(S.IUPAC_LETTERS, S.IUPAC_COMPLEMENT))


def rc(s):
    return "".join(COMP[b] for b in reversed(s))


def possible(a, b):
    return bool(set(S.IUPAC_SETS[a]) & set(S.IUPAC_SETS[b]))


def brute_sites(oligos, subjects, max_mm, anchor):
    out = set()
    for ok, o in oligos:
        for sk, s in subjects:
            for strand, text in (("+", s), ("-", rc(s))):
                for i in range(len(text) - len(o) + 1):
                    w = text[i:i + len(o)]
                    mm = sum(not possible(a, b) for a, b in zip(o, w))
                    if mm <= max_mm and all(possible(a, b) for a, b in zip(o[len(o) - anchor:], w[len(w) - anchor:])):
                        lo = i if strand == "+" else len(s) - i - len(o)
                        out.add((ok, sk, strand, lo, mm))
    return out


@pytest.mark.parametrize("anchor", [3, 0])
def test_sites_match_brute_force_with_ambiguity(spark, anchor):
    rnd = random.Random(5)
    subjects = [(i, "".join(rnd.choice("ACGT" if rnd.random() < 0.97 else "RYN") for _ in range(rnd.choice([8, 90, 300])))) for i in range(12)]
    oligos = [(0, max((x[1] for x in subjects), key=len)[10:24]), (1, "ACGTRYACGTAC"), (2, "TTGACA"), (3, "ACGTTGCANACGTTGCAACGTACGT"), (4, "ACGTACG")]
    got = find_sites(spark.createDataFrame(oligos, "o int, oligo string"), spark.createDataFrame(subjects, "d int, seq string"),
                     oligo_keys=["o"], subject_keys=["d"], anchor=anchor, max_len=30)
    rows = [tuple(r) for r in got.select("o", "d", "strand", "lo", "mm").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_sites(oligos, subjects, 2, anchor)


def test_sites_cross_chunk_borders(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("ACGT") for _ in range(5000))
    oligos = [(k, long[k:k + 18]) for k in (2035, 2040, 2047, 4090, 4982)] + [(-k, rc(long[k:k + 18])) for k in (2035, 4090)]
    got = find_sites(spark.createDataFrame(oligos, "o int, oligo string"), spark.createDataFrame([(1, long)], "d int, seq string"),
                     oligo_keys=["o"], subject_keys=["d"], max_len=30)
    exact = {(r.o, r.lo, r.strand) for r in got.filter("mm = 0").collect()}
    assert exact == {(o, abs(o), "+" if o > 0 else "-") for o, _ in oligos}


F_, R_, PROBE = "ACGATTGCAGGTCCATAGCA", "TTGCCATGACCTGAATCGGA", "CCATGACTTGACCAGGTTCA"
FILL = "GATTACAGATTC" + PROBE + "CTTAGGACTAGA"


def _amplify(spark, subjects):
    assays = spark.createDataFrame([(1, F_, R_, PROBE)], "a int, forward string, reverse string, probe string")
    subs = spark.createDataFrame(subjects, "d int, seq string")
    made = P.amplify(P.priming_sites(assays, subs, ["a"], ["d"], max_len=30), ["a", "d"])
    return {r.d: r for r in P.probe_identity(made, subs, assays, ["a"], ["d"]).collect()}


def test_product_facts(spark):
    whole = F_ + FILL + rc(R_)
    broken = F_[:-1] + ("C" if F_[-1] != "C" else "G") + FILL + rc(R_)
    rows = _amplify(spark, [(1, whole), (2, broken), (3, rc(F_) + FILL + R_), (4, "N" * 200), (5, rc(whole))])
    assert set(rows) == {1}, "terminal mismatch, divergent primers and unknown bases give no product"
    assert rows[1].n_products == 1 and rows[1].product == len(whole) and rows[1].probe_binds


@pytest.mark.parametrize("stretch", [1 << 16, 1])
def test_sweep_equals_all_pairs(spark, monkeypatch, stretch):
    monkeypatch.setattr(P, "STRETCH", stretch)
    rnd = random.Random(2)
    text = "".join(rnd.choice("ACG") for _ in range(900))
    assays = [(k, text[k * 40:k * 40 + 10], rc(text[k * 40 + 60:k * 40 + 70]), None) for k in range(8)]
    a = spark.createDataFrame(assays, "a int, forward string, reverse string, probe string")
    sites = P.priming_sites(a, spark.createDataFrame([(1, text)], "d int, seq string"), ["a"], ["d"], max_len=30).cache()
    rows = sites.collect()
    expect = {}
    for k in range(8):
        pairs = []
        for f in rows:
            for r in rows:
                if f.a == k == r.a and f.role == "F" and r.role == "R":
                    size = r.hi + 1 - f.lo
                    if f.lo < r.lo and 20 <= size <= 300:
                        pairs.append((size, f.mm + r.mm))
        if pairs:
            expect[k] = (len(pairs), *min(pairs))
    got = {r.a: (r.n_products, r["product"], r.mm) for r in P.amplify(sites, ["a", "d"], min_product=20, max_product=300).collect()}
    assert got == expect and expect


def test_convergent_products_any_primer(spark):
    hits = [(1, 1, "F", "+", 0, 9, True), (1, 1, "R", "-", 50, 59, True), (1, 1, "F", "-", 70, 79, True), (1, 1, "R", "+", 4000, 4009, True),
            (1, 1, "R", "-", 6999, 7008, True), (1, 1, "R", "-", 7100, 7109, True)]
    df = spark.createDataFrame(hits, "a int, d int, role string, strand string, lo int, hi int, q3 boolean")
    got = {(r.left_primer, r.right_primer, r["size"]) for r in P.convergent_products(df, ["a", "d"]).collect()}
    assert got == {("F", "R", 60), ("F", "F", 80)}


def test_placement_ties_and_unknown_bases(spark):
    oligos = spark.createDataFrame([("x", "ACGT"), ("y", "AARN")], "k string, oligo string")
    subs = spark.createDataFrame([(1, "TTACGTACGT"), (2, "TTNNNNTT"), (3, "ACG")], "d int, seq string")
    got = {(r.k, r.d): (r.strand, r.offset, r.score) for r in B.best_placements(oligos, subs, oligo_key="k", subject_key="d").collect()}
    assert got[("x", 1)] == ("+", 2, 4) and got[("x", 2)] == ("+", 2, 4) and ("x", 3) not in got


def test_conservation_counts_unknown_as_match(spark):
    oligos = spark.createDataFrame([("x", "ACGTACGT")], "k string, oligo string")
    subs = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGN"), (3, "ACGTACGA")], "d int, seq string")
    placed = B.best_placements(oligos, subs, oligo_key="k", subject_key="d")
    last = [r for r in B.conservation(placed, "k").collect() if r.pos == 8][0]
    assert round(last.pct_match, 3) == 66.667


def test_clean_and_notation(spark):
    df = spark.createDataFrame([(1, ">h x\nacg uu-n 12\n"), (2, "ACXZ"), (3, "  "), (4, "12-")], "i int, raw string")
    clean, error = S.clean_sequence(F.col("raw"))
    got = {r.i: (r.c, r.e) for r in df.select("i", clean.alias("c"), error.alias("e")).collect()}
    assert got[1] == ("ACGTTN", None) and got[2] == (None, "invalid character(s): X Z")
    assert got[3][1] == "empty sequence" and got[4][1] == "no sequence left after cleaning"
    marks = spark.createDataFrame([("/56-FAM/CT+TA+C*A /3BHQ/",)], "s string")
    row = marks.select(S.strip_order_marks(F.col("s")).alias("b"), S.locked_positions(F.col("s")).alias("p")).first()
    assert row.b == "CTTACA" and row.p == [3, 5]


@pytest.mark.parametrize("stretch", [1 << 16, 1])
def test_probe_binding_equals_containment(spark, monkeypatch, stretch):
    monkeypatch.setattr(P, "STRETCH", stretch)
    rnd = random.Random(11)
    spans = [(1, 1, lo, lo + rnd.randint(30, 99)) for lo in (rnd.randint(0, 900) for _ in range(60))]
    probes = [(1, 1, lo, lo + 14) for lo in (rnd.randint(0, 900) for _ in range(12))]
    got = P.mark_probe_binding(spark.createDataFrame(spans, "a int, d int, span_lo int, span_hi int"),
                               spark.createDataFrame(probes, "a int, d int, lo int, hi int"), ["a", "d"], max_product=100)
    rows = [(r.span_lo, r.span_hi, r.probe_binds) for r in got.collect()]
    assert sorted(rows) == sorted((lo, hi, any(lo <= p[2] and p[3] <= hi for p in probes)) for _, _, lo, hi in spans)
