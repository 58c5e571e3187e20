"""Product tallies against products listed pair by pair."""

import random

from pyspark.sql import functions as F

from ampliq.operators.product_tallies import product_tallies, subject_coverage

HIT = "a long, s long, strand string, lo int, hi int, q3 boolean, flen int, rlen int"
PROBE = "a long, s long, lo int, hi int, flen int, rlen int"


def _listed(primers, probes, low, high):
    out = {}
    for a, s, strand, lo, hi, q3, *_ in primers:
        if strand != "+" or not q3:
            continue
        for a2, s2, strand2, lo2, hi2, q32, *_ in primers:
            size = hi2 - lo + 1
            if (a2, s2) == (a, s) and strand2 == "-" and q32 and lo <= hi2 and hi <= lo2 + 5 and low <= size <= high:
                holds = any((x[0], x[1]) == (a, s) and lo <= x[2] and x[3] <= hi2 for x in probes)
                n, m = out.get((a, s), (0, 0))
                out[a, s] = n + 1, m + holds
    return out


def _same(spark, primers, probes, low, high):
    got = product_tallies(spark.createDataFrame(primers, HIT), spark.createDataFrame(probes, PROBE), ["a", "s"], min_product=low, max_product=high)
    assert {(r["a"], r["s"]): (r["n_products"], r["n_binding"]) for r in got.collect()} == _listed(primers, probes, low, high)
    return got


def _hits(rng, n, span, assays, lengths):
    primers, probes = [], []
    for _ in range(n):
        a, lo = rng.randrange(assays), rng.randrange(span)
        flen, rlen = lengths[a % len(lengths)]
        primers.append((a, rng.randrange(2), rng.choice("+-"), lo, lo + rng.choice((flen, rlen)) - 1, rng.random() < 0.9, flen, rlen))
    for _ in range(n // 4):
        a, lo = rng.randrange(assays), rng.randrange(span)
        probes.append((a, rng.randrange(2), lo, lo + 8 + rng.randrange(8), *lengths[a % len(lengths)]))
    return primers, probes


def test_equals_listed_products(spark):
    rng = random.Random(5)
    _same(spark, *_hits(rng, 400, 600, 3, [(12, 12), (9, 20)]), 20, 150)
    # Primers longer than the least product, products no longer than a primer, one base apart.
    _same(spark, *_hits(rng, 300, 80, 2, [(18, 25), (7, 7)]), 1, 30)


def test_over_the_edges_of_stretches(spark):
    rng = random.Random(6)
    primers, probes = _hits(rng, 300, 400, 2, [(12, 15)])
    shift = 65536 - 200
    moved = [(*r[:3], r[3] + shift, r[4] + shift, *r[5:]) for r in primers]
    _same(spark, moved, [(*r[:2], r[2] + shift, r[3] + shift, *r[4:]) for r in probes], 20, 300)


def test_one_key_with_most_hits_ties_and_copies(spark):
    primers = [(0, 0, s, 5 * (i % 7) + (60 if s == "-" else 0), 5 * (i % 7) + (71 if s == "-" else 11), True, 12, 12)
               for i in range(120) for s in "+-"]
    primers += [(1, 0, "+", 0, 11, True, 12, 12), (1, 0, "-", 40, 51, False, 12, 12), (2, 1, "-", 0, 11, True, 12, 12)]
    got = _same(spark, primers, [(0, 0, 12, 40, 12, 12), (0, 0, 12, 40, 12, 12), (1, 0, 12, 30, 12, 12)], 20, 80)
    row = subject_coverage(got, spark.range(4).select(F.col("id").alias("s")), ["a"]).collect()
    assert [(r["a"], r["product_subjects"], r["signal_subjects"], r["product_fraction"]) for r in row] == [(0, 1, 1, 0.25)]


def test_empty_and_too_long_probe(spark):
    none = spark.createDataFrame([], HIT)
    assert product_tallies(none, spark.createDataFrame([], PROBE), ["a", "s"]).count() == 0
    _same(spark, [(0, 0, "+", 0, 11, True, 12, 12), (0, 0, "-", 30, 41, True, 12, 12)], [(0, 0, 0, 90, 12, 12)], 20, 60)
