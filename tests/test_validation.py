"""Validation inputs, run changes and single-placement PCR against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ampliq.functions import seq as S
from ampliq.operators import single_placement as SP
from ampliq.operators import validation as V


def test_candidates(spark):
    rows = [("p", 1, "a", "acgu", "GG tt", None, None), ("p", 2, "a", "ACGG", "GGTT", "", "x"), ("p", 3, " ", "ACGT", "GGTT", None, ""), ("p", 4, None, "AAAA", "CCCC", "GG", "y"),
            ("p", 5, "b", None, "GG", None, None), ("p", 6, "b", "12", "GG", None, None), ("q", 1, "z", "AC", "GT", None, None), ("q", 2, "w", "AC", "GT", None, "unspecified")]
    frame = spark.createDataFrame(rows, "plan string, line int, candidate_id string, forward string, reverse string, probe string, chemistry string")
    good, bad = V.validate_candidates(frame, ["plan"], "line")
    assert {(r.plan, r.candidate_id, r.forward, r.reverse, r.probe, r.chemistry) for r in good.collect()} == {
        ("p", "a", "ACGT", "GGTT", None, "unspecified"), ("p", "candidate-4", "AAAA", "CCCC", "GG", "y")}
    # Row 3 repeats row 1; row 2 takes an id that is taken; plan q has one candidate left.
    assert {(r.plan, r.line, r.error) for r in bad.collect()} == {("p", 2, "candidate_id_repeated"), ("p", 5, "primer_missing"), ("p", 6, "primer_missing"), ("q", 1, "too_few_candidates")}


def test_cases(spark):
    rows = [("p", 1, "a", None, None, None, "ac-gu"), ("p", 2, "a", "target", "g", None, "AC"), ("p", 3, "", "Near-Neighbor", "g", "Synthetic", "nn"), ("p", 4, "d", "offtarget", None, None, "123"),
            ("p", 5, "e", "control", None, None, "AC"), ("p", 6, "f", "off-target", None, "rock", "AC"), ("q", 7, "a", "OFF_TARGET", None, None, "T")]
    frame = spark.createDataFrame(rows, "plan string, line int, case_id string, role string, grp string, material string, sequence string")
    good, bad = V.validate_cases(frame, ["plan"], "line")
    assert {(r.plan, r.case_id, r.role, r.grp, r.material, r.sequence) for r in good.collect()} == {
        ("p", "a", "target", "ungrouped", "natural", "ACGT"), ("p", "case-3", "off_target", "g", "synthetic", "NN"), ("q", "a", "off_target", "ungrouped", "natural", "T")}
    assert {(r.line, r.error) for r in bad.collect()} == {(2, "case_id_repeated"), (4, "sequence_missing"), (5, "role_unknown"), (6, "material_unknown")}


def test_conditions(spark):
    rows = [(1, "50", "3", "0.8", "200", "60"), (2, None, None, None, None, None), (3, "x", "3", "1", "1", "60"), (4, "50", "-1", "1", "1", "60"), (5, "0", "0", "0", "1", "60"), (6, "50", "3", "3", "1", None),
            (7, "50", "3", "1", "inf", "60"), (8, "50", "3", "1", "1", "20"), (9, "2000", "200", "100", "1e6", "85"), (10, "NaN", "3", "1", "1", "60")]
    got = {r.id: (r.error, r.warning) for r in V.condition_errors(spark.createDataFrame(rows, "id int, mv string, dv string, dntp string, dna string, anneal string")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("mv_not_numeric", None), 4: ("dv_out_of_range", None), 5: ("no_salt", None), 6: (None, "no_free_magnesium"),
                   7: ("dna_not_finite", None), 8: ("anneal_out_of_range", None), 9: (None, None), 10: ("mv_not_finite", None)}


def test_changes_between_runs(spark):
    schema = "id int, rank int, hard_valid boolean, failures array<string>, categories array<string>, target_coverage double, amplicon int"
    left = spark.createDataFrame([(1, 5, False, ["b", "a"], ["x"], 0.5, 90), (2, 1, True, None, None, float("nan"), None), (3, 2, True, [], [], 1.0, 1)], schema)
    right = spark.createDataFrame([(1, 2, True, ["a", "c"], ["x", "y"], 0.75, 80), (2, 1, True, [], ["z"], 1.0, 5), (4, 1, True, [], [], 1.0, 1)], schema)
    got = {r.id: tuple(r)[1:] for r in V.candidate_changes(left, right, ["id"], evidence=["target_coverage", "amplicon"]).collect()}
    assert got == {1: (3, True, ["c"], ["b"], ["y"], [], 0.25, -10.0), 2: (0, False, [], [], ["z"], [], None, None)}


COMP = str.maketrans("ACGTN", "TGCAN")


def fit(a, b):
    return b == "N" or b in S.IUPAC_SETS[a]


def place(oligo, seq):
    best = None
    for strand, t in (("+", seq), ("-", seq.translate(COMP)[::-1])):
        for i in range(len(t) - len(oligo) + 1):
            score = sum(map(fit, oligo, t[i:i + len(oligo)]))
            if best is None or score > best[0]:
                best = (score, strand, i, t[i:i + len(oligo)])
    return best


def pcr(f, r, probe, seq, low, high):
    hits = []
    for role, o in (("F", f), ("R", r)):
        got = place(o, seq)
        if got and got[0] >= .75 * len(o) and fit(o[-1], got[3][-1]):
            lo = got[2] + 1 if got[1] == "+" else len(seq) - (got[2] + len(o)) + 1
            hits.append((role, got[1], lo, lo + len(o) - 1))
    for rp, sp, lp, hp in hits:
        for _, sm, lm, hm in hits:
            if sp == "+" and sm == "-" and lp <= hm and hp <= lm + 5 and low <= hm - lp + 1 <= high:
                spot = place(probe, seq[lp - 1:hm]) if probe else None
                return hm - lp + 1, lp, hm, rp, (bool(spot and spot[0] >= .8 * len(probe)) if probe else None)
    return None


def test_single_placement_equals_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    assays = [(k, say(10), say(10), p) for k, p in enumerate([say(8), None, "", say(8), "ACRYN" + say(5)])]
    seqs = []
    for i in range(60):
        k, f, r, p = rnd.choice(assays)
        back = r.translate(COMP)[::-1]
        inner = say(rnd.randrange(0, 40)) + (p.replace("R", "A").replace("Y", "C").replace("N", "T") if p and rnd.random() < .7 else "") + say(5)
        s = say(rnd.randrange(6)) + f + inner + back + say(rnd.randrange(6))
        s = list(s)
        for _ in range(rnd.randrange(4)):
            s[rnd.randrange(len(s))] = rnd.choice("ACGTN")
        s = "".join(s)
        seqs.append((i, s if rnd.random() < .5 else s.translate(COMP)[::-1]))
    seqs += [(100, "ACG"), (101, say(300))]
    got = SP.single_placement_products(spark.createDataFrame(assays, "k int, forward string, reverse string, probe string"), spark.createDataFrame(seqs, "id int, seq string"),
                                       assay="k", subject="id", min_product=20, max_product=90).collect()
    want = {(k, i): pcr(f, r, p, s, 20, 90) for k, f, r, p in assays for i, s in seqs}
    assert {(r.k, r.id): tuple(r)[2:] for r in got} == {key: v for key, v in want.items() if v}
    assert len(got) > 20 and {r.probe_binds for r in got} == {True, False, None} and {r.left_primer for r in got} == {"F", "R"}


@pytest.mark.parametrize("seed", [1])
def test_exact_location(spark, seed):
    rnd = random.Random(seed)
    say = lambda n, letters="ACGT": "".join(rnd.choice(letters) for _ in range(n))
    rows = [(i, say(rnd.randrange(2, 5), "ACGTRYSWKMBDHVN"), say(30).replace("T", rnd.choice("TU"))) for i in range(80)] + [(900, "", "ACGT"), (901, "AC", ""), (902, None, "AC"), (903, "acn", "ttacg")]
    got = {r.id: r.at for r in spark.createDataFrame(rows, "id int, o string, s string").select("id", SP.locate(F.col("o"), F.col("s")).alias("at")).collect()}
    for i, o, s in rows:
        hit = re.search("".join("[" + "".join(S.IUPAC_SETS[c]) + "]" for c in o.upper()), s.upper().replace("U", "T")) if o and s else None
        assert got[i] == (hit.start() if hit else None)
    # The same probe stands before the primers too; the place between them is meant.
    t = "GGCATTT" + "AAAA" + "GGCATTT" + "CC"
    frame = spark.createDataFrame([(t, "GGCATTT", "+", 8, 20), (t, "AAATGCC", "-", 8, 20), (t, "GGCATTT", "+", 8, 10), (t, "CCCCC", "+", 0, 20)], "t string, p string, s string, a int, b int")
    spans = [tuple(r) for r in frame.select(*SP.probe_span(F.col("t"), F.col("p"), F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert spans == [(11, 18), (11, 18), (0, 7), (None, None)]
