"""Informative cases, discriminating pairs, placement tallies and exact melting ranges against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from ampliq.functions import seq as S
from ampliq.functions import thermo as T
from ampliq.operators import melting_range as M
from ampliq.operators import selection as C
from ampliq.operators import tallies as TL


def greedy(states, cases, candidates, limit):
    """states: case -> candidate -> state; all others silent."""
    pairs, kinds = {}, {}
    for case in cases:
        own = {c: states.get(case, {}).get(c, "-") for c in candidates}
        pairs[case] = {p for p in itertools.combinations(sorted(candidates), 2) if own[p[0]] != own[p[1]]}
        kinds[case] = len(set(own.values()))
    left, covered, groups, out = [c for c in cases if pairs[c]], set(), set(), []
    while left and len(out) < limit:
        best = min(left, key=lambda c: (-len(pairs[c] - covered), -kinds[c], cases[c] in groups, -(cases[c][0] == "off_target"), c))
        out.append((best, len(pairs[best] - covered), kinds[best]))
        left.remove(best)
        covered |= pairs[best]
        groups.add(cases[best])
    return out


@pytest.mark.parametrize("seed,limit", [(1, 12), (3, 40)])
def test_informative_cases_equal_greedy_over_pairs(spark, seed, limit):
    rnd = random.Random(seed)
    candidates = list(range(9))
    cases = {c: (rnd.choice(["target", "off_target", None]), rnd.choice(["a", "b", None])) for c in range(30 if limit == 40 else 200)}
    states = {c: {k: rnd.choice(["product", "signal_product", "product_without_probe", "no_product_terminal"]) for k in candidates if rnd.random() < rnd.choice([0, .1, .5])}
              for c in cases}
    rows = [(c, k, s) for c, own in states.items() for k, s in own.items()]
    got = C.informative_cases(spark.createDataFrame(rows, "kase int, cand int, state string"),
                              spark.createDataFrame([(c, *g) for c, g in cases.items()], "kase int, role string, grp string"),
                              spark.createDataFrame([(k,) for k in candidates], "cand int"), "kase", "cand", max_cases=limit).orderBy("round").collect()
    assert [(r["kase"], r["new_pairs"], r["n_states"]) for r in got] == greedy(states, cases, candidates, limit)
    assert all(r["probe_disagreement"] == ("product_without_probe" in states[r["kase"]].values()) for r in got)


def test_gains_of_cases_that_span_batches(spark):
    rnd = random.Random(8)
    panel = [(k, rnd.choice([5, 6, 7])) for k in range(20)]
    held = {c: {k: rnd.choice(["x", "y", None]) for k in range(20) if rnd.random() < rnd.choice([.2, .9])} or {0: "x"} for c in range(40)}
    cases = spark.createDataFrame([(c, c * 3, list(own.items())) for c, own in held.items()], "kase int, row long, held array<struct<cand:int,state:string>>").repartition(3)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        made = C._gains(cases, spark.createDataFrame(panel, "cand int, sig long"), "cand")
        # Only the panel moves: the states of the cases are neither joined by a shuffle nor grouped by one.
        assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        got = {r.kase: r.gain for r in made.collect()}
    finally:
        spark.conf.set(conf, before)
    assert got == {c: sum(s == t and own.get(a, "-") != own.get(b, "-") for (a, s), (b, t) in itertools.combinations(panel, 2)) for c, own in held.items()}


def test_no_informative_case(spark):
    states = spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "kase int, cand int, state string")
    cases = spark.createDataFrame([(1, "target", "a"), (2, "target", "b")], "kase int, role string, grp string")
    panel = spark.createDataFrame([(1,), (2,)], "cand int")
    assert C.informative_cases(states, cases, panel, "kase", "cand").collect() == []


def match(a, b):
    return b == "N" or b in S.IUPAC_SETS[a]


def placements(oligo, seqs):
    """Best window of an oligo on each sequence that can hold it."""
    comp = str.maketrans("ACGTN", "TGCAN")
    for s in seqs:
        best = None
        for strand in (s, s.translate(comp)[::-1]):
            for i in range(len(strand) - len(oligo) + 1):
                score = sum(map(match, oligo, strand[i:i + len(oligo)]))
                if best is None or score > best[0]:
                    best = (score, strand[i:i + len(oligo)])
        if best:
            yield best


@pytest.mark.parametrize("whole", [1 << 14, 60])
def test_tallies_equal_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(TL, "WHOLE", whole)
    monkeypatch.setattr(TL, "STEP", 16)
    monkeypatch.setattr(TL, "BLOCK", 3)
    rnd = random.Random(whole)
    say = lambda n, letters="ACGT": "".join(rnd.choice(letters) for _ in range(n))
    seqs = [say(rnd.randrange(5, 120)) for _ in range(25)] + [say(40, "ACGTN"), "ACG", say(300)]
    seqs += [seqs[0]] * 6
    oligos = [say(12) for _ in range(5)] + [say(9, "ACGTRYN"), say(15), seqs[3][:8], say(12)]
    rows = spark.createDataFrame([(s,) for s in [*seqs, None, ""]], "seq string")
    tallies = TL.placement_tallies(spark.createDataFrame([(o,) for o in [*oligos, oligos[0], None, ""]], "oligo string"), rows)
    got = {(r["oligo"], r["family"], r["i"]): r["n"] for r in tallies.collect()}
    want = Counter()
    for o in set(oligos):
        for score, w in placements(o, seqs):
            wrong = [i for i, (a, b) in enumerate(zip(o, w)) if not match(a, b)]
            want[o, "score", score] += 1
            want[o, "last", sum(i >= len(o) - 5 for i in wrong)] += 1
            for i in wrong:
                want[o, "miss", i] += 1
            if score >= .6 * len(o) - 1e-9:
                for i, b in enumerate(w):
                    want[o, "base", i * 5 + "ACGTN".index(b)] += 1
    assert got == want
    profile = {r["oligo"]: r for r in TL.discrimination_profile(tallies).collect()}
    for o in set(oligos):
        found = list(placements(o, seqs))
        last = [sum(not match(a, b) for a, b in zip(o[-5:], w[-5:])) for _, w in found]
        assert (profile[o]["n"], profile[o]["min_3prime_mismatch"]) == (len(found), min(last))
        assert profile[o]["median_ident"] == pytest.approx(np.median([100 * s / len(o) for s, _ in found]))
        share = [round(sum(not match(o[i], w[i]) for _, w in found) / len(found), 3) for i in range(len(o))]
        assert profile[o]["off_mismatch_frac"] == pytest.approx(share, abs=1.1e-3)


def test_discriminating_pairs_equal_nested_loops(spark):
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    offs = [say(rnd.randrange(20, 60)) for _ in range(12)]
    pairs = [(1, say(10), say(10), i, i + 50, float(rnd.randrange(9))) for i in range(40)]
    pairs += [(1, pairs[0][1], pairs[0][2], 3, 60, 1.0), (2, offs[0][:10], offs[1][:10], 0, 50, 0.0), (2, "AC" * 60, say(10), 0, 300, 1.0)]
    frame = spark.createDataFrame(pairs, "item int, forward string, reverse string, f_start int, r_end int, score double")
    both = frame.select("forward").union(frame.select("reverse")).toDF("oligo")
    profile = TL.discrimination_profile(TL.placement_tallies(both, spark.createDataFrame([(s,) for s in offs], "seq string")))
    got = C.discriminating_pairs(frame, profile, ["item"], want=1000).collect()

    def block(o):
        found = list(placements(o, offs))
        if not found:
            return 0, 100.0
        return min(sum(a != b for a, b in zip(o[-5:], w[-5:])) for _, w in found), max(100 * s / len(o) for s, _ in found)

    want = {}
    for item, f, r, a, e, score in pairs:
        (fb, fi), (rb, ri) = block(f), block(r)
        if max(fb, rb) >= 1:
            row = (-(fb + rb), -max(fb, rb), round((fi + ri) / 2, 6), score, a, e, f, r)
            want[item, f, r] = min(want.get((item, f, r), row), row)
    for item in (1, 2):
        rows = sorted(v for (i, *_), v in want.items() if i == item)
        mine = sorted((r for r in got if r["item"] == item), key=lambda r: r["place"])
        assert [(r["forward"], r["reverse"], r["f_start"], r["total_block"]) for r in mine] == [(v[6], v[7], v[4], -v[0]) for v in rows]
    assert not any(r["item"] == 2 and r["forward"] == offs[0][:10] and r["f_block"] for r in got)


@pytest.mark.parametrize("cond", [T.Conditions(), T.Conditions(dv=0), T.Conditions(mv=0), T.Conditions(mv=1000, dv=.9), T.Conditions(mv=0, dv=0)])
def test_melting_range_by_paths_equals_listing(monkeypatch, cond):
    rnd = random.Random(6)
    oligos = ["".join(rnd.choice("ACGTRYSWKMBN") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    # Forms that are their own reverse complement among others, and alone.
    oligos += ["RYRY", "NNNN", "NNNNNN", "WWWW", "ACGT", "SSSSSS", "AANNTT", "RN", "NNCGNN"]
    monkeypatch.setattr(M, "LISTED", 10 ** 9)
    listed = M.extremes(oligos, cond)
    monkeypatch.setattr(M, "LISTED", 0)
    monkeypatch.setattr(M, "CELLS", 1 << 9)
    np.testing.assert_allclose(M.extremes(oligos, cond), listed, atol=1e-9)


def test_melting_range_of_rows(spark):
    rows = spark.createDataFrame([(1, "ACGTTRYN"), (2, "ACGTTACG"), (3, None), (4, ""), (5, "ACX"), (6, "N" * 20), (7, "acguu")], "id int, oligo string")
    got = {r["id"]: r for r in M.tm_extremes(rows, ["id"], "oligo").collect()}
    single = rows.where("id = 2").select(T.melting_temperature(rows["oligo"]).alias("tm")).first()["tm"]
    assert got[2]["tm_min"] == got[2]["tm_max"] == pytest.approx(single) and got[2]["fold"] == 1
    forms = spark.createDataFrame([("ACGTT" + "".join(x),) for x in itertools.product("AG", "CT", "ACGT")], "o string")
    tms = [r["tm"] for r in forms.select(T.melting_temperature(forms["o"]).alias("tm")).collect()]
    assert (got[1]["fold"], got[1]["tm_min"], got[1]["tm_max"]) == (16, pytest.approx(min(tms)), pytest.approx(max(tms)))
    assert [got[i]["tm_min"] for i in (3, 4, 5)] == [None] * 3
    assert got[6]["fold"] == 4.0 ** 20 and got[6]["tm_min"] < got[6]["tm_max"]
    capped = {r["id"]: r for r in M.resolved_range(rows.where("id in (1, 2)"), ["id"], "oligo", cap=8).collect()}
    assert capped[1]["capped"] and capped[1]["tm_min"] is None and not capped[2]["capped"]
