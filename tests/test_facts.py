import itertools
import math
import random

from pyspark.sql import functions as F

from ampliq.functions import thermo as T
from ampliq.operators import expression as X
from ampliq.operators import interactions as I
from ampliq.operators import melting_range as M
from ampliq.operators import quant as Q
from ampliq.operators import ranking as R
from ampliq.operators import redesign as RD
from ampliq.operators import traces as TR
from ampliq.sources.profiles import chemistry, chemistry_table, custom_limits, objective_table


def test_fold_change_facts(spark):
    rows = [(s, g, gene, cq) for s, g, t in (("c1", "control", 25.0), ("c2", "control", 25.0), ("i1", "infected", 23.0), ("i2", "infected", 23.0))
            for gene, cq in (("IFNG", t), ("RPL13", 20.0), ("YWHAZ", 20.0))] + [("i3", "infected", "IFNG", 10.0), ("i3", "infected", "RPL13", None)]
    cq = spark.createDataFrame(rows, "sample string, grp string, gene string, cq double")
    got = {r.grp: r for r in X.fold_changes(X.relative_quantities(cq, ["RPL13", "YWHAZ"], []), [], "control").collect()}
    assert got["infected"].n == 2 and math.isclose(got["infected"].ddcq, -2.0)
    assert math.isclose(got["infected"].fold_livak, 4.0) and math.isclose(got["infected"].log2_fold, 2.0)
    assert math.isclose(got["control"].fold_livak, 1.0) and got["infected"].low_n
    corrected = X.fold_changes(X.relative_quantities(cq, ["RPL13", "YWHAZ"], [], efficiencies={"IFNG": 80.0}), [], "control")
    assert math.isclose({r.grp: r.fold_pfaffl for r in corrected.collect()}["infected"], 3.24, rel_tol=1e-9)


def test_published_melting_temperatures(spark):
    known = [("CTGGAACGGTGAAGGTGACA", 64.3), ("AAGGGACTTCCTGTAACAATGCA", 63.9), ("TGCTGTCTCCATGTTTGATGTATCT", 63.7)]
    got = spark.createDataFrame(known, "s string, tm double").select("tm", T.melting_temperature(F.col("s")).alias("ours")).collect()
    assert all(abs(r.tm - r.ours) <= 0.06 for r in got)


def test_salt_regimes_are_finite(spark):
    df = spark.createDataFrame([("ACGTACGTTAGC", 50.0, 0.0), ("ACGTACGTTAGC", 1000.0, 1.0), ("ACGTACGTTAGC", 1.0, 8.0)], "s string, mv double, dv double")
    tm = T.melting_temperature(F.col("s"), T.Conditions(mv=F.col("mv"), dv=F.col("dv"), dntp=0.0))
    assert all(20 < r[0] < 80 for r in df.select(tm).collect())


def _trace(n0, k=0.6):
    return [50 + 1000 / (1 + math.exp(-k * (c - n0))) + (c * 7 % 5) * 0.1 for c in range(1, 46)]


def test_later_inflection_means_larger_cq(spark):
    wells = spark.createDataFrame([("a", _trace(26)), ("b", _trace(34)), ("flat", [50.0 + (i % 3) * 0.1 for i in range(45)])], "well string, fluor array<double>")
    rows = TR.explode_traces(wells, ["well"])
    got = {r.well: r for r in TR.call_cq(rows, ["well"]).collect()}
    assert got["b"].cq_threshold - got["a"].cq_threshold > 3 and got["b"].cq_sdm - got["a"].cq_sdm > 3
    assert not got["flat"].amplified and got["flat"].cq_threshold is None
    bad = spark.createDataFrame([("s", [1.0, 2.0])], "well string, fluor array<double>")
    assert TR.trace_errors(TR.explode_traces(bad, ["well"]), ["well"]).count() == 1


def test_curve_and_limit(spark):
    pts = [("a", 10.0 ** k, 40 - 3.32 * k) for k in range(1, 7) for _ in range(3)] + [("a", 1.0, None)] * 3
    df = spark.createDataFrame(pts, "assay string, quantity double, cq double")
    r = Q.standard_curve(df, ["assay"]).first()
    assert math.isclose(r.slope, -3.32, abs_tol=1e-9) and r.n_levels == 6 and r.efficiency_ok and r.lowest_fully_detected == 10.0
    calls = [("a", 10.0 ** k, 30.0 if i < hit else None) for k, hit in ((0, 1), (1, 4), (2, 9), (3, 10)) for i in range(10)] + [("b", 10.0, 30.0)] * 5
    got = {r.assay: r.lod95 for r in Q.detection_limit(spark.createDataFrame(calls, "assay string, quantity double, cq double"), ["assay"]).collect()}
    assert 10 < got["a"] < 1000 and got["b"] is None


def test_pareto_fronts_equal_peeling(spark):
    rnd = random.Random(1)
    rows = [(run, i, rnd.randint(0, 6), rnd.randint(0, 6), rnd.randint(0, 6)) for run in "ab" for i in range(60)]
    got = {(r.run, r.id): r.front for r in R.pareto_fronts(spark.createDataFrame(rows, "run string, id int, x int, y int, z int"), ["run"], "id", ["x", "y", "z"]).collect()}
    for run in "ab":
        left, front = {r[1]: r[2:] for r in rows if r[0] == run}, 1
        while left:
            best = {i for i, v in left.items() if not any(all(a <= b for a, b in zip(w, v)) and w != v for w in left.values())}
            assert all(got[(run, i)] == front for i in best)
            left = {i: v for i, v in left.items() if i not in best}
            front += 1


def test_skyline_with_many_blocks(spark):
    rnd = random.Random(3)
    rows = [("a", i, float(rnd.randint(0, 40)), float(rnd.randint(0, 40))) for i in range(300)]
    live = spark.createDataFrame(rows, "run string, id int, x double, y double").select("run", "id", F.array("x", "y").alias("v"))
    got = {r.id for r in R.skyline(live, ["run"], "id", block=16).collect()}
    vs = {r[1]: r[2:] for r in rows}
    assert got == {i for i, v in vs.items() if not any(all(a <= b for a, b in zip(w, v)) and w != v for w in vs.values())}


def test_finalists_equal_sequential_fill(spark):
    names = ["run", "rank", "hard_valid", "signal_subjects", "product_subjects", "target_coverage", "worst_3prime", "robustness", "amplicon",
             "degeneracy_fold", "panel_risk", "f_start", "forward", "reverse", "probe"]
    rows, expect = [], {}
    # Few primers and regions: pairs come back in later regions, which the fill must notice. P2 in a new region beats rank 2.
    for seed in range(25):
        rnd = random.Random(seed)
        own = [(f"r{seed}", i + 1, rnd.random() < 0.8, rnd.randint(0, 1), rnd.randint(0, 2), rnd.choice([0.9, 1.0]), rnd.choice([0.8, 1.0]), rnd.choice([0.33, 1.0]),
                rnd.randint(60, 99), rnd.choice([1, 2]), rnd.randint(0, 2), rnd.randint(0, 1500), f"F{rnd.randint(0, 4)}", f"R{rnd.randint(0, 2)}", f"P{rnd.randint(0, 2)}")
               for i in range(rnd.choice([5, 40, 120]))]
        rows += own
        valid = [dict(zip(names, r)) for r in own if r[2]]
        keys = {"recommended_balanced": lambda x: x["rank"], "best_specificity": lambda x: (x["signal_subjects"], x["product_subjects"], x["rank"]),
                "best_inclusivity": lambda x: (-x["target_coverage"], -x["worst_3prime"], x["rank"]), "most_condition_robust": lambda x: (-x["robustness"], x["rank"]),
                "best_short_amplicon": lambda x: (x["amplicon"], x["rank"]), "minimal_degeneracy": lambda x: (x["degeneracy_fold"], x["rank"]),
                "best_multiplex_fit": lambda x: (x["panel_risk"], x["rank"])}
        ident, pair, region = (lambda x: (x["forward"], x["reverse"], x["probe"])), (lambda x: (x["forward"], x["reverse"])), (lambda x: x["f_start"] // 250)
        chosen, label = {}, {}
        for name, key in keys.items() if valid else ():
            best = min(valid, key=key)
            label.setdefault(chosen.setdefault(ident(best), best)["rank"], []).append(name)
        for name, need_pair, need_region in (("alternate_region", True, True), ("alternate_primer_pair", True, False), ("alternate_probe", False, False)):
            for x in valid:
                if (len(chosen) < 12 and ident(x) not in chosen and not (need_pair and pair(x) in map(pair, chosen.values()))
                        and not (need_region and region(x) in map(region, chosen.values()))):
                    chosen[ident(x)] = x
                    label[x["rank"]] = [name]
        for rank in sorted(x["rank"] for x in chosen.values())[:12]:
            expect[f"r{seed}", rank] = ",".join(label[rank])
    got = {(r["run"], r["rank"]): r["label"] for r in R.finalists(spark.createDataFrame(rows, names), ["run"], 12).collect()}
    assert got == expect


def test_independent_set_is_maximal(spark):
    rnd = random.Random(4)
    edges = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(90)}
    nodes = spark.range(40).withColumnRenamed("id", "n")
    got = {r.n for r in I.independent_set(nodes, spark.createDataFrame(list(edges), "a long, b long"), "n").collect()}
    assert not any(a in got and b in got for a, b in edges)
    assert all(any((min(n, m), max(n, m)) in edges for m in got) for n in set(range(40)) - got)


def test_interactions_equal_brute_force(spark):
    rnd = random.Random(9)
    pool = [(i, "".join(rnd.choice("ACGT") for _ in range(14))) for i in range(25)]
    comp = str.maketrans("ACGT", "TGCA")

    def energy(run):
        ends = sum((2.3 - 310.15 * 0.0041) if e in "AT" else (0.1 + 310.15 * 0.0028) for e in (run[0], run[-1]))
        return ends + sum(T.STEP_TERMS[run[i:i + 2]][0] - 310.15 * T.STEP_TERMS[run[i:i + 2]][1] / 1000 for i in range(len(run) - 1))

    expect = {}
    for (i, a), (j, b) in itertools.combinations(pool, 2):
        rb = b.translate(comp)[::-1]
        runs = [a[s:e] for s in range(14) for e in range(s + 2, 15) if a[s:e] in rb]
        best = min((energy(r) for r in runs), default=0)
        if best <= -4:
            expect[(i, j)] = round(best, 6)
    df = spark.createDataFrame(pool, "id int, seq string")
    got = {(r.a, r.b): round(r.dg, 6) for r in I.interacting_pairs(df, df, "id", "seq", -4.0).collect()}
    assert got == expect and expect
    direct = df.alias("x").crossJoin(df.withColumnsRenamed({"id": "j", "seq": "t"})).filter("id < j").select(
        "id", "j", I.pair_energy(I.stable_runs(F.col("seq"), -4.0), F.col("t")).alias("dg")).filter("dg <= -4")
    assert {(r.id, r.j): round(r.dg, 6) for r in direct.collect()} == expect


def test_reversed_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    order = list(range(1, 31))
    rnd.shuffle(order)
    left = spark.createDataFrame([("r", i, i) for i in range(1, 31)], "run string, id int, rank int")
    right = spark.createDataFrame([("r", i, order[i - 1]) for i in range(1, 31)], "run string, id int, rank int")
    got = R.reversed_pairs(left, right, ["run"], "id").first()
    assert got.n_reversed == sum(order[a] > order[b] for a, b in itertools.combinations(range(30), 2)) and got.n_pairs == 435


def test_shared_block(spark):
    df = spark.createDataFrame([("g", 1, "TTACGTACGGTT"), ("g", 2, "CCACGTACGGAA")], "g string, t int, s string")
    r = RD.shared_blocks(df, "g", "t", "s", 6).first()
    assert (r.start, r.length) == (3, 8)


def test_profiles(spark):
    assert chemistry_table(spark).count() == 10 and objective_table(spark).count() == 10
    assert chemistry("parasite_mtdna")["anneal_c"] == 54.0
    c = custom_limits("idt_taqman", tm=(64, 58), gc=(-5, 120), amp=(10, 9000), length=(5, 50))
    assert (c["tm_min"], c["tm_opt"], c["gc_min"], c["gc_max"], c["amp_min"], c["amp_max"], c["len_min"], c["len_max"]) == (58.0, 61.0, 0.0, 100.0, 40, 2000, 12, 40)


def test_wide_ranking_equals_plain_ranking(spark):
    rows = [("a" if i % 3 else "b", i, [float(i * 7 % 13), float(i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "run string, id int, rank_key array<double>")
    plain = {(r.run, r.id): r["rank"] for r in R.ranked(df, ["run"], ["id"]).collect()}
    assert {(r.run, r.id): r["rank"] for r in R.ranked_wide(df, ["run"], ["id"], slices=7).collect()} == plain


def test_degenerate_oligos_beyond_the_cap_keep_a_row(spark):
    rows = spark.createDataFrame([(1, "ACGTACGTACGTACGTACGT"), (2, "RCGTACGTACGTACGTACGT"), (3, "NNNNACGTACGTACGTACGT")], "id int, oligo string")
    got = {r["id"]: r for r in M.resolved_range(rows, ["id"], "oligo").collect()}
    assert [(got[i]["fold"], got[i]["capped"], got[i]["tm_min"] is None) for i in (1, 2, 3)] == [(1, False, False), (2, False, False), (256, True, True)]
    assert got[1]["tm_min"] == got[1]["tm_max"] and got[2]["tm_min"] < got[2]["tm_max"]


def test_short_oligos_are_placed(spark):
    from ampliq.operators.products import best_seeded_hit
    oligos = spark.createDataFrame([("seven", "ACGTTGC", "+"), ("six", "GGATCC", "+"), ("gone", "TTTTTTT", "+")], "name string, oligo string, on string")
    subjects = spark.createDataFrame([(1, "AACCACGTTGCAACCGGATCCAA")], "doc int, seq string")
    got = {r["name"]: (r["mm"], r["olen"]) for r in best_seeded_hit(oligos, subjects, ["name"], ["doc"]).collect()}
    assert got == {"seven": (0, 7), "six": (0, 6)}


def test_stability_ranks_every_gene(spark):
    from ampliq.operators.expression import stability_ranking
    genes = "abcdefgh"
    rows = [("s", x, y, float((genes.index(x) + 1) * (genes.index(y) + 1))) for x in genes for y in genes if x != y]
    got = sorted((r["place"], r["gene"]) for r in stability_ranking(spark.createDataFrame(rows, "study string, gene string, other string, v double"), ["study"]).collect())
    assert got == [(1, "a"), (1, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f"), (7, "g"), (8, "h")]


def test_reversals_of_very_large_ranks(spark):
    rnd = random.Random(3)
    left = [("r", i, i + 1) for i in range(30)]
    right = [("r", i, rnd.randrange(1, 2 ** 40)) for i in range(30)]
    kind = "run string, id int, rank long"
    got = R.reversed_pairs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["run"], "id").collect()
    want = sum(1 for i in range(30) for j in range(i) if right[j][2] > right[i][2])
    assert got[0]["n_reversed"] == want


def test_designed_assays_choose_among_all_pairs(spark):
    from ampliq.functions import thermo
    from ampliq.operators import design
    from ampliq.plans import design as plan, shapes
    folder = "/root/testdata/sf0.001"
    wins = design.enumerate_windows(shapes.templates(spark, folder), ["item_id"], "t", 12, 13)
    kept = (wins.filter(design.primer_rejection(F.col("oligo"), plan.SHORT).isNull())
            .withColumns({"tm": thermo.melting_temperature(F.col("oligo")), "runs": design.I.stable_runs(F.col("oligo"), -2.0)}))
    pairs = design.pair_primers(kept, ["item_id"], plan.SHORT)
    want = design.retain_diverse_pairs(pairs, ["item_id"], limit=8, region=20).filter("decision = 'retained'")
    key = ["item_id", "f_start", "r_end", "forward", "reverse"]
    got = plan.designed_assays(spark, folder)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_pareto_rounds_go_by_slices_not_fronts(spark, monkeypatch):
    """A chain of as many fronts as candidates, equal vectors and a missing metric, in a few rounds."""
    rows = [("a", i, i // 2, 3 * (i // 2), 1) for i in range(120)] + [("b", i, (i * 7) % 23, (i * 5) % 17, i % 3) for i in range(200, 300)] + [("a", 500, None, 0, 0)]
    written = []
    monkeypatch.setattr(R, "cut_to_parquet", lambda df, cut=R.cut_to_parquet: written.append(df) or cut(df))
    df = spark.createDataFrame(rows, "run string, id int, x int, y int, z int")
    got = {(r.run, r.id): r.front for r in R.pareto_fronts(df, ["run"], "id", ["x", "y", "z"], block=25).collect()}
    want = {}
    for run, i, *v in sorted((r for r in rows if None not in r), key=lambda r: r[2:]):
        over = [want[q, j] for q, j, *w in rows if (q, j) in want and q == run and w != v and all(a <= b for a, b in zip(w, v))]
        want[run, i] = 1 + max(over, default=0)
    assert got == want | {("a", 500): 1} and max(want.values()) == 60
    assert len(written) <= 2 + 6
