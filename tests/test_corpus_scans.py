"""Cleaning, snapshot metrics and one-base repairs: results by hand, and sequences read once."""

from pyspark.sql import functions as F

from ampliq.functions import seq as S
from ampliq.operators import corpus as C
from ampliq.operators import redesign as RD
from ampliq.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cleaning_works_text_out_once(spark):
    plan = _plan(all_queries()["sequence_cleaning"].build(spark, FOLDER))
    assert plan.count("(?m)") == 1


def test_cleaning_by_hand(spark):
    rows = {"": (None, "empty sequence"), "  ": (None, "empty sequence"), None: (None, "empty sequence"),
            ">head\nac gu\t1.2-n\x0b\r\n >x\nR": ("ACGTNR", None), "acz!gz é": (None, "invalid character(s): ! Z É"), "12 .-": (None, "no sequence left after cleaning"),
            ">only head": (None, "no sequence left after cleaning")}
    df = spark.createDataFrame([(k,) for k in rows], "raw string")
    clean, error = S.clean_sequence(F.col("raw"))
    assert {r.raw: (r.c, r.e) for r in df.select("raw", clean.alias("c"), error.alias("e")).collect()} == rows


def test_metrics_read_the_corpus_once(spark):
    assert _plan(all_queries()["snapshot_metrics"].build(spark, FOLDER)).count("Relation [") == 1


def test_metrics_by_hand(spark):
    rows = [(3, "a", "ACGT"), (1, "b", "ACGT"), (1, "a", "ACGT"), (1, "a", "ACGT"), (7, None, "GGGTT"), (8, "a", "AC E"), (9, "a", ""), (None, "c", "ACGT"), (4, "c", "ac gu"),
            (None, "d", "TTTTTTT")]
    r = C.snapshot_metrics(spark.createDataFrame(rows, "id int, grp string, seq string").repartition(3), "id").first()
    assert (r.raw_record_count, r.unique_sequence_count, r.raw_total_bases, r.unique_total_bases) == (8, 4, 36, 17)
    assert (r.exact_duplicate_count, r.rejected_record_count, r.group_counts) == (2, 2, {"a": 2, "b": 1, "ungrouped": 1})
    none = C.snapshot_metrics(spark.createDataFrame([], "id int, grp string, seq string"), "id").first()
    assert (none.raw_record_count, none.unique_sequence_count, none.rejected_record_count, none.group_counts) == (0, 0, 0, {})


def test_repairs_by_hand_without_a_join_of_sequences(spark):
    oligos = spark.createDataFrame([(1, "F", "ACGTTGCA"), (2, "R", "TTGACC"), (3, "P", "GGGGGCCA")], "a int, role string, oligo string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = {1: "TTTTACGATGCATTTT", 2: "AAAA" + rc("TTGATC") + "AAAA", 3: "ATAT" + rc("GGGGGCCT") + "ATAT", 4: "TTTTACGNTGCATTTT"}
    out = RD.one_base_repairs(oligos, spark.createDataFrame(list(seqs.items()), "d int, seq string"), ["a", "role"], "d", max_len=30)
    got = {tuple(r) for r in out.select("a", "d", "strand", "lo", "old", "new", "position", "three_prime_distance").collect()}
    want = set()
    for a, role, old in ((1, "F", "ACGTTGCA"), (2, "R", "TTGACC"), (3, "P", "GGGGGCCA")):
        for d, text in seqs.items():
            for lo in range(len(text) - len(old) + 1):
                for strand in {"F": "+", "R": "-", "P": "+-"}[role]:
                    window = text[lo:lo + len(old)]
                    new = window if strand == "+" else rc(window)
                    diff = [i for i, (x, y) in enumerate(zip(old, new)) if x != y]
                    if len(diff) == 1 and "N" not in new:
                        want.add((a, d, strand, lo, old, new, diff[0] + 1, len(old) - diff[0] - 1))
    assert got == want and len(want) >= 3
    assert _plan(all_queries()["one_base_repairs"].build(spark, FOLDER)).count("Relation [doc_id") == 1
