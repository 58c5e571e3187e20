import json

import pytest
from pyspark.sql import functions as F

from ampliq.sources import committed as CM
from ampliq.sources import readers as RD
from ampliq.sources import sinks as SK
from ampliq.streaming import drift as SD

F_, R_ = "ACGATTGCAGGTCCATAGCA", "TTGCCATGACCTGAATCGGA"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first\nACGT\nacgu\n>r2\nTT-TT 12\n\n>r3\nNN\n")
    (tmp_path / "b.fa").write_text(">x y z\r\nGGGG\r\n")
    got = {r.record_id: (r.header, r.seq) for r in RD.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("r1 first", "ACGTACGU"), "r2": ("r2", "TTTT"), "r3": ("r3", "NN"), "x": ("x y z", "GGGG")}


def test_cq_tables(spark, tmp_path):
    p = tmp_path / "cq.csv"
    p.write_text("Sample,Group,G1,G2\ns1,a,21.5,NA\ns2,b, und ,20\n")
    got = {(r["sample"], r.gene): r.cq for r in RD.read_cq_table(spark, str(p)).collect()}
    assert got == {("s1", "G1"): 21.5, ("s1", "G2"): None, ("s2", "G1"): None, ("s2", "G2"): 20.0}
    q = tmp_path / "genes.txt"
    q.write_text("# note\nA 20 21 22\nB 20,21,22\nC 20 21\nA 1 2 3\nD 20 99 22\n")
    long, problems = RD.read_gene_rows(spark, str(q))
    assert {(r.gene, r.problem.split()[0]) for r in problems.collect()} == {("A", "duplicate"), ("C", "unequal"), ("D", "Cq")}
    assert long.filter("gene = 'B'").count() == 3


def test_feedback_and_runs(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"records": [{"assay_id": "a", "status": "success"}, {"assay_id": "b", "status": "odd"}]}))
    (tmp_path / "g.json").write_text(json.dumps([{"assay_id": "c", "status": "failed"}]))
    assert {r.assay_id for r in RD.read_feedback(spark, str(tmp_path)).collect()} == {"a", "b", "c"}
    run = tmp_path / "runs"
    run.mkdir()
    (run / "r.json").write_text(json.dumps({"run_id": "x", "finalists": [
        {"assay": {"forward": "acg", "reverse": "tt"}, "rank": 2}, {"forward": "GG", "reverse": "CC", "rank": 1}, {"forward": "ACG", "reverse": "TT", "rank": 9}]}))
    got = [(r["rank"], r.forward) for r in RD.read_ranked_runs(spark, str(run)).orderBy("rank").collect()]
    assert got == [(1, "GG"), (2, "ACG")]


def test_registry(spark, tmp_path):
    doc = {"name": "p", "assays": [{"id": "old", "forward": "ACGTACGT", "reverse": "TTGCATGC"},
                                   {"assay_id": "new", "components": [{"role": "Forward Primer", "order_sequence": "/5Bio/AC+GT"}, {"role": "probe", "sequence": "ACG"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    parts = RD.read_registry(spark, str(tmp_path))
    assert {(r.assay_id, r.role, r.sequence) for r in parts.collect()} == {
        ("old", "forward_primer", "ACGTACGT"), ("old", "reverse_primer", "TTGCATGC"), ("new", "forward_primer", "ACGT"), ("new", "probe", "ACG")}
    assert [tuple(r) for r in RD.registry_problems(parts).collect()] == [("new", "reverse_primer")]


def test_pool_and_exons(spark, tmp_path):
    p = tmp_path / "pool.txt"
    p.write_text("a,ACGT\nb\tGG GG\nc ACGTT\nACGTACGT\n")
    assert {(r.name, r.seq) for r in RD.read_oligo_pool(spark, str(p)).collect()} == {("a", "ACGT"), ("b", "GG GG"), ("c", "ACGTT"), (None, "ACGTACGT")}
    ex = RD.split_exons(spark.createDataFrame([(1, "ACG|TT U|A")], "k int, t string"), "k", "t")
    assert [(r.seq, r.length) for r in ex.orderBy("exon").collect()] == [("ACG", 3), ("TTT", 3), ("A", 1)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=x", "ac gt acg", "primer"), ("p", "AC+GTACG", "probe_lna"), ("bad", "AC+GTACG", "primer")], "name string, seq string, kind string")
    good, bad = SK.order_rows(rows)
    assert {tuple(r) for r in good.collect()} == {("'=x", "ACGTACG", "25nm", "STD"), ("p", "/56-FAM/AC+GTACG/3IABkFQ/", "100nm", "HPLC")}
    assert bad.count() == 1
    assert SK.write_snapshot(rows, str(tmp_path / "snap"), "s1") and not SK.write_snapshot(rows.limit(1), str(tmp_path / "snap"), "s1")
    assert spark.read.parquet(str(tmp_path / "snap")).where("snapshot_id = 's1'").count() == 3
    good, bad = SK.fragment_lines(spark.createDataFrame([("a b", "ac gt"), ("x", "ACN"), (None, None), (None, "gg")], "name string, seq string"))
    assert {r[0] for r in good.collect()} == {">a_b\nACGT", ">\nGG"} and bad.count() == 2
    assert len(SK.panel_report(spark.createDataFrame([("a", "n")], "assay_id string, name string")).columns) == 31


def test_interleaved_writers_leave_one_row_per_key(spark, tmp_path):
    folder = str(tmp_path / "vr")
    schema = "fingerprint string, v int"
    rows = lambda *x: spark.createDataFrame([(f"{i:02x}f", v) for i, v in x], schema)
    show = lambda: {(r.fingerprint, r.v, r.batch) for r in CM.visible(spark, folder, schema).collect()}
    assert show() == set()
    # Both writers look before either commits; the one that commits first is shown.
    CM.stage(rows((1, 1), (2, 1), (2, 1)), folder, "a")
    CM.stage(rows((2, 2), (3, 2)), folder, "b")
    assert show() == set()
    assert CM.commit(spark, folder, "b") and CM.commit(spark, folder, "a") and not CM.commit(spark, folder, "b")
    want = {("01f", 1, "a"), ("02f", 2, "b"), ("03f", 2, "b")}
    assert show() == want
    # A retry of a committed batch changes nothing, also with other rows; a failed one may be staged again.
    assert not SK.append_vulnerability_records(rows((9, 9)), folder, "a")
    CM.stage(rows((4, 4)), folder, "c")
    assert show() == want
    assert SK.append_vulnerability_records(rows((4, 5), (1, 5)), folder, "c")
    assert show() == want | {("04f", 5, "c")}
    assert CM.log(spark, folder) == ["b", "a", "c"]
    # Two writers that saw the same last entry: the loser takes the next number.
    files = CM._Files(spark, folder)
    for name in ("d", "e"):
        files.write(f"{folder}/draft/{name}", name)
    assert files.move(f"{folder}/draft/d", f"{folder}/log/000000000004") and not files.move(f"{folder}/draft/e", f"{folder}/log/000000000004")


def test_replayed_batch_finds_the_same_first_arrivals(spark, tmp_path):
    folder = str(tmp_path / "s")
    batch = lambda *x: spark.createDataFrame(x, "sequence_sha256 string, doc_id long, day int").select(
        "sequence_sha256", "doc_id", F.timestamp_seconds(F.col("day") * 86400).alias("arrived_at"))
    arriving = [batch(("aa1", 1, 5), ("aa1", 2, 4), ("bb2", 3, 1)), batch(("aa1", 4, 0), ("cc3", 5, 0), ("ab4", 6, 9)), batch(("cc3", 7, 1), ("ab4", 8, 1), ("dd5", 9, 0))]
    want = [{2, 3}, {5, 6}, {9}]

    def run(n):
        got = SD.unseen(arriving[n], n, folder, "doc_id")
        ids = {r.doc_id for r in got.collect()}
        SD.remember(got, n, folder)
        return ids

    assert [run(0), run(1)] == want[:2]
    assert run(1) == want[1] and run(2) == want[2]
    assert run(1) == want[1] and run(0) == want[0]
    assert spark.read.parquet(f"{folder}/seen").count() == 5


def test_stream_monitor_sees_each_sequence_once(spark, tmp_path):
    good, lost = F_ + "GATTACA" * 6 + rc(R_), "GATTACA" * 12
    src = tmp_path / "in"

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, seq string, role string, grp string, day int").coalesce(1).write.mode("append").parquet(str(src))

    assays = spark.createDataFrame([("a", F_, R_, None)], "assay string, forward string, reverse string, probe string")

    def run():
        schema = "doc_id long, seq string, role string, grp string, day int"
        raw = spark.readStream.schema(schema).parquet(str(src)).withColumn("arrived_at", F.timestamp_seconds(F.col("day") * 86400))
        SD.monitor(SD.arriving_sequences(raw), assays, str(tmp_path / "out"), assay="assay", record="doc_id", max_len=30).awaitTermination()

    arrive([(1, good, "target", "x", 1), (2, good, "target", "x", 1), (3, lost, "target", "x", 1)])
    run()
    arrive([(4, good, "target", "x", 2), (5, lost + "A", "target", "y", 2), (6, good + "A", "off_target", "y", 2)])
    run()
    out = str(tmp_path / "out")
    assert spark.read.parquet(f"{out}/seen").select("sequence_sha256").distinct().count() == spark.read.parquet(f"{out}/seen").count() == 4
    got = {(r.doc_id, r.code) for r in spark.read.parquet(f"{out}/reasons").collect()}
    assert got == {(3, "new_target_lost_coherent_product"), (5, "new_target_lost_coherent_product"), (6, "new_signal_generating_off_target")}


def test_tallied_batches_move_the_watermark_batch_by_batch(spark, tmp_path):
    """A batch of many files is still one micro-batch: the second batch is not late, whatever the file order of the first."""
    folder = str(tmp_path / "s")
    rows = lambda *days: spark.createDataFrame([(d,) for d in days], "day int").select(F.timestamp_seconds(F.col("day") * 86400).alias("arrived_at"), F.lit("x").alias("grp"))
    rows(*range(40)).repartition(12).write.parquet(f"{folder}/fresh/batch=0")
    rows(1, 1, 50).repartition(3).write.parquet(f"{folder}/fresh/batch=1")
    rows(2, 49).repartition(2).write.parquet(f"{folder}/fresh/batch=2")
    stream = SD.tallied_batches(spark.read.parquet(f"{folder}/fresh"), folder, 3, ["grp"], "1 day")
    counts = (stream.withWatermark("arrived_at", "2 days").groupBy(F.window("arrived_at", "1 day").alias("w"), "grp")
              .agg(F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "grp", "n"))
    SD.write_counts(counts, folder, ["window_start", "grp"]).awaitTermination()
    got = {(r.window_start.timetuple().tm_yday - 1, r.n) for r in SD.latest_counts(spark, folder, ["window_start", "grp"]).collect()}
    # A watermark filters from the batch after next on, so day 2 is late in the third batch only.
    assert got == {(d, 3 if d == 1 else 1) for d in (*range(40), 49, 50)}


def test_stream_queries_read_a_table_of_several_files(spark, tmp_path):
    """documents.parquet may be a folder; its files carry other names."""
    import __spark_entry__ as E
    src = "/root/testdata/sf0.001"
    spark.read.parquet(f"{src}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("streamed_drift_reasons", "streamed_window_counts"):
        one, many = (sorted(E.queries()[name](spark, f).collect(), key=repr) for f in (src, str(tmp_path)))
        assert one == many and one
