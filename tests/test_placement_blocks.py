"""Placement in bounded batches: mixed lengths, pieces of long sequences, nearest sequences."""

import random

import numpy as np
import pyarrow as pa

from ampliq.operators import placement as B

COMP = str.maketrans("ACGT", "TGCA")


def best(oligo, seq):
    found = [(-sum(a == b for a, b in zip(oligo, s[i:i + len(oligo)])), sign, i, s[i:i + len(oligo)])
             for sign, s in (("+", seq), ("-", seq.translate(COMP)[::-1])) for i in range(len(s) - len(oligo) + 1)]
    return min(found, default=None)


def test_best_and_nearest_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    monkeypatch.setattr(B, "WHOLE", 64)
    monkeypatch.setattr(B, "BLOCK", 7)
    seqs = {i: text(n) for i, n in enumerate([5, 12, 20, 63, 64, 65, 130, 300, 41])}
    oligos = {f"o{i}": text(rnd.choice([8, 9, 12, 17, 31, 40])) for i in range(20)} | {"in": seqs[7][100:125], "top": seqs[6][:12]}
    left = spark.createDataFrame(list(oligos.items()), "k string, oligo string")
    right = spark.createDataFrame(list(seqs.items()), "d long, seq string")
    want = {(k, d): best(o, s) for k, o in oligos.items() for d, s in seqs.items() if len(s) >= len(o)}
    got = {(r.k, r.d): (-r.score, r.strand, r.offset, r.window) for r in B.best_placements(left, right, oligo_key="k", subject_key="d").collect()}
    assert got == want
    near = {(r.k, r.d) for r in B.best_placements(left, right, oligo_key="k", subject_key="d", least=0.6).collect()}
    assert near == {x for x, b in want.items() if -b[0] >= 0.6 * len(oligos[x[0]])}
    top = {r.k: (r.matches, r.exact) for r in B.nearest_sequences(left, right, oligo_key="k", subject_key="d").collect()}
    assert top == {k: (max(-want[k, d][0] for d in seqs if (k, d) in want),
                       min((d for d in seqs if (k, d) in want and -want[k, d][0] == len(o)), default=None)) for k, o in oligos.items()}


def test_batches_that_leave_a_task_are_bounded():
    """10 000 sequences by 100 oligos are a million rows; they leave in many batches, not as one."""
    rnd = random.Random(4)
    oligos = ["".join(rnd.choice("ACGT") for _ in range(12)) for _ in range(100)]
    rows = [(0, 0, 0, f"o{i}", o, None, None) for i, o in enumerate(oligos)]
    rows += [(0, 0, 1, str(i), "ACGTTGCATGCAAG" + "ACGT"[i % 4], 0, 15) for i in range(10000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["slice", "block", "kind", "id", "text", "start", "slen"])
    sizes = [b.num_rows for b in B.stream(iter([batch]), lambda ids, texts: B._Placed(ids, texts, 0.0), "start", "slen")]
    assert sum(sizes) == 1_000_000 and max(sizes) < B.FLUSH + 100 and np.mean(sizes) > 20000


def test_windows_hold_the_bases_that_end_there(spark, monkeypatch):
    """Every word of every position, across blocks of 15 and chunk ends, and text is converted once a block, not once a position."""
    from ampliq.functions import seq as S
    from ampliq.operators import sites as SI
    monkeypatch.setattr(SI, "CHUNK", 32)
    rnd = random.Random(5)
    seqs = {n: "".join(rnd.choice("ACGTN") for _ in range(n)) for n in (1, 14, 15, 16, 31, 32, 33, 64, 100)}
    got = SI.windows(spark.createDataFrame(list(seqs.items()), "d int, seq string"), ["d"], "seq", 30, "+")
    code = dict(zip(S.IUPAC_LETTERS, S.IUPAC_HEX))
    held = lambda s, stop: int("".join(code[c] for c in s[max(stop - 15, 0):max(stop, 0)]) or "0", 16)
    want = {(n, q, held(s, q + 1)) for n, s in seqs.items() for q in range(n)}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.d, r.q, r.m0) for r in rows} == want
    # The second word may lack bases beyond the 30 that were asked for, never one of them.
    assert all(r.m1 == held(seqs[r.d], r.q - 14) for r in rows if r.q % 32 >= 29 or r.q < 32)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(sequence(0, more")[0]
    assert "conv(" not in above


def test_failure_reasons_sweep_products_once(spark):
    """What is read twice is worked out once: the final plan holds no sweep and no site search any more."""
    import __spark_entry__ as E
    out = E.queries()["failed_amplification_reasons"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "bit_count" not in plan
    assert out.count() > 0
