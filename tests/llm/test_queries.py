import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import oracle
import texts as X
import corpus_pipeline
from ampliq.llm import mixing
from ampliq.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, con, name):
    build, sql = QUERIES[name]
    problems, _ = oracle.compare(build(spark, FOLDER), con, sql)
    assert problems == []


def test_language_of_held_out_texts(spark, docs):
    lang = {d: lg for d, _, lg, _ in docs}
    got = QUERIES["op1_language_id"][0](spark, FOLDER).where("held_out").collect()
    assert {r["doc_id"] for r in got} == {d for d in lang if X.held(d, 5)}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.95 * len(got)


def test_toxicity_of_held_out_texts(spark, con):
    truth = dict(con.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY doc_id").fetchall())
    got = [r for r in QUERIES["op2_toxicity_grammar"][0](spark, FOLDER).collect() if r["doc_id"] in truth]
    wrong = sum(r["predicted"] != truth[r["doc_id"]] for r in got if r["held_out"])
    assert wrong <= 0.15 * sum(r["held_out"] for r in got)


def test_class_model(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_brown_classes"][0](spark, FOLDER).collect()}
    words = {d: X.spaced(t) + [None] for d, t, *_ in docs}
    count = Counter(w for d, ws in words.items() if not X.held(d, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in ws))
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_repeated_bytes(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op9_bucket_pointers"][0](spark, FOLDER).collect()}
    assert got == {d: x for (d, *_), x in zip(docs, X.repeated_bytes([t for _, t, *_ in docs], 400))}


def redacted(rows):
    """Brute-force secrets stage: the values themselves are searched for."""
    owners, out = defaultdict(set), []
    for _, t, _, s in rows:
        for *_, value in X.base_spans(t):
            owners[value].add(s)
    live = [v for v, held in owners.items() if len(held) < 3]
    for d, t, lg, s in rows:
        base = X.base_spans(t)
        spans = [(a, b, k) for a, _, k, b, v in base if len(owners[v]) < 3]
        spans += [(a, b, "token") for a, b in X.bare_values(t, live) if not any(x < b and a < y for x, _, _, y, _ in base)]
        at, text = 0, ""
        for a, b, k in sorted(spans):
            if a >= at:
                text += t[at:a] + f"[{k}]"
            at = max(at, b)
        out.append((d, text + t[at:], lg, s))
    return out


def test_pipeline_stages(spark, docs, con):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in list(stages.items())[:4]:
        seen[name] = frame = stage(spark, frame, FOLDER).cache()
        assert set(frame.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    rows = {k: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in f.collect()) for k, f in seen.items()}
    # Clean texts stay: every text with letters has a clear language here.
    assert rows["language"] == sorted(r for r in docs if any(c.isalpha() for c in r[1]))
    plain, _ = X.jaccard(rows["language"])
    stay = {d for d, n, root in plain if not n or d == root}
    assert rows["near_duplicates"] == [r for r in rows["language"] if r[0] in stay]
    hits = X.leaks([r[1] for r in rows["near_duplicates"]], con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert rows["decontaminate"] == [r for r, h in zip(rows["near_duplicates"], hits) if not h[1]]
    assert rows["redact_secrets"] == sorted(redacted(rows["decontaminate"]))
    # The mix, by hand: quotas from words, documents in hash order.
    words = {d: len(X.spaced(t)) for d, t, *_ in rows["redact_secrets"]}
    by = defaultdict(list)
    for d, _, _, s in rows["redact_secrets"]:
        by[s].append(d)
    names = sorted(by)
    sizes = [sum(words[d] for d in by[s]) for s in names]
    aims = mixing.quota(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    want = {}
    for s, size, aim in zip(names, sizes, aims):
        laps, rest = divmod(math.floor(aim), size)
        for d in sorted(by[s], key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            part = min(words[d], rest)
            rest -= part
            want[d] = laps * words[d] + part
    got = stages["mix"](spark, frame, FOLDER)
    assert {r["doc_id"]: r["taken"] for r in got.collect()} == {d: n for d, n in want.items() if n}


def test_run_is_the_chain_of_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and out.where(F.col("taken") <= 0).count() == 0
