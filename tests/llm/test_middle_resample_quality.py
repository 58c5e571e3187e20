import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
import texts as X
from ampliq.llm import middle, quality, resample
from ampliq.llm import text as tx
from ampliq.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def lined(seed=3):
    """Awkward rows, and texts whose lines, sentinels and code points matter."""
    rnd = random.Random(seed)
    rows = X.awkward()
    extra = ["a\nb\nc", "a\n", "\n", "\n\n\n", "no line end", "é\n日本\n\nü", "cut <P> here\nand", "<S>\nx", "x\n<M>", "<P\n>", "<\nS>x\n<", "\r\na\rb\r\n",
             "\n".join("x" * rnd.randrange(200) for _ in range(3000)), "y" * 50000 + "\n" + "z\n" * 5000]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(extra)] + [(1003, "\n\n\n", "en", "a"), (None, "p\nq\nr\n", "en", "b")]
    return rows


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def cut_by_hand(ident, text, seed="7", rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 90, "seed": "x", "bound": 1}])
def test_middle_equals_cutting_by_hand(spark, options):
    rows = lined()
    out = middle.transform(X.table(spark, rows), "doc_id", "text", **options).withColumn("back", middle.restore(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect()), key=repr)
    hand = {k: v for k, v in options.items() if k != "bound"}
    assert got == sorted(((i, *cut_by_hand(i, t, **hand), t or "") for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_of_nothing(spark):
    assert middle.transform(X.table(spark, []), "doc_id", "text").collect() == []


@pytest.mark.parametrize("bound", [0, 1, 7, 64])
def test_rank_index_is_bounded_and_exact(bound):
    rnd = random.Random(bound)
    for n in (1, 2, 3, 50, 5000):
        offsets = np.cumsum([0] + [rnd.choice([1, 3, 40, 900]) if rnd.random() < .9 else rnd.randrange(1, 10 ** 6) for _ in range(n - 1)])
        index = middle.fit(offsets, bound)
        assert (index.offset(np.arange(n)) == offsets).all()
        assert np.abs(index.residuals).max() <= bound + 1  # one more: predictions are floored
    straight = middle.fit(np.arange(0, 700000, 7), bound)
    assert len(straight.first) == 1


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(X.LOW))


def resample_by_hand(rows, target, buckets=10000, least=20, percent=25):
    def grams(t):
        w = words_of(t)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    source, goal = np.zeros(buckets), np.zeros(buckets)
    for _, t, *_ in rows:
        np.add.at(source, grams(t), 1)
    for t in target:
        np.add.at(goal, grams(t), 1)
    out = []
    for i, t, *_ in rows:
        g = [math.floor(1000 * math.log((goal[b] + 1) * (source.sum() + buckets) / ((source[b] + 1) * (goal.sum() + buckets)))) for b in grams(t)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))
        out.append([i, len(g), weight, score, None, len(words_of(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=repr)


@pytest.mark.parametrize("options", [{}, {"percent": 100, "least_words": 0}, {"percent": 60, "least_words": 3, "buckets": 50}, {"percent": 0}])
def test_resampling_equals_brute_force(spark, options):
    rows = X.awkward() + [(2000, "Ab" * 400 + " ab " + "ñ" * 90 + "-x" * 300, "en", "a"), (1, X.awkward()[0][1], "en", "a")]
    target = ["w1 w2 w3 w4", None, "", "Straße été w1 w2", "ab ab"]
    goal = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id int, text string, id string")
    got = resample.resample(X.table(spark, rows), "doc_id", "text", goal, "text", **options)
    hand = {"buckets": options.get("buckets", 10000), "least": options.get("least_words", 20), "percent": options.get("percent", 25)}
    assert sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()), key=repr) == resample_by_hand(rows, target, **hand)


def test_resampling_of_empty_tables(spark):
    goal = spark.createDataFrame([], "item_id int, text string")
    assert resample.resample(X.table(spark, []), "doc_id", "text", goal, "text").collect() == []
    got = resample.resample(X.table(spark, X.awkward()), "doc_id", "text", goal, "text").collect()
    assert sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got), key=repr) == resample_by_hand(X.awkward(), [])


def test_quickselect_over_repeated_keys(spark):
    rnd = random.Random(8)
    values = [(rnd.choice([1, 2, 3, rnd.randrange(10 ** 9)]), rnd.choice([None, rnd.randrange(5)])) for _ in range(3000)]
    rows = spark.createDataFrame(values, "a long, b long").repartition(7).cache()
    key = F.struct("a", F.col("b").isNull().alias("no"), "b")
    order = sorted(values, key=lambda v: (v[0], v[1] is None, v[1] or 0))
    for k in (1, 2, 700, 1500, 2999, 3000):
        found = spark.range(1).select(resample.kth_key(rows, key, k, pivots=3).alias("k")).select("k.a", "k.b").first()
        assert tuple(found) == order[k - 1]
    ranks = resample.ranked(rows, F.col("a"), F.col("b").asc_nulls_last()).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 3001)) and [(r["a"], r["b"]) for r in ranks] == order


def describe_by_hand(text):
    raw = (text or "").encode()
    kind = [next((k for k, m in enumerate(quality.CLASSES) if c in m), len(quality.CLASSES)) for c in raw]
    pairs = [0.0] * (quality.SIDE ** 2)
    for a, b in zip(kind, kind[1:]):
        pairs[a * quality.SIDE + b] += 1
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").translate(X.LOW).encode())
    size, some, long = max(1, len(raw)), max(1, len(w)), [len(x) for x in w]
    mean = sum(long) / some
    spread = math.sqrt(max(0, sum(x * x for x in long) / some - mean ** 2))
    stats = [math.log1p(size) / 10, math.log1p(len(w)) / 8, mean / 10, spread / 10, len(set(w)) / some, math.log1p(len(set(w))) / 8,
             sum(x <= 3 for x in long) / some, 1.0]
    return [math.sqrt(p / size) for p in pairs] + [min(4, s) for s in stats]


def test_features_equal_counting_by_hand():
    texts = [t or "" for _, t, *_ in lined()]
    got = quality.describe(*packed(texts))
    assert got.shape == (len(texts), quality.WIDTH)
    np.testing.assert_allclose(got, np.array([describe_by_hand(t) for t in texts]), rtol=1e-4, atol=1e-5)


def _two_clouds(rnd, n_pos, n_all, share):
    x = rnd.normal(size=(n_all, quality.WIDTH)) * .3
    good = rnd.random(n_all) < share
    x[:, 0] += np.where(good, 1, -1)
    p = rnd.normal(size=(n_pos, quality.WIDTH)) * .3
    p[:, 0] += 1
    x[:, -1] = p[:, -1] = 1
    return p, x, good


@pytest.mark.parametrize("n_pos", [60, 4000])
def test_risk_is_non_negative_and_minimal(n_pos):
    rnd = np.random.default_rng(n_pos)
    p, x, good = _two_clouds(rnd, n_pos, 400 if n_pos < 100 else 6000, .7)
    pos, every = (quality.Moments(len(m), m.sum(0), m.T @ m) for m in (p, x))
    w = quality.minimise(pos, every, .7, 1e-4)

    def risk(v):
        return .7 * pos.mean(v, 1) + max(0.0, quality.excess(v, pos, every, .7)) + 1e-4 * (v[:-1] ** 2).sum()

    assert quality.excess(w, pos, every, .7) >= -1e-9
    assert all(risk(w) <= risk(w + s * rnd.normal(size=len(w))) + 1e-9 for s in (1e-3, 1e-2, .1) for _ in range(200))
    assert abs(pos.mean(w, 1) - np.mean((1 - p @ w) ** 2) / 4) < 1e-9
    assert n_pos < 100 or np.mean((x @ w > 0) == good) > .97


def test_quality_of_awkward_rows(spark):
    rnd = random.Random(5)
    fine = ["The " + " ".join(rnd.choice(["plain", "words", "of", "prose", "stand", "here"]) for _ in range(60)) + "." for _ in range(80)]
    junk = [" | ".join(rnd.choice(["BUY", "$$$", "now!!!", "###"]) for _ in range(60)) for _ in range(40)]
    rows = X.awkward() + [(100 + i, t, "en", "a") for i, t in enumerate(fine + junk)]
    labels = ([(100 + i, 1) for i in range(50)] + [(180 + i, 0) for i in range(20)] + [(100, 0), (100, 1), (None, 1), (130, None), (999999, 1)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("x", F.lit("clash"))
    ids = lambda i: i.isNotNull()
    got = quality.quality(X.table(spark, rows), "doc_id", "text", marks, "doc_id", "quality", ids).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, *_ in rows), key=repr)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[100 + i] for i in range(80)) >= .5 > max(score[180 + i] for i in range(40))
    assert all(0 <= s <= 1 for s in score.values()) and score[5] == score[6]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(X.table(spark, X.awkward()), "doc_id", "text", none, "doc_id", "quality", lambda i: i.isNotNull()).collect()
    assert {r["score"] for r in got} == {.5}
    assert quality.quality(X.table(spark, []), "doc_id", "text", none, "doc_id", "quality", lambda i: i.isNotNull()).collect() == []


def test_prior_without_negatives():
    p, x, _ = _two_clouds(np.random.default_rng(1), 3000, 9000, .6)
    pos, every = (quality.Moments(len(m), m.sum(0), m.T @ m) for m in (p, x))
    assert abs(quality._blind_prior(pos, every, 1e-4) - .6) < .1


def test_quality_of_held_out_texts(spark):
    truth = dict(oracle.connect(FOLDER.replace("0.001", "0.01")).execute("SELECT doc_id, max(quality) FROM labels GROUP BY doc_id").fetchall())
    got = [r for r in QUERIES["op13_positive_unlabelled"][0](spark, FOLDER.replace("0.001", "0.01")).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= .9 * len(got)


def test_crc_of_words():
    texts = ["a", "Ab c" * 40, "ñ" * 100 + " x", "", "q" * 5000 + " r"]
    bucket, owner, count = resample.features(*packed(texts), 2 ** 31)
    hand = [(zlib.crc32(f.encode()) % 2 ** 31, i) for i, t in enumerate(texts) for f in words_of(t)]
    hand += [(zlib.crc32(f"{a} {b}".encode()) % 2 ** 31, i) for i, t in enumerate(texts) for a, b in zip(words_of(t), words_of(t)[1:])]
    assert sorted(zip(bucket.tolist(), owner.tolist())) == sorted(hand)
    assert count.tolist() == [len(words_of(t)) for t in texts]
    assert tx.PUNCTUATION[32]
