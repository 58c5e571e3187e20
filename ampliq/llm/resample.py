"""Target-distribution importance resampling with a distributed quickselect.

Hashed one- and two-word features are counted over the whole corpus and the whole target; their log ratios are an array of
fixed size that scores every document. A Gumbel draw per id turns weights into keys, of which the k best are drawn: random
pivot keys and exact three-way counts narrow the interval of the k-th key; only the winners are then sorted and ranked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from ..session import cut_lineage, table

#: Bytes of a word that are hashed side by side with all other words; longer words are finished one by one.
WIDE = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & 255] ^ (state >> 8)


def _run(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 registers after feeding data[start:end] to each state."""
    order = np.argsort(starts - ends, kind="stable")
    at, size, s = starts[order], (ends - starts)[order], state[order]
    for j in range(min(WIDE, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -j, side="left"))
        s[:m] = _step(s[:m], data[at[:m] + j])
    for i in range(int(np.searchsorted(-size, -WIDE, side="left"))):
        s[i] = zlib.crc32(data[at[i] + WIDE:at[i] + size[i]], int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(offsets: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature (all words, then all pairs of neighbours), and the words of each text."""
    data = tx.lowered(data)
    starts, ends, first = tx.words(offsets, data, tx.PUNCTUATION)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    one = _run(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    two = _run(_step(one[pairs], np.uint32(32)), data, starts[pairs + 1], ends[pairs + 1])
    crc = np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([owner, owner[pairs]]), count


def tally(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs over all texts. Every task adds up its own counts first."""
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for _, offsets, data in tx.slices(batches, "t"):
            sums += np.bincount(features(offsets, data, buckets)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["b", "n"])

    found = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for b, n in found.collect():  # at most `buckets`
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratios of the smoothed shares of each bucket."""
    size = len(source)
    up = (target + 1.0) * float(source.sum() + size)
    down = (source + 1.0) * float(target.sum() + size)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def kth_key(rows: DataFrame, key: Column, k: int, *, pivots: int = 16):
    """The k-th smallest key (k from 1 to the number of rows) by quickselect.

    Each round draws at most `pivots` keys of the open interval by a hash of key and round, counts the rows before, on and
    between them exactly, and keeps the part that holds the k-th. Keys may repeat. Nothing but pivots and their counts
    reaches the driver; an interval of fewer keys than pivots ends the search. rows should be materialised.
    """
    keys = rows.select(key.alias("key"))
    low = high = None
    turn = 0
    while True:
        turn += 1
        part = keys
        part = part.where(F.col("key") > low) if low is not None else part
        part = part.where(F.col("key") < high) if high is not None else part
        drawn = part.orderBy(F.xxhash64("key", F.lit(turn)), "key").limit(pivots).distinct().orderBy("key").collect()
        marks = [_literal(r["key"], keys.schema["key"].dataType) for r in drawn]
        place = sum((F.when(F.col("key") > m, 2).when(F.col("key") == m, 1).otherwise(0) for m in marks), F.lit(0))
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for at in range(2 * len(marks) + 1):
            if k <= counts.get(at, 0):
                break
            k -= counts.get(at, 0)
        if at % 2:
            return marks[at // 2]
        low = marks[at // 2 - 1] if at else low
        high = marks[at // 2] if at < 2 * len(marks) else high


def _literal(value, kind) -> Column:
    return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with rank 1, 2, 3... in that order: range partitions sorted on their own, shifted by the rows before them."""
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one per range partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    shift = F.create_map(*[F.lit(x) for pair in before for x in pair])[part] if before else F.lit(0)
    return placed.withColumn("rank", within + shift + 1).drop("at")


def resample(docs: DataFrame, id_col: str, text_col: str, target: DataFrame, target_text: str, *, buckets: int = 10000,
             least_words: int = 20, percent: int = 25, seed: str = "7") -> DataFrame:
    """One row per input row: id, n_features, n_words, weight, score, rank (1 is best; null where not drawn), all long.

    weight: floored mean of the gains of the text's features (none: 0). score: weight plus a floored thousandfold Gumbel
    draw from the id. Of the N rows with `least_words` or more, floor(percent * N / 100) of the highest scores are drawn;
    ties go to the smaller id, null last, then to fewer features and the smaller weight; rows equal in all of these are
    interchangeable. Null texts have no features; null ids draw like an empty one. An empty target has no counts. Empty
    input: no rows. Extra columns are not read.

    Shuffles: `buckets` counts per task, and the narrow rows of the winners once. The drawn share may be any part of the
    corpus: no task, and never the driver, holds more than a range partition of it.
    """
    gain = gains(tally(docs, text_col, buckets), tally(target, target_text, buckets))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def weigh(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            bucket, owner, count = features(offsets, data, buckets)
            sums = np.bincount(owner, gain[bucket], rows.num_rows).astype(np.int64)
            n = count + np.maximum(count - 1, 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(count), pa.array(sums // np.maximum(n, 1))],
                                             ["id", "n_features", "n_words", "weight"])

    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
            .cast("double") + 0.5) / 4294967296.0
    rows = cut_lineage(source.mapInArrow(weigh, f"id {kind}, n_features long, n_words long, weight long")
                       .withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(unit)))))
    able = F.col("n_words") >= least_words
    n = rows.where(able).count() * percent // 100
    key = F.struct((-F.col("score")).alias("far"), F.col("id").isNull().alias("no_id"), "id", "n_features", "weight")
    none = F.lit(None).cast("long")
    if n == 0:
        return rows.select(F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", none.alias("rank"))
    drawn = able & (key <= kth_key(rows.where(able), key, n))
    winners = ranked(rows.where(drawn), F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight")
    # Rows equal to the last winner may stand behind it.
    return (winners.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).unionByName(rows.where(~drawn).withColumn("rank", none))
            .select(F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", "rank"))


def op12_target_resampling(spark, folder: str) -> DataFrame:
    out = resample(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "text")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (SELECT x, x, 0 FROM range(256) r(x) UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
w AS (SELECT src, doc_id, row_number() OVER () AS rid, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM (SELECT 0 AS src, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark) z),
f AS (SELECT src, rid, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w),
n AS (SELECT src, rid, f, count(*) AS n FROM f GROUP BY src, rid, f),
h AS (SELECT f, xor(4294967295, list_reduce([4294967295] || [('0x' || hex(f)[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, strlen(f) + 1)],
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 10000 AS b FROM (SELECT DISTINCT f FROM n) z, crc),
e AS (SELECT b, coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE AS t FROM n JOIN h USING (f) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM e),
g AS (SELECT b, floor(1000 * ln(((e.t + 1) * (a.s + 10000)) / ((e.s + 1) * (a.t + 10000)))) AS g FROM e, a),
d AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM n JOIN h USING (f) JOIN g USING (b) WHERE src = 0 GROUP BY rid),
s AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (rid) WHERE src = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id, n_features, weight) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= (25 * n) // 100 THEN r END AS rank FROM r
"""
