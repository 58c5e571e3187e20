"""Fill-in-middle transformation over a piecewise-linear learned rank index.

The line boundaries of a text are a sorted list of code point offsets. Segments of a line are fitted to (rank, offset) so
that no prediction is off by more than a bound; what is left is stored as a residual per rank. A cut at a rank is then
predicted by its segment and corrected by its residual, exactly, without looking at the text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from ..session import table

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class RankIndex:
    """Segment j predicts base[j] + floor(slope[j] * (rank - first[j])) for ranks from first[j] on."""
    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        j = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[j] + np.floor(self.slope[j] * (ranks - self.first[j])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residuals[ranks]


def fit(offsets: np.ndarray, bound: int = 64) -> RankIndex:
    """Greedy segments through their first point: each is as long as some slope keeps all its points within `bound`.

    The feasible slopes of a growing segment are an interval that only shrinks; runs of ranks are tried at a time, twice
    as many after each success, so long texts take few steps.
    """
    n, at = len(offsets), 0
    first, slope = [], []
    while at < n:
        low, high, end, step = -np.inf, np.inf, at + 1, 32
        while end < n:
            dx = np.arange(end - at, min(n, end + step) - at)
            dy = offsets[end:end + step] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((dy - bound) / dx, low))
            highs = np.minimum.accumulate(np.minimum((dy + bound) / dx, high))
            empty = np.flatnonzero(lows > highs)
            good = int(empty[0]) if len(empty) else len(dx)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end += good
            if len(empty):
                break
            step *= 2
        first.append(at)
        slope.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    first = np.array(first, np.int64)
    index = RankIndex(first, offsets[first], np.array(slope), np.zeros(0, np.int32))
    index.residuals = (offsets - index.predict(np.arange(n))).astype(np.int32)
    return index


def boundaries(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Code point offsets of the line boundaries of each text, 0 and its length included; an empty text has only 0."""
    ends = np.flatnonzero(data == 10) + 1
    cuts = np.unique(np.concatenate([offsets, ends]))
    # Code points before a byte: bytes that do not continue one.
    heads = np.add.reduceat((data & 0xC0) != 0x80, cuts[:-1], dtype=np.int64) if len(cuts) > 1 else np.zeros(0, np.int64)
    points = np.concatenate([[0], np.cumsum(heads)])
    first = np.searchsorted(cuts, offsets)
    return [points[a:b + 1] - points[a] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _draws(key: Column) -> list[Column]:
    """The first four 8-digit groups of the sha256 of a key, as unsigned integers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cutter(bound: int):
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            picks, out, at = np.stack([one.to_numpy(False), two.to_numpy(False)]), np.zeros((5, len(texts)), np.int64), 0
            for part, offsets, data in tx.slices([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
                for marks in boundaries(offsets, data):
                    n = len(marks) - 1
                    index = fit(marks, bound)
                    ranks = np.sort(picks[:, at] % (n + 1))
                    a, b = index.offset(ranks)
                    out[:, at] = n, a, b, len(index.first), np.abs(index.residuals).max()
                    at += 1
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "a", "b", "segments", "worst"])

    return F.arrow_udf(cut, "n long, a long, b long, segments long, worst long")


def transform(docs: DataFrame, id_col: str, text_col: str, *, seed: str = "7", rate: int = 100, spm: int = 50, bound: int = 64) -> DataFrame:
    """One row per input row: id, n (lines), form, prefix_chars, middle_chars, output, segments, worst (largest residual).

    Two ranks drawn from the id by hash cut the text at line boundaries into prefix, middle and suffix. form: `plain` (the
    text as it is) for empty texts, texts that hold a sentinel and the share of ids outside `rate` percent; else `spm` for
    `spm` percent, `psm` for the rest. Null texts are empty; a null id draws like an empty one; rows of equal ids draw
    alike. prefix_chars and middle_chars are null for plain texts. Empty input: no rows. Extra columns are not read.

    A row depends on itself alone: no shuffle, and one text at a time in memory beyond the batch.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _draws(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    got = (docs.select(F.col(id_col).alias("id"), text.alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
           .withColumn("x", _cutter(bound)("t", "h1", "h2")))
    held = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = (F.when((F.col("t") == "") | held | (F.col("h3") % 100 >= rate), "plain")
            .when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    a, b = F.col("x.a").cast("int"), F.col("x.b").cast("int")
    head, body, tail = F.substring("t", F.lit(1), a), F.substring("t", a + 1, b - a), F.substring("t", b + 1, F.lit(2 ** 31 - 1))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = (F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", F.concat(p, head, s, tail, m, body))
              .otherwise(F.concat(s, tail, p, head, m, body)))
    cut = F.col("form") != "plain"
    return (got.withColumn("form", form)
            .select(F.col("id").alias(id_col), F.col("x.n").alias("n"), "form", F.when(cut, F.col("x.a")).alias("prefix_chars"),
                    F.when(cut, F.col("x.b") - F.col("x.a")).alias("middle_chars"), output.alias("output"),
                    F.col("x.segments").alias("segments"), F.col("x.worst").alias("worst")))


def restore(output: Column, form: Column) -> Column:
    """The text of an output. Cut texts hold no sentinel, so the first one of a kind is the one that was set."""
    end = F.lit(2 ** 31 - 1)
    s, p, m = F.instr(output, SUFFIX), F.instr(output, PREFIX), F.instr(output, MIDDLE)
    body = F.substring(output, m + len(MIDDLE), end)
    skip = len(PREFIX)
    psm = F.concat(F.substring(output, F.lit(1 + skip), s - 1 - skip), body, F.substring(output, s + skip, m - s - skip))
    spm = F.concat(F.substring(output, p + skip, m - p - skip), body, F.substring(output, F.lit(1 + skip), p - 1 - skip))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_rank_index_middle(spark, folder: str) -> DataFrame:
    out = transform(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM l),
c AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
