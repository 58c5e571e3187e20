"""Quality classifier by positive-unlabelled learning.

Trusted positives and the unlabelled corpus are all it learns from, together with an estimate of the share of positives.
With the squared loss and a linear scorer, the unbiased risk and its non-negative form depend on the data through first
and second moments only: those of all positives and of all texts, added up in one pass. The non-negative risk is then
minimised exactly on matrices of a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .langid import held_out
from ..session import cut_lineage, table

#: Classes of bytes whose neighbourhoods are counted; everything beyond ASCII is a letter.
CLASSES = [bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:",
           b"!?", b"'\"-()", b"|/\\<>=_{}[]", b"#$%&*@^~+`"]
KIND = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    KIND[np.frombuffer(_members, np.uint8)] = _k
SIDE = len(CLASSES) + 1
WIDTH = SIDE * SIDE + 8


def describe(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """texts x WIDTH features: root shares of neighbouring byte classes, length, words, their spread and variety, bias."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    kind = KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    cell = owner[1:] * (SIDE * SIDE) + kind[:-1] * SIDE + kind[1:]
    pairs = np.bincount(cell[owner[1:] == owner[:-1]], minlength=n * SIDE * SIDE).reshape(n, -1)
    low = tx.lowered(data)
    starts, ends, first = tx.words(offsets, low)
    words, long = np.diff(first), (ends - starts).astype(float)
    holder, some = np.repeat(np.arange(n), words), np.maximum(words, 1)
    # Different words of a text: hashes of (text, word), sorted once.
    named = np.sort(tx.mixed(tx.word_hashes(low, starts, ends) + tx.mixed(holder.astype(np.uint64))) >> np.uint64(20) | holder.astype(np.uint64) << np.uint64(44))
    new = np.ones(len(named), bool)
    new[1:] = named[1:] != named[:-1]
    kinds = np.bincount((named[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    mean = np.bincount(holder, long, n) / some
    spread = np.sqrt(np.maximum(np.bincount(holder, long * long, n) / some - mean ** 2, 0))
    stats = [np.log1p(size) / 10, np.log1p(words) / 8, mean / 10, spread / 10, kinds / some, np.log1p(kinds) / 8,
             np.bincount(holder[long <= 3], minlength=n) / some, np.ones(n)]
    # Very long words must not outweigh everything else.
    return np.column_stack([np.sqrt(pairs / size[:, None]), *[np.minimum(s, 4) for s in stats]]).astype(np.float32)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the features of each whole text as packed floats; null texts are empty."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([rows.column(0), tx.binary_column([x.tobytes() for x in describe(offsets, data)])], ["id", "x"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), WIDTH).astype(float)


@dataclass
class Moments:
    """Rows, sum of x and sum of x xT of a set of texts."""
    rows: float
    first: np.ndarray
    second: np.ndarray

    def mean(self, w: np.ndarray, sign: int) -> float:
        """Mean squared loss (1 - sign * wx)^2 / 4."""
        return float(1 - 2 * sign * w @ self.first / self.rows + w @ self.second @ w / self.rows) / 4


def moments(rows: DataFrame) -> tuple[Moments, Moments]:
    """Moments of the rows with y and of all rows of (x, y). Tasks add up their own; sums of a fixed number of cells meet."""
    upper = np.triu_indices(WIDTH)
    cells = 1 + WIDTH + len(upper[0])

    def run(batches):
        sums = np.zeros((2, cells))
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for k, part in enumerate((x[y], x)):
                    sums[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * cells)), pa.array(sums.ravel())], ["i", "v"])

    total = np.zeros(2 * cells)
    for i, v in rows.select("x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():  # 2 * cells rows
        total[i] = v
    out = []
    for t in total.reshape(2, -1):
        second = np.zeros((WIDTH, WIDTH))
        second[upper] = t[1 + WIDTH:]
        out.append(Moments(t[0], t[1:1 + WIDTH], second + np.triu(second, 1).T))
    return out[0], out[1]


def excess(w: np.ndarray, pos: Moments, every: Moments, prior: float) -> float:
    """Estimated risk on negatives: that of all texts as negatives less the positives' share of it. Truly never below 0."""
    return every.mean(w, -1) - prior * pos.mean(w, -1)


def minimise(pos: Moments, every: Moments, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative risk: prior * mean loss of positives + max(0, excess) + ridge.

    The unbiased risk has a closed minimum. Where it drives the excess below 0, the minimum lies on excess = 0; its
    multiplier, by which the excess counts less, is found by bisection.
    """
    pull = np.full(WIDTH, ridge)
    pull[-1] = 1e-9
    mp, mu, qp, qu = pos.first / pos.rows, every.first / every.rows, pos.second / pos.rows, every.second / every.rows

    def at(less: float) -> np.ndarray:
        q = less * prior * qp + (1 - less) * qu
        return np.linalg.solve(q / 2 + np.diag(pull), ((2 - less) * prior * mp - (1 - less) * mu) / 2)

    w = at(0.0)
    if excess(w, pos, every, prior) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(at(middle), pos, every, prior) >= 0 else (middle, high)
    return at(high)


def _blind_prior(pos: Moments, every: Moments, ridge: float) -> float:
    """Share of positives without any negative: a scorer of positive against any text, whose mean over all texts is compared
    with that over positives."""
    w = np.linalg.solve(every.second / every.rows + np.eye(WIDTH) * ridge, pos.first / pos.rows)
    return float(np.clip((w @ every.first / every.rows) / max(1e-9, w @ pos.first / pos.rows), 0.05, 0.95))


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def labelled(features: DataFrame, labels: DataFrame, label_id: str, label_col: str, usable) -> tuple[DataFrame, dict[bool, int]]:
    """features with y (trusted positive or not), and how many usable labels there are of each kind."""
    known = (labels.where(usable(F.col(label_id)) & F.col(label_col).isNotNull())
             .groupBy(F.col(label_id).alias("i")).agg((F.max(label_col) > 0).alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    good = known.where("y").select("i")
    return features.join(good, F.col("id") == F.col("i"), "left").select("id", "x", F.col("i").isNotNull().alias("y")), counts


def fit(features: DataFrame, labels: DataFrame, label_id: str, label_col: str, usable, *, ridge: float = 1e-4) -> Model:
    """features: from `described`, all texts. usable: function from the id column to the filter of ids to learn from.

    Positives are all texts with a usable positive label (several labels of an id count as their maximum, null labels are
    not used); the unlabelled side is every text, whatever its label. The prior is the smoothed share of positive ids among
    the usable labels, or, where those have no negatives, estimated from the positives and the corpus alone. No positives
    at all: a model that scores 0.5.
    """
    rows, counts = labelled(features, labels, label_id, label_col, usable)
    pos, every = moments(rows)
    if not pos.rows:
        return Model(np.zeros(WIDTH), 0.5)
    ridge += 0.25 / pos.rows
    ups, downs = counts.get(True, 0), counts.get(False, 0)
    prior = (ups + 1) / (ups + downs + 2) if downs else _blind_prior(pos, every, ridge)
    return Model(minimise(pos, every, prior, ridge), prior)


def score(features: DataFrame, model: Model, *, digits: int = 9) -> DataFrame:
    """id and score (0 to 1), half the margin plus a half, rounded so that the order in which sums met does not show."""
    kind = features.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = np.clip((_matrix(batch.column(1)) @ model.weights + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, digits))], ["id", "score"])

    return features.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def quality(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, usable, **options) -> DataFrame:
    """One row per input row: id and score. Null and empty texts share the features of an empty text; repeated rows and null
    ids are scored like others, null ids are never learned from. Empty input: no rows. Extra columns are not read.

    Texts are read once; their features (a few hundred bytes each) are written and joined with the labels, so a hot id or a
    group of copies weighs what its rows weigh and no text is shuffled.
    """
    features = cut_lineage(described(docs, id_col, text_col))
    return score(features, fit(features, labels, label_id, label_col, usable, **options)).withColumnRenamed("id", id_col)


def op13_positive_unlabelled(spark, folder: str) -> DataFrame:
    out = quality(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "labels"), "doc_id", "quality", lambda i: ~held_out(i, 5))
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
