"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are read in windows of `core` bytes with `margin` bytes of context on both sides, so that a text of any length is
many rows of one matrix. Every core position gets a probability per language; a document pools them by their mean.
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

PAD = 256


@dataclass
class Net:
    languages: list[str]
    weights: dict[str, np.ndarray]
    core: int = 48
    margin: int = 8


def _start(hidden: int, classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, PAD + 1)).astype(np.float32)
        w[f"u{d}"] = rng.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(np.float32)
        w[f"o{d}"] = rng.normal(0, 0.3, (classes, hidden)).astype(np.float32)
    w["c"] = np.zeros((classes, 1), np.float32)
    return w


def _run(w: dict, d: str, codes: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(position, state) along one direction; codes: positions x windows. keep collects what training needs."""
    hidden = w[f"u{d}"].shape[1]
    h = np.zeros((hidden, codes.shape[1]), np.float32)
    for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
        x = np.take(w[f"x{d}"], codes[t], axis=1)
        a = w[f"u{d}"] @ h
        gates = x[:2 * hidden]
        gates += a[:2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:hidden], gates[hidden:]
        n = np.tanh(x[2 * hidden:] + r * a[2 * hidden:])
        if keep is not None:
            keep.append((t, h, z, r, n, a[2 * hidden:]))
        h = n + z * (h - n)
        yield t, h


def probabilities(net: Net, codes: np.ndarray) -> np.ndarray:
    """positions x languages x windows."""
    w = net.weights
    out = np.empty((len(codes), len(net.languages), codes.shape[1]), np.float32)
    for t, h in _run(w, "f", codes):
        out[t] = w["of"] @ h + w["c"]
    for t, h in _run(w, "b", codes):
        out[t] += w["ob"] @ h
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def _gradients(net: Net, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    w, hidden = net.weights, net.weights["uf"].shape[1]
    kept = {"f": [], "b": []}
    states = {d: dict(_run(w, d, codes, kept[d])) for d in "fb"}
    g = {k: np.zeros_like(v) for k, v in w.items()}
    delta = {}
    for t in range(len(codes)):
        s = w["of"] @ states["f"][t] + w["ob"] @ states["b"][t] + w["c"]
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        s[labels, np.arange(len(labels))] -= 1
        s *= (codes[t] != PAD) / np.float32(codes.size)
        delta[t] = s
        g["c"] += s.sum(axis=1, keepdims=True)
        for d in "fb":
            g[f"o{d}"] += s @ states[d][t].T
    for d in "fb":
        back = np.zeros((hidden, codes.shape[1]), np.float32)
        for t, h, z, r, n, a in reversed(kept[d]):
            back = back + w[f"o{d}"].T @ delta[t]
            dn = back * (1 - z) * (1 - n * n)
            dz = back * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            dx = np.concatenate([dz, dr, dn])
            da = np.concatenate([dz, dr, dn * r])
            g[f"u{d}"] += da @ h.T
            for row in range(3 * hidden):
                g[f"x{d}"][row] += np.bincount(codes[t], dx[row], PAD + 1)
            back = back * z + w[f"u{d}"].T @ da
    return g


def train(languages: list[str], codes: np.ndarray, labels: np.ndarray, *, hidden: int = 8, steps: int = 160, batch: int = 192,
          rate: float = 0.02, seed: int = 7, core: int = 48, margin: int = 8) -> Net:
    """Adam on windows (positions x windows, PAD beyond a text) with one label per window, drawn evenly per language."""
    rng = np.random.default_rng(seed)
    net = Net(languages, _start(hidden, len(languages), rng), core, margin)
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
        g = _gradients(net, codes[:, pick], labels[pick])
        now = rate * min(1.0, 1.5 * (1 - (step - 1) / steps))
        for k in g:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.weights[k] = (net.weights[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def windows(offsets: np.ndarray, data: np.ndarray, core: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window's core and the text it belongs to."""
    count = -(-np.diff(offsets) // core)
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[owner] + nth * core, owner


def codes_of(offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, owner: np.ndarray, core: int, margin: int) -> np.ndarray:
    at = starts[None, :] + np.arange(-margin, core + margin)[:, None]
    inside = (at >= offsets[owner]) & (at < offsets[owner + 1])
    return np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))], PAD).astype(np.int16)


def held_out(ident: Column, parts: int) -> Column:
    """crc32 of the id as text falls on 0; a null id is never learned from."""
    return F.coalesce(F.crc32(ident.cast("string")) % parts == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, *, texts_per_label: int = 240,
        windows_per_text: int = 12, **options) -> Net:
    """Train on a bounded sample: about `texts_per_label` usable texts per label, chosen by a hash of the text,
    `windows_per_text` windows spread over each whole text. Null labels and texts without letters are not used.
    """
    net = Net([], {})
    core, margin = net.core, net.margin
    known = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label_col).cast("string")).count().collect()}
    names = sorted(counts)
    if not names:
        return net
    place = F.col("h") / F.lit(float(2 ** 63))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, texts_per_label / counts[k])))])
    chosen = (known.select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("t"),
                           F.abs(F.xxhash64(F.col(text_col), F.col(id_col).cast("string"))).alias("h"))
              .where(place < share[F.col("y")]))

    def cut(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            starts, owner = windows(offsets, data, core, margin)
            n = np.bincount(owner, minlength=rows.num_rows)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            # Evenly spread: the window on which the next multiple of 1 / windows_per_text falls.
            pick = np.flatnonzero((nth * windows_per_text // np.maximum(n[owner], 1))
                                  != ((nth + 1) * windows_per_text // np.maximum(n[owner], 1)))
            codes = codes_of(offsets, data, starts[pick], owner[pick], core, margin)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner[pick])), rows.column(2).take(pa.array(owner[pick])),
                                              pa.array(nth[pick]), tx.binary_column([c.tobytes() for c in codes.T])],
                                             ["y", "h", "nth", "codes"])

    got = chosen.mapInArrow(cut, "y string, h long, nth long, codes binary").orderBy("h", "nth", "y", "codes").toPandas()
    codes = np.stack([np.frombuffer(c, np.int16) for c in got["codes"]], axis=1)
    return train(names, codes, np.array([names.index(y) for y in got["y"]]), core=core, margin=margin, **options)


def label(docs: DataFrame, text_col: str, net: Net, *, lang: str = "lang_pred", score: str = "score",
          at_once: int = 4096) -> DataFrame:
    """All rows and columns of docs plus the language and its pooled probability (columns of the same names are
    replaced). `und` and 0.0: null, empty or letterless texts, or a net without languages."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    mark, = tx.fresh(docs.columns, "_letters")
    carried = docs.drop(lang, score).withColumn(mark, letters)
    schema = carried.drop(mark).schema.add(lang, "string").add(score, "double")
    names, core, margin = net.languages, net.core, net.margin

    def run(batches):
        for rows, offsets, data in tx.slices(batches, text_col):
            some = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False)
            sums = np.zeros((len(names), rows.num_rows))
            if names:
                starts, owner = windows(offsets, data, core, margin)
                keep = some[owner]
                starts, owner = starts[keep], owner[keep]
                for a in range(0, len(starts), at_once):
                    codes = codes_of(offsets, data, starts[a:a + at_once], owner[a:a + at_once], core, margin)
                    p = probabilities(net, codes)[margin:margin + core]
                    p *= (codes[margin:margin + core] != PAD)[:, None, :]
                    for k, each in enumerate(p.sum(axis=0)):
                        sums[k] += np.bincount(owner[a:a + at_once], each, rows.num_rows)
            best = sums.argmax(axis=0) if names else np.zeros(rows.num_rows, int)
            top = sums.max(axis=0) / np.maximum(np.diff(offsets), 1) if names else np.zeros(rows.num_rows)
            some = some & bool(names)
            tags = pa.array([names[b] if s else "und" for b, s in zip(best, some)], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], tags, pa.array(np.where(some, np.clip(top, 0, 1), 0.0))], names=schema.names)

    return carried.mapInArrow(run, schema)


def op1_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    net = fit(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id"), 5))
    bare = docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    return label(bare, "text", net).drop("text")
