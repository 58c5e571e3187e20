"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reporting verb), sentence ends become boundaries. Three
transducers - negation, reported speech, target - are composed into one machine that rewrites the symbols of a sentence
and scores what it accepts: an insult at a target weighs differently from one that is denied or only quoted. The insult
lexicon and the weights of the accepted patterns are learned from labels.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .langid import held_out
from ..session import cut_lineage, table

#: Word lists of the grammar, by symbol.
INSULT = ["idiot", "idiots", "stupid", "moron", "dumb", "loser", "imbecile", "trottel", "dummkopf", "crétin", "imbécil"]
THREAT = ["kill", "hurt", "destroy", "shoot", "stab", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"]
TARGET = ["you", "your", "youre", "they", "them", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "tú", "usted", "ustedes"]
NEGATION = ["not", "never", "isn", "aren", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás"]
REPORT = ["said", "says", "wrote", "called", "claimed", "sagte", "schrieb", "disait", "écrit", "dijo", "escribió"]
ENDS = b".!?;\n"
PREFIXES = (4, 5, 6)


@dataclass
class Transducer:
    """arcs[state][symbol] = (next state, output symbol or ''); state 0 starts. Symbols without an arc pass unchanged."""
    arcs: list[dict[str, tuple[int, str]]] = field(default_factory=lambda: [{}])

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs[state].get(symbol, (state, symbol))


def compose(machines: list[Transducer], symbols: Iterable[str]) -> Transducer:
    """One machine that feeds each symbol through all of them in turn; its states are tuples of theirs."""
    states = {(0,) * len(machines): 0}
    out, todo = Transducer([{}]), [(0,) * len(machines)]
    while todo:
        state = todo.pop()
        for symbol in symbols:
            now, passing = list(state), symbol
            for i, machine in enumerate(machines):
                if passing:
                    now[i], passing = machine.step(now[i], passing)
            key = tuple(now)
            if key not in states:
                states[key] = len(out.arcs)
                out.arcs.append({})
                todo.append(key)
            out.arcs[states[state]][symbol] = (states[key], passing)
    return out


def grammar() -> Transducer:
    """Outputs: I or H (insult, threat), then - if negated, \" if reported, > if a target stands before it; < is a
    target that follows."""
    hits = ["I", "H"]
    negation = Transducer([{"N": (1, "")}, {"B": (0, "B"), "N": (0, "")} | {x: (0, x + "-") for x in hits}])
    seen = hits + [x + "-" for x in hits]
    reported = Transducer([{"R": (1, "")}, {"B": (0, "B"), "R": (1, "")} | {x: (1, x + '"') for x in seen}])
    seen = seen + [x + '"' for x in seen]
    target = Transducer([{"T": (1, ""), "B": (0, "")} | {x: (2, x) for x in seen},
                         {"T": (1, ""), "B": (0, "")} | {x: (1, x + ">") for x in seen},
                         {"T": (1, "<"), "B": (0, "")} | {x: (2, x) for x in seen}])
    return compose([negation, reported, target], ["I", "H", "T", "N", "R", "B"])


KINDS = [h + n + r + t for h in "IH" for n in ("", "-") for r in ("", '"') for t in ("", ">")] + ["<"]


@dataclass
class Grammar:
    """lexicon: word or stem with '*' -> strength. weights: by accepted pattern; bias."""
    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float = -4.0


def untrained() -> Grammar:
    weights = np.array([0.0 if "-" in k or '"' in k else 3.0 for k in KINDS[:-1]] + [0.5])
    return Grammar({w: 2.0 for w in INSULT}, weights)


def _hash(word: bytes, salt: int = 0) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(tx.word_hashes(data, np.array([0]), np.array([len(data)]))[0]) ^ salt


class Matcher:
    """Symbols of all words of a slice of texts."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.machine = grammar()
        self.exact: dict[int, tuple[str, float]] = {}
        for symbol, listed in (("H", THREAT), ("T", TARGET), ("N", NEGATION), ("R", REPORT)):
            self.exact |= {_hash(w.encode()): (symbol, 1.0) for w in listed}
        self.exact |= {_hash(w.encode()): ("I", s) for w, s in lexicon.items() if not w.endswith("*")}
        self.stems: dict[int, dict[int, float]] = {}
        for w, s in lexicon.items():
            if w.endswith("*"):
                stem = w[:-1].encode()
                self.stems.setdefault(len(stem), {})[_hash(stem)] = s
        self.fast = {n: self._bits(d) for n, d in [(0, self.exact), *self.stems.items()]}

    @staticmethod
    def _bits(keys) -> np.ndarray:
        bits = np.zeros(1 << 16, bool)
        bits[[k & 0xFFFF for k in keys]] = True
        return bits

    def features(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """texts x kinds: summed strength of the accepted patterns of each text."""
        data = tx.lowered(data)
        starts, ends, first = tx.words(offsets, data, tx.PUNCTUATION)
        out = np.zeros((len(offsets) - 1, len(KINDS)))
        if not len(starts):
            return out
        sums, down = tx.prefix_hashes(data), tx.powers(len(data) + 1, down=True)
        symbols: dict[int, tuple[str, float]] = {}
        for n, bits in self.fast.items():
            at = np.arange(len(starts)) if n == 0 else np.flatnonzero(ends - starts >= n)
            stop = ends[at] if n == 0 else starts[at] + n
            h = tx.mixed((sums[stop] - sums[starts[at]]) * down[starts[at]] + (stop - starts[at]).astype(np.uint64))
            near = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
            for i, key in zip(at[near].tolist(), h[near].tolist()):
                hit = self.exact.get(key) if n == 0 else (("I", self.stems[n][key]) if key in self.stems[n] else None)
                if hit and (i not in symbols or hit[1] > symbols[i][1]):
                    symbols[i] = hit
        if not symbols:
            return out
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(np.isin(data, np.frombuffer(ENDS, np.uint8)), out=stops[1:])
        index = sorted(symbols)
        clause = stops[starts[index]].tolist()
        owner = (np.searchsorted(first, index, side="right") - 1).tolist()
        live = {(o, c) for i, o, c in zip(index, owner, clause) if symbols[i][0] in "IH"}
        state, before, strength = 0, None, 1.0
        column = {k: j for j, k in enumerate(KINDS)}
        for i, o, c in zip(index, owner, clause):
            if (o, c) not in live:
                continue
            if (o, c) != before:
                state, _ = self.machine.arcs[state]["B"]
                before = (o, c)
            symbol, s = symbols[i]
            state, got = self.machine.arcs[state][symbol]
            strength = s if symbol in "IH" else strength
            if got in column:
                out[o, column[got]] += strength
        return out


def _squash(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps towards `start` as the prior mean; the last column is the bias."""
    w = start.copy()
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, usable, *,
        positives: int = 3000, negatives: int = 12000, features: int = 5000, contexts: int = 8, margin: float = 2.5) -> Grammar:
    """Learn lexicon and weights from a bounded sample of labelled rows: about `positives` and `negatives` ids by hash.

    A word or stem joins the lexicon if it stands after at least `contexts` different words in positive texts (copies
    of one text count once) and its log odds reach `margin`. usable: function from id column to the filter of ids
    that may be learned from. Null labels are not used; several labels of an id count as their maximum. Without labels of
    both kinds the built-in lexicon and weights stay.
    """
    base = untrained()
    ids = (labels.where(usable(F.col(label_id)) & F.col(label_col).isNotNull())
           .groupBy(F.col(label_id).alias("i")).agg((F.max(label_col) > 0).alias("y")))
    counts = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    if len(counts) < 2:
        return base
    share = F.when(F.col("y"), F.lit(min(1.0, positives / counts[True]))).otherwise(F.lit(min(1.0, negatives / counts[False])))
    # At most about positives + negatives ids: bounded by the parameters.
    chosen = F.broadcast(ids.where(F.abs(F.xxhash64("i")) / F.lit(float(2 ** 63)) < share))
    sample = cut_lineage(docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(chosen, "i").select("y", "t"))

    def candidates(word: bytes) -> list[str]:
        w = word.decode("utf-8", "ignore")
        return [w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)]

    def spell(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            data = tx.lowered(data)
            starts, ends, first = tx.words(offsets, data, tx.PUNCTUATION)
            raw, h = data.tobytes(), tx.word_hashes(data, starts, ends).view(np.int64)
            seen = set()
            for a, b in zip(first[:-1], first[1:]):
                before = 0
                for i in range(a, b):
                    seen.add((raw[starts[i]:ends[i]], before))
                    before = int(h[i])
            pairs = {(c, p) for w, p in seen for c in candidates(w)}
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.int64())], ["f", "p"])

    wide = (sample.where("y").select("t").mapInArrow(spell, "f string, p long").distinct().groupBy("f").agg(F.count("*").alias("n"))
            .where(F.col("n") >= contexts).orderBy(F.desc("n"), "f").limit(features))
    names = sorted(r["f"] for r in wide.collect())  # at most `features`
    if not names:
        return base
    number = {n: i for i, n in enumerate(names)}

    def presence(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            data = tx.lowered(data)
            starts, ends, first = tx.words(offsets, data, tx.PUNCTUATION)
            raw, y = data.tobytes(), rows.column(0).to_pylist()
            tally = np.zeros((2, len(names)), np.int64)
            for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
                own = {raw[starts[i]:ends[i]] for i in range(a, b)}
                tally[int(y[d]), list({number[c] for w in own for c in candidates(w) if c in number})] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(tally[1]), pa.array(tally[0])], ["f", "pos", "neg"])

    tally = sample.mapInArrow(presence, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos"), F.sum("neg")).collect()
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return base
    lexicon = {}
    for f, pos, neg in tally:
        odds = np.log((pos + 0.5) / (sizes[True] + 1)) - np.log((neg + 0.5) / (sizes[False] + 1))
        if odds >= margin:
            lexicon[names[f]] = float(odds)
    if not lexicon:
        return base
    matcher = Matcher(lexicon)

    def accepted(batches):
        for rows, offsets, data in tx.slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([rows.column(0), tx.binary_column([f.tobytes() for f in matcher.features(offsets, data)])], ["y", "x"])

    got = sample.mapInArrow(accepted, "y boolean, x binary").toPandas().sort_values(["y", "x"])
    x = _squash(np.stack([np.frombuffer(b) for b in got["x"]]))
    scale = np.append(base.weights / np.log(3), base.bias)
    w = logistic(np.column_stack([x, np.ones(len(x))]), got["y"].to_numpy(float), scale)
    return Grammar(lexicon, w[:-1], float(w[-1]))


def score(docs: DataFrame, text_col: str, model: Grammar, *, name: str = "score") -> DataFrame:
    """All rows and columns plus the probability that the text is toxic (a column of that name is replaced).

    Null and empty texts match no pattern and get the score of a text without matches.
    """
    carried = docs.drop(name)
    schema = T.StructType([*carried.schema.fields, T.StructField(name, T.DoubleType())])
    matcher = Matcher(model.lexicon)

    def run(batches):
        for rows, offsets, data in tx.slices(batches, text_col):
            z = _squash(matcher.features(offsets, data)) @ model.weights + model.bias
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    return carried.mapInArrow(run, schema)


def op2_toxicity_grammar(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, "doc_id", "text", table(spark, folder, "labels"), "doc_id", "toxic", lambda i: ~held_out(i, 5))
    out = score(docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text"), "text", model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
