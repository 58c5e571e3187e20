"""Best ungapped placement of oligos on sequences, conservation and discrimination.

Every (oligo, sequence) pair has a best placement, so this operator is a block product by
definition. Sequences and oligo blocks meet in slices that Spark partitions and sorts: a task
reads the oligos of a block, then streams the sequences of its slice past them, one matrix product
a sequence and strand. Rows that leave a task are in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S

#: Oligos that a task holds at a time.
BLOCK = 1024
#: Letters of a sequence that is placed as a whole; longer ones are cut into pieces.
WHOLE = 1 << 14
#: Window positions scored at a time.
STEP = 1 << 11
#: Rows of a batch that leaves a task.
FLUSH = 1 << 15
#: Oligos of one length from which on they are scored apart from others of similar length.
OWN = 64
_LETTERS = np.zeros((256, 4), dtype=np.float32)
for _code, _bases in S.IUPAC_SETS.items():
    for _b in _bases:
        _LETTERS[ord(_code), "ACGT".index(_b)] = 1.0
_BASES = np.zeros((256, 4), dtype=np.float32)
for _b in "ACGT":
    _BASES[ord(_b), "ACGT".index(_b)] = 1.0
_BASES[ord("N")] = 1.0
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _code, _other in zip(S.IUPAC_LETTERS, S.IUPAC_COMPLEMENT):
    _COMPLEMENT[ord(_code)] = ord(_other)


class Panel:
    """Oligos of similar length, padded to the longest, and their best windows on one sequence."""

    def __init__(self, oligos: list[str]) -> None:
        self.sizes = np.array([len(o) for o in oligos])
        self.n, self.width = len(oligos), int(self.sizes.max())
        letters = np.frombuffer("".join(o.ljust(self.width, "\0") for o in oligos).encode("ascii", "replace"), np.uint8).reshape(self.n, -1)
        self.sets = _LETTERS[letters]
        self.plain = bool((self.sets.sum(axis=2) <= 1).all())
        self.weights = np.ascontiguousarray(self.sets.reshape(self.n, -1))
        self.rows, self.spots = np.arange(self.n), np.arange(self.width)
        self.room: np.ndarray | None = None

    def scores(self, hot: np.ndarray, exact: bool) -> np.ndarray:
        """(oligo, start) matches; with ambiguity on both sides a position counts once however many bases intersect."""
        m = len(hot) - self.width + 1
        if not exact:
            view = np.lib.stride_tricks.as_strided(hot, (m, 4 * self.width), (16, 4))
            # One buffer for all: fresh pages for every product cost more than the product.
            if self.room is None or len(self.room) < self.n * m:
                self.room = np.empty(self.n * max(m, STEP), np.float32)
            return np.matmul(self.weights, np.ascontiguousarray(view).T, out=self.room[:self.n * m].reshape(self.n, m))
        total = np.zeros((self.n, m), np.float32)
        for k in range(self.width):
            total += np.minimum(self.weights[:, 4 * k:4 * k + 4] @ hot[k:k + m].T, 1.0)
        return total

    def best(self, raw: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches (-1: no room), strand (minus: True) and start in strand coordinates of the best window of every oligo.

        Ties go to the plus strand, then to the lowest start.
        """
        n = len(raw)
        top, minus, at = np.full(self.n, -1.0, np.float32), np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        starts = n - int(self.sizes.min()) + 1
        exact = not self.plain and bool((raw == ord("N")).any())
        for turned in (False, True):
            hot = np.zeros((n + self.width, 4), np.float32)
            hot[:n] = _BASES[raw][::-1, ::-1] if turned else _BASES[raw]
            for a in range(0, starts, step):
                m = min(step, starts - a)
                got = self.scores(hot[a:a + m + self.width - 1], exact)
                room = n - self.sizes - a
                tail = max(0, int(room.min()) + 1)
                if tail < m:
                    got[:, tail:][np.arange(tail, m) > room[:, None]] = -1.0
                spot = got.argmax(axis=1)
                found = got[self.rows, spot]
                better = found > top
                top[better], minus[better], at[better] = found[better], turned, spot[better] + a
        return top, minus, at

    def windows(self, letters: np.ndarray, turned: np.ndarray, minus: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Letters under every oligo, from the sequence and its reverse complement; what lies beyond the end is its last letter."""
        spots = np.minimum(at[:, None] + self.spots, len(letters) - 1)
        return np.where(minus[:, None], turned[spots], letters[spots])


def panels(oligos: list[str]) -> list[np.ndarray]:
    """Numbers of the oligos that share a panel: one length if many have it, else lengths up to the next multiple of 16."""
    sizes = np.array([len(o) for o in oligos])
    kinds, counts = np.unique(sizes, return_counts=True)
    many = set(kinds[counts >= OWN].tolist())
    tier = np.array([n if n in many else -(-n // 16) * 16 + (1 << 30) for n in sizes.tolist()])
    return [np.flatnonzero(tier == t) for t in np.unique(tier)]


def meet(oligos: DataFrame, rows: DataFrame, spread_by: str, n_blocks: int) -> DataFrame:
    """Oligos (id, text) and sequence rows, dealt into slices: in a partition the oligos of a block (kind 0) come before the
    sequence rows (kind 1) that they meet, slice by slice.

    ``rows`` have a column ``text``; every row meets every block once. Nothing is gathered: an oligo travels once a slice, a
    sequence once a block.
    """
    parts = int(oligos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several slices a task even out their sizes.
    slices = max(1, -(-8 * parts // n_blocks))
    rest = [(c, t) for c, t in rows.dtypes if c not in ("id", "text")]
    left = oligos.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"),
                         F.lit(0).alias("kind"), "id", "text", *[F.lit(None).cast(t).alias(c) for c, t in rest])
    right = rows.select(F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                        F.lit(1).alias("kind"), "id", "text", *[c for c, _ in rest])
    # Much arithmetic in few bytes: an explicit number of partitions keeps AQE from merging the tasks by size.
    return left.unionByName(right).repartition(parts, "slice", "block").sortWithinPartitions("slice", "block", "kind")


def stream(batches: Iterator[pa.RecordBatch], start: Callable, *columns: str) -> Iterator:
    """Walk rows of ``meet``: ``start(ids, oligos)`` makes the state of a slice's block, ``state.add(id, text, *columns)`` takes
    each sequence row. Yields what ``state.ready()`` and at last ``state.done()`` give."""
    state, key, ids, oligos = None, None, [], []
    for batch in batches:
        places = list(zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist()))
        kinds = batch.column("kind").to_pylist()
        cells = [batch.column(c) for c in ("id", "text", *columns)]
        for i, (place, kind) in enumerate(zip(places, kinds)):
            if place != key:
                if state is not None:
                    yield from state.done()
                state, key, ids, oligos = None, place, [], []
            if kind == 0:
                ids.append(cells[0][i].as_py())
                oligos.append(cells[1][i].as_py())
            elif ids:
                if state is None:
                    state = start(ids, oligos)
                state.add(*[c[i].as_py() for c in cells])
                yield from state.ready()
    if state is not None:
        yield from state.done()


class _Placed:
    """Collects placement rows of a block."""

    def __init__(self, ids: list[str], oligos: list[str], least: float) -> None:
        self.ids, self.oligos = pa.array(ids), pa.array(oligos)
        self.groups = [(g, Panel([oligos[i] for i in g])) for g in panels(oligos)]
        self.need = [np.maximum(np.ceil(least * p.sizes - 1e-9), 0) for _, p in self.groups]
        self.clear()

    def clear(self) -> None:
        self.held, self.subjects, self.parts = 0, [], []

    def add(self, subject: str, text: str, start: int, slen: int) -> None:
        letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        turned = _COMPLEMENT[letters][::-1]
        for (numbers, panel), need in zip(self.groups, self.need):
            if len(letters) < panel.sizes.min():
                continue
            top, minus, at = panel.best(letters)
            keep = np.flatnonzero(top >= need)
            if not len(keep):
                continue
            seen = panel.windows(letters, turned, minus, at)[keep]
            sizes = panel.sizes[keep]
            ahead = np.where(minus[keep], slen - start - len(letters), start)
            self.parts.append((np.full(len(keep), len(self.subjects)), numbers[keep], minus[keep], top[keep].astype(np.int64), at[keep] + ahead,
                               seen[panel.spots < sizes[:, None]], sizes))
            self.held += len(keep)
        self.subjects.append(subject)

    def ready(self) -> Iterator[pa.RecordBatch]:
        return self.done() if self.held >= FLUSH else iter(())

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            subject, number, minus, score, at, letters, sizes = (np.concatenate(x) for x in zip(*self.parts))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            window = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))
            number = pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.subjects, pa.string()).take(pa.array(subject)), pa.array(["+", "-"]).take(pa.array(minus.astype(np.int8))),
                 self.ids.take(number), self.oligos.take(number), pa.array(score), pa.array(at), window],
                ["subject", "strand", "oligo_id", "oligo", "score", "offset", "window"])
        self.clear()


class _Nearest:
    """Keeps the sequences that come nearer to an oligo than any before them in the slice, and those it fits on as a whole."""

    def __init__(self, ids: list[str], oligos: list[str]) -> None:
        self.ids, self.oligos = ids, oligos
        self.groups = [(g, Panel([oligos[i] for i in g])) for g in panels(oligos)]
        self.top = [np.full(p.n, -1.0, np.float32) for _, p in self.groups]
        self.rows: list[tuple] = []

    def add(self, subject: str, text: str, start: int, slen: int) -> None:
        letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        for (numbers, panel), known in zip(self.groups, self.top):
            if len(letters) < panel.sizes.min():
                continue
            top, _, _ = panel.best(letters)
            for o in np.flatnonzero((top > known) | (top == panel.sizes)).tolist():
                self.rows.append((self.ids[numbers[o]], self.oligos[numbers[o]], subject, int(top[o])))
            np.maximum(known, top, out=known)

    def ready(self) -> Iterator[pa.RecordBatch]:
        return self.done() if len(self.rows) >= FLUSH else iter(())

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*self.rows)], ["oligo_id", "oligo", "subject", "score"])
        self.rows = []


def _keyed(oligos: DataFrame, oligo_key: str, oligo: str) -> tuple[DataFrame, int, int]:
    """Oligos as (id, text), the number of blocks and the greatest length."""
    keyed = oligos.select(F.col(oligo_key).cast("string").alias("id"), F.upper(F.col(oligo)).alias("text")).where(F.length("text") > 0)
    n, longest = keyed.agg(F.count("*"), F.max(F.length("text"))).first()
    return keyed, max(1, -(-n // BLOCK)), longest or 1


def _pieces(subjects: DataFrame, subject_key: str, seq: str, longest: int) -> DataFrame:
    """Sequence rows (id, text, start, slen): the whole sequence, or overlapping pieces of a long one."""
    rows = subjects.select(F.col(subject_key).cast("string").alias("id"), F.translate(F.upper(F.col(seq)), "U", "T").alias("s")).where(F.length("s") > 0)
    cut = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(WHOLE))))
    return cut.select("id", F.substr("s", F.col("start") + 1, F.lit(WHOLE + longest - 1)).alias("text"), "start", F.length("s").alias("slen"))


def best_placements(oligos: DataFrame, subjects: DataFrame, *, oligo_key: str, subject_key: str,
                    oligo: str = "oligo", seq: str = "seq", least: float = 0.0) -> DataFrame:
    """One row per oligo and sequence: strand, offset, score, identity and window; with ``least`` only where so much fits.

    Ties go to the plus strand, then to the lowest offset in strand coordinates. A sequence
    shorter than the oligo has no row.
    """
    keyed, n_blocks, longest = _keyed(oligos, oligo_key, oligo)
    rows = _pieces(subjects, subject_key, seq, longest)
    names = "subject string, strand string, oligo_id string, oligo string, score long, offset long, window string"

    def place(some: DataFrame) -> DataFrame:
        return meet(keyed, some, "id", n_blocks).mapInArrow(
            lambda batches: stream(batches, lambda ids, texts: _Placed(ids, texts, least), "start", "slen"), names)

    # A whole sequence is settled in its task; only the pieces of long ones meet again.
    far = place(rows.where(F.col("slen") > WHOLE)).groupBy("oligo_id", "oligo", "subject").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "strand", "offset", "window")).alias("b"))
    best = place(rows.where(F.col("slen") <= WHOLE)).unionByName(far.select(
        "subject", "b.strand", "oligo_id", "oligo", (-F.col("b.neg")).alias("score"), "b.offset", "b.window"))
    return best.select(
        F.col("oligo_id").cast(dict(oligos.dtypes)[oligo_key]).alias(oligo_key), "oligo",
        F.col("subject").cast(dict(subjects.dtypes)[subject_key]).alias(subject_key), "strand", "offset", "score",
        (F.col("score") / F.length("oligo")).alias("ident"), "window")


def nearest_sequences(oligos: DataFrame, subjects: DataFrame, *, oligo_key: str, subject_key: str,
                      oligo: str = "oligo", seq: str = "seq") -> DataFrame:
    """Per oligo the most matches that any sequence gives (matches) and the least key of those it fits on as a whole (exact)."""
    keyed, n_blocks, longest = _keyed(oligos, oligo_key, oligo)
    met = meet(keyed, _pieces(subjects, subject_key, seq, longest), "id", n_blocks).mapInArrow(
        lambda batches: stream(batches, _Nearest, "start", "slen"), "oligo_id string, oligo string, subject string, score long")
    exact = F.when(F.col("score") == F.length("oligo"), F.col("subject").cast(dict(subjects.dtypes)[subject_key]))
    return (met.groupBy("oligo_id", "oligo").agg(F.max("score").alias("matches"), F.min(exact).alias("exact"))
            .select(F.col("oligo_id").cast(dict(oligos.dtypes)[oligo_key]).alias(oligo_key), "oligo", "matches", "exact"))


def conservation(placed: DataFrame, oligo_key: str, min_ident: float = 0.6) -> DataFrame:
    """Per oligo position: share of matching bases, majority base and tally over placed sequences."""
    kept = placed.filter(F.col("ident") >= min_ident)
    letters = (kept.groupBy(oligo_key, "oligo", "window").agg(F.count("*").alias("n"))
               .select(oligo_key, "oligo", "n", F.posexplode(F.filter(F.split("window", ""), lambda c: c != "")).alias("p", "base"))
               .groupBy(oligo_key, "oligo", "p", "base").agg(F.sum("n").alias("n")))
    matches = F.col("base").eqNullSafe("N") | F.array_contains(S.base_set(F.substr("oligo", F.col("p") + 1, F.lit(1))), F.col("base"))
    return (letters.withColumn("ok", F.when(matches, F.col("n")).otherwise(0))
            .groupBy(oligo_key, "oligo", (F.col("p") + 1).alias("pos"))
            .agg((100.0 * F.sum("ok") / F.sum("n")).alias("pct_match"),
                 F.max(F.struct(F.col("n"), F.col("base"))).getField("base").alias("major"),
                 F.map_from_entries(F.sort_array(F.collect_list(F.struct("base", "n")))).alias("dist")))


def conservation_summary(positions: DataFrame, oligo_key: str) -> DataFrame:
    n = F.length("oligo")
    return positions.groupBy(oligo_key).agg(
        F.min("pct_match").alias("min_pct_match"),
        F.min(F.when(F.col("pos") > n - 5, F.col("pct_match"))).alias("worst_3prime"))


def discrimination(placed: DataFrame, oligo_key: str) -> DataFrame:
    """How far an oligo stays from a set it must not bind, from best placements."""
    n = F.length("oligo")

    def misses(start: int):
        spots = F.sequence(F.lit(1), n)
        return F.size(F.filter(spots, lambda i: (i > n - start) & ~(
            (F.substr("window", i, F.lit(1)) == "N")
            | F.array_contains(S.base_set(F.substr("oligo", i, F.lit(1))), F.substr("window", i, F.lit(1))))))

    rows = placed.withColumn("m3", misses(5))
    tally = rows.groupBy(oligo_key, "score", "ident", F.length("oligo").alias("olen"), "m3").agg(F.count("*").alias("n"))
    return tally.groupBy(oligo_key).agg(
        F.sum("n").alias("n"),
        F.expr("percentile(ident * 100, 0.5, n)").alias("median_ident"),
        (F.max("ident") * 100.0).alias("max_ident"),
        F.min(F.col("olen") - F.col("score")).alias("min_mismatch"),
        F.min("m3").alias("min_3prime_mismatch"))
