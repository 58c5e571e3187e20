"""Oligo sites on whole batches of sequences: blocks of oligos and slices of sequences meet in tasks.

Every window is written in the oligo's own 5'->3' orientation, so its last base is the priming end on both strands. Sequences of a
batch lie behind each other in one array; a position holds the packed base sets of the 15 bases that end there. Seeds are a few
concrete bases at fixed distances from the 3' end: an array over all values of a seed names the oligos that have it, and the
pigeonhole principle makes the seeds exact for the allowed number of mismatches. Candidates are verified in runs of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S

# What runs in tasks travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD, ONES = S.WORD, S.ONES
#: Letters that are searched at a time.
LETTERS = 1 << 18
#: Candidates that are verified at a time.
CANDIDATES = 1 << 20
#: Letters of a sequence that one row carries; longer ones are cut into pieces.
WHOLE = 1 << 16
#: Bases of a seed at most, and of its part before the anchor.
SEED, PIECE = 10, 8
#: Oligos that a task holds at a time.
BLOCK = 4096

_MASKS = np.zeros(256, np.uint8)
for _letter, _hex in zip(S.IUPAC_LETTERS, S.IUPAC_HEX):
    _MASKS[ord(_letter)] = int(_hex, 16)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _letter, _other in zip(S.IUPAC_LETTERS, S.IUPAC_COMPLEMENT):
    _COMPLEMENT[ord(_letter)] = ord(_other)
_TURNED = np.array([(m & 1) << 3 | (m & 2) << 1 | (m & 4) >> 1 | (m & 8) >> 3 for m in range(16)], np.uint8)
_CODES = np.zeros(16, np.int32)
_CODES[[1, 2, 4, 8]] = range(4)
_BITS = np.array([bin(m).count("1") for m in range(16)], np.uint8)


def _back(values: np.ndarray, n: int) -> np.ndarray:
    """What stands ``n`` positions before."""
    if n == 0:
        return values
    out = np.zeros_like(values)
    out[n:] = values[:-n]
    return out


def flags(masks: np.ndarray) -> np.ndarray:
    """One set bit per nibble that is not zero."""
    either = masks | masks >> 1
    return (either | either >> 2) & ONES


class Strand:
    """One strand of a batch: packed base sets and, on demand, seed values of every position."""

    def __init__(self, masks: np.ndarray) -> None:
        one = masks.astype(np.int64)
        two = one | _back(one, 1) << 4
        four = two | _back(two, 2) << 8
        eight = four | _back(four, 4) << 16
        self.words = eight | _back(four, 8) << 32 | _back(two, 12) << 48 | _back(one, 14) << 56
        self.code, bits = _CODES[masks], _BITS[masks]
        self.vague, self.crowded = bits != 1, bits > 1
        self.mixed = bool(self.crowded.any())

    def values(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Value of the ``width`` bases that end at every position, and where one of them is not a single letter."""
        value, vague = np.zeros(len(self.code), np.int32), np.zeros(len(self.code), bool)
        for k in range(width):
            value |= _back(self.code, k) << 2 * k
            vague |= _back(self.vague, k)
        return value, vague

    def mixed_within(self, span: int) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(self.crowded)])
        at = np.arange(1, len(self.crowded) + 1)
        return seen[at] > seen[np.maximum(at - span, 0)]


class Texts:
    """Sequences of a batch with ``room`` empty positions around each."""

    def __init__(self, texts: list[str], room: int) -> None:
        gap = "\0" * room
        raw = np.frombuffer((gap + gap.join(texts) + gap).encode("ascii", "replace"), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = room + np.concatenate([[0], np.cumsum(self.sizes[:-1] + room)]).astype(np.int64)
        self.raw, self.masks, self.n = raw, _MASKS[raw], len(raw)
        self.made: dict[bool, Strand] = {}

    def letters(self, subject: np.ndarray, lo: np.ndarray, size: np.ndarray, minus: np.ndarray) -> pa.StringArray:
        """Letters of sites, in the direction of their strand."""
        first, ends = self.starts[subject] + lo, np.cumsum(size)
        k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        back = np.repeat(minus, size)
        seen = self.raw[np.where(back, np.repeat(first + size - 1, size) - k, np.repeat(first, size) + k)]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.where(back, _COMPLEMENT[seen], seen)))

    def strand(self, minus: bool) -> Strand:
        if minus not in self.made:
            self.made[minus] = Strand(_TURNED[self.masks[::-1]] if minus else self.masks)
        return self.made[minus]


class Hits:
    """Sites as arrays: sequence, oligo, minus (strand), lo (from the start of the text), mm, q3 and on demand more."""

    def __init__(self, subject, oligo, minus, lo, mm, q3, definite, mixed) -> None:
        self.subject, self.oligo, self.minus, self.lo, self.mm = subject, oligo, minus, lo, mm
        self.q3, self.definite, self.mixed = q3, definite, mixed

    @staticmethod
    def together(parts: list[Hits]) -> Hits:
        if not parts:
            none = np.zeros(0, np.int64)
            return Hits(none, none, none.astype(bool), none, none, none.astype(bool), none.astype(bool), none)
        return Hits(*(np.concatenate(x) for x in zip(*(vars(p).values() for p in parts))))


class Oligos:
    """Oligos of a block with their seeds. ``on``: the strands that an oligo is looked for on (+, - or both)."""

    def __init__(self, oligos: list[str], on: list[str], *, max_mm: int, anchor: int, exact_tail: bool = False) -> None:
        self.max_mm, self.anchor = max_mm, anchor
        self.sizes = np.array([len(o) for o in oligos], np.int64)
        self.longest = int(self.sizes.max()) if len(oligos) else 0
        width = -(-max(self.longest, 1) // WORD) * WORD
        raw = np.frombuffer(bytearray("".join(o.rjust(width, "\0") for o in oligos).encode("ascii", "replace")), np.uint8)
        # Column k holds the base k before the 3' end.
        self.masks = _MASKS[raw].reshape(-1, width)[:, ::-1]
        self.words = [sum(self.masks[:, k + j].astype(np.int64) << 4 * j for j in range(WORD)) for k in range(0, width, WORD)]
        self.plans = {minus: self._plans([i for i, w in enumerate(on) if ("-" if minus else "+") in w], 0 if exact_tail else max_mm + 1)
                      for minus in (False, True)}

    def _plans(self, numbers: list[int], pieces: int) -> list[tuple]:
        """(width, pieces, oligos, per piece: where oligos of a seed value start, oligos by seed value)."""
        head = min(self.anchor, SEED)
        by_width: dict[int, list[int]] = {}
        for i in numbers:
            fits = min((int(self.sizes[i]) - self.anchor) // pieces, PIECE, SEED - head) if pieces else 0
            # An oligo with no base for every piece goes by its anchor alone.
            by_width.setdefault(max((w for w in (8, 6, 5, 4, 3, 2, 1) if w <= fits), default=0), []).append(i)
        out = []
        for width, mine in sorted(by_width.items()):
            tables = []
            for j in range(pieces if width else 1):
                spots = [*range(head), *range(self.anchor + j * width, self.anchor + (j + 1) * width)]
                codes, order = self._seeds(np.array(mine), spots)
                sort = np.argsort(codes, kind="stable")
                tables.append((np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=4 ** len(spots)))]), order[sort]))
            out.append((width, len(tables), np.array(mine), tables))
        return out

    def _seeds(self, mine: np.ndarray, spots: list[int]) -> tuple[np.ndarray, np.ndarray]:
        masks = self.masks[mine][:, spots]
        plain = (_BITS[masks] == 1).all(axis=1)
        codes, order = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if plain.any():
            codes.append((_CODES[masks[plain]].astype(np.int64) << 2 * np.arange(len(spots))).sum(axis=1))
            order.append(mine[plain])
        for i in np.flatnonzero(~plain):
            sets = [[c for c in range(4) if m >> c & 1] for m in masks[i].tolist()]
            some = np.array([sum(c << 2 * k for k, c in enumerate(letters)) for letters in product(*sets)], np.int64)
            codes.append(some)
            order.append(np.full(len(some), mine[i]))
        return np.concatenate(codes), np.concatenate(order)

    def search(self, texts: Texts) -> Iterator[Hits]:
        """All sites with at most ``max_mm`` mismatches and an exact anchor."""
        head = min(self.anchor, SEED)
        for minus, plans in self.plans.items():
            if not plans:
                continue
            strand = texts.strand(minus)
            first, first_vague = strand.values(head)
            for width, pieces, mine, tables in plans:
                star = strand.mixed_within(self.anchor + width * pieces if width else head) if strand.mixed else None
                piece, piece_vague = strand.values(width)
                for j, (starts, order) in enumerate(tables):
                    at = self.anchor + j * width
                    value, vague = first, first_vague
                    if width:
                        value = first | _back(piece, at) << 2 * head
                        vague = first_vague | _back(piece_vague, at)
                    usable = ~vague if star is None else ~vague & ~star
                    n = starts[value + 1] - starts[value]
                    where = np.flatnonzero(usable & (n > 0))
                    before = [(self.anchor + i * width, self.anchor + (i + 1) * width) for i in range(j)]
                    yield from self._runs(texts, strand, minus, where, starts[value[where]], n[where], order, before)
                if star is not None:
                    # A window that may stand for many seeds meets every oligo.
                    where = np.flatnonzero(star)
                    yield from self._runs(texts, strand, minus, where, np.zeros(len(where), np.int64), np.full(len(where), len(mine)), mine, [])

    def _runs(self, texts, strand, minus, where, first, n, order, before) -> Iterator[Hits]:
        upto = np.cumsum(n)
        done = 0
        while done < len(where):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CANDIDATES, "right")))
            some = n[done:stop]
            spot = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[done:stop], some)
            yield self._verified(texts, strand, minus, np.repeat(where[done:stop], some), order[spot], before)
            done = stop

    def _verified(self, texts: Texts, strand: Strand, minus: bool, where: np.ndarray, oligo: np.ndarray, before: list[tuple[int, int]]) -> Hits:
        held, mm = [], np.zeros(len(where), np.int64)
        for k, words in enumerate(self.words):
            same = flags(strand.words[np.maximum(where - k * WORD, 0)] & words[oligo])
            mm += np.clip(self.sizes[oligo] - k * WORD, 0, WORD) - np.bitwise_count(same)
            held.append(same)
            keep = mm <= self.max_mm
            if not keep.all():
                where, oligo, mm, held = where[keep], oligo[keep], mm[keep], [h[keep] for h in held]
        keep = self._all_set(held, 0, self.anchor) if self.anchor else np.ones(len(where), bool)
        # A site that several pieces reach is kept for the first of them.
        for lo, hi in before:
            keep &= ~self._all_set(held, lo, hi)
        size = self.sizes[oligo]
        front = texts.n - 1 - where if minus else where - size + 1
        subject = np.searchsorted(texts.starts, front, "right") - 1
        lo = front - texts.starts[np.maximum(subject, 0)]
        keep &= (subject >= 0) & (lo + size <= texts.sizes[np.maximum(subject, 0)])
        where, oligo, tail = where[keep], oligo[keep], strand.words[where[keep]] & 4095
        mixed = np.zeros(len(where), np.int64)
        for k in range(len(self.words) if strand.mixed else 0):
            cut = np.clip(self.sizes[oligo] - k * WORD, 0, WORD)
            site = strand.words[np.maximum(where - k * WORD, 0)] & ((np.int64(1) << 4 * cut) - 1)
            bits = [site >> b & ONES for b in range(4)]
            mixed += np.bitwise_count((bits[0] | bits[1]) & (bits[2] | bits[3]) | bits[0] & bits[1] | bits[2] & bits[3])
        definite = (tail & ~self.words[0][oligo] == 0) & (flags(tail) & 273 == 273)
        return Hits(subject[keep], oligo, np.full(len(where), minus), lo[keep], mm[keep], held[0][keep] & 273 == 273, definite, mixed)

    @staticmethod
    def _all_set(held: list[np.ndarray], start: int, stop: int) -> np.ndarray:
        out = np.ones(len(held[0]), bool)
        for k in range(start // WORD, (stop - 1) // WORD + 1):
            want = sum(1 << 4 * (n - k * WORD) for n in range(max(start, k * WORD), min(stop, (k + 1) * WORD)))
            if k >= len(held):
                return np.zeros(len(held[0]), bool)
            out &= held[k] & want == want
        return out


def cut_rows(subjects: DataFrame, keys: list[str], seq: str, ahead: int, beyond: int) -> DataFrame:
    """Sequence rows (s, text, own, until, begin, slen): a piece owns what starts in its WHOLE letters from ``own`` to ``until``; its
    text begins at ``begin``, up to ``ahead`` letters before, and holds ``beyond`` letters more."""
    size = F.length(seq)
    cut = subjects.where(size > 0).select(F.struct(*keys).alias("s"), F.col(seq).alias("__t"), size.alias("slen"),
                                          F.explode(F.sequence(F.lit(0), size - 1, F.lit(WHOLE))).alias("own"))
    begin = F.greatest(F.col("own") - ahead, F.lit(0))
    return cut.select("s", F.substr("__t", begin + 1, F.col("own") - begin + WHOLE + beyond).alias("text"), "own",
                      (F.col("own") + WHOLE).alias("until"), begin.alias("begin"), "slen")


def meet(oligos: DataFrame, rows: DataFrame, n_blocks: int, block_by: list[str]) -> DataFrame:
    """Oligos (o: what names them, text, x: what else a task needs) and sequence rows, dealt into slices: in a partition a block's
    oligos (kind 0) come before the sequence rows (kind 1) of its slice. An oligo travels once a slice, a sequence once a block."""
    parts = int(oligos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-4 * parts // n_blocks))
    kinds = {**dict(oligos.dtypes), **dict(rows.dtypes)}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    extra = ["own", "until", "begin", "slen"]
    left = oligos.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.pmod(F.xxhash64(*block_by), F.lit(n_blocks)).cast("int").alias("block"),
                         F.lit(0).alias("kind"), "o", "text", "x", none("s"), *map(none, extra))
    right = rows.select(F.pmod(F.xxhash64("text", "own"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                        F.lit(1).alias("kind"), none("o"), "text", none("x"), "s", *extra)
    # Much arithmetic in few bytes: an explicit number of partitions keeps AQE from merging the tasks by size.
    return left.unionByName(right).repartition(parts, "slice", "block").sortWithinPartitions("block", "slice", "kind")


def stream(batches: Iterator[pa.RecordBatch], start: Callable) -> Iterator[pa.RecordBatch]:
    """Walk rows of ``meet``: ``start(oligos)`` makes the state of a block, ``state.take(rows)`` gets up to LETTERS letters of
    sequence rows at a time and ``state.done()`` ends the block; both yield what leaves the task."""
    state, key, oligos = None, None, []
    for batch in batches:
        places = np.stack([batch.column(c).to_numpy() for c in ("block", "slice", "kind")], axis=1)
        edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(places)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue  # an empty batch
            run, (block, part, kind) = batch.slice(a, b - a), places[a].tolist()
            if kind == 0:
                if key == (block, part):
                    oligos.append(run)
                else:
                    if state is not None and key[0] != block:
                        yield from state.done()
                        state = None
                    key, oligos = (block, part), [run]
                continue
            if key != (block, part):
                continue  # no oligo in this block
            if state is None:
                state = start(pa.Table.from_batches(oligos))
            sizes = np.cumsum(compute.utf8_length(run.column("text")).to_numpy())
            done = 0
            while done < len(sizes):
                stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + LETTERS, "right")))
                yield from state.take(run.slice(done, stop - done))
                done = stop
    if state is not None:
        yield from state.done()


class _Listed:
    """Lists every site."""

    def __init__(self, oligos: pa.Table, room: int, site: bool, **rules) -> None:
        self.o, self.room, self.site = oligos.column("o").combine_chunks(), room, site
        on = oligos.column("x").combine_chunks().field("on").to_pylist()
        self.oligos = Oligos(oligos.column("text").to_pylist(), on, **rules)

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, until, begin = (rows.column(c).to_numpy().astype(np.int64) for c in ("own", "until", "begin"))
        texts = Texts(rows.column("text").to_pylist(), self.room)
        for h in self.oligos.search(texts):
            at = h.lo + begin[h.subject]
            k = np.flatnonzero((at >= own[h.subject]) & (at < until[h.subject]))
            if len(k):
                size = self.oligos.sizes[h.oligo[k]]
                yield pa.RecordBatch.from_arrays(
                    [self.o.take(pa.array(h.oligo[k])), rows.column("s").take(pa.array(h.subject[k])), pa.array(["+", "-"]).take(pa.array(h.minus[k].astype(np.int8))),
                     pa.array(size, pa.int32()), pa.array(h.mm[k], pa.int32()), pa.array(at[k], pa.int32()), pa.array(at[k] + size - 1, pa.int32()),
                     pa.array(h.q3[k]), pa.array(h.definite[k]), pa.array(h.mixed[k], pa.int32()),
                     *([texts.letters(h.subject[k], h.lo[k], size, h.minus[k])] if self.site else [])],
                    ["o", "s", "strand", "olen", "mm", "lo", "hi", "q3", "q3_definite", "ambiguous_bases", *(["site"] if self.site else [])])

    def done(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def list_sites(oligos: DataFrame, subjects: DataFrame, *, oligo_keys: list[str], subject_keys: list[str], oligo: str, seq: str, max_len: int,
               on: str, max_mm: int, anchor: int, exact_tail: bool, site: bool = False) -> DataFrame:
    """One row per site, with its letters if ``site``; ``on`` names the column of the strands that an oligo is looked for on."""
    left = oligos.select(F.struct(*oligo_keys).alias("o"), F.col(oligo).alias("text"), F.struct(F.col(on).alias("on")).alias("x"))
    n_blocks = max(1, -(-oligos.count() // BLOCK))
    rows = cut_rows(subjects, subject_keys, seq, 0, max_len - 1)
    kinds = {c: t for c, t in [*left.dtypes, *rows.dtypes]}
    names = (f"o {kinds['o']}, s {kinds['s']}, strand string, olen int, mm int, lo int, hi int, q3 boolean, q3_definite boolean, ambiguous_bases int"
             + ", site string" * site)
    found = meet(left, rows, n_blocks, ["o", "text"]).mapInArrow(lambda batches: stream(
        batches, lambda some: _Listed(some, max_len, site, max_mm=max_mm, anchor=anchor, exact_tail=exact_tail)), names)
    return found.select("o.*", "s.*", *[c for c in found.columns if c not in ("o", "s")])
