"""Exact lowest and highest melting temperature over all concrete forms of a degenerate oligo, whatever their number.

With the salts given, the inverse temperature is (entropy + constant) / enthalpy plus a term linear in the GC count. For each
GC count the extreme ratio is found by Dinkelbach steps, each one a longest path over the bases along the oligo; so the work
grows with the length and the number of free positions, not with the number of forms. Forms that are their own reverse
complement follow other constants and are walked on their own, by half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo as T

BASES = "ACGT"
#: Up to this many forms are written out; beyond it paths are cheaper. Both give the same result.
LISTED = 256
#: Cells of a path table that are worked on at a time.
CELLS = 1 << 20
_SETS = {code: np.array([b in bases for b in BASES]) for code, bases in S.IUPAC_SETS.items()}
#: Base set by byte; none for other letters.
_BASES_OF = np.zeros((256, 4), bool)
for _code, _set in [*_SETS.items(), ("U", _SETS["T"])]:
    _BASES_OF[[ord(_code), ord(_code.lower())]] = _set
_STEP = np.array([[T.STEP_TERMS[a + b] for b in BASES] for a in BASES])
_END = np.array([T.END_AT if b in "AT" else T.END_GC for b in BASES])
_GC = np.array([0, 1, 1, 0])


class Salts:
    """1/T at the reaction salts = 1/T at 1 M + shift(n) + slope * GC fraction; numbers as in salt_adjusted_tm."""

    def __init__(self, cond: T.Conditions) -> None:
        mv, dv, dntp, dna = (float(getattr(cond, f)) for f in ("mv", "dv", "dntp", "dna"))
        self.mono, self.mg = max(mv, 0.0) / 1000, max(dv - dntp, 0.0) / 1000
        strand = max(dna, 1e-3) * 1e-9
        self.constant = {True: T.GAS * math.log(strand), False: T.GAS * math.log(strand / 2)}

    def terms(self, n: int) -> tuple[float, float]:
        lm = math.log(self.mono) if self.mono > 0 else 0.0
        ratio = math.sqrt(self.mg) / self.mono if self.mono > 0 else math.inf
        if self.mg <= 1e-9 and self.mono <= 0:
            return 0.0, 0.0
        if self.mono > 0 and (self.mg <= 1e-9 or ratio < 0.22):
            return -3.95e-5 * lm + 9.40e-6 * lm * lm, 4.29e-5 * lm
        a, d, g = 3.92e-5, 1.42e-5, 8.31e-5
        if self.mono > 0 and ratio < 6.0:
            a *= 0.843 - 0.352 * math.sqrt(self.mono) * lm
            d *= 1.279 - 4.03e-3 * lm - 8.03e-3 * lm * lm
            g *= 0.486 - 0.258 * lm + 5.25e-3 * lm ** 3
        lg = math.log(self.mg)
        return a - 9.11e-6 * lg + (-4.82e-4 + 5.25e-4 * lg + g * lg * lg) / (2 * (n - 1)), 6.26e-5 + d * lg


def _paths(sets: np.ndarray, half: bool, weight: np.ndarray, most: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Enthalpy and entropy of the path with the largest sign * (entropy + weight * enthalpy), per pattern and GC count.

    sets: patterns x positions x 4. weight: patterns x counts, for the count a path must end with. half: the sets are the
    first half of a palindrome, whose steps count twice and whose middle step joins the last base and its complement. Where no
    path has the count: nan.
    """
    n, size = sets.shape[:2]
    times = 2 if half else 1
    cell = np.full((n, most, 4, most), -np.inf)  # patterns x wanted count x last base x count so far
    h, s = np.zeros(cell.shape), np.zeros(cell.shape)

    def gain(dh, ds):
        return sign * (ds + weight[..., None] * dh)

    for b in range(4):
        at = _GC[b]
        if at < most:
            eh, es = times * _END[b]
            cell[:, :, b, at] = np.where(sets[:, 0, b, None], gain(np.array([eh]), es)[..., 0], -np.inf)
            h[:, :, b, at], s[:, :, b, at] = eh, es
    for k in range(1, size):
        new, nh, ns = np.full(cell.shape, -np.inf), np.zeros(cell.shape), np.zeros(cell.shape)
        for b in range(4):
            dh, ds = times * _STEP[:, b, 0], times * _STEP[:, b, 1]
            tried = cell + gain(dh, ds)[..., None]
            best = tried.argmax(axis=2)[:, :, None, :]
            keep, put = slice(0, most - _GC[b]), slice(_GC[b], most)
            take = lambda x: np.take_along_axis(x, best, 2)[:, :, 0, keep]
            new[:, :, b, put] = np.where(sets[:, k, b, None, None], take(tried), -np.inf)
            nh[:, :, b, put] = take(h) + dh[best[:, :, 0, keep]]
            ns[:, :, b, put] = take(s) + ds[best[:, :, 0, keep]]
        cell, h, s = new, nh, ns
    for b in range(4):
        eh, es = (_STEP[b, 3 - b] + np.array([0.0, T.SYMMETRY[1]])) if half else _END[b]
        cell[:, :, b] += gain(np.array([eh]), es)
        h[:, :, b] += eh
        s[:, :, b] += es
    each = np.arange(most)
    own = lambda x: x[:, each, :, each].transpose(1, 2, 0)  # noqa: E731 - patterns x bases x counts
    end = own(cell)
    top = end.argmax(axis=1)[:, None, :]
    found = np.take_along_axis(end, top, 1)[:, 0] > -np.inf
    return tuple(np.where(found, np.take_along_axis(own(x), top, 1)[:, 0], np.nan) for x in (h, s))


def _inverse(sets: np.ndarray, half: bool, salts: Salts) -> np.ndarray:
    """Least and greatest 1/T (2 x patterns) of patterns of one length; nan where a pattern has no form."""
    times = 2 if half else 1
    n = sets.shape[1] * times
    shift, slope = salts.terms(n)
    most = int(sets[:, :, _GC == 1].any(axis=2).sum(axis=1).max(initial=0)) + 1
    out = np.full((2, len(sets)), np.nan)
    step = max(1, CELLS // (4 * most * most))
    for row, sign in enumerate((1, -1)):
        for a in range(0, len(sets), step):
            part = sets[a:a + step]
            ratio = np.full((len(part), most), 1 / 330.0)
            for _ in range(60):
                h, s = _paths(part, half, -1000 * ratio, most, sign)
                new = np.where(np.isnan(h), ratio, (s + salts.constant[half]) / (1000 * h))
                done = np.abs(new - ratio).max(initial=0) < 1e-15
                ratio = new
                if done:
                    break
            value = np.where(np.isnan(h), sign * np.inf, ratio + shift + slope * np.arange(most) * times / n)
            best = value.min(axis=1) if sign > 0 else value.max(axis=1)
            out[row, a:a + step] = np.where(np.isinf(best), np.nan, best)
    return out


def _listed(sets: np.ndarray, salts: Salts) -> np.ndarray:
    """Least and greatest 1/T (2 x patterns) from all forms, of patterns of one length that have as many bases at each position."""
    n, size = sets.shape[:2]
    sizes = sets[0].sum(axis=1)
    number = np.arange(sizes.prod())
    forms = np.repeat(sets.argmax(axis=2)[:, None, :], len(number), axis=1)
    for k in np.flatnonzero(sizes > 1):
        forms[:, :, k] = np.nonzero(sets[:, k])[1].reshape(n, sizes[k])[:, number % sizes[k]]
        number = number // sizes[k]
    forms = forms.reshape(-1, size)
    mirrored = (forms[:, ::-1] == 3 - forms).all(axis=1)
    sums = _STEP[forms[:, :-1], forms[:, 1:]].sum(axis=1) + _END[forms[:, 0]] + _END[forms[:, -1]]
    constant = np.where(mirrored, salts.constant[True] + T.SYMMETRY[1], salts.constant[False])
    shift, slope = salts.terms(size)
    value = ((sums[:, 1] + constant) / (1000 * sums[:, 0]) + shift + slope * _GC[forms].mean(axis=1)).reshape(n, -1)
    return np.array([value.min(axis=1), value.max(axis=1)])


def _unmirrored(sets: np.ndarray) -> list[np.ndarray]:
    """Patterns that together hold every form that is not its own reverse complement: one mirrored pair is pinned apart."""
    out = []
    for i in range(len(sets) // 2):
        for a in np.flatnonzero(sets[i]):
            for b in np.flatnonzero(sets[-1 - i]):
                if b != 3 - a:
                    pinned = sets.copy()
                    pinned[i], pinned[-1 - i] = np.arange(4) == a, np.arange(4) == b
                    out.append(pinned)
    return out


def extremes(oligos: list[str], cond: T.Conditions) -> np.ndarray:
    """Fold, lowest and highest temperature per oligo; nan temperatures for fewer than two letters or unknown ones."""
    salts, out = Salts(cond), np.full((len(oligos), 3), np.nan)
    inverse = np.full((2, len(oligos)), np.nan)
    waiting: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}
    lengths = np.array([len(x or "") for x in oligos], dtype=np.int64)
    for size in np.unique(lengths[lengths >= 2]).tolist():
        at = np.flatnonzero(lengths == size)
        every = _BASES_OF[np.frombuffer("".join(oligos[i] for i in at).encode("ascii", "replace"), np.uint8)].reshape(-1, size, 4)
        known = every.any(axis=2).all(axis=1)
        at, every = at[known], every[known]
        out[at, 0] = every.sum(axis=2, dtype=float).prod(axis=1)
        short = np.flatnonzero(out[at, 0] <= LISTED)
        # Patterns that are free in the same places are written out together, a bounded number of letters at a time.
        counts, kind = np.unique(every[short].sum(axis=2), axis=0, return_inverse=True)
        for k, count in enumerate(counts):
            mine = short[kind.ravel() == k]
            step = max(1, CELLS // (int(count.prod()) * size))
            for a in range(0, len(mine), step):
                inverse[:, at[mine[a:a + step]]] = _listed(every[mine[a:a + step]], salts)
        for i in np.flatnonzero(out[at, 0] > LISTED):
            sets = every[i]
            mirrored = sets[:size // 2] & sets[::-1, ::-1][:size // 2]
            if size % 2 or not mirrored.any(axis=1).all():
                waiting.setdefault((size, False), []).append((at[i], sets))
            else:
                waiting.setdefault((size, True), []).append((at[i], mirrored))
                waiting.setdefault((size, False), []).extend((at[i], x) for x in _unmirrored(sets))
    for (_, half), members in waiting.items():
        got = _inverse(np.stack([x for _, x in members]), half, salts)
        at = np.array([i for i, _ in members])
        np.fmin.at(inverse[0], at, got[0])
        np.fmax.at(inverse[1], at, got[1])
    out[:, 1], out[:, 2] = 1 / inverse[1] - 273.15, 1 / inverse[0] - 273.15
    return out


def tm_extremes(oligos: DataFrame, keys: list[str], oligo: str, cond: T.Conditions = T.Conditions()) -> DataFrame:
    """Per row: keys, fold (number of concrete forms, a double), tm_min and tm_max over all of them; no cap.

    Conditions are plain numbers. Temperatures are null for null oligos, fewer than two letters or letters without a base
    set; fold is null then too. A row depends on itself alone.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = extremes(batch.to_pylist(), cond)
            yield pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in found.T], ["fold", "tm_min", "tm_max"])

    got = F.arrow_udf(run, "fold double, tm_min double, tm_max double")
    return oligos.select(*keys, got(oligo).alias("r")).select(*keys, "r.fold", "r.tm_min", "r.tm_max")


def resolved_range(oligos: DataFrame, keys: list[str], oligo: str, *, cap: int = 64) -> DataFrame:
    """The reporting form of tm_extremes: an oligo with more than ``cap`` forms is flagged ``capped`` and has no range."""
    out = tm_extremes(oligos, keys, oligo).withColumn("capped", F.col("fold") > cap)
    within = lambda name: F.when(~F.col("capped"), F.col(name)).alias(name)
    return out.select(*keys, F.col("fold").cast("long").alias("fold"), within("tm_min"), within("tm_max"), "capped")
