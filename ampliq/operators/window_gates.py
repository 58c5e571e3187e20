"""Primer gates over every window of whole batches of sequences: counts per outcome leave a task, windows do not.

Steps, ends and letters of a window are differences of running sums over the batch. A window and its reverse complement have one
melting temperature, one GC content and the same runs, so both strands are judged together.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import thermo as T

# As in site_blocks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Window starts that one row carries; longer sequences are cut. Letters that are judged at a time.
WHOLE, LETTERS = 1 << 16, 1 << 18

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
# Enthalpy and entropy in tenths, so that sums are exact; index 4 is any other letter.
_STEPS, _ENDS = np.zeros((2, 5, 5), np.int64), np.zeros((2, 5), np.int64)
for _part in (0, 1):
    for _pair, _terms in T.STEP_TERMS.items():
        _STEPS[_part]["ACGT".index(_pair[0]), "ACGT".index(_pair[1])] = round(10 * _terms[_part])
    _ENDS[_part, :4] = [round(10 * e[_part]) for e in (T.END_AT, T.END_GC, T.END_GC, T.END_AT)]
_SYMMETRY, _GAS = round(10 * T.SYMMETRY[1]), T.GAS

OUTCOMES = ["retained", "length", "gc", "tm", "three_prime_T", "three_prime_gc", "g_run", "homopolymer"]


def _melt(dh: np.ndarray, ds: np.ndarray, paired: np.ndarray, gc: np.ndarray, n: int, cond: dict) -> np.ndarray:
    """``thermo.tm_from_sums`` over arrays; ``gc`` is a fraction, ``paired`` marks self-complementary windows."""
    strand = max(cond["dna"], 1e-3) * 1e-9
    tm = 1000.0 * dh / (ds + _GAS * np.where(paired, math.log(strand), math.log(strand / 2.0))) - 273.15
    mono, mg = max(cond["mv"], 0.0) / 1000.0, max(cond["dv"] - cond["dntp"], 0.0) / 1000.0
    inverse = 1.0 / (tm + 273.15)
    if mono > 0 and (mg <= 1e-9 or math.sqrt(mg) / mono < 0.22):
        lm = math.log(mono)
        return 1.0 / (inverse + (4.29 * gc - 3.95) * 1e-5 * lm + 9.40e-6 * lm * lm) - 273.15
    if mg <= 1e-9:
        return tm
    a, d, g, lg = 3.92e-5, 1.42e-5, 8.31e-5, math.log(mg)
    if mono > 0 and math.sqrt(mg) / mono < 6.0:
        lm = math.log(mono)
        a *= 0.843 - 0.352 * math.sqrt(mono) * lm
        d *= 1.279 - 4.03e-3 * lm - 8.03e-3 * lm * lm
        g *= 0.486 - 0.258 * lm + 5.25e-3 * lm * lm * lm
    return 1.0 / (inverse + a - 9.11e-6 * lg + gc * (6.26e-5 + d * lg)
                  + (1.0 / (2.0 * (n - 1))) * (-4.82e-4 + 5.25e-4 * lg + g * lg * lg)) - 273.15


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _ending_runs(codes: np.ndarray, size: int, letter: int | None = None) -> np.ndarray:
    """Where ``size`` equal letters (A, C, G or T, or the one given) end."""
    same = codes < 4 if letter is None else codes == letter
    out = same.copy()
    for k in range(1, size):
        out[k:] &= same[:-k] & (codes[k:] == codes[:-k])
        out[:k] = False
    return out


def outcomes(codes: np.ndarray, start: np.ndarray, k: int, c: dict, cond: dict) -> tuple[np.ndarray, np.ndarray]:
    """Place in OUTCOMES of the windows of ``k`` letters at ``start``, on the plus and on the minus strand."""
    stop = start + k
    strong = _sums((codes == 1) | (codes == 2))
    gc = 100.0 * (strong[stop] - strong[start]) / k
    if k < 2:
        melted = np.zeros(len(start), bool)
    else:
        first, last = codes[start], codes[stop - 1]
        paired = np.ones(len(start), bool) if k % 2 == 0 else np.zeros(len(start), bool)
        for i in range(k // 2 if k % 2 == 0 else 0):
            paired &= codes[start + i] + codes[stop - 1 - i] == 3
        sums = []
        for steps, ends in zip(_STEPS, _ENDS):
            upto = _sums(steps[codes[:-1], codes[1:]])
            sums.append(upto[stop - 1] - upto[start] + ends[first] + ends[last])
        dh, ds = sums
        other = _sums(codes > 3)
        with np.errstate(divide="ignore", invalid="ignore"):
            tm = _melt(dh / 10.0, (ds + np.where(paired, _SYMMETRY, 0)) / 10.0, paired, gc / 100.0, k, cond)
        melted = (tm >= c["tm_min"]) & (tm <= c["tm_max"]) & (other[stop] == other[start])
    no = np.zeros(len(start), bool)

    def holds(size: int, letter: int | None = None) -> np.ndarray:
        if size < 1:
            return ~no
        upto = _sums(_ending_runs(codes, size, letter))
        return upto[stop] > upto[start + size - 1] if size <= k else no

    tail, homopolymer = min(k, 5), holds(c["max_any_run"])
    made = []
    for ends_in_t, near, far, g in ((codes[stop - 1] == 3, stop - tail, stop, 2), (codes[start] == 0, start, start + tail, 1)):
        failed = [no if c["len_min"] <= k <= c["len_max"] else ~no, ~((gc >= c["gc_min"]) & (gc <= c["gc_max"])), ~melted,
                  ends_in_t if c["no_three_prime_t"] else no, strong[far] - strong[near] > c["max_3prime_gc"], holds(c["max_g_run"], g), homopolymer]
        made.append(np.select(failed, list(range(1, len(OUTCOMES))), 0))
    return made[0], made[1]


def window_attrition(templates: DataFrame, keys: list[str], seq: str, len_min: int, len_max: int, c: dict, cond: T.Conditions = T.Conditions()) -> DataFrame:
    """(keys, strand, outcome, n): windows of ``len_min`` to ``len_max`` letters on both strands by the first gate they fail.

    Equals ``attrition`` of ``primer_rejection`` without structure over ``enumerate_windows``. Conditions are numbers.
    """
    salts = {name: float(getattr(cond, name)) for name in ("mv", "dv", "dntp", "dna")}
    gates = {name: c[name] for name in ("len_min", "len_max", "gc_min", "gc_max", "tm_min", "tm_max", "no_three_prime_t", "max_3prime_gc", "max_g_run", "max_any_run")}
    size = F.length(seq)
    rows = templates.where(size >= len_min).select(*keys, F.col(seq).alias("__t"), F.explode(F.sequence(F.lit(0), size - len_min, F.lit(WHOLE))).alias("__at"))
    rows = rows.select(*keys, F.substr("__t", F.col("__at") + 1, F.lit(WHOLE + len_max - 1)).alias("__t"))
    whole, letters = WHOLE, LETTERS

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__t").to_pylist()
            if not texts:
                continue
            kinds = np.zeros(len(texts), np.int64)
            for name in keys:
                own = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                kinds = np.unique(kinds * (int(own.max()) + 1) + own, return_inverse=True)[1]
            _, named = np.unique(kinds, return_index=True)
            sizes = np.array([len(t) for t in texts], np.int64)
            tally = np.zeros((len(named), 2, len(OUTCOMES)), np.int64)
            upto, done = np.cumsum(sizes), 0
            while done < len(texts):
                stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + letters, "right")))
                some = sizes[done:stop]
                codes = _CODE[np.frombuffer("".join(texts[done:stop]).encode("ascii", "replace"), np.uint8)]
                ends = np.cumsum(some)
                at = np.arange(len(codes)) - np.repeat(ends - some, some)
                room = np.repeat(some, some) - at
                group = np.repeat(kinds[done:stop], some)
                for k in range(len_min, len_max + 1):
                    start = np.flatnonzero((room >= k) & (at < whole))
                    for strand, found in enumerate(outcomes(codes, start, k, gates, salts)):
                        tally[:, strand] += np.bincount(group[start] * len(OUTCOMES) + found, minlength=len(named) * len(OUTCOMES)).reshape(len(named), -1)
                done = stop
            kind, strand, outcome = np.nonzero(tally)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(pa.array(named[kind])) for name in keys], pa.array(np.array(["+", "-"])[strand]),
                 pa.array(np.array(OUTCOMES)[outcome]), pa.array(tally[kind, strand, outcome])], [*keys, "strand", "outcome", "n"])

    kind = dict(templates.dtypes)
    found = rows.mapInArrow(judged, ", ".join(f"`{name}` {kind[name]}" for name in keys) + ", strand string, outcome string, n long")
    return found.groupBy(*keys, "strand", "outcome").agg(F.sum("n").alias("n"))
