"""Nearest-neighbour duplex thermodynamics as column expressions.

Reaction conditions are explicit arguments (numbers or columns), never session state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import seq as S

GAS = 1.987

# Unified nearest-neighbour set for DNA duplexes (SantaLucia 1998), one row per
# dinucleotide of the top strand: enthalpy kcal/mol, entropy cal/(mol K).
STEP_TERMS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
END_AT = (2.3, 4.1)
END_GC = (0.1, -2.8)
SYMMETRY = (0.0, -1.4)

# Locked-base increments (McTigue 2004), cal/mol and cal/(mol K), keyed by the step
# and by which of its two bases is locked.
LOCKED_FIRST = {
    "AA": (707.0, 2.5), "AC": (1131.0, 4.1), "AG": (264.0, 2.6), "AT": (2282.0, 7.5),
    "CA": (1049.0, 4.3), "CC": (2096.0, 8.0), "CG": (785.0, 3.7), "CT": (708.0, 4.2),
    "GA": (3162.0, 10.5), "GC": (-360.0, -0.3), "GG": (-2844.0, -6.7), "GT": (-212.0, 0.1),
    "TA": (-46.0, 1.6), "TC": (1893.0, 6.7), "TG": (-1540.0, -3.0), "TT": (1528.0, 5.3),
}
LOCKED_SECOND = {
    "AA": (992.0, 4.1), "AC": (2890.0, 10.6), "AG": (-1200.0, -1.8), "AT": (1816.0, 6.9),
    "CA": (1358.0, 4.4), "CC": (2063.0, 7.6), "CG": (-276.0, -0.7), "CT": (-1671.0, -4.1),
    "GA": (444.0, 2.9), "GC": (-925.0, -1.1), "GG": (-943.0, -0.9), "GT": (-635.0, -0.3),
    "TA": (1591.0, 5.3), "TC": (609.0, 3.2), "TG": (2165.0, 7.2), "TT": (2326.0, 8.1),
}


@dataclass(frozen=True)
class Conditions:
    """Millimolar salts, nanomolar oligo and the annealing temperature; values or columns."""

    mv: float | Column = 50.0
    dv: float | Column = 3.0
    dntp: float | Column = 0.8
    dna: float | Column = 200.0
    anneal: float | Column = 60.0

    def column(self, name: str) -> Column:
        value = getattr(self, name)
        return value if isinstance(value, Column) else F.lit(float(value))


def free_magnesium(cond: Conditions) -> Column:
    return F.greatest(cond.column("dv") - cond.column("dntp"), F.lit(0.0))


def sodium_equivalent(cond: Conditions) -> Column:
    """Monovalent equivalent in mol/l used by the product melt formula."""
    na = F.greatest(cond.column("mv"), F.lit(0.0)) + 120.0 * F.sqrt(free_magnesium(cond))
    return F.greatest(na, F.lit(1.0)) / 1000.0


def amplicon_tm(col: Column, cond: Conditions = Conditions()) -> Column:
    return (81.5 + 16.6 * F.log10(sodium_equivalent(cond)) + 0.41 * S.gc_percent(col)
            - 600.0 / F.length(col))



def step_count(col: Column, step: str) -> Column:
    """Number of positions holding a dinucleotide, overlapping positions counted."""
    if step[0] == step[1]:
        return F.length(col) - F.length(F.regexp_replace(col, f"{step[0]}(?={step[1]})", ""))
    return (F.length(col) - F.length(F.replace(col, F.lit(step), F.lit("")))) / 2


def step_sum(col: Column, part: int) -> Column:
    """Sum of one component of the step table over all neighbouring base pairs."""
    return reduce(lambda x, y: x + y, [step_count(col, k) * F.lit(v[part]) for k, v in STEP_TERMS.items()])


def locked_increment(bases: Column, locked: Column, part: int) -> Column:
    """Sum of locked-base increments of a sequence, given its locked 1-based positions."""
    first = F.create_map(*[x for k, v in LOCKED_FIRST.items() for x in (F.lit(k), F.lit(v[part]))])
    second = F.create_map(*[x for k, v in LOCKED_SECOND.items() for x in (F.lit(k), F.lit(v[part]))])
    n = F.length(bases)
    as_first = F.aggregate(
        F.filter(locked, lambda i: i < n), F.lit(0.0),
        lambda acc, i: acc + F.element_at(first, F.substr(bases, i, F.lit(2))))
    as_second = F.aggregate(
        F.filter(locked, lambda i: i > 1), F.lit(0.0),
        lambda acc, i: acc + F.element_at(second, F.substr(bases, i - 1, F.lit(2))))
    return as_first + as_second


def end_terms(col: Column, part: int) -> Column:
    def one(letter: Column) -> Column:
        return F.when(letter.isin("A", "T"), F.lit(END_AT[part])).otherwise(F.lit(END_GC[part]))

    return one(F.left(col, F.lit(1))) + one(F.right(col, F.lit(1)))


def is_plain(col: Column) -> Column:
    return col.rlike("^[ACGT]{2,}$")


def is_self_complementary(col: Column) -> Column:
    return col == S.revcomp(col)


def enthalpy(col: Column) -> Column:
    return F.when(is_plain(col), step_sum(col, 0) + end_terms(col, 0))


def entropy(col: Column) -> Column:
    sym = F.when(is_self_complementary(col), F.lit(SYMMETRY[1])).otherwise(F.lit(0.0))
    return F.when(is_plain(col), step_sum(col, 1) + end_terms(col, 1) + sym)


_STEP_KEYS = [(k, "ACGT".index(k[0]) * 4 + "ACGT".index(k[1])) for k in STEP_TERMS]


def _duplex_sums(texts: pd.Series) -> pd.DataFrame:
    """Step and end sums of whole batches, added in the order of ``step_sum``."""
    letters = texts.fillna("")
    sizes = letters.str.len().to_numpy(np.int64)
    codes = _LETTER[np.frombuffer("".join(letters).encode("ascii", "replace"), np.uint8)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    plain = (sizes >= 2) & (np.bincount(row[codes > 3], minlength=len(sizes)) == 0)
    inside = np.flatnonzero((row[1:] == row[:-1]) & plain[row[1:]])
    counts = np.bincount(row[inside] * 16 + codes[inside] * 4 + codes[inside + 1], minlength=16 * len(sizes)).reshape(-1, 16)
    first = np.cumsum(sizes) - sizes
    out = {}
    for name, part in (("dh", 0), ("ds", 1)):
        total = reduce(lambda x, y: x + y, [counts[:, at] * STEP_TERMS[k][part] for k, at in _STEP_KEYS])
        end = np.array([END_AT[part], END_GC[part], END_GC[part], END_AT[part]])
        out[name] = np.full(len(sizes), np.nan)
        out[name][plain] = total[plain] + (end[codes[first[plain]]] + end[codes[(first + sizes - 1)[plain]]])
    return pd.DataFrame(out)


_LETTER = np.full(256, 9, np.int64)
_LETTER[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def duplex_sums(col: Column) -> tuple[Column, Column]:
    """``enthalpy`` and ``entropy`` of whole tables of oligos, worked out batch by batch; null where those are."""
    made = F.pandas_udf(_duplex_sums, "dh double, ds double")(col)
    sym = F.when(is_self_complementary(col), F.lit(SYMMETRY[1])).otherwise(F.lit(0.0))
    return F.nanvl(made["dh"], F.lit(None)), F.nanvl(made["ds"], F.lit(None)) + sym


def tm_one_molar(dh: Column, ds: Column, self_comp: Column, cond: Conditions) -> Column:
    strand = F.greatest(cond.column("dna"), F.lit(1e-3)) * 1e-9
    k = F.when(self_comp, strand).otherwise(strand / 2.0)
    return 1000.0 * dh / (ds + GAS * F.log(k)) - 273.15


def salt_adjusted_tm(tm1m: Column, gc_fraction: Column, n: Column, cond: Conditions) -> Column:
    """Move a 1 M sodium melt temperature to the reaction salts (Owczarzy 2004 and 2008).

    The regime follows sqrt(free Mg) / monovalent: monovalent below 0.22, mixed below 6,
    magnesium above.
    """
    mono = F.greatest(cond.column("mv"), F.lit(0.0)) / 1000.0
    mg = free_magnesium(cond) / 1000.0
    inverse = 1.0 / (tm1m + 273.15)
    lm = F.log(F.when(mono > 0, mono))
    only_mono = inverse + (4.29 * gc_fraction - 3.95) * 1e-5 * lm + 9.40e-6 * lm * lm
    ratio = F.sqrt(mg) / F.when(mono > 0, mono)
    mixed = (mono > 0) & (ratio < 6.0)
    a = F.when(mixed, 3.92e-5 * (0.843 - 0.352 * F.sqrt(mono) * lm)).otherwise(F.lit(3.92e-5))
    d = F.when(mixed, 1.42e-5 * (1.279 - 4.03e-3 * lm - 8.03e-3 * lm * lm)).otherwise(F.lit(1.42e-5))
    g = F.when(mixed, 8.31e-5 * (0.486 - 0.258 * lm + 5.25e-3 * lm * lm * lm)).otherwise(F.lit(8.31e-5))
    lg = F.log(F.when(mg > 1e-9, mg))
    with_mg = (inverse + a - 9.11e-6 * lg + gc_fraction * (6.26e-5 + d * lg)
               + (1.0 / (2.0 * (n - 1))) * (-4.82e-4 + 5.25e-4 * lg + g * lg * lg))
    return (F.when((mg <= 1e-9) & (mono > 0), 1.0 / only_mono - 273.15)
            .when(mg <= 1e-9, tm1m)
            .when((mono > 0) & (ratio < 0.22), 1.0 / only_mono - 273.15)
            .otherwise(1.0 / with_mg - 273.15))


def tm_from_sums(col: Column, dh: Column, ds: Column, cond: Conditions) -> Column:
    tm1 = tm_one_molar(dh, ds, is_self_complementary(col), cond)
    return salt_adjusted_tm(tm1, S.gc_percent(col) / 100.0, F.length(col), cond)


def melting_temperature(col: Column, cond: Conditions = Conditions()) -> Column:
    return tm_from_sums(col, enthalpy(col), entropy(col), cond)


def free_energy(dh: Column, ds: Column, kelvin: float = 310.15) -> Column:
    return dh - kelvin * ds / 1000.0


def fraction_bound(dh: Column, tm: Column, cond: Conditions) -> Column:
    ta = cond.column("anneal") + 273.15
    return 1.0 / (1.0 + F.exp(dh * 1000.0 / GAS * (1.0 / ta - 1.0 / (tm + 273.15))))


def _micro(h: float, s: float) -> int:
    """37 C energy of one table row in whole millionths of a kcal/mol, so cut-offs compare exactly."""
    return round((h - 310.15 * s / 1000.0) * 1e6)


def step_prefix(col: Column) -> Column:
    """Running step energies: element ``i`` covers the first ``i`` bases (element 1 is 0)."""
    lookup = F.create_map(*[x for k, v in STEP_TERMS.items() for x in (F.lit(k), F.lit(_micro(*v)).cast("long"))])
    steps = F.sequence(F.lit(1), F.length(col) - 1)
    start = F.array(F.lit(0).cast("long"))
    return F.when(F.length(col) < 2, start).otherwise(F.aggregate(
        steps, start,
        lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + F.element_at(lookup, F.substr(col, i, F.lit(2))))))


def run_energy(col: Column, prefix: Column, at: Column, length: Column) -> Column:
    """Energy (millionths of kcal/mol) of the perfectly paired run ``col[at, at + length)``, 1-based."""
    def end(position: Column) -> Column:
        return F.when(F.substr(col, position, F.lit(1)).isin("A", "T"), F.lit(_micro(*END_AT))).otherwise(
            F.lit(_micro(*END_GC)))

    last = at + length - 1
    return F.element_at(prefix, last) - F.element_at(prefix, at) + end(at) + end(last)
