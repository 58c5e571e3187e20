"""Nucleotide column expressions. Everything here stays inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide ambiguity alphabet, its complement, and one bit per base
# (A=1, C=2, G=4, T=8) written as the hex digit of the base set each letter stands for.
IUPAC_LETTERS = "ACGTRYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBN"
IUPAC_HEX = "12485A69C3EDB7F"
IUPAC_SETS = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Bases held by one 64-bit mask word: 15 nibbles keep the sign bit clear.
WORD = 15
ONES = int("1" * WORD, 16)


def letters_only(col: Column, alphabet: str = "ACGT") -> Column:
    """Keep only the letters of ``alphabet`` (either case) and upper-case them.

    Letters are dropped before the case change, so no special letter unfolds into new ones.
    """
    return F.upper(F.regexp_replace(col, f"[^{alphabet}{alphabet.lower()}]+", ""))


def revcomp(col: Column) -> Column:
    """Reverse complement, ambiguity aware."""
    return F.reverse(F.translate(col, IUPAC_LETTERS, IUPAC_COMPLEMENT))


def cleaned(raw: Column) -> Column:
    """Struct ``(clean, error)`` for pasted sequence text.

    Header lines, blanks, digits and gap marks go, RNA becomes DNA; any other letter
    outside the alphabet makes the row a reject instead of being dropped.
    """
    blanks = " \t\n\x0b\f\r0123456789.-"
    upper = F.upper(F.regexp_replace(raw, r"(?m)^[ \t]*>.*$", ""))

    # A lambda's argument is worked out once however often it is read.
    def judge(text: Column, bad: Column) -> Column:
        dna = F.translate(F.translate(text, blanks, ""), "U", "T")
        none = F.lit(None).cast("string")
        row = lambda clean, error: F.struct(clean.alias("clean"), error.alias("error"))
        return (F.when(raw.isNull() | (F.trim(raw) == ""), row(none, F.lit("empty sequence")))
                .when(F.size(bad) > 0, row(none, F.concat(F.lit("invalid character(s): "), F.array_join(bad, " "))))
                .when(F.translate(text, blanks, "") == "", row(none, F.lit("no sequence left after cleaning")))
                .otherwise(row(dna, none)))

    def letters(text: Column) -> Column:
        bad = F.array_distinct(F.split(F.translate(text, f"{blanks}{IUPAC_LETTERS}U", ""), ""))
        return F.array_sort(F.filter(bad, lambda c: c != ""))

    return F.get(F.flatten(F.transform(F.array(upper), lambda t: F.transform(F.array(letters(t)), lambda b: judge(t, b)))), F.lit(0))


def clean_sequence(raw: Column) -> tuple[Column, Column]:
    """``cleaned`` as two columns."""
    made = cleaned(raw)
    return made["clean"], made["error"]


def strip_order_marks(col: Column) -> Column:
    """Drop modification blocks, locked-base and linkage marks and blanks from an order string."""
    return F.translate(F.regexp_replace(col, "/[^/]*/", ""), "+* \t", "")


def locked_positions(col: Column) -> Column:
    """1-based positions of locked bases (written ``+N``) in an order string."""
    tokens = F.regexp_extract_all(
        F.upper(F.translate(F.regexp_replace(col, "/[^/]*/", ""), "* ", "")), F.lit(r"(\+?[A-Z])"), 1)
    marked = F.transform(tokens, lambda t, i: F.when(t.startswith("+"), i + 1))
    return F.filter(marked, lambda p: p.isNotNull())


def count_of(col: Column, letters: str) -> Column:
    return F.length(col) - F.length(F.translate(col, letters, ""))


def gc_percent(col: Column) -> Column:
    return F.when(F.length(col) > 0, 100.0 * count_of(col, "GC") / F.length(col)).otherwise(F.lit(0.0))


def last5_gc(col: Column) -> Column:
    return count_of(F.right(col, F.lit(5)), "GC")


def longest_run(col: Column, base: str | None = None) -> Column:
    """Longest run of one base, or of any base."""
    pattern = f"({base}+)" if base else "(A+|C+|G+|T+)"
    runs = F.transform(F.regexp_extract_all(col, F.lit(pattern), 1), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def longest_dinucleotide_repeat(col: Column) -> Column:
    """Repeat count of the longest tandem dinucleotide of two different bases."""
    pairs = [a + b for a in "ACGT" for b in "ACGT" if a != b]
    counts = [
        F.coalesce(
            F.array_max(F.transform(F.regexp_extract_all(col, F.lit(f"((?:{p})+)"), 1), lambda r: F.length(r) / 2)),
            F.lit(0.0))
        for p in pairs
    ]
    return F.greatest(*counts).cast("int")


_SETS = "map(" + ", ".join(
    f"'{code}', array({', '.join(repr(b) for b in bases)})" for code, bases in IUPAC_SETS.items()) + ")"


def base_set(letter: Column) -> Column:
    """Array of concrete bases one ambiguity letter stands for; other letters stand for themselves."""
    return F.coalesce(F.try_element_at(F.expr(_SETS), letter), F.array(letter))


def degeneracy_fold(col: Column) -> Column:
    """Number of concrete oligos a degenerate oligo stands for."""
    two, three, four = count_of(col, "RYSWKM"), count_of(col, "BDHV"), count_of(col, "N")
    return (F.pow(F.lit(2.0), two) * F.pow(F.lit(3.0), three) * F.pow(F.lit(4.0), four)).cast("long")


def resolutions(col: Column) -> Column:
    """Array of the concrete sequences of a degenerate sequence; guard with degeneracy_fold."""
    letters = F.filter(F.split(col, ""), lambda c: c != "")
    return F.aggregate(
        letters,
        F.array(F.lit("")),
        lambda acc, letter: F.flatten(
            F.transform(acc, lambda head: F.transform(base_set(letter), lambda b: F.concat(head, b)))),
    )


# Packed base masks. A sequence is a list of 64-bit words, right aligned: word 0 holds the last
# WORD bases with the final base in the lowest nibble, so sequences of different length line up on
# their 3' ends. The helpers below build SQL text over named word columns: one parse instead of
# hundreds of separate expression calls.


def word_count(max_len: int) -> int:
    return (max_len + WORD - 1) // WORD


def hex_word(text: str) -> str:
    """One word from at most WORD hex digits; empty text is zero."""
    return f"coalesce(cast(conv({text}, 16, 10) as bigint), 0L)"


def mask_words(col: str, max_len: int, prefix: str) -> dict[str, Column]:
    """Word columns ``prefix0, prefix1, ...`` of a sequence column."""
    out = {}
    for k in range(word_count(max_len)):
        part = f"right(left({col}, greatest(length({col}) - {k * WORD}, 0)), {WORD})"
        out[f"{prefix}{k}"] = F.expr(hex_word(f"translate({part}, '{IUPAC_LETTERS}', '{IUPAC_HEX}')"))
    return out


def nibble_range(prefix: str, start: int, stop: int) -> str:
    """Bases ``[start, stop)`` counted from the 3' end as one integer of at most 15 nibbles."""
    parts = []
    for k in range(start // WORD, (stop - 1) // WORD + 1):
        lo, hi = max(start, k * WORD), min(stop, (k + 1) * WORD)
        part = f"(shiftright({prefix}{k}, {4 * (lo - k * WORD)}) & {(1 << (4 * (hi - lo))) - 1}L)"
        parts.append(f"shiftleft({part}, {4 * (lo - start)})")
    return "(" + " | ".join(parts) + ")"


def match_flags(a: str, b: str) -> str:
    """One set bit per nibble where the two base sets intersect."""
    both = f"({a} & {b})"
    return f"(({both} | shiftright({both}, 1) | shiftright({both}, 2) | shiftright({both}, 3)) & {ONES}L)"


def nonzero_flags(a: str) -> str:
    """One set bit per nibble that is not zero."""
    return f"(({a} | shiftright({a}, 1) | shiftright({a}, 2) | shiftright({a}, 3)) & {ONES}L)"


def match_count(flags: list[str]) -> str:
    return "(" + " + ".join(f"bit_count({f})" for f in flags) + ")"


def nibbles_all_set(prefix: str, start: int, stop: int) -> str:
    """True when every flag nibble in ``[start, stop)``, counted from the 3' end, is set."""
    tests = []
    for k in range(start // WORD, (stop - 1) // WORD + 1):
        lo, hi = max(start, k * WORD), min(stop, (k + 1) * WORD)
        const = sum(1 << (4 * (n - k * WORD)) for n in range(lo, hi))
        tests.append(f"({prefix}{k} & {const}L) = {const}L")
    return "(" + " AND ".join(tests) + ")"
