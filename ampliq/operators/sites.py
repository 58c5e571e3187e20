"""Oligo site search and the windows behind it.

Sites are found in ``site_blocks``. ``windows`` writes every window in the oligo's own 5'->3' orientation, so its last base is
the priming end on both strands; subjects are cut into overlapping chunks before any position is exploded: one long chromosome
becomes many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .site_blocks import list_sites

CHUNK = 2048


def strands(subjects: DataFrame, seq: str, which: str) -> DataFrame:
    """One row per strand; the minus strand is the reverse complement text."""
    rows = []
    if "+" in which:
        rows.append(F.struct(F.lit("+").alias("strand"), F.col(seq).alias("s")))
    if "-" in which:
        rows.append(F.struct(F.lit("-").alias("strand"), S.revcomp(F.col(seq)).alias("s")))
    return (subjects.withColumn("__o", F.explode(F.array(*rows)))
            .withColumn("strand", F.col("__o.strand")).withColumn("__s", F.col("__o.s")).drop("__o"))


def windows(subjects: DataFrame, keys: list[str], seq: str, max_len: int, which: str = "+-") -> DataFrame:
    """One row per 3' position with the packed bases that end there.

    ``q`` is the 0-based 3' position in strand coordinates, so ``q + 1`` bases are available;
    ``slen`` is the subject length and ``m0, m1, ...`` are the right-aligned base masks of the up
    to ``max_len`` bases ending at ``q``.
    """
    both = strands(subjects, seq, which).withColumn("slen", F.length("__s")).filter(F.col("slen") > 0)
    starts = F.sequence(F.lit(0), F.col("slen") - 1, F.lit(CHUNK))
    chunks = (both.withColumn("base", F.explode(starts))
              .withColumn("off", F.least(F.col("base"), F.lit(max_len - 1)))
              .withColumn("piece", F.translate(F.substr(F.col("__s"), F.col("base") - F.col("off") + 1,
                                                        F.col("off") + CHUNK), S.IUPAC_LETTERS, S.IUPAC_HEX))
              .select(*keys, "strand", "slen", "base", "off", "piece"))
    # Text is read once a block of WORD positions; the words of a position are two neighbouring blocks shifted together.
    n_words = S.word_count(max_len)
    blocks = [S.hex_word(f"rpad(substr(piece, off + b + 1, {S.WORD}), {S.WORD}, '0')")]
    for k in range(n_words):
        stop = f"(off + b - {k * S.WORD})"
        first = f"greatest({stop} - {S.WORD}, 0)"
        blocks.append(S.hex_word(f"substr(piece, {first} + 1, greatest({stop} - {first}, 0))"))
    cut = (chunks.withColumn("b", F.expr(f"explode(sequence(0, length(piece) - off - 1, {S.WORD}))"))
           .select(*keys, "strand", "slen", F.expr("base + b").alias("first"), F.expr(f"least({S.WORD - 1}, length(piece) - off - b - 1)").alias("more"),
                   *[F.expr(v).alias(f"v{k}") for k, v in enumerate(blocks)]))
    full = (1 << 4 * S.WORD) - 1
    words = [F.expr(f"(shiftright(v{k}, 4 * ({S.WORD - 1} - i)) | shiftleft(v{k + 1}, 4 * (i + 1))) & {full}L").alias(f"m{k}") for k in range(n_words)]
    return (cut.withColumn("i", F.expr("explode(sequence(0, more))"))
            .select(*keys, "strand", "slen", F.expr("first + i").alias("q"), *words))


def find_sites(
    oligos: DataFrame,
    subjects: DataFrame,
    *,
    oligo_keys: list[str],
    subject_keys: list[str],
    oligo: str = "oligo",
    seq: str = "seq",
    max_mm: int = 2,
    anchor: int = 3,
    exact_tail: bool = False,
    which: str = "+-",
    max_len: int = 60,
    subject_n_matches: bool = True,
    strand_of_oligo: str | None = None,
    site: bool = False,
) -> DataFrame:
    """All sites of every oligo on every subject with at most ``max_mm`` mismatches.

    ``anchor`` bases at the 3' end must match. With ``exact_tail`` the anchor alone is the seed
    (priming-zone search); otherwise ``max_mm + 1`` blocks before the anchor are the seeds.
    Coordinates ``lo``/``hi`` are 0-based inclusive on the plus strand. An ambiguous subject
    base is a possible match unless ``subject_n_matches`` is off, in which case only A, C, G, T
    of the subject can match. ``strand_of_oligo`` names a column that restricts an oligo to one
    strand. ``site`` adds the letters of the site as the oligo reads them.
    """
    alphabet = S.IUPAC_LETTERS if subject_n_matches else "ACGT"
    known = oligos.filter(F.length(oligo) >= F.lit(max(anchor, 1 if exact_tail else max_mm + 1)))
    checked = known.withColumn(
        oligo, F.when(F.length(oligo) > max_len, F.raise_error(F.lit("oligo longer than max_len")))
        .otherwise(F.col(oligo)))
    on = F.lit(which) if strand_of_oligo is None else F.when(F.instr(F.lit(which), F.col(strand_of_oligo)) > 0, F.col(strand_of_oligo)).otherwise("")
    clean = subjects.withColumn(seq, F.regexp_replace(seq, f"[^{alphabet}]", "0"))
    return list_sites(checked.withColumn("__on", on), clean, oligo_keys=oligo_keys, subject_keys=subject_keys, oligo=oligo, seq=seq,
                      max_len=max_len, on="__on", max_mm=max_mm, anchor=anchor, exact_tail=exact_tail, site=site)
