"""Choosing few out of many: informative validation cases and primer pairs that exclude a set of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_to_parquet


def _gains(cases: DataFrame, signatures: DataFrame, candidate: str) -> DataFrame:
    """Cases with ``gain``, the candidate pairs that share a signature and differ in the case.

    A pair is covered once some chosen case has told it apart, so uncovered pairs are those inside a signature group; no
    pair is ever written. Candidates without a row are in one further state together. A case's candidates (``held``) come
    from one row and follow each other in its task, so nothing but the panel is moved.
    """
    sizes = signatures.groupBy("sig").agg(F.count("*").alias("size"))
    told = [c for c in cases.columns if c not in ("held", "row")]
    rows = (cases.select(F.struct(*told).alias("head"), "row", F.posexplode("held"))
            .select(F.when(F.col("pos") == 0, F.col("head")).alias("head"), "row", F.col(f"col.{candidate}").alias(candidate), F.xxhash64("col.state").alias("state"))
            .join(F.broadcast(signatures.join(sizes, "sig")), candidate).select("head", "row", "sig", "state", "size"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gains(some: pa.Table) -> pa.RecordBatch:
            row, sig, state, size = (some[c].to_numpy() for c in ("row", "sig", "state", "size"))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            case = np.cumsum(np.diff(row, prepend=-1) != 0) - 1
            order = np.lexsort((state, sig, case))
            case, sig, state, size = case[order], sig[order], state[order], size[order]
            group = np.append(True, (case[1:] != case[:-1]) | (sig[1:] != sig[:-1]))
            kind = np.flatnonzero(np.append(True, group[1:] | (state[1:] != state[:-1])))
            n = np.diff(np.append(kind, len(case)))
            begin = np.flatnonzero(group)
            inside = np.searchsorted(kind, begin)
            seen, sq, size = np.add.reduceat(n, inside), np.add.reduceat(n * n, inside), size[begin]
            gain = np.zeros(len(first), np.int64)
            np.add.at(gain, case[begin], size * size - sq - (size - seen) ** 2)
            return pa.RecordBatch.from_arrays([some["head"].combine_chunks().take(pa.array(first)), pa.array(gain // 2)], ["head", "gain"])

        held = None
        for batch in batches:
            some = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            row = some["row"].to_numpy()
            # The last case may go on in the next batch.
            whole = int(np.flatnonzero(row != row[-1])[-1]) + 1 if len(row) and row[0] != row[-1] else 0
            if whole:
                yield gains(some.slice(0, whole))
            held = some.slice(whole)
        if held is not None and len(held):
            yield gains(held)

    return rows.mapInArrow(summed, f"head {dict(rows.dtypes)['head']}, gain long").select("head.*", "gain")


def informative_cases(states: DataFrame, cases: DataFrame, candidates: DataFrame, case: str, candidate: str, *, max_cases: int = 12) -> DataFrame:
    """Greedy cover of candidate pairs by cases: at most ``max_cases`` rows, in the order of choice.

    ``states`` (case, candidate, state) lists the candidates with a state of their own, each once; all others share one
    silent state. ``cases`` (case, role, grp): every case. Only cases that tell some pair apart can be chosen. Each round
    takes the case with the most pairs not yet told apart; ties go to more states, then a (role, group) not chosen yet,
    then off-targets, then the smaller case. A null role or group is a group of its own.

    The states of a case are gathered into one row, at most one entry a candidate. Each round is one pass over these rows
    without a shuffle, and none reads the states once every pair is covered: gains only fall.
    """
    panel = candidates.select(candidate).distinct()
    signatures = cut_lineage(panel.withColumn("sig", F.lit(0).cast("long")))
    own = (states.join(signatures.select(candidate), candidate).groupBy(case).agg(F.collect_list(F.struct(candidate, "state")).alias("held"))
           .join(signatures.agg(F.count("*").alias("panel")))
           .select(case, "held", (F.size(F.array_distinct(F.transform("held", lambda h: h["state"])))
                                  + F.when(F.col("panel") > F.size("held"), 1).otherwise(0)).cast("long").alias("n_states")))
    open_cases = cut_to_parquet(cases.select(case, "role", "grp").join(own, case).where("n_states > 1")
                                .withColumn("row", F.monotonically_increasing_id()))
    chosen: list[tuple] = []
    covered = False
    while len(chosen) < max_cases:
        rest = open_cases.where(~F.col(case).isin([c for c, *_ in chosen])) if chosen else open_cases
        if covered:
            scored = rest.select(case, "role", "grp", "n_states", F.lit(0).cast("long").alias("gain"))
        else:
            scored = _gains(rest, signatures, candidate)
        known = F.lit(False)
        for _, role, grp, *_ in chosen:
            known = known | (F.col("role").eqNullSafe(F.lit(role)) & F.col("grp").eqNullSafe(F.lit(grp)))
        best = scored.orderBy(F.desc("gain"), F.desc("n_states"), known.cast("int"),
                              F.coalesce((F.col("role") == "off_target").cast("int"), F.lit(0)).desc(), case).first()
        if best is None:
            break
        chosen.append((best[case], best["role"], best["grp"], best["gain"], best["n_states"]))
        covered = covered or best["gain"] == 0
        if not covered:
            mine = open_cases.where(F.col(case) == F.lit(best[case])).select(F.explode("held").alias("h")).select("h.*").distinct()
            sig = F.when(F.col("state").isNull(), F.xxhash64("sig")).otherwise(F.xxhash64("sig", "state"))
            signatures = cut_lineage(signatures.join(mine, candidate, "left").select(candidate, sig.alias("sig")))
    kind = dict(cases.dtypes)
    picked = cases.sparkSession.createDataFrame(
        [(n, *row) for n, row in enumerate(chosen, 1)],
        f"round long, {case} {kind[case]}, role {kind['role']}, grp {kind['grp']}, new_pairs long, n_states long")
    flags = (open_cases.where(F.col(case).isin([c for c, *_ in chosen])).select(case, F.explode("held").alias("h")).groupBy(case)
             .agg(F.bool_or(F.col("h.state") == "product_without_probe").alias("probe_disagreement"),
                  F.bool_or(F.col("h.state") == "no_product_terminal").alias("terminal_mismatch")))
    # At most max_cases rows.
    return picked.join(flags, case, "left").select("round", case, "role", "grp", "new_pairs", "n_states",
                                                   F.coalesce("probe_disagreement", F.lit(False)).alias("probe_disagreement"),
                                                   F.coalesce("terminal_mismatch", F.lit(False)).alias("terminal_mismatch"))


def discriminating_pairs(pairs: DataFrame, profile: DataFrame, keys: list[str], *, want: int | None = None) -> DataFrame:
    """Pairs of which one primer mismatches every off-target in its last five bases, best first within ``keys``.

    ``profile`` (oligo, n, max_ident, min_3prime_mismatch) has one row per oligo, folded over all off-targets, so a pair
    meets two rows however many off-targets there are. An oligo that lies on no off-target has no block and identity 100.
    Order: total block, strongest block, mean identity, score, then oligos and positions.
    """
    side = profile.select("oligo", F.col("min_3prime_mismatch").alias("block"), F.col("max_ident").alias("ident"))
    made = (pairs.join(side.select(F.col("oligo").alias("forward"), F.col("block").alias("f_block"), F.col("ident").alias("f_ident")), "forward", "left")
            .join(side.select(F.col("oligo").alias("reverse"), F.col("block").alias("r_block"), F.col("ident").alias("r_ident")), "reverse", "left"))
    made = made.fillna({"f_block": 0, "r_block": 0, "f_ident": 100.0, "r_ident": 100.0})
    made = (made.withColumn("total_block", F.col("f_block") + F.col("r_block")).withColumn("best_block", F.greatest("f_block", "r_block"))
            .where("best_block >= 1").withColumn("mean_ident", F.round((F.col("f_ident") + F.col("r_ident")) / 2.0, 6)))
    if want is None:
        return made
    order: list[Column] = [F.desc("total_block"), F.desc("best_block"), F.col("mean_ident"), F.col("score"), F.col("f_start"), F.col("r_end"),
                           F.col("forward"), F.col("reverse")]
    one = Window.partitionBy(*keys, "forward", "reverse").orderBy(*order)
    by = Window.partitionBy(*keys).orderBy(*order)
    return (made.withColumn("__nth", F.row_number().over(one)).where("__nth = 1").withColumn("place", F.row_number().over(by))
            .where(F.col("place") <= want).drop("__nth"))


def specialist_triplets(pairs: DataFrame, probes: DataFrame, keys: list[str], *, want: int = 6, per_pair: int = 3) -> DataFrame:
    """Discriminating triplets of one template: a probe for every pair first, then second and third probes in turn.

    ``pairs`` from :func:`discriminating_pairs` with ``place``; ``probes`` the probes attached to them, with ``probe_penalty``.
    Pairs without a probe give way to the next pair.
    """
    budget = max(8, min(want, (3 * want + 3) // 4))
    pair = [*keys, "forward", "reverse", "f_start", "r_end"]
    nth = Window.partitionBy(*pair).orderBy("probe_penalty", "probe", "p_strand", "p_start", "p_end")
    own = pairs.select(*pair, "place", "total_block", "best_block", "mean_ident").join(probes, pair)
    ranked = own.withColumn("depth", F.row_number().over(nth)).where(F.col("depth") <= per_pair)
    line = F.dense_rank().over(Window.partitionBy(*keys).orderBy("place"))
    turn = Window.partitionBy(*keys).orderBy("depth", "place")
    return (ranked.withColumn("pair_no", line).where(F.col("pair_no") <= budget)
            .withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= want).drop("place"))
