"""Candidate generation: windows, gates, pairs, probes, scores and diverse retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo as T
from . import interactions as I

DIMER_FLOOR = -5.5
HAIRPIN_FLOOR = -3.0


def chemistry_order(seq: Column) -> Column:
    """Chemistries to try, by composition: AT-rich below 40 % GC, GC-rich above 62 %."""
    def names(*keys: str) -> Column:
        return F.array(*[F.lit(k) for k in keys])

    gc = S.gc_percent(seq)
    return (F.when(gc < 40.0, names("parasite_mtdna", "idt_taqman", "gc_rich", "parasite_sybr"))
            .when(gc > 62.0, names("gc_rich", "idt_taqman", "parasite_mtdna", "sybr_generic"))
            .otherwise(names("idt_taqman", "biorad_probe", "thermo_taqman", "sybr_generic")))


def quality_flags(seq: Column) -> tuple[Column, Column]:
    """Red flags of an oligo (runs, dinucleotide repeats, extreme GC) and their penalty."""
    run, pairs, gc = S.longest_run(seq), S.longest_dinucleotide_repeat(seq), S.gc_percent(seq)
    flags = F.array_compact(F.array(
        F.when(run >= 5, F.concat(run.cast("string"), F.lit("-base run"))),
        F.when(pairs >= 3, F.concat(pairs.cast("string"), F.lit("x dinucleotide repeat"))),
        F.when(gc > 72, "GC high").when(gc < 28, "GC low")))
    penalty = (F.when(run >= 6, 2.0).when(run == 5, 0.5).otherwise(0.0)
               + F.when(pairs >= 4, 2.0).when(pairs == 3, 0.8).otherwise(0.0)
               + F.when(gc > 72, 1.5).when(gc < 28, 1.0).otherwise(0.0))
    return flags, penalty


def window_starts(length: Column, window: int, max_windows: int, step: int, *, limit: bool = False) -> Column:
    """Starts that span a target: an even grid of ``max_windows`` joined with a fixed-step grid.

    With ``limit`` a target whose joint grid is larger keeps the even grid alone; the default searches all starts.
    """
    span = F.greatest(length - window, F.lit(0))
    even = F.transform(F.sequence(F.lit(0), F.lit(max_windows - 1)),
                       lambda i: F.bround(i * span / F.lit(max(1, max_windows - 1)), 0).cast("int"))
    stepped = F.transform(F.sequence(F.lit(0), span, F.lit(step)), lambda x: x.cast("int"))
    grid = F.array_sort(F.array_distinct(F.concat(even, stepped)))
    if limit:
        grid = F.when(F.size(grid) <= max_windows, grid).otherwise(F.array_sort(F.array_distinct(even)))
    return F.when(span == 0, F.array(F.lit(0))).otherwise(grid)


def enumerate_windows(templates: DataFrame, keys: list[str], seq: str, len_min: int, len_max: int) -> DataFrame:
    """Every window of every length on both strands, half-open plus-strand coordinates."""
    starts = (templates.filter(F.length(seq) >= len_min)
              .select(*keys, F.col(seq).alias("__t"),
                      F.explode(F.sequence(F.lit(0), F.length(seq) - len_min)).alias("start")))
    sized = starts.select(*keys, "start", "__t", F.explode(F.sequence(
        F.lit(len_min), F.least(F.lit(len_max), F.length("__t") - F.col("start")))).alias("k"))
    genomic = sized.select(*keys, "start", (F.col("start") + F.col("k")).alias("end"),
                           F.substr("__t", F.col("start") + 1, F.col("k")).alias("__g"))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("__g").alias("oligo")),
                   F.struct(F.lit("-").alias("strand"), S.revcomp(F.col("__g")).alias("oligo")))
    return genomic.withColumn("__s", F.explode(both)).select(*keys, "start", "end", "__s.strand", "__s.oligo")


def primer_rejection(seq: Column, c: dict, *, cond: T.Conditions = T.Conditions(), structure: bool = True, tm: Column | None = None) -> Column:
    """First failed gate of a primer, null when it passes; cheap gates come first. ``tm``: its temperature, where known."""
    gc = S.gc_percent(seq)
    tm = T.melting_temperature(seq, cond) if tm is None else tm
    out = (F.when(~F.length(seq).between(c["len_min"], c["len_max"]), "length")
           .when(~gc.between(c["gc_min"], c["gc_max"]), "gc")
           .when(~F.coalesce(tm.between(c["tm_min"], c["tm_max"]), F.lit(False)), "tm"))
    if c["no_three_prime_t"]:
        out = out.when(F.right(seq, F.lit(1)) == "T", "three_prime_T")
    out = (out.when(S.last5_gc(seq) > c["max_3prime_gc"], "three_prime_gc")
           .when(S.longest_run(seq, "G") >= c["max_g_run"], "g_run")
           .when(S.longest_run(seq) >= c["max_any_run"], "homopolymer"))
    if structure:
        runs = I.stable_runs(seq, max(c["hairpin_min"], c["self_dimer_min"]))
        out = (out.when(I.hairpin_energy(runs, seq) <= c["hairpin_min"], "hairpin_at_anneal")
               .when(I.pair_energy(runs, seq) <= c["self_dimer_min"], "self_dimer_at_anneal"))
    return out


def attrition(gated: DataFrame, keys: list[str], reason: str = "rejection") -> DataFrame:
    """Entered and per-reason counts of one stage; retained rows carry a null reason."""
    return (gated.groupBy(*keys, F.coalesce(F.col(reason), F.lit("retained")).alias("outcome"))
            .agg(F.count("*").alias("n")))


def pair_primers(primers: DataFrame, keys: list[str], c: dict, *, dimers: bool = True) -> DataFrame:
    """Forward and reverse primers of one template within the size, gap and Tm limits.

    ``primers`` carry ``start, end, strand, oligo, tm``. The size limit is a range on positions,
    so pairs meet on a position bucket of the maximum product size.
    """
    width = max(int(c["amp_max"]), 1)
    f = primers.filter("strand = '+'").select(
        *keys, F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("oligo").alias("forward"),
        F.col("tm").alias("f_tm"), *([F.col("runs").alias("f_runs")] if dimers else []),
        F.floor(F.col("start") / width).alias("bucket"))
    r = primers.filter("strand = '-'").select(
        *keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("oligo").alias("reverse"),
        F.col("tm").alias("r_tm"),
        F.explode(F.sequence(F.floor((F.col("end") - c["amp_max"]) / width),
                             F.floor((F.col("end") - c["amp_min"]) / width))).alias("bucket"))
    amp, gap = F.col("r_end") - F.col("f_start"), F.abs(F.col("f_tm") - F.col("r_tm"))
    pairs = (f.join(r, [*keys, "bucket"]).drop("bucket")
             .withColumn("amplicon", amp).filter(F.col("amplicon").between(c["amp_min"], c["amp_max"]))
             .filter(F.col("r_start") - F.col("f_end") >= c["min_probe_gap"])
             .withColumn("tm_gap", gap).filter(F.col("tm_gap") <= c["pair_tm_gap_max"])
             .withColumn("score", F.abs((F.col("f_tm") + F.col("r_tm")) / 2 - c["tm_opt"]) + F.col("tm_gap")))
    if dimers:
        pairs = (pairs.withColumn("dimer", I.pair_energy(F.col("f_runs"), F.col("reverse"))).drop("f_runs")
                 .filter(F.col("dimer") > c["pair_dimer_min"])
                 .withColumn("score", F.col("score") + 2.0 * F.greatest(F.lit(0.0), DIMER_FLOOR - F.col("dimer"))))
    return pairs


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")


def probe_rejection(seq: Column, c: dict) -> Column:
    """First failed pair-independent probe gate."""
    return (F.when(F.instr(F.left(seq, F.lit(3)), "G") > 0, "five_prime_G")
            .when(S.count_of(seq, "C") < S.count_of(seq, "G"), "more_G_than_C")
            .when(S.longest_run(seq, "G") >= c["max_g_run"], "g_run")
            .when(S.longest_run(seq) >= c["max_any_run"], "homopolymer"))


def attach_probes(pairs: DataFrame, probes: DataFrame, keys: list[str], c: dict) -> DataFrame:
    """Probes that lie between the primers of a pair and melt in the offset window above them.

    Probe windows are enumerated once per template; the interval containment meets on position
    buckets no wider than a product.
    """
    width = max(int(c["amp_max"]), 1)
    p = probes.select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                      F.col("strand").alias("p_strand"), F.col("oligo").alias("probe"), F.col("tm").alias("p_tm"),
                      F.floor(F.col("start") / width).alias("bucket"))
    spread = pairs.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("f_end") / width), F.floor(F.col("r_start") / width))))
    offset = F.col("p_tm") - F.greatest("f_tm", "r_tm")
    best = min(max(c["probe_offset_min"], 9.0), c["probe_offset_max"])
    return (spread.join(p, [*keys, "bucket"]).drop("bucket")
            .filter((F.col("f_end") <= F.col("p_start")) & (F.col("p_end") <= F.col("r_start")))
            .withColumn("offset", offset)
            .filter(F.col("offset").between(c["probe_offset_min"], c["probe_offset_max"]))
            .withColumn("probe_penalty", F.abs(F.col("offset") - best)))


def assay_score(c: dict, *, f_tm: str = "f_tm", r_tm: str = "r_tm", amplicon: str = "amplicon",
                dimer: Column | None = None, offset: Column | None = None, hairpin: Column | None = None) -> Column:
    """Preliminary score of a whole assay, lower is better."""
    ft, rt, amp = F.col(f_tm), F.col(r_tm), F.col(amplicon)
    score = F.abs((ft + rt) / 2.0 - c["tm_opt"]) + 1.5 * F.abs(ft - rt) + 0.20 * F.greatest(amp - 150, F.lit(0))
    if dimer is not None:
        score = score + 2.0 * F.greatest(F.lit(0.0), DIMER_FLOOR - dimer)
    if offset is not None:
        best = min(max(c["probe_offset_min"], 9.0), c["probe_offset_max"])
        score = score + 0.35 * F.abs(offset - best)
    if hairpin is not None:
        score = score + 1.5 * F.greatest(F.lit(0.0), HAIRPIN_FLOOR - hairpin)
    return score


def _near_capped(df: DataFrame, keys: list[str], near: list[Column], order: list[Column], per_near: int) -> DataFrame:
    w = Window.partitionBy(*keys, *near).orderBy(*order)
    return df.withColumn("__near", F.row_number().over(w))


def retain_diverse_pairs(pairs: DataFrame, keys: list[str], *, limit: int = 24, region: int = 120,
                         amplicon_bin: int = 25, per_near: int = 2) -> DataFrame:
    """Pair beam: one pair per region first, then one per (region, length band) and pass.

    Every input row comes back with ``decision`` retained or the reason it was dropped.
    """
    order = [F.col("score"), F.col("forward"), F.col("reverse"), F.col("f_start"), F.col("r_end")]
    near = [F.floor(F.col("f_start") / 10), F.floor(F.col("r_end") / 10), F.floor(F.col("amplicon") / amplicon_bin)]
    df = _near_capped(pairs, keys, near, order, per_near)
    kept = F.col("__near") <= per_near
    df = df.withColumn("region", F.floor(F.col("f_start") / region)).withColumn("band", F.floor(F.col("amplicon") / amplicon_bin))
    by_region = Window.partitionBy(*keys, "region").orderBy(F.when(kept, 0).otherwise(1), *order)
    df = df.withColumn("__first", kept & (F.row_number().over(by_region) == 1))
    rest = kept & ~F.col("__first")
    by_stratum = Window.partitionBy(*keys, "region", "band", rest).orderBy(*order[:1], *order[1:])
    df = df.withColumn("__depth", F.when(F.col("__first"), 0).otherwise(F.row_number().over(by_stratum)))
    # Strata take turns in the order of their text form, as "(region, band)" sorts.
    stratum = F.concat(F.lit("("), F.col("region"), F.lit(", "), F.col("band"), F.lit(")"))
    line = Window.partitionBy(*keys, kept).orderBy(
        "__depth", F.when(F.col("__first"), F.lpad(F.col("region").cast("string"), 12, "0")).otherwise(stratum))
    df = df.withColumn("__line", F.row_number().over(line))
    decision = (F.when(~kept, "near_duplicate_budget").when(F.col("__line") > limit, "diversity_beam_budget")
                .otherwise("retained"))
    return df.withColumn("decision", decision).drop("__near", "__first", "__depth", "__line")


def retain_diverse_probes(probes: DataFrame, keys: list[str], *, limit: int = 4, position_bin: int = 8,
                          offset_bin: float = 1.5) -> DataFrame:
    """Probe beam: the best of each strand first, then one per (strand, position, offset) and pass."""
    order = [F.col("probe_penalty"), F.col("probe"), F.col("p_strand"), F.col("p_start"), F.col("p_end")]
    by_strand = Window.partitionBy(*keys, "p_strand").orderBy(*order)
    df = probes.withColumn("__first", F.row_number().over(by_strand) == 1)
    stratum = F.concat(F.lit("('"), "p_strand", F.lit("', "), F.floor(F.col("p_start") / position_bin), F.lit(", "),
                       F.bround(F.col("offset") / offset_bin, 0).cast("int"), F.lit(")"))
    df = df.withColumn("__stratum", stratum)
    by_stratum = Window.partitionBy(*keys, "__stratum", "__first").orderBy(*order)
    df = df.withColumn("__depth", F.when(F.col("__first"), 0).otherwise(F.row_number().over(by_stratum)))
    line = Window.partitionBy(*keys).orderBy(
        "__depth", F.when(F.col("__first"), F.col("probe_penalty")), "__stratum", *order)
    df = df.withColumn("__line", F.row_number().over(line))
    decision = F.when(F.col("__line") > limit, "diversity_beam_budget").otherwise("retained")
    return df.withColumn("decision", decision).drop("__first", "__depth", "__line", "__stratum")


def retain_diverse_assays(assays: DataFrame, keys: list[str], *, limit: int = 160, region: int = 250,
                          per_region: int = 16, per_near: int = 2, score: str = "score") -> DataFrame:
    """Assay beam: best per region, then round robin to ``per_region``, then global fill.

    Regions take turns in the order of their best score. The three phases become one sort key, so
    the beam is a fixed number of window passes whatever the pool size.
    """
    ident = [F.col("forward"), F.col("reverse"), F.coalesce(F.col("probe"), F.lit(""))]
    order = [F.col(score), *ident]
    dup = Window.partitionBy(*keys, *ident).orderBy(F.col(score), "f_start", "r_end")
    df = assays.withColumn("__dup", F.row_number().over(dup))
    near = [F.floor(F.col("f_start") / 12), F.floor(F.col("r_end") / 12),
            F.floor(F.coalesce(F.col("p_start"), F.lit(0)) / 12), F.floor(F.col("amplicon") / 10), F.col("__dup") == 1]
    df = _near_capped(df, keys, near, order, per_near)
    kept = (F.col("__dup") == 1) & (F.col("__near") <= per_near)
    df = df.withColumn("region", F.floor(F.col("f_start") / region)).withColumn("__kept", kept)
    in_region = Window.partitionBy(*keys, "__kept", "region")
    df = (df.withColumn("__depth", F.row_number().over(in_region.orderBy(*order)) - 1)
          .withColumn("__best", F.min(score).over(in_region)))
    phase = F.when(F.col("__depth") == 0, 0).when(F.col("__depth") < per_region, 1).otherwise(2)
    df = df.withColumn("__phase", phase)
    turn = F.when(F.col("__phase") < 2, F.col("__depth"))
    region_turn = F.when(F.col("__phase") < 2, F.struct("__best", "region"))
    line = Window.partitionBy(*keys, "__kept").orderBy("__phase", turn, region_turn, *order)
    df = df.withColumn("__line", F.row_number().over(line))
    decision = (F.when(F.col("__dup") > 1, "exact_duplicate").when(~F.col("__kept"), "near_duplicate_budget")
                .when(F.col("__line") > limit, "regional_or_global_budget").otherwise("retained"))
    return df.withColumn("decision", decision).drop(*[c for c in df.columns if c.startswith("__")])


def synthetic_fragment(template: Column, f_start: Column, r_end: Column, *, flank: int = 40, min_len: int = 125) -> Column:
    """Amplicon with flanks, widened inside the template to ``min_len`` and padded if it cannot reach it.

    One base is added on each open side per step until the length is reached, in closed form.
    """
    n = F.length(template)
    s = F.greatest(f_start - flank, F.lit(0))
    e = F.least(r_end + flank, n)
    need = F.greatest(F.lit(min_len) - (e - s), F.lit(0))
    # Both sides grow together; a side that hits the template edge leaves the rest to the other.
    left_room, right_room = s, n - e
    both = F.least(F.ceil(need / 2).cast("int"), F.least(left_room, right_room))
    rest = F.greatest(need - 2 * both, F.lit(0))
    more_left = F.least(rest, left_room - both)
    more_right = F.least(rest, right_room - both)
    s2 = s - both - F.when(right_room > both, F.lit(0)).otherwise(more_left)
    e2 = e + both + F.when(right_room > both, more_right).otherwise(F.lit(0))
    block = F.substr(template, s2 + 1, e2 - s2)
    pad = F.substr(F.repeat(F.lit(FILLER), F.lit(min_len // len(FILLER) + 1)), F.lit(1), F.greatest(F.lit(min_len) - F.length(block), F.lit(0)))
    return F.concat(block, pad)


# Fixed value: balanced filler appended to fragments whose template is too short.
FILLER = ("GCATAGCTGACTGATCAGCTAGTCGATCAGTACGATCGTAGCATCGTAGCTAGCT"
          "GACGTACGATCGATCAGCTAGCATCGATGCATCGATCGATCGTACGTAGCATGCA")


def lint_oligos(oligos: DataFrame, keys: list[str], oligo: str, role: str, c: dict) -> DataFrame:
    """One row per oligo and rule: PASS, WARN or FAIL."""
    s = F.col(oligo)
    runs = F.col("__runs")
    tm = F.col("__tm")

    def rule(name: str, ok: Column, bad: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.when(ok, "PASS").otherwise(F.lit(bad)).alias("status"))

    degenerate = rule("no degenerate bases", ~s.rlike("[^ACGTN]"), "WARN")
    self_dimer = rule("self-dimer", I.pair_energy(runs, s) > c["self_dimer_min"], "WARN")
    if role == "probe":
        rules = [degenerate, rule("length", F.length(s).between(c["probe_len_min"], c["probe_len_max"]), "FAIL"),
                 rule("5' not G", F.left(s, F.lit(1)) != "G", "FAIL"),
                 rule("no G in first 3", F.instr(F.left(s, F.lit(3)), "G") == 0, "WARN"),
                 rule("more C than G", S.count_of(s, "C") >= S.count_of(s, "G"), "FAIL"),
                 rule("probe Tm above primers", tm >= c["tm_min"] + c["probe_offset_min"], "WARN"),
                 rule("hairpin", I.hairpin_energy(runs, s) > c["probe_hairpin_min"], "WARN"), self_dimer]
    else:
        rules = [degenerate, rule("length", F.length(s).between(c["len_min"], c["len_max"]), "FAIL"),
                 rule("GC%", S.gc_percent(s).between(c["gc_min"], c["gc_max"]), "FAIL"),
                 rule("Tm", tm.between(c["tm_min"], c["tm_max"]), "FAIL"),
                 rule("3' clamp", S.last5_gc(s) <= c["max_3prime_gc"], "FAIL"),
                 rule("G-run", S.longest_run(s, "G") < c["max_g_run"], "FAIL"),
                 rule("homopolymer", S.longest_run(s) < c["max_any_run"], "FAIL"),
                 rule("hairpin", I.hairpin_energy(runs, s) > c["hairpin_min"], "WARN"), self_dimer]
        if c["no_three_prime_t"]:
            rules.append(rule("3' not T", F.right(s, F.lit(1)) != "T", "WARN"))
        if c["min_3prime_gc"]:
            rules.append(rule("3' GC clamp present", S.last5_gc(s) >= c["min_3prime_gc"], "WARN"))
    ready = (oligos.withColumn("__runs", I.stable_runs(s, -1.0)).withColumn("__tm", T.melting_temperature(s)))
    return ready.withColumn("__r", F.explode(F.array(*rules))).select(*keys, "__r.rule", "__r.status")


def lint_pairs(pairs: DataFrame, keys: list[str], c: dict) -> DataFrame:
    """Pair rules: Tm match, cross dimer and product size."""
    runs = I.stable_runs(F.col("forward"), c["pair_dimer_min"])

    def rule(name: str, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))

    rules = F.array(
        rule("pair Tm match", F.abs(F.col("f_tm") - F.col("r_tm")) <= c["pair_tm_gap_max"]),
        rule("F x R dimer", I.pair_energy(runs, F.col("reverse")) > c["pair_dimer_min"]),
        rule("amplicon size", F.col("amplicon").between(c["amp_min"], c["amp_max"])))
    return pairs.withColumn("__r", F.explode(rules)).select(*keys, "__r.rule", "__r.status")


def degenerate_consensus(votes: DataFrame, keys: list[str], oligo: str, *, min_count: int = 2, min_share: float = 0.18) -> DataFrame:
    """Ambiguity-coded oligo from per-position base votes (``pos, base, n``).

    A base is kept with at least ``min_count`` votes and ``min_share`` of the position; the
    majority base always stays.
    """
    codes = F.create_map(*[x for code, bases in S.IUPAC_SETS.items() for x in (F.lit("".join(sorted(bases))), F.lit(code))])
    w = Window.partitionBy(*keys, "pos")
    marked = (votes.withColumn("total", F.sum("n").over(w))
              .withColumn("top", F.row_number().over(w.orderBy(F.desc("n"), "base")) == 1))
    kept = marked.filter(F.col("top") | ((F.col("n") >= min_count) & (F.col("n") / F.col("total") >= min_share)))
    letters = kept.groupBy(*keys, oligo, "pos").agg(
        F.array_join(F.sort_array(F.collect_set("base")), "").alias("set"))
    coded = letters.withColumn("letter", F.element_at(codes, F.col("set")))
    return coded.groupBy(*keys, oligo).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"),
        F.count_if(F.length("set") > 1).alias("n_degenerate"))
