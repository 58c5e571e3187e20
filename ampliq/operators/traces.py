"""Amplification and melt traces: every well is one window partition of a long table.

A well holds tens of readings, so partitions stay small and even however many runs there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_traces(wells: DataFrame, keys: list[str], fluor: str = "fluor", cycles: str | None = None) -> DataFrame:
    """Array columns to one row per reading; cycles default to 1..n."""
    axis = (F.col(cycles).cast("array<double>") if cycles
            else F.transform(F.col(fluor), lambda _, i: (i + 1).cast("double")))
    pairs = F.arrays_zip(axis.alias("x"), F.col(fluor).cast("array<double>").alias("y"))
    return (wells.select(*keys, F.posexplode(pairs).alias("ix", "p"))
            .select(*keys, "ix", F.col("p")["x"].alias("cycle"), F.col("p")["y"].alias("fluor")))


def trace_errors(trace: DataFrame, keys: list[str], min_points: int = 6) -> DataFrame:
    """One row per unusable well with the first reason that applies."""
    w = Window.partitionBy(*keys).orderBy("ix")
    stepped = trace.withColumn("step", F.col("cycle") - F.lag("cycle").over(w))
    bad = F.isnan("fluor") | F.col("fluor").isNull() | F.col("cycle").isNull()
    facts = stepped.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.min("step").alias("step"))
    reason = (F.when(F.col("n") < min_points, F.lit(f"need >= {min_points} cycles of fluorescence"))
              .when(F.col("bad"), "trace_not_finite")
              .when(F.col("step") <= 0, "cycles_not_increasing"))
    return facts.select(*keys, reason.alias("error")).filter("error is not null")


def smooth3(df: DataFrame, keys: list[str], order: str, col: str, passes: int = 2) -> DataFrame:
    """Three-point moving mean, end points untouched, applied ``passes`` times."""
    w = Window.partitionBy(*keys).orderBy(order)
    for _ in range(passes):
        before, after = F.lag(col).over(w), F.lead(col).over(w)
        smoothed = F.when(before.isNull() | after.isNull(), F.col(col)).otherwise((before + F.col(col) + after) / 3.0)
        df = df.withColumn(col, smoothed)
    return df


def detrend(trace: DataFrame, keys: list[str], lo: float = 3.0, hi: float = 15.0) -> DataFrame:
    """Subtract the least-squares baseline of the cycles in ``[lo, hi]``.

    With fewer than three such cycles the first max(3, n/5) readings are the baseline.
    """
    well = Window.partitionBy(*keys)
    order = well.orderBy("cycle")
    df = (trace.withColumn("k", F.row_number().over(order) - 1)
          .withColumn("n", F.count("*").over(well))
          .withColumn("n_base", F.count_if(F.col("cycle").between(lo, hi)).over(well)))
    first = F.least(F.col("n"), F.greatest(F.lit(3), F.floor(F.col("n") / 5)))
    in_base = F.when(F.col("n_base") >= 3, F.col("cycle").between(lo, hi)).otherwise(F.col("k") < first)
    df = df.withColumn("in_base", in_base)
    y = F.when(F.col("in_base"), F.col("fluor"))
    x = F.when(F.col("in_base"), F.col("cycle"))
    df = (df.withColumn("slope", F.coalesce(F.regr_slope(y, x).over(well), F.lit(0.0)))
          .withColumn("base_mean", F.avg(y).over(well)).withColumn("x_mean", F.avg(x).over(well))
          .withColumn("start", F.max(F.when(F.col("in_base"), F.col("k"))).over(well) + 1))
    resid = F.col("fluor") - (F.col("base_mean") + F.col("slope") * (F.col("cycle") - F.col("x_mean")))
    df = df.withColumn("resid", resid)
    base_resid = F.when(F.col("in_base"), F.col("resid"))
    noise = F.when(F.count(base_resid).over(well) > 2, F.stddev_samp(base_resid).over(well)).otherwise(F.lit(0.0))
    return df.withColumn("noise", noise).drop("x_mean")


def _interpolated(x1: Column, x2: Column, y1: Column, y2: Column, thr: Column) -> Column:
    positive = (y1 > 0) & (y2 > 0) & (thr > 0)
    log_den = F.log10(F.when(positive, y2)) - F.log10(F.when(positive, y1))
    log_cq = x1 + (F.log10(thr) - F.log10(F.when(positive, y1))) / log_den * (x2 - x1)
    lin_cq = x1 + (thr - y1) / (y2 - y1) * (x2 - x1)
    return F.when(y1 == y2, x2).when(positive & (log_den != 0), log_cq).otherwise(lin_cq)


def call_cq(trace: DataFrame, keys: list[str], *, threshold: float | None = None, sd_mult: float = 10.0,
            sustain: int = 3, lo: float = 3.0, hi: float = 15.0) -> DataFrame:
    """Threshold and second-derivative Cq per well behind the amplification-shape gate."""
    base = detrend(trace, keys, lo, hi)
    well = Window.partitionBy(*keys)
    order = well.orderBy("cycle")
    ahead = order.rowsBetween(0, sustain - 1)
    thr = F.lit(float(threshold)) if threshold is not None else F.greatest(sd_mult * F.col("noise"), F.lit(1e-12))
    df = (base.withColumn("thr", thr)
          .withColumn("low3", F.min("resid").over(ahead)).withColumn("n3", F.count("*").over(ahead))
          .withColumn("prev", F.lag("resid").over(order)).withColumn("prev_c", F.lag("cycle").over(order)))
    sustained = ((F.col("k") >= F.greatest(F.col("start"), F.lit(1))) & (F.col("n3") == sustain)
                 & (F.col("low3") >= F.col("thr")))
    df = df.withColumn("cq_here", F.when(sustained, _interpolated(
        F.col("prev_c"), F.col("cycle"), F.col("prev"), F.col("resid"), F.col("thr"))))
    tail_n = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("n") / 10)))
    post = F.col("k") >= F.col("start")
    rise = post & (F.col("k") > F.col("start")) & (F.col("resid") > F.col("prev"))
    df = smooth3(df.withColumn("y", F.col("resid")), keys, "cycle", "y", passes=2)
    lead_c, lag_c = F.lead("cycle").over(order), F.lag("cycle").over(order)
    left = (F.col("y") - F.lag("y").over(order)) / (F.col("cycle") - lag_c)
    right = (F.lead("y").over(order) - F.col("y")) / (lead_c - F.col("cycle"))
    df = df.withColumn("d2", 2.0 * (right - left) / (lead_c - lag_c))
    y0, y1, y2 = F.lag("d2").over(order), F.col("d2"), F.lead("d2").over(order)
    denom = y0 - 2.0 * y1 + y2
    delta = F.when(denom != 0, 0.5 * (y0 - y2) / denom).otherwise(F.lit(0.0))
    vertex = F.when(denom.isNotNull() & delta.between(-1.0, 1.0),
                    F.col("cycle") + delta * (lead_c - lag_c) / 2.0).otherwise(F.col("cycle"))
    df = df.withColumn("vertex", vertex)
    out = df.groupBy(*keys).agg(
        F.max("n").alias("n_cycles"), F.max("thr").alias("threshold"), F.max("noise").alias("noise"),
        F.max("base_mean").alias("baseline_fluor"), F.max("slope").alias("baseline_slope"),
        (F.max("n_base") < 3).alias("baseline_fallback"),
        F.min(F.when(sustained, F.struct("k", "cq_here"))).getField("cq_here").alias("cq_raw"),
        F.max_by(F.when(y1_positive(), F.col("vertex")),
                 F.when(F.col("d2").isNotNull(), F.struct(F.col("d2"), -F.col("k")))).alias("sdm_raw"),
        (F.max(F.when(post, F.col("resid"))) - F.min(F.when(post, F.col("resid")))).alias("amplitude"),
        (F.count_if(rise) / F.greatest(F.count_if(post) - 1, F.lit(1))).alias("rise_fraction"),
        F.avg(F.when(F.col("n") - F.col("k") <= tail_n, F.col("resid"))).alias("tail"))
    amplified = (F.col("cq_raw").isNotNull()
                 & (F.col("amplitude") >= F.greatest(10.0 * F.col("noise"), 3.0 * F.col("threshold"), F.lit(1e-12)))
                 & (F.col("tail") >= F.greatest(1.5 * F.col("threshold"), 5.0 * F.col("noise")))
                 & (F.col("rise_fraction") >= 0.45))
    out = out.withColumn("amplified", F.coalesce(amplified, F.lit(False)))
    return (out.withColumn("cq_threshold", F.when(F.col("amplified"), F.col("cq_raw")))
            .withColumn("cq_sdm", F.when(F.col("amplified"), F.col("sdm_raw")))
            .drop("cq_raw", "sdm_raw"))


def y1_positive() -> Column:
    return F.col("d2") > 0


def melt_peaks(melts: DataFrame, keys: list[str], *, min_prominence: float = 0.10) -> DataFrame:
    """Local maxima of -dF/dT above the prominence floor, refined by a parabola."""
    well = Window.partitionBy(*keys)
    order = well.orderBy("temp")
    df = smooth3(melts.withColumn("y", F.col("fluor")), keys, "temp", "y", passes=2)
    dt = F.lead("temp").over(order) - F.lag("temp").over(order)
    slope = F.when(dt != 0, -(F.lead("y").over(order) - F.lag("y").over(order)) / dt)
    df = (df.withColumn("dt", dt).withColumn("d", F.coalesce(slope, F.lit(0.0)))
          .withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(well)))
    df = df.withColumn("dmax", F.max("d").over(well))
    d, m1, p1 = F.col("d"), F.lag("d", 1).over(order), F.lead("d", 1).over(order)
    m2, p2 = F.lag("d", 2).over(order), F.lead("d", 2).over(order)
    denom = m1 - 2 * d + p1
    delta = F.when(denom != 0, 0.5 * (m1 - p1) / denom).otherwise(F.lit(0.0))
    tm = F.col("temp") + F.when(delta.between(-1.0, 1.0), delta * F.col("dt") / 2.0).otherwise(F.lit(0.0))
    peak = ((F.col("dmax") > 0) & (d >= min_prominence * F.col("dmax")) & (d >= m1) & (d >= p1) & (d > m2) & (d > p2)
            & (F.col("k") >= 2) & (F.col("k") < F.col("n") - 2))
    return (df.withColumn("is_peak", peak).withColumn("tm", tm).filter("is_peak")
            .select(*keys, F.round("tm", 2).alias("tm"), F.round("d", 4).alias("height"), "k"))


def merge_peaks(peaks: DataFrame, keys: list[str], *, gap: float = 0.8) -> DataFrame:
    """Keep peaks from the tallest down, dropping any within ``gap`` degrees of a kept one."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("neg"), "k", "tm", "height")))
    empty = F.array().cast("array<struct<neg:double,k:int,tm:double,height:double>>")
    kept = F.aggregate("all", empty, lambda acc, p: F.when(
        F.forall(acc, lambda q: F.abs(q["tm"] - p["tm"]) > gap), F.array_append(acc, p)).otherwise(acc))
    out = peaks.groupBy(*keys).agg(ordered.alias("all")).withColumn("kept", kept)
    return out.select(*keys, F.size("kept").alias("n_peaks"), F.col("kept")[0]["tm"].alias("dominant_tm"),
                      (F.size("kept") == 1).alias("single_product"),
                      F.transform("kept", lambda p: F.struct(p["tm"].alias("tm"), p["height"].alias("height"))).alias("peaks"))
