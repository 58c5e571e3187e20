"""Standard curves, detection limits, copy numbers and dilution series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AVOGADRO = 6.02214076e23
# Average molecular weight per base or base pair, and two-sided 97.5 % t quantiles
# for 1 to 30 degrees of freedom.
MW_PER_UNIT = {"dsDNA": 650.0, "ssDNA": 330.0, "RNA": 340.0}
T975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
        2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


def unit_weight(kind: Column) -> Column:
    out = F.lit(MW_PER_UNIT["dsDNA"])
    for name, weight in MW_PER_UNIT.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def copies_per_ul(ng_per_ul: Column, length: Column, kind: Column) -> Column:
    return ng_per_ul * 1e-9 / (length * unit_weight(kind)) * AVOGADRO


def ng_for_copies(copies: Column, length: Column, kind: Column) -> Column:
    return copies / AVOGADRO * length * unit_weight(kind) / 1e-9


def dilution_series(starts: DataFrame, start: str, *, factor: float = 10.0, points: int = 6) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return (starts.withColumn("step", F.explode(steps))
            .withColumn("copies", F.col(start) / F.pow(F.lit(float(factor)), F.col("step"))))


def point_errors(points: DataFrame) -> Column:
    """Reason a standard point is unusable; a null Cq is a non-detect, not an error."""
    q, c = F.col("quantity"), F.col("cq")
    return (F.when(q.isNull() | F.isnan(q) | (q <= 0), "quantity_not_positive")
            .when(c.isNotNull() & (F.isnan(c) | (c <= 0) | (c > 80)), "cq_out_of_range"))


def efficiency_from_slope(slope: Column) -> Column:
    exponent = -1.0 / F.when(slope != 0, slope)
    return F.when((slope < -0.25) & (exponent <= 4.0), F.pow(F.lit(10.0), exponent) - 1.0)


def level_table(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per dilution level: replicates, detected, mean and sample sd of detected Cq."""
    return points.groupBy(*keys, "quantity").agg(
        F.count("*").alias("n"), F.count("cq").alias("detected"), F.avg("cq").alias("mean_cq"),
        F.when(F.count("cq") > 1, F.stddev_samp("cq")).alias("sd_cq"),
        (100.0 * F.count("cq") / F.count("*")).alias("detection_rate"))


def standard_curve(points: DataFrame, keys: list[str]) -> DataFrame:
    """Regression of the mean detected Cq per level on log10 quantity, one row per curve.

    Replicates are folded to level means by a first, combinable aggregate; the second one sees
    one row per level.
    """
    levels = level_table(points, keys).withColumn("x", F.log10("quantity"))
    x = F.when(F.col("mean_cq").isNotNull(), F.col("x"))
    y = F.col("mean_cq")
    curve = levels.groupBy(*keys).agg(
        F.count(y).alias("n_levels"), F.sum("n").alias("n_observations"), F.sum("detected").alias("n_detected"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.pow(F.lit(10.0), F.min(x)).alias("range_low"), F.pow(F.lit(10.0), F.max(x)).alias("range_high"),
        F.min(F.when(F.col("detected") == F.col("n"), F.col("quantity"))).alias("lowest_fully_detected"))
    curve = curve.filter((F.col("n_levels") >= 2) & (F.col("sxx") > 0))
    ss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    r2 = F.when(F.col("syy") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("ss") / F.col("syy")))).otherwise(
        F.when(F.col("ss") <= 1e-15, F.lit(1.0)).otherwise(F.lit(0.0)))
    df = F.col("n_levels") - 2
    tcrit = F.when(df.between(1, len(T975)), F.element_at(F.array(*[F.lit(t) for t in T975]),
                                                          F.greatest(F.least(df, F.lit(len(T975))), F.lit(1)).cast("int"))
                   ).otherwise(F.lit(1.96))
    se = F.when(df >= 1, F.sqrt(F.greatest(F.col("ss") / F.greatest(df, F.lit(1)) / F.col("sxx"), F.lit(0.0))))
    curve = (curve.withColumn("ss", ss).withColumn("r2", r2).withColumn("slope_se", se)
             .withColumn("efficiency", efficiency_from_slope(F.col("slope")))
             .withColumn("slope_low", F.col("slope") - tcrit * F.col("slope_se"))
             .withColumn("slope_high", F.col("slope") + tcrit * F.col("slope_se")))
    e_lo, e_hi = efficiency_from_slope(F.col("slope_low")), efficiency_from_slope(F.col("slope_high"))
    both = e_lo.isNotNull() & e_hi.isNotNull()
    return (curve.withColumn("efficiency_low", F.when(both, 100.0 * F.least(e_lo, e_hi)))
            .withColumn("efficiency_high", F.when(both, 100.0 * F.greatest(e_lo, e_hi)))
            .withColumn("efficiency_ok", F.coalesce((100.0 * F.col("efficiency")).between(90.0, 110.0), F.lit(False)))
            .withColumn("r2_ok", F.col("r2") >= 0.98)
            .withColumn("slope_ok", F.col("slope").between(-3.58, -3.10))
            .drop("sxx", "syy", "sxy", "ss"))


def detection_limit(points: DataFrame, keys: list[str], *, target: float = 0.95, steps: int = 60) -> DataFrame:
    """Quantity detected with probability ``target`` from a logistic fit on log10 quantity.

    Calls are tallied per level first, so the Newton iteration folds over a handful of levels
    whatever the number of replicates. Null without a detect/non-detect transition, with a
    falling slope, or beyond one log of extrapolation.
    """
    levels = (points.filter("quantity > 0").groupBy(*keys, "quantity")
              .agg(F.count("*").cast("double").alias("n"), F.count("cq").cast("double").alias("y"))
              .withColumn("x", F.log10("quantity")))
    packed = levels.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x", "n", "y"))).alias("lv"),
        F.sum("n").alias("total"), F.sum("y").alias("hits"),
        (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    spread = F.sqrt(F.aggregate("lv", F.lit(0.0), lambda a, r: a + r["n"] * F.pow(r["x"] - F.col("mx"), 2)) / F.col("total"))
    packed = packed.withColumn("sx", spread).withColumn("sx", F.when(F.col("sx") == 0, F.lit(1.0)).otherwise(F.col("sx")))
    packed = packed.withColumn("lv", F.transform("lv", lambda r: F.struct(
        ((r["x"] - F.col("mx")) / F.col("sx")).alias("z"), r["n"].alias("n"), r["y"].alias("y"))))

    zero = F.struct(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(False).alias("done"))

    def newton(state: Column, _: Column) -> Column:
        sums0 = F.struct(*[F.lit(0.0).alias(k) for k in ("g0", "g1", "h00", "h01", "h11")])

        def add(a: Column, r: Column) -> Column:
            z = state["b0"] + state["b1"] * r["z"]
            p = F.when(z >= 700.0, 1.0).when(z <= -700.0, 0.0).otherwise(1.0 / (1.0 + F.exp(-z)))
            w = r["n"] * p * (1.0 - p)
            miss = r["y"] - r["n"] * p
            return F.struct((a["g0"] + miss).alias("g0"), (a["g1"] + miss * r["z"]).alias("g1"),
                            (a["h00"] + w).alias("h00"), (a["h01"] + w * r["z"]).alias("h01"),
                            (a["h11"] + w * r["z"] * r["z"]).alias("h11"))

        def step(s: Column) -> Column:
            det = s["h00"] * s["h11"] - s["h01"] * s["h01"]
            flat = F.abs(det) < 1e-12
            safe = F.when(flat, F.lit(1.0)).otherwise(det)
            d0 = F.when(flat, 0.0).otherwise((s["h11"] * s["g0"] - s["h01"] * s["g1"]) / safe)
            d1 = F.when(flat, 0.0).otherwise((s["h00"] * s["g1"] - s["h01"] * s["g0"]) / safe)
            return F.struct((state["b0"] + d0).alias("b0"), (state["b1"] + d1).alias("b1"),
                            (flat | (F.abs(d0) + F.abs(d1) < 1e-9)).alias("done"))

        return F.when(state["done"], state).otherwise(F.aggregate("lv", sums0, add, step))

    fit = packed.withColumn("b", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, newton))
    import math
    zt = math.log(target / (1.0 - target))
    x95 = (F.lit(zt) - F.col("b.b0")) / F.when(F.col("b.b1") > 0, F.col("b.b1")) * F.col("sx") + F.col("mx")
    fit = fit.withColumn("x95", x95)
    known = ((F.col("total") >= 4) & (F.col("hits") > 0) & (F.col("hits") < F.col("total"))
             & F.col("x95").between(F.col("xmin") - 1.0, F.col("xmax") + 1.0))
    return fit.select(*keys, F.col("total").cast("long").alias("n_calls"),
                      F.when(known, F.col("x95")).alias("log10_lod95"),
                      F.when(known, F.pow(F.lit(10.0), F.col("x95"))).alias("lod95"))
