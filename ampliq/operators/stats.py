"""Small statistics shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median_of_tally(tally: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Count, minimum, maximum and the element at index ``n // 2`` of the sorted values.

    The input is already tallied per distinct value, so a key never gathers its raw rows.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy(*keys))
    holds = F.col("__upto") > F.floor(F.col("__total") / 2)
    return (tally.withColumn("__upto", upto).withColumn("__total", total).groupBy(*keys)
            .agg(F.max("__total").alias("n"), F.min(value).alias("shortest"), F.max(value).alias("longest"),
                 F.min(F.when(holds, F.col(value))).alias("upper_median")))


def geometric_mean(col: Column) -> Column:
    return F.exp(F.avg(F.log(col)))


def wilson_interval(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    n = F.when(total > 0, total)
    p = successes / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def unit_interval_hash(col: Column) -> Column:
    """Stable number in [0, 1) from the first 12 hex digits of sha256."""
    return F.conv(F.substring(F.sha2(col, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
