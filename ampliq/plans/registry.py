"""Named queries: a Spark builder and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Widen narrow numbers so that results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int"):
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind == "float" or kind.startswith("decimal"):
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, lambda spark, folder: plain_types(build(spark, folder)), sql)
        return build

    return register
