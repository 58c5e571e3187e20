"""Run one registered query in Spark and in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


def compare(df, con, sql):
    """Return the differences (empty when both sides agree) and a timing note."""
    t0 = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    theirs = rows_of(names, res.fetchall())
    t1 = time.time()
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    timing = f"spark {time.time() - t1:.1f}s duckdb {t1 - t0:.1f}s"
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"], timing
    for name, kind in df.dtypes:
        if kind in TYPES and TYPES[kind] != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, e.g. {sorted(names)}: {wrong[:2]}")
    if not ours:
        problems.append("no rows")
    return problems, timing
