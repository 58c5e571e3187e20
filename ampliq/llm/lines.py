"""Substring dedup by hashed units: the earliest ranked occurrence of each unit stays, later ones go.

Units are the lines of a text and the sentences inside them, so that a passage that repeats inside other prose is found
too. Units are compared after normalisation, their offsets are those of the original text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")
UPPER = re.compile("[A-Z]+")
GAP = re.compile("[ \t-\r]+")
ODD_GAP = re.compile("[\t\v\f\r]|  ")


def lowered(text: str) -> str:
    """A-Z in lower case; other letters and all offsets stay."""
    return text.lower() if text.isascii() else UPPER.sub(lambda m: m.group().lower(), text)


def units(text: str, min_words: int) -> list[tuple[int, int, str]]:
    """(start, end, normalised unit) of all lines and sentences of at least min_words words."""
    out, at = [], 0
    text = lowered(text)
    plain = not ODD_GAP.search(text)
    for line in text.split("\n"):
        spans = [(at, at + len(line))]
        inner = [(at + m.start(), at + m.end()) for m in SENTENCE.finditer(line)]
        spans += inner if inner != spans else []
        for start, end in spans:
            unit = text[start:end] if plain else GAP.sub(" ", text[start:end])
            unit = unit.strip(" ")
            if unit.count(" ") >= min_words - 1 and unit:
                out.append((start, end, unit))
        at += len(line) + 1
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def dedup_units(docs: DataFrame, id_col: str, text_col: str, *, min_words: int = 5) -> DataFrame:
    """One row per input row: id, n_chars, spans (removed parts, code points of the original text, merged), text (what stays).

    A unit stays where it comes first by id (null last), then by a digest of the text, then by offset. Rows equal in id
    and text are one document and get equal results. Null and empty texts have no units and stay (null as empty).
    Extra columns are not read. Empty input: no rows. Digests of units have 64 bits.

    Skew: a unit in a third of all rows is reduced to its minimum before the shuffle; the join that finds the others
    has no hint and AQE splits hot units. Texts are shuffled once, only for documents that lose something.
    """
    ident = F.col(id_col)
    rows = docs.select(ident.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("dk", F.xxhash64("t"))
    kind = dict(rows.dtypes)["id"]

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                owner, start, end, h = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for s, e, unit in units(text, min_words):
                        owner.append(i)
                        start.append(s)
                        end.append(e)
                        h.append(hashlib.blake2b(unit.encode(), digest_size=8).digest())
                at = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(h), np.int64)), part.column(0).take(at), part.column(2).take(at),
                     pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["h", "id", "dk", "start", "end"])

    found = rows.mapInArrow(cut, f"h long, id {kind}, dk long, start int, end int")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "dk", "start")
    firsts = found.groupBy("h").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A sentence that is a whole line is one unit; a repeated row repeats its own first occurrence.
    later = (found.join(firsts, "h").where(~(rank.eqNullSafe(F.col("first"))))
             .groupBy("id", "dk").agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    def drop(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                spans, texts = [], []
                for text, raw in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = merged([(s["start"], s["end"]) for s in raw or []])
                    edges = [0, *[x for s in own for x in s], len(text)]
                    spans.append([{"start": s, "end": e} for s, e in own])
                    texts.append("".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pc.utf8_length(part.column(1)).cast(pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.string())],
                    ["id", "n_chars", "spans", "text"])

    joined = (rows.join(later.withColumnRenamed("id", "i").withColumnRenamed("dk", "k"),
                        F.col("id").eqNullSafe(F.col("i")) & (F.col("dk") == F.col("k")), "left").select("id", "t", "spans"))
    return (joined.mapInArrow(drop, f"id {kind}, n_chars long, spans array<struct<start:int,end:int>>, text string")
            .withColumnRenamed("id", id_col))


def op7_line_dedup(spark, folder: str) -> DataFrame:
    out = dedup_units(table(spark, folder, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_chars", F.size("spans").cast("long").alias("n_spans"),
                      F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
                      F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
                      F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT DISTINCT doc_id, t FROM d),
ln AS (SELECT doc_id, t, x, sum(length(x) + 1) OVER (PARTITION BY doc_id, t ORDER BY i) - length(x) - 1 AS s
  FROM (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM k) z),
se AS (SELECT doc_id, t, x, sum(length(x)) OVER (PARTITION BY doc_id, t ORDER BY i) - length(x) AS s
  FROM (SELECT doc_id, t, unnest(m) AS x, generate_subscripts(m, 1) AS i
        FROM (SELECT doc_id, t, regexp_extract_all(t, '[^.!?\n]*[.!?]+|[^.!?\n]+|\n') AS m FROM k) y) z),
u AS (SELECT DISTINCT doc_id, t, s, s + length(x) AS e, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t-\r]+', ' ', 'g'), ' ') AS n FROM (SELECT * FROM ln UNION ALL SELECT * FROM se) z),
r AS (SELECT *, rank() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST, s) AS place FROM u WHERE len(string_split(n, ' ')) >= 5),
c AS (SELECT doc_id, t, s, e, max(e) OVER (PARTITION BY doc_id, t ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE place > 1),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM c),
m AS (SELECT doc_id, t, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM g GROUP BY doc_id, t, run),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, t ORDER BY s), 0) AS prev FROM m),
a AS (SELECT doc_id, t, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS spans,
    string_agg(substr(t, prev + 1, s - prev), '' ORDER BY s) || substr(t, max(e) + 1) AS kept FROM p GROUP BY doc_id, t)
SELECT d.doc_id, length(d.t)::BIGINT AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(spans, '') AS spans, sha256(coalesce(kept, d.t)) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.t = a.t
"""
