"""Embedding near-dedup with an inverted multi-index.

Each half of a vector has its own codebook; pairs of codewords are the cells of a product grid. Every vector is stored in
one cell and visits the nearest cells in multi-sequence order (by the sum of both halves' distances). How many cells are
visited follows from a target recall, measured against brute force for a bounded set of queries over all rows. All pairs that
meet in a cell are verified by their cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from ..session import cut_lineage, table


@dataclass
class Grid:
    """codes[0], codes[1]: codewords of the first and second half; visits: cells that each vector visits."""
    codes: tuple[np.ndarray, np.ndarray]
    visits: int = 16

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.codes[0].shape[1]
        out = []
        for part, code in zip((x[:, :cut], x[:, cut:]), self.codes):
            out.append((part ** 2).sum(axis=1)[:, None] - 2 * part @ code.T + (code ** 2).sum(axis=1)[None, :])
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.codes[1]) + b.argmin(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The first `visits` cells of each vector in multi-sequence order.

        A cell whose halves rank i-th and j-th comes after the i * j cells that are no farther in both halves, so only
        cells with i * j <= visits can be among the first.
        """
        a, b = self.distances(x)
        n = min(self.visits, a.shape[1] * b.shape[1])
        oa, ob = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :n]
        da, db = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        i, j = np.meshgrid(np.arange(oa.shape[1]), np.arange(ob.shape[1]), indexing="ij")
        front = (i + 1) * (j + 1) <= n
        i, j = i[front], j[front]
        first = np.argsort(da[:, i] + db[:, j], axis=1, kind="stable")[:, :n]
        return np.take_along_axis(oa[:, i] * b.shape[1] + ob[:, j], first, 1)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    code = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ code.T + (code ** 2).sum(axis=1)).argmin(axis=1)
        count = np.bincount(near, minlength=len(code))
        sums = np.zeros_like(code)
        np.add.at(sums, near, x)
        code[count > 0] = sums[count > 0] / count[count > 0, None]
    return code


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of a column of equally long, valid vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, *, cosine: float = 0.93, recall: float = 0.995,
                    sample: int = 20_000, queries: int = 512, per_cell: float = 8.0, max_codes: int = 1024, block: int = 512,
                    enough: int = 128) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Rows are compared when their labels are equal and not null and their vectors equally long. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Equal vectors of a label link and are searched
    once. Repeated rows and ids are separate rows; a null id is the least only where no other is reachable. Empty
    input: no rows. Extra columns are not read. The codebooks are fitted on about `sample` rows chosen by hash and the
    visits on turns of `queries` of them against all rows, at most 8, until `enough` have a partner; every row is indexed.

    Skew: a cell with more than `block` vectors is cut into blocks; visitors are streamed past a block, links are
    counted there and only edges of a spanning forest leave it, never the pairs of a group.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col(label_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = cut_lineage(vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.when(valid, F.concat_ws("/", F.col(label_col).cast("string"), F.size(v))).alias("room"), F.when(valid, v).alias("v")))
    distinct = cut_lineage(rows.where("room is not null").groupBy("room", "v").agg(F.min("rid").alias("rid"), F.count("*").alias("k")))
    same = rows.where("room is not null").select("rid", "room", "v").join(distinct.select("room", "v", F.col("rid").alias("lead"), "k"), ["room", "v"]) \
        .select("rid", "lead", "k")
    found = None
    for size, n in sorted((r[0], r[1]) for r in distinct.groupBy(F.size("v")).count().collect()):
        some = _links(distinct.where(F.size("v") == size), size, n, cosine, recall, sample, queries, per_cell, max_codes, block, enough)
        found = some if found is None else found.unionAll(some)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found)
    counts = found.where("other is null").groupBy(F.col("node").alias("lead")).agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "lead")
    full = (rows.select("rid", "id").join(same, "rid", "left").join(counts, "lead", "left").join(roots, "lead", "left")
            .withColumn("root", F.coalesce("root", "lead", "rid")))
    least = full.groupBy("root").agg(F.min("id").alias("component_id"))
    return (full.join(least, "root").select(
        F.col("id").alias(id_col), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("k") - 1, F.lit(0))).cast("long").alias("n_links"),
        "component_id").withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _hash_share(ident: Column, share: float) -> Column:
    return F.abs(F.xxhash64(ident)) / F.lit(float(2 ** 63)) < share


def visits_for(places: list[list[tuple[int, int]]], recall: float) -> int:
    """Least number of cells that reaches the mean recall over queries, each given by (place, count) of its true partners.

    Every query weighs the same, however many partners it has.
    """
    if not places:
        return 0
    at = np.concatenate([[p for p, _ in one] for one in places])
    share = np.concatenate([np.array([c for _, c in one]) / sum(c for _, c in one) for one in places]) / len(places)
    order = np.argsort(at, kind="stable")
    reached = np.cumsum(share[order]) >= recall - 1e-9
    return int(at[order][reached.argmax() if reached.any() else -1]) + 1


def _ranks(distinct: DataFrame, grid: Grid, q: np.ndarray, q_rid: np.ndarray, q_room: np.ndarray, cosine: float) -> DataFrame:
    """(query, place, c): places, in each query's order of cells, of the cells of its true partners, itself left out."""
    qa, qb = grid.distances(q)
    flat = np.sort((qa[:, :, None] + qb[:, None, :]).reshape(len(q), -1), axis=1) if qa.shape[1] * qb.shape[1] * len(q) <= 4e7 else None

    def ranks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, room, rid = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            hit = (q @ y.T >= cosine) & (q_room[:, None] == room[None, :]) & (q_rid[:, None] != rid[None, :])
            i, j = np.nonzero(hit)
            own = grid.cells(y[j]) if len(j) else np.zeros(0, np.int64)
            at = qa[i, own // qb.shape[1]] + qb[i, own % qb.shape[1]] if len(j) else np.zeros(0)
            place = [int(np.searchsorted(flat[a], d - 1e-12)) if flat is not None else int((qa[a][:, None] + qb[a][None, :] < d - 1e-12).sum())
                     for a, d in zip(i.tolist(), at.tolist())]
            both, count = np.unique(np.stack([i, np.array(place, np.int64)], axis=1).reshape(-1, 2), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(count)], ["query", "place", "c"])

    return distinct.select("room", "v", "rid").mapInArrow(ranks, "query long, place long, c long").groupBy("query", "place").agg(F.sum("c").alias("c"))


def _links(distinct: DataFrame, size: int, n: int, cosine: float, recall: float, sample: int, queries: int, per_cell: float,
           max_codes: int, block: int, enough: int) -> DataFrame:
    """(node, other, n): edges of a spanning forest (other set) and links of a node by number of rows (other null)."""
    got = distinct.where(_hash_share(F.col("rid"), sample / n)).select("rid", "room", "v").orderBy("rid").toPandas()
    if not len(got):
        got = distinct.select("rid", "room", "v").orderBy("rid").limit(1).toPandas()
    x = np.stack(got["v"].to_list()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng, cut = np.random.default_rng(3), max(1, size // 2)
    k = int(min(max_codes, max(2, round((n / per_cell) ** 0.5))))
    halves = (codebook(x[:, :cut], k, rng), codebook(x[:, cut:], k, rng) if size > 1 else np.zeros((1, 0)))
    grid = Grid(halves)
    # The sample is a hash choice over the whole table; queries are taken from it in random order, not in that of the ids.
    turns, places = np.random.default_rng(5).permutation(len(x)), {}
    rids, rooms = got["rid"].to_numpy(), got["room"].to_numpy()
    cells = len(halves[0]) * len(halves[1])
    done = 0
    while done < len(turns) and len(places) < min(enough, queries) and done < 8 * queries:
        asked = turns[done:done + queries]
        done += len(asked)
        q, q_rid, q_room = x[asked], rids[asked], rooms[asked]
        for r in _ranks(distinct, grid, q, q_rid, q_room, cosine).collect():
            places.setdefault(int(q_rid[r["query"]]), []).append((r["place"], r["c"]))
    grid.visits = max(8, visits_for(list(places.values()), recall))
    if len(places) < min(enough, queries) and done < n:
        # Too few queries have a partner to set a number by.
        grid.visits = max(grid.visits, 64)
    grid.visits = int(min(grid.visits, cells))

    def assign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _matrix(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3),
                                                  pa.array(grid.cells(x)), pa.array(list(grid.nearest(x)), pa.list_(pa.int64()))],
                                                 ["rid", "room", "v", "k", "cell", "visits"])

    placed = cut_lineage(distinct.select("rid", "room", "v", "k").mapInArrow(assign, "rid long, room string, v array<double>, k long, cell long, visits array<long>"))
    crowd = placed.groupBy("room", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    stored = placed.join(crowd, ["room", "cell"]).select("room", "cell", F.pmod(F.hash("rid"), F.col("blocks")).alias("block"), F.lit(0).alias("side"),
                                                         "rid", "v", "k", F.col("cell").alias("own"), "visits")
    visitors = (placed.select("room", F.explode("visits").alias("cell"), "rid", "v", "k", F.col("cell").alias("own"))
                .join(crowd, ["room", "cell"])
                .select("room", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "rid", "v", "k",
                        "own", F.expr("cast(array() as array<bigint>)").alias("visits")))
    names = ["room", "cell", "block"]

    def verify(batches):
        key, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            room, cell, blk, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((room[1:] != room[:-1]) | (cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (room[a], cell[a], blk[a]) != key:
                    key, held, state = (room[a], cell[a], blk[a]), [], None
                if side[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if state is None:
                    member = pa.Table.from_batches(held).combine_chunks()
                    state = (member["rid"].to_numpy(), _matrix(member["v"].combine_chunks()), member["k"].to_numpy(), np.array(member["visits"].to_pylist()),
                             member["own"].to_numpy())
                m_rid, m, m_k, m_visits, m_own = state
                for c in range(a, b, 1024):
                    part = batch.slice(c, min(1024, b - c))
                    p_rid, p_k, p_own = (part.column(i).to_numpy() for i in (4, 6, 7))
                    hit = (_matrix(part.column(5)) @ m.T >= cosine) & (p_rid[:, None] != m_rid[None, :])
                    i, j = np.nonzero(hit)
                    if not len(i):
                        continue
                    node, count = [p_rid[i]], [m_k[j]]
                    # The partner does not visit this vector's cell: count the link for it here.
                    blind = ~(m_visits[j] == p_own[i][:, None]).any(axis=1)
                    node.append(m_rid[j][blind])
                    count.append(p_k[i][blind])
                    node, back = np.unique(np.concatenate(node), return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()),
                                                      pa.array(np.bincount(back, np.concatenate(count)).astype(np.int64))], ["node", "other", "n"])
                    # Least label on both sides until it stays: one edge per node instead of all pairs.
                    top = np.iinfo(np.int64).max
                    lp, lm = p_rid.copy(), m_rid.copy()
                    while True:
                        np_ = np.minimum(lp, np.where(hit, lm[None, :], top).min(axis=1))
                        nm = np.minimum(lm, np.where(hit, np_[:, None], top).min(axis=0))
                        if (np_ == lp).all() and (nm == lm).all():
                            break
                        lp, lm = np_, nm
                    ends, roots = np.concatenate([p_rid, m_rid]), np.concatenate([lp, lm])
                    some = ends != roots
                    yield pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.array(roots[some]), pa.array(np.zeros(some.sum(), np.int64))], ["node", "other", "n"])

    return (stored.unionByName(visitors).repartition(*names).sortWithinPartitions(*names, "side")
            .mapInArrow(verify, "node long, other long, n long"))


def op5_multi_index(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter([isfinite(y::DOUBLE) FOR y IN embedding], lambda f: f IS NOT TRUE)) = 0),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id) c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
