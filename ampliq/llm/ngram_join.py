"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Columns (n-grams) are cut into blocks by hash. A first product over the lower part of every row counts, per row, how
many of its columns any other row has; rows below the bound that follows from their size cannot link and leave. The rest is
ordered by column frequency, and only the columns that every linked partner must share are multiplied out. Overlaps of the
pairs left are then accumulated over all columns and held against the size-derived bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .decontam import _near
from .scratch import forget, tidy
from ..session import cut_lineage, table

#: Bytes of text whose lower columns meet before the shuffle.
SLICE = 4 << 20
BITS = 1024
STEPS = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(5).integers(1, 2**62, 16)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Texts of fewer words have one, of the whole sequence."""
    data = tx.lowered(data)
    starts, ends, first = tx.words(offsets, data)
    w = tx.word_hashes(data, starts, ends)
    count = max(0, len(w) - size + 1)
    s = np.zeros(count, np.uint64)
    for j in range(size):
        s += w[j:j + count] * STEPS[j]
    s = tx.mixed(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(s[a:b - size + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for j in range(b - a):
                x = tx.mixed(x * STEPS[15] + w[a + j])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def need(n, percent: int):
    """Least overlap of a set of n with any linked partner."""
    return -(-n * percent // 100)


def _extra(n: int) -> int:
    """Columns beyond the necessary prefix that the first product looks at."""
    return max(1, n // 10)


def parities(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of BITS classes. Where two sets differ in k parities, at least k shingles
    are in one set only."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included), digest
    (64 bits, of the text), stays (the row is its component's first by id, null last, then digest).

    Two texts link when 100 * overlap >= percent * union of their shingle sets. Null, empty and blank texts have no
    shingles and link with nothing. Copies link and are searched once; repeated rows and ids count like others. A null id is
    the smallest only where no other is reachable. Empty input: no rows. Extra columns are not read. Texts and shingles
    are compared by 64-bit digests.

    Skew: a slice of texts sends one entry for a shingle, however many of its texts hold it; frequencies and leaders
    are partial aggregates; joins on shingles have no hint, so AQE splits hot ones. Lists of texts with a common
    shingle are first linked to leaders, one each in a turn; pairs are only written out between texts in different
    components after that whose sketches of parities do not rule a link out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("dk"))
    kind = dict(base.dtypes)["id"]
    buckets = 8 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches):
        for part, offsets, data in tx.slices(batches, "t"):
            n = [len(s) for s in shingle_sets(offsets, data, size)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["id", "dk", "n"])

    rows = cut_lineage(base.mapInArrow(count, f"id {kind}, dk long, n long"))

    def lower(batches):
        """Lower columns of each row, in blocks of the hash range; what the slice itself shares is counted here."""
        for part, offsets, data in tx.slices(batches, "t", SLICE):
            dks, which = np.unique(part.column(1).to_numpy(), return_index=True)
            sets = shingle_sets(offsets, data, size)
            keep = [i for i in which if len(sets[i])]
            if not keep:
                continue
            dks = part.column(1).to_numpy()[keep]
            n = np.array([len(sets[i]) for i in keep])
            used = [sets[i][:min(len(sets[i]), len(sets[i]) - need(len(sets[i]), percent) + _extra(len(sets[i])))] for i in keep]
            h = np.concatenate(used)
            owner = np.repeat(np.arange(len(keep)), [len(u) for u in used])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            shared = np.repeat(times > 1, times)
            local = np.bincount(owner[shared], minlength=len(keep))
            bound = np.array([_extra(int(need(x, percent))) for x in n.tolist()])
            key = np.where(shared, 0, dks[owner].astype(np.int64))[new]
            h = h[new]
            block = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rest = h.astype(np.uint32)
            edges = np.searchsorted(block, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            mine = int(dks[0]) % len(some)
            hs = [rest[edges[b]:edges[b + 1]].tobytes() for b in some]
            ks = [key[edges[b]:edges[b + 1]].tobytes() for b in some]
            own = [b""] * len(some)
            own[mine] = np.stack([dks.astype(np.int64), local, bound]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), tx.binary_column(hs), tx.binary_column(ks), tx.binary_column(own)],
                                             ["bucket", "h", "k", "own"])

    def meet(batches):
        held, last = [], None

        def settle():
            h = np.frombuffer(b"".join(x for x, _ in held), np.uint32)
            k = np.frombuffer(b"".join(x for _, x in held), np.int64)
            order = np.argsort(h, kind="stable")
            h, k = h[order], k[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(h)))
            low, high = np.minimum.reduceat(k, heads), np.maximum.reduceat(k, heads)
            zero = np.logical_or.reduceat(k == 0, heads)
            got = np.repeat((low != high) | zero, sizes) & (k != 0)
            dk, c = np.unique(k[got], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(dk), pa.array(c), pa.array(np.zeros(len(dk), np.int64))], ["dk", "c", "bound"])

        for batch in batches:
            for b, h, k, own in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and b != last:
                    yield settle()
                    held = []
                last = b
                held.append((h, k))
                if own:
                    dk, c, bound = np.frombuffer(own, np.int64).reshape(3, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(dk), pa.array(c), pa.array(bound)], ["dk", "c", "bound"])
        if held:
            yield settle()

    alive = cut_lineage(base.select("t", "dk").mapInArrow(lower, "bucket int, h binary, k binary, own binary")
                        .repartition("bucket").sortWithinPartitions("bucket")
                        .mapInArrow(meet, "dk long, c long, bound long").groupBy("dk").agg(F.sum("c").alias("c"), F.max("bound").alias("bound"))
                        .where("c >= bound").select("dk"))
    n_alive = alive.count()

    def full(batches):
        for part, offsets, data in tx.slices(batches, "t"):
            sets = shingle_sets(offsets, data, size)
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            bits = np.concatenate([parities(s) for s in sets]) if sets else np.zeros(0, np.int64)
            each = np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                                              pa.ListArray.from_arrays(pa.array(each), pa.array(bits))], ["dk", "s", "bits"])

    sets = cut_lineage(base.select("t", "dk").join(_near(alive, n_alive), "dk", "left_semi").select("t", "dk")
                       .mapInArrow(full, "dk long, s array<long>, bits array<long>").dropDuplicates(["dk"]).withColumn("n", F.size("s").cast("long")))
    cells = sets.select("dk", "n", F.explode("s").alias("e"))
    often = cells.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    must = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("cols"))
    prefix = (cells.join(often, "e").groupBy("dk", "n").agg(F.collect_list(F.struct("df", "e")).alias("cols"))
              .withColumn("must", must.cast("int")).where("must > 0")
              # A text whose columns are common is the centre of its family.
              .withColumn("hub", F.aggregate("cols", F.lit(0).cast("long"), lambda a, c: a + c["df"]) / F.col("n"))
              .select("dk", "n", "hub", F.explode(F.slice(F.array_sort("cols"), 1, F.col("must"))).alias("c")).select("dk", "n", "hub", F.col("c.e").alias("e")))
    prefix = cut_lineage(prefix)
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def verify(pairs: DataFrame) -> DataFrame:
        """Accumulate the overlap of each distinct pair (a, b) over all columns."""
        pairs = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        left = sets.select(F.col("dk").alias("a"), F.col("s").alias("sa"))
        right = sets.select(F.col("dk").alias("b"), F.col("s").alias("sb"))
        overlap = F.size(F.array_intersect("sa", "sb"))
        return (pairs.join(left, "a").join(right, "b")
                .where(overlap * 100 >= (F.size("sa") + F.size("sb") - overlap) * percent).select("a", "b"))

    forget(alive)
    tidy(spark)
    links, named, parts = None, prefix.withColumn("root", F.col("dk")), []
    for turn in range(2):
        # One leader per list: its centre, and from the second turn on the centre of what the first did not reach.
        lead = F.min(F.struct((-F.col("hub")).alias("far"), "dk", "n", "root"))
        lists = named.groupBy("e").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), lead.alias("lead")).where("r0 <> r1").select("e", "lead")
        if turn:
            lists = (named.join(lists, "e").where(F.col("root") != F.col("lead.root")).groupBy("e").agg(lead.alias("lead")))
        pairs = (named.join(lists, "e").where(F.col("root") != F.col("lead.root"))
                 .select(F.col("dk").alias("a"), F.col("n").alias("na"), F.col("lead.dk").alias("b"), F.col("lead.n").alias("nb")))
        found = cut_lineage(verify(pairs))
        parts.append(found)
        links = found if links is None else links.unionAll(found)
        roots = components(links, "a", "b")
        last = named
        named = cut_lineage(prefix.join(roots.withColumnRenamed("node", "dk"), "dk", "left").withColumn("root", F.coalesce("root", "dk"))
                            .select("dk", "n", "hub", "e", "root"))
        if turn:
            forget(last)
    forget(prefix)
    # What is left: lists that still hold several components. The side outside the largest one meets all others.
    sizes = named.groupBy("e", "root").agg(F.count("*").alias("k"))
    main = (sizes.groupBy("e").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("m")).where("roots > 1")
            .select("e", F.col("m.root").alias("main")))
    open_lists = named.join(main, "e").join(sets.select("dk", "bits"), "dk")
    outside = open_lists.where("root <> main").select("e", F.col("dk").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("bits").alias("xa"))
    others = open_lists.select("e", F.col("dk").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("bits").alias("xb"),
                               (F.col("root") == F.col("main")).alias("in_main"))
    # Linked sets differ in at most (na + nb) * (100 - percent) / (100 + percent) shingles, so in no more parities.
    differ = sum((F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(BITS // 64)), F.lit(0))
    near = differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    pairs = outside.join(others, (outside["e"] == others["e"]) & (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & fits & near)
    pairs = pairs.select("a", "na", "b", "nb")
    parts.append(cut_lineage(verify(pairs)))
    forget(named, sets)
    roots = components(links.unionAll(parts[-1]), "a", "b").withColumnRenamed("node", "dk")
    forget(*parts)
    joined = rows.join(roots, "dk", "left").withColumn("root", F.coalesce("root", "dk"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "dk")
    least = joined.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"), F.min(place).alias("first"))
    return (joined.join(least, "root", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.col("dk").alias("digest"), ((F.col("n") == 0) | F.coalesce(place.eqNullSafe(F.col("first")), F.lit(False))).alias("stays")))


def first_of_each(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of docs, all columns, one per component; texts without shingles all stay. Of rows equal in id and text
    one stays."""
    found = jaccard_components(docs, id_col, text_col, **options)
    ident, dig, stays, some, times = tx.fresh(docs.columns, "_id", "_digest", "_stays", "_n", "_k")
    lists = cut_lineage(found.groupBy(F.col(id_col).alias(ident), F.col("digest").alias(dig))
                        .agg(F.max("stays").alias(stays), F.max("n_shingles").alias(some), F.count("*").alias(times)).where(F.col(stays)))
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(lists, F.col(id_col).eqNullSafe(F.col(ident)) & (digest == F.col(dig)))
    # Rows equal in id and text are rare; only they are compared once more.
    repeated = (F.col(times) > 1) & (F.col(some) > 0)
    single = kept.where(~repeated).select(*docs.columns)
    if lists.where(repeated).limit(1).count():
        return single.unionByName(kept.where(repeated).dropDuplicates([dig]).select(*docs.columns))
    return single


def op8_ngram_jaccard(spark, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS e FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reach)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
