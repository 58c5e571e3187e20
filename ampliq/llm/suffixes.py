"""Exact substring dedup with suffixes sorted by bucket-pointer refinement.

A string of `length` bytes that occurs twice has the same least q-gram hash in both places, so only suffixes that share
such an anchor can match. Anchors split every text into short segments of suffixes. Equal segments are settled by
grouping; the rest are sorted: buckets of q-grams are refined by the bucket pointers of later offsets, and refined pointers
are used at once for the next depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .decontam import _near
from ..session import cut_lineage, table

Q = 24
LOW = np.uint64(0xFFFFFFFF)
RECORD = np.dtype([("wh", np.uint64), ("dk", np.int64), ("a", np.int32), ("known", bool)])


def anchors(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: (first start, last start, anchor hash, segment hash), starts in `data`."""
    n, w = len(data), length - Q + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums, down = tx.prefix_hashes(data), tx.powers(n + 1, down=True)
    grams = tx.mixed((sums[Q:] - sums[:-Q]) * down[:n - Q + 1])
    key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = np.minimum(behind[:count], ahead[w - 1:w - 1 + count]) & LOW
    inside = np.zeros(n + 2, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside)[:count] > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    close = valid.copy()
    close[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    last = np.flatnonzero(close)
    whole = (sums[last + length] - sums[first]) * down[first]
    shape = ((at[first].astype(np.int64) - first) * length + (last - first)).astype(np.uint64)
    return first, last, grams[at[first].astype(np.int64)], tx.mixed(whole ^ tx.mixed(shape))


def refine(data: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Bucket pointers of all suffixes, sorted to at least `depth` bytes where that is a power of two times 8.

    A pointer is the place of the bucket's first suffix in the suffix array, so refining a bucket never touches others.
    Suffixes that are alone in their bucket drop out of the work.
    """
    n = len(data)
    gram = np.zeros(n, np.uint64)
    for j in range(8):
        gram[:n - j] |= data[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    order = np.argsort(gram, kind="stable")
    new = np.ones(n, bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    heads = np.flatnonzero(new)
    pointer = np.empty(n + 1, np.int64)
    pointer[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    pointer[n] = -1
    crowd = np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))
    active, d = order[crowd], 8
    while d < depth and len(active):
        later = pointer[np.minimum(active + d, n)] + 1
        own = pointer[active]
        rank = np.argsort(own.astype(np.uint64) * np.uint64(n + 2) + later.astype(np.uint64), kind="stable")
        active, own, later = active[rank], own[rank], later[rank]
        start = np.ones(len(active), bool)
        start[1:] = own[1:] != own[:-1]
        place = np.arange(len(active)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(active))))
        part = start.copy()
        part[1:] |= later[1:] != later[:-1]
        sizes = np.diff(np.append(np.flatnonzero(part), len(active)))
        pointer[active] = own + np.repeat(place[part], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        d *= 2
    return pointer, d


def classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start; equal for equal strings of `length` bytes."""
    depth = 8
    while depth * 2 <= length:
        depth *= 2
    pointer, _ = refine(data, depth)
    n = np.uint64(len(data) + 1)
    both = pointer[starts].astype(np.uint64) * n + pointer[starts + length - depth].astype(np.uint64)
    return np.unique(both, return_inverse=True)[1]


def _spans(hit: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int):
    """Runs of hit suffixes as (owner, first byte, end)."""
    begin = hit.copy()
    begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(stop)
    return owner[a], start[a], start[b] + length


def repeats(docs: DataFrame, id_col: str, text_col: str, *, length: int = 400, block: int = 1000) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans (removed runs, UTF-8 bytes of the input, merged), sha256 of the rest.

    Every byte covered by a string of `length` bytes that also starts elsewhere, in the same text or another, is removed.
    Null texts are empty. Texts that occur more than once (repeated rows too) repeat as a whole. Empty input: no rows.
    Extra columns are not read. Texts and anchors are named by 64-bit digests.

    Skew: equal segments collapse before the shuffle. An anchor with more than `block` different segments is cut into
    blocks that are sorted apart; each sends one record per different string to a second grouping, dealt by hash into as
    many parts as there are blocks, so strings shared by two blocks are found as well.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.xxhash64(raw).alias("dk"), F.octet_length(raw).cast("long").alias("n_bytes"),
                                   F.sha2(raw, 256).alias("sha")))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("dk").agg((F.count("*") > 1).alias("copied"))
    texts = docs.select(F.xxhash64(raw).alias("dk"), raw.alias("t")).where(F.octet_length("t") >= length)

    def mark(batches):
        for part, offsets, data in tx.slices(batches, "t"):
            first, last, h, g = anchors(offsets, data, length)
            owner = np.searchsorted(offsets, first, side="right") - 1
            _, one, back = np.unique(part.column(0).to_numpy(), return_index=True, return_inverse=True)
            keep = one[back[owner]] == owner
            first, last, h, g, owner = first[keep], last[keep], h[keep], g[keep], owner[keep]
            base = offsets[owner]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), part.column(0).take(pa.array(owner)),
                                              pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                                             ["h", "g", "dk", "s0", "s1"])

    marks = cut_lineage(texts.mapInArrow(mark, "h long, g long, dk long, s0 int, s1 int"))
    segments = cut_lineage(marks.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s0", "s1")).alias("at")))
    whole = (marks.join(segments.where("n > 1").select("h", "g"), ["h", "g"], "left_semi")
             .select("dk", F.col("s0").alias("a"), (F.col("s1") + length).alias("b")))
    mixed = segments.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = (segments.join(mixed, "h").select("h", "g", "n", "at.*", F.when(F.col("kinds") > block, F.ceil(F.col("kinds") / block)).otherwise(F.lit(0)).cast("int").alias("salts"))
             .withColumn("salt", F.when(F.col("salts") > 0, F.pmod(F.hash("g"), F.col("salts"))).otherwise(F.lit(0))))
    wanted = cut_lineage(asked.groupBy("dk").agg(F.collect_list(F.struct("h", "salt", "salts", "n", "s0", "s1")).alias("asks")))
    n_wanted = wanted.count()
    held = texts.join(_near(wanted.select("dk"), n_wanted), "dk", "left_semi") if n_wanted <= 500_000 else texts

    def extract(batches):
        for batch in batches:
            dk, done = batch.column(0).to_pylist(), set()
            names = ["h", "salt", "dk", "s0", "n", "seg", "salts"]
            out: list[list] = [[] for _ in names]
            size = 0
            for i, key in enumerate(dk):
                if key in done:
                    continue
                done.add(key)
                data = batch.column(1)[i].as_py().encode()
                for ask in batch.column(2)[i].as_py():
                    seg = data[ask["s0"]:ask["s1"] + length]
                    for column, value in zip(out, (ask["h"], ask["salt"], key, ask["s0"], ask["n"], seg, ask["salts"])):
                        column.append(value)
                    size += len(seg)
                if size > 4 << 20:
                    yield _batch(out, names)
                    out, size = [[] for _ in names], 0
            yield _batch(out, names)

    def _batch(out, names):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    # The same text in several rows asks for the same segments: one copy is enough, and a second one must not count.
    pieces = (held.join(wanted, "dk").select("dk", "t", "asks")
              .mapInArrow(extract, "h long, salt int, dk long, s0 int, n long, seg binary, salts int").dropDuplicates(["h", "salt", "dk", "s0"]))

    fields = ["dk", "a", "b", "h", "part", "pack"]

    def settle(group):
        segs = [s for b in group for s in b.column(5).to_pylist()]
        sizes = np.array([len(s) for s in segs], np.int64)
        data = np.frombuffer(b"".join(segs), np.uint8)
        begins = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(segs)), count)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        kind = classes(data, begins[owner] + local, length)
        many = np.bincount(kind)[kind] > 1
        dk = np.concatenate([b.column(2).to_numpy() for b in group])
        s0 = np.concatenate([b.column(3).to_numpy() for b in group]).astype(np.int64)
        n = np.concatenate([b.column(4).to_numpy() for b in group])
        h, salts = (np.concatenate([b.column(i).to_numpy() for b in group]) for i in (0, 6))
        own, a, b = _spans(many & (n == 1)[owner], owner, s0[owner] + local, length)
        empty = [pa.nulls(len(own), k) for k in (pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(dk[own]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *empty], fields)
        # What a block of a crowded anchor holds, one record per different string, dealt by the string's hash.
        _, lead = np.unique(kind, return_index=True)
        lead = lead[salts[owner[lead]] > 0]
        if len(lead):
            at, seg = begins[owner[lead]] + local[lead], owner[lead]
            sums = tx.prefix_hashes(data)
            wh = tx.mixed((sums[at + length] - sums[at]) * tx.powers(len(data) + 1, down=True)[at])
            records = np.empty(len(lead), RECORD)
            records["wh"], records["dk"], records["a"] = wh, dk[seg], s0[seg] + local[lead]
            records["known"] = many[lead] | (n[seg] != 1)
            part = (wh % salts[seg].astype(np.uint64)).astype(np.int32)
            order = np.lexsort((part, h[seg]))
            records, part, key = records[order], part[order], h[seg][order]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(key)]
            empty = [pa.nulls(len(cuts) - 1, k) for k in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(key[cuts[:-1]]), pa.array(part[cuts[:-1]]), tx.binary_column(
                [records[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])])], fields)

    def sort(batches):
        group, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            seg_ends = tx.buffers(batch.column(5))[0]
            for a, b in zip(edges[:-1], edges[1:]):
                key = (h[a], salt[a])
                if key != last and size > 2 << 20:
                    yield from settle(group)
                    group, size = [], 0
                group.append(batch.slice(a, b - a))
                size += int(seg_ends[b] - seg_ends[a])
                last = key
        if group:
            yield from settle(group)

    def share(batches):
        """Strings that two blocks of one anchor hold."""
        held, last = [], None

        def settle():
            r = np.concatenate([np.frombuffer(x, RECORD) for x in held])
            _, back, times = np.unique(r["wh"], return_inverse=True, return_counts=True)
            r = r[(times[back] > 1) & ~r["known"]]
            r = r[np.lexsort((r["a"], r["dk"]))]
            new = np.ones(len(r), bool)
            new[1:] = (r["dk"][1:] != r["dk"][:-1]) | (r["a"][1:] > r["a"][:-1] + length)
            end = np.append(new[1:], True)[:len(r)]
            return pa.RecordBatch.from_arrays([pa.array(r["dk"][new]), pa.array(r["a"][new]), pa.array(r["a"][end] + np.int32(length))], fields[:3])

        for batch in batches:
            for h, part, pack in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (h, part) != last:
                    yield settle()
                    held = []
                last = (h, part)
                held.append(pack)
        if held:
            yield settle()

    sorted_out = cut_lineage(pieces.repartition("h", "salt").sortWithinPartitions("h", "salt")
                             .mapInArrow(sort, "dk long, a int, b int, h long, part int, pack binary"))
    across = (sorted_out.where("pack is not null").select("h", "part", "pack").repartition("h", "part").sortWithinPartitions("h", "part")
              .mapInArrow(share, "dk long, a int, b int"))
    spans = whole.unionByName(sorted_out.where("pack is null").select("dk", "a", "b")).unionByName(across)
    gone = cut_lineage(spans.groupBy("dk").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    n_gone = gone.count()
    lost = texts.join(_near(gone.select("dk"), n_gone), "dk", "left_semi") if n_gone <= 500_000 else texts

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data, runs = text.encode(), []
                for s, e in sorted((x["a"], x["b"]) for x in spans):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                digest, at = hashlib.sha256(), 0
                for s, e in runs:
                    digest.update(data[at:s])
                    at = e
                digest.update(data[at:])
                out.append({"dk": key, "runs": [{"start": s, "end": e} for s, e in runs], "kept": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dk", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                                                             ("kept", pa.string())]))

    result = (lost.join(gone, "dk").select("dk", "t", "spans")
              .mapInArrow(cut, "dk long, runs array<struct<start:int,end:int>>, kept string").dropDuplicates(["dk"]))
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    copied = F.coalesce("copied", F.lit(False))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    runs = F.when(copied, all_of).otherwise(F.coalesce("runs", none))
    return (rows.join(copies, "dk", "left").join(result, "dk", "left")
            .select(F.col("id").alias(id_col), "n_bytes", runs.alias("spans"),
                    F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
            .withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])))


def op9_bucket_pointers(spark, folder: str) -> DataFrame:
    out = repeats(table(spark, folder, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


SQL = None
