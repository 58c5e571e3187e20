"""LM scoring with Brown classes: exchange clustering, class transitions and word emissions.

Word counts cover the whole training corpus and stay a distributed table. A core of the most frequent words is clustered
by exchange among units: each core word is one, other words share one per ending. Every other word of the training corpus
then goes to the class that its own neighbours make likeliest. Only words never learned from keep the class of their ending. A text's
probability needs the counts and classes of its own words only: frequent ones come from a table of bounded size, the rest
from a join on the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .langid import held_out
from .scratch import forget, tidy
from ..session import cut_lineage, cut_to_parquet, table

SLICE = 1 << 20
ADD = 0.1


def _words(offsets: np.ndarray, data: np.ndarray):
    data = tx.lowered(data)
    starts, ends, first = tx.words(offsets, data)
    return data, starts, ends, first, tx.word_hashes(data, starts, ends)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()).cast(pa.string())


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, c) over all texts."""
    def count(batches):
        for _, offsets, data in tx.slices(batches, column, SLICE):
            data, starts, ends, _, h = _words(offsets, data)
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_spelled(data, starts[at], ends[at]), pa.array(n)], ["word", "c"])

    return texts.select(column).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """Frequent words by hash (sorted), their counts, the unit of each core word (-1 outside the core) and of each ending."""
    keys: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    shared: np.ndarray
    endings: int
    frequent: int

    @property
    def size(self) -> int:
        return self.frequent + self.endings + 1

    @property
    def edge(self) -> int:
        """The unit of text ends."""
        return self.size - 1

    def ending(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = data[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        return self.frequent + (last * 131 + before * 7 + np.minimum(ends - starts, 12)) % self.endings

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, -1 where it is not there."""
        if not len(self.keys):
            return np.full(len(h), -1)
        some, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        return np.where(self.keys[at] == some, at, -1)[back]

    def of(self, data, starts, ends, place: np.ndarray) -> np.ndarray:
        known = place >= 0
        out = self.ending(data, starts, ends)
        out[known] = np.where(self.unit[place[known]] >= 0, self.unit[place[known]], out[known])
        return out


def frequent_units(counts: DataFrame, *, table_words: int, unit_words: int, endings: int) -> Units:
    """The at most `table_words` most frequent words: all words above a count, found from a histogram of its logarithm."""
    level = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect()  # at most 16 * 64 rows
    least, room = None, table_words
    for row in steps:
        room -= row["count"]
        if room < 0:
            break
        least = row["l"]
    got = counts.where(level >= least).toPandas() if least is not None else None
    if got is None or not len(got):
        return Units(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, endings, 0)
    got = got.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    arr = pa.array(got["word"], pa.string())
    offsets, data = tx.buffers(arr)
    h = tx.word_hashes(data[:offsets[-1]], offsets[:-1], offsets[1:])
    rank = np.arange(len(h))
    frequent = min(unit_words, len(h))
    order = np.argsort(h)
    units = Units(h[order], got["c"].to_numpy()[order], np.where(rank < frequent, rank, -1)[order], np.zeros(0, np.int64), endings, frequent)
    units.shared = units.ending(data, offsets[:-1], offsets[1:])[order]
    return units


def bigrams(texts: DataFrame, column: str, units: Units) -> np.ndarray:
    """units x units counts over all texts; at most units ** 2 cells leave Spark."""
    n = units.size

    def count(batches):
        total = np.zeros(n * n, np.int64)
        for _, offsets, data in tx.slices(batches, column, SLICE):
            data, starts, ends, first, h = _words(offsets, data)
            line = np.full(len(starts) + len(first), units.edge)
            # One edge before each text and one behind the last.
            at = np.arange(len(starts)) + np.repeat(np.arange(1, len(first)), np.diff(first))
            line[at] = units.of(data, starts, ends, units.find(h))
            total += np.bincount(line[:-1] * n + line[1:], minlength=n * n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "c"])

    got = texts.select(column).mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(n * n, np.int64)
    out[got["pair"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return out.reshape(n, n)


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """Class of each unit. The last unit (text ends) is class 0 alone; each other unit moves, in order of frequency, to the
    class that raises the likelihood of the class bigrams most, until a sweep moves none."""
    def f(x):
        return x * np.log(np.maximum(x, 1))

    n = len(pairs)
    weight = pairs.sum(axis=1)
    order = [u for u in np.argsort(-weight, kind="stable") if u != n - 1 and weight[u] > 0]
    cls = np.zeros(n, np.int64)
    cls[:n - 1] = 1
    for i, u in enumerate(order):
        cls[u] = 1 + i % (classes - 1)
    one = np.eye(classes, dtype=np.int64)[cls]
    after = (pairs @ one).astype(float)
    before = (pairs.T @ one).astype(float)
    big = (one.T @ pairs @ one).astype(float)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = cls[u], float(pairs[u, u])
            out, into = after[u].copy(), before[u].copy()
            out[a] -= own
            into[a] -= own
            big[a] -= out
            big[:, a] -= into
            big[a, a] -= own
            row = (f(big + out[None, :]) - f(big)).sum(axis=1)
            col = (f(big + into[:, None]) - f(big)).sum(axis=0)
            d = np.diag(big)
            gain = row + col - (f(d + out) - f(d)) - (f(d + into) - f(d)) + f(d + out + into + own) - f(d)
            left, right = big.sum(axis=1), big.sum(axis=0)
            gain -= f(left + out.sum() + own) - f(left) + f(right + into.sum() + own) - f(right)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            big[b] += out
            big[:, b] += into
            big[b, b] += own
            if b != a:
                moved += 1
                cls[u] = b
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if not moved:
            break
    return cls


def transitions(steps: np.ndarray) -> np.ndarray:
    """log10 of the smoothed chance of each class after each class."""
    classes = len(steps)
    prior = (steps.sum(axis=0) + 1) / (steps.sum() + classes)
    smooth = ADD * classes
    return np.log10((steps + smooth * prior) / (steps.sum(axis=1, keepdims=True) + smooth))


@dataclass
class Classes:
    """Class of each unit and of each word of the table."""
    units: Units
    unit: np.ndarray
    word: np.ndarray

    def of(self, data, starts, ends, place: np.ndarray) -> np.ndarray:
        """Classes of words; outside the table that of the ending."""
        known = place >= 0
        out = self.unit[self.units.ending(data, starts, ends)]
        out[known] = self.word[place[known]]
        return out


def assigned(texts: DataFrame, column: str, start: Classes, steps: np.ndarray) -> DataFrame:
    """(h, place, k, c): class and count of every word outside the core, named by its hash; place in the table or -1.

    A word's contexts are the counts of its neighbours' classes in `start` on either side. It joins the class under
    which they are likeliest, transitions and class sizes held fixed.
    """
    units, n = start.units, len(steps)
    free = np.append(units.unit < 0, True)

    def rows(h, key, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key.astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "key", "c"])

    def count(batches):
        # Contexts of the table's words are summed over the task: at most 2 * classes cells a word.
        held = np.zeros(len(units.keys) * 2 * n, np.int32)
        for _, offsets, data in tx.slices(batches, column):
            data, starts, ends, first, h = _words(offsets, data)
            if not len(starts):
                continue
            place = units.find(h)
            line = np.zeros(len(starts) + len(first), np.int64)
            at = np.arange(len(starts)) + np.repeat(np.arange(1, len(first)), np.diff(first))
            line[at] = start.of(data, starts, ends, place)
            for mine in (np.flatnonzero(free[place] & (place >= 0)), np.flatnonzero(place < 0)):
                some, name = (None, place[mine]) if not len(mine) or place[mine[0]] >= 0 else np.unique(h[mine], return_inverse=True)
                code = np.concatenate([name * 2 * n + line[at[mine] + 1], name * 2 * n + n + line[at[mine] - 1]])
                code, times = np.unique(code, return_counts=True)
                if some is None:
                    held[code] += times.astype(np.int32)
                else:
                    yield rows(some[code // (2 * n)], code % (2 * n), times)
        code = np.flatnonzero(held)
        for i in range(0, len(code), 1 << 17):
            part = code[i:i + (1 << 17)]
            yield rows(units.keys[part // (2 * n)], part % (2 * n), held[part])

    change, size = transitions(steps), np.log10(steps.sum(axis=0) + 1)
    gain = np.concatenate([change.T, change - size])  # followed by class k, then preceded by class k

    def best(batches):
        for batch in batches:
            m, keys, times = batch.num_rows, batch.column(1), batch.column(2)
            row = np.repeat(np.arange(m), np.diff(keys.offsets.to_numpy()))
            seen = np.bincount(row * 2 * n + keys.flatten().to_numpy(), times.flatten().to_numpy(), m * 2 * n).reshape(m, 2 * n)
            # Class 0 is that of text ends.
            to = (seen @ gain[:, 1:]).argmax(axis=1) + 1
            place = units.find(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), pa.array(to), pa.array(seen[:, :n].sum(axis=1).astype(np.int64))],
                                             ["h", "place", "k", "c"])

    # Tasks have summed already: a word arrives as at most 2 * classes rows of a task, and one shuffle on the word serves both
    # groupings.
    cells = texts.select(column).mapInArrow(count, "h long, key int, c long").repartition("h").groupBy("h", "key").agg(F.sum("c").alias("c"))
    each = cells.groupBy("h").agg(F.collect_list(F.struct("key", "c")).alias("x")).select("h", "x.key", "x.c")
    return cut_to_parquet(each.mapInArrow(best, "h long, place long, k long, c long"))


def class_steps(texts: DataFrame, column: str, cls: Classes, rare: DataFrame, classes: int) -> np.ndarray:
    """classes x classes counts of neighbours over all texts; at most 3 * classes ** 2 rows leave Spark.

    Steps with a word outside the table on one side are rows (h, salt, side), on both sides (h, next, 2 * classes); sums of the
    steps inside the table are rows (salt, salt, -1 - cell). Salts spread over the tasks and name no word that counts: what
    they join is not read.
    """
    units = cls.units

    def rows(h, to, side, c):
        return pa.RecordBatch.from_arrays([h, to, pa.array(side.astype(np.int32)), pa.array(c)], ["h", "to", "side", "c"])

    def count(batches):
        total = np.zeros(classes * classes, np.int64)
        for _, offsets, data in tx.slices(batches, column):
            data, starts, ends, first, h = _words(offsets, data)
            place = units.find(h)
            line = np.zeros(len(starts) + len(first), np.int64)
            outside, name = np.zeros(len(line), bool), np.zeros(len(line), np.int64)
            at = np.arange(len(starts)) + np.repeat(np.arange(1, len(first)), np.diff(first))
            line[at], outside[at], name[at] = cls.of(data, starts, ends, place), place < 0, h.view(np.int64)
            a, b = outside[:-1], outside[1:]
            total += np.bincount((line[:-1] * classes + line[1:])[~(a | b)], minlength=classes * classes)
            i = np.flatnonzero(a | b)
            side = np.where(a[i] & b[i], 2 * classes, np.where(a[i], line[i + 1], classes + line[i]))
            h = np.where(a[i], name[i], name[i + 1])
            salt = tx.mixed((side * 64 + (h & 63)).astype(np.uint64)).view(np.int64)
            to = np.where(a[i] & b[i], name[i + 1], salt)
            # Equal steps of a slice leave as one row.
            order = np.lexsort((side, to, h))
            h, to, side = h[order], to[order], side[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (to[1:] != to[:-1]) | (side[1:] != side[:-1])
            yield rows(pa.array(h[new]), pa.array(to[new]), side[new], np.diff(np.append(np.flatnonzero(new), len(h))))
        some = np.flatnonzero(total)
        salt = pa.array(tx.mixed(some.astype(np.uint64)).view(np.int64))
        yield rows(salt, salt, -1 - some, total[some])

    steps = texts.select(column).mapInArrow(count, "h long, to long, side int, c long")
    first = steps.join(rare.select("h", F.col("k").alias("a")), "h", "left").groupBy("a", "to", "side").agg(F.sum("c").alias("c"))
    second = first.join(rare.select(F.col("h").alias("to"), F.col("k").alias("b")), "to", "left").groupBy("a", "b", "side").agg(F.sum("c"))
    out = np.zeros((classes, classes))
    for a, b, side, c in second.collect():
        if side < 0:
            a, b = divmod(-1 - side, classes)
        elif side < classes:
            b = side
        elif side < 2 * classes:
            a, b = side - classes, a
        out[a, b] += c
    return out


def score(docs: DataFrame, id_col: str, text_col: str, learn: Column, *, table_words: int = 131_072, unit_words: int = 700,
          endings: int = 150, classes: int = 48) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram), score (class
    model), perplexity. `learn` says which rows are learned from; held_out is its negation.

    Null and empty texts are one end token. Without training rows every count is 0: n_known 0 and each class is as
    likely as the other. Repeated rows count and score as often as they stand. Extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (~learn).alias("held_out"), text.alias("t"))
    corpus = rows.where(~F.col("held_out")).select("t")
    counts = cut_lineage(word_counts(corpus, "t"))
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = docs.where(learn).count()
    n_all, n_words = got[0] + n_texts, got[1] + (n_texts > 0)
    units = frequent_units(counts, table_words=table_words, unit_words=unit_words, endings=endings)
    forget(counts)
    tidy(docs.sparkSession)
    pairs = bigrams(corpus, "t", units)
    # The edge before the first text of a slice and behind its last one stand for one text end between any two texts.
    unit_class = exchange(pairs, classes)
    one = np.eye(classes)[unit_class]
    cls = Classes(units, unit_class, unit_class[np.where(units.unit >= 0, units.unit, units.shared)])
    found = assigned(corpus, "t", cls, one.T @ pairs @ one)
    tidy(docs.sparkSession)
    for place, k in found.where("place >= 0").select("place", "k").collect():  # at most table_words rows
        cls.word[place] = k
    beyond = found.where("place < 0").select("h", "k", "c")
    change = transitions(class_steps(corpus, "t", cls, beyond, classes))
    tidy(docs.sparkSession)

    mass, kinds = np.bincount(cls.word, units.counts, classes), np.bincount(cls.word, minlength=classes).astype(float)
    for k, c, v in beyond.groupBy("k").agg(F.sum("c"), F.count("*")).collect():
        mass[k] += c
        kinds[k] += v
    below = np.log10(mass + ADD * (kinds + 1))
    # The class of text ends holds nothing else: its emission is certain.
    edge_count, table_log = np.log10(n_texts + ADD), np.log10(units.counts + ADD)

    def run(batches):
        for part, offsets, data in tx.slices(batches, "t"):
            data, starts, ends, first, h = _words(offsets, data)
            m = len(offsets) - 1
            owner = np.repeat(np.arange(m), np.diff(first))
            place = units.find(h)
            known = place >= 0
            c = cls.of(data, starts, ends, place)
            line = np.zeros(len(c) + m, np.int64)
            mine = np.concatenate([[0], np.cumsum(np.diff(first) + 1)])
            line[np.arange(len(c)) + owner] = c
            prev = np.empty_like(line)
            prev[1:] = line[:-1]
            prev[mine[:-1]] = 0
            # Steps from or to words outside the table, and their emissions, follow from the joins.
            where = np.arange(len(c)) + owner
            outside = np.zeros(len(line), bool)
            outside[where[~known]] = True
            loose = outside.copy()
            loose[1:] |= outside[:-1]
            loose[mine[:-1]] = outside[mine[:-1]]
            moves = np.add.reduceat(np.where(loose, 0.0, change[prev, line]), mine[:-1]) if m else np.zeros(0)
            model = moves - np.bincount(owner[known], below[c[known]], m)
            tally = np.bincount(owner[known], table_log[place[known]], m)
            sure = np.bincount(owner[known], minlength=m)
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((h[rare], owner[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(order)))
            lists = np.searchsorted(owner[order[at]], np.arange(m + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(lists), pa.array(h[order[at]].view(np.int64)))
            often = pa.ListArray.from_arrays(pa.array(lists), pa.array(times))
            kind = pa.ListArray.from_arrays(pa.array(lists), pa.array(c[order[at]]))
            # Ends of a loose step: a class, or `classes` + place in the text's list of words.
            sign = line.copy()
            sign[where[order]] = classes + np.cumsum(new) - 1 - lists[owner[order]]
            i = np.flatnonzero(loose)
            before = np.where(np.isin(i, mine[:-1]), 0, sign[i - 1])
            ends_at = np.searchsorted(i, mine).astype(np.int32)
            moved = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(before << 32 | sign[i]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(first) + 1), pa.array(sure),
                                              pa.array(tally), pa.array(model), words, often, kind, moved],
                                             ["rid", "id", "held_out", "n", "sure", "tally", "model", "words", "times", "ks", "moves"])

    def flat(lists):
        """Lengths and joined values of a column of lists; a null is an empty list."""
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten()

    def finish(batches):
        for batch in batches:
            m, get = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            many, own = flat(get["ks"])
            start, owner = np.cumsum(many) - many, np.repeat(np.arange(m), many)
            k, times = own.to_numpy().astype(np.int64), flat(get["times"])[1].to_numpy()
            c = np.zeros(len(k), np.int64)
            many, told = flat(get["told"])
            at = np.repeat(start, many) + told.field("pos").to_numpy()
            k[at], c[at] = told.field("k").to_numpy(), told.field("c").to_numpy()
            emitted = np.bincount(owner, times * below[k], m)
            more = np.bincount(owner, times * np.log10(c + ADD), m)
            found = np.bincount(owner, times * (c > 0), m).astype(np.int64)
            many, moves = flat(get["moves"])
            moves, first = moves.to_numpy(), np.repeat(start, many)

            def ends(x):
                x, rare = x.copy(), x >= classes
                x[rare] = k[first[rare] + x[rare] - classes]
                return x

            stepped = np.bincount(np.repeat(np.arange(m), many), change[ends(moves >> 32), ends(moves & (2 ** 32 - 1))], m)
            whole = get["tally"].to_numpy() + more
            n = get["n"].to_numpy()
            result = whole + get["model"].to_numpy() + stepped - emitted
            yield pa.RecordBatch.from_arrays(
                [get["id"], get["held_out"], get["n"], pa.array(get["sure"].to_numpy() + found + (1 if n_texts else 0)),
                 pa.array(np.full(m, int(n_all))), pa.array(whole + edge_count - n * each), pa.array(result), pa.array(10.0 ** (-result / n))],
                [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = dict(docs.dtypes)[id_col]
    each = float(np.log10(n_all + ADD * (n_words + 1)))
    scored = cut_to_parquet(rows.mapInArrow(run, f"rid long, id {kind}, held_out boolean, n long, sure long, tally double, model double, "
                                                 "words array<long>, times array<long>, ks array<long>, moves array<long>"))
    # A text gets the classes and counts of its own words back as one list, no longer than its row.
    told = (scored.select("rid", F.posexplode("words").alias("pos", "h")).join(beyond, "h")
            .groupBy("rid").agg(F.collect_list(F.struct("pos", "k", "c")).alias("told")))
    return scored.drop("words").join(told, "rid", "left").mapInArrow(
        finish, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op4_brown_classes(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, "doc_id", "text", ~held_out(F.col("doc_id"), 10))
