"""Small inputs with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] +
                      # Columns that operators might use inside.
                      [T.StructField(n, T.StringType()) for n in ("id", "t", "h", "dk", "n", "rid", "digest", "words", "size", "word", "score", "spans", "e")])


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lg, s, None if t is None else len(t), *["x"] * 13) for i, t, lg, s in rows], SCHEMA)


def awkward(seed=1):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Straße", "été", "ñu", "日本"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = say(60), "Shared " + say(55) + "."
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, base + " tail", "en", "a"), (4, base.replace("w1 ", "W1  "), "en", None),
            (5, None, "en", "a"), (6, "", None, "b"), (7, " \t\n ", "de", "b"), (8, "one two", "de", "c"), (9, "One\ttwo", "de", None),
            (None, say(40), "en", "a"), (None, None, None, None), (10, base, "en", "a"), (10, base, "en", "a"), (10, say(30), "en", "a"),
            (11, say(5) + "\n" + passage + "\n" + say(9), "en", "a"), (12, passage + " " + say(70), "en", "b"), (13, say(20) + " " + passage, "en", "c"),
            (14, "ab " * 500, "en", "a"), (15, "ab " * 700, "fr", "b"), (16, say(4000), "en", "c"), (17, "!!! ... ###", "en", "a"),
            (18, "x", "en", "a"), (19, "line of five whole words\nline of five whole words\nother", "en", "a")]
    for i in range(20, 60):
        words = (base if i % 2 else passage).split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words), "en", rnd.choice("abc")))
    rnd.shuffle(rows)
    return rows


def closure(nodes, links, value):
    """Smallest value reachable per node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    out = {}
    for group in groups.values():
        known = [value[n] for n in group if value[n] is not None]
        for n in group:
            out[n] = min(known) if known else None
    return out


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def shingles(text):
    w = spaced(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    least = closure(range(len(rows)), links, {i: r[0] for i, r in enumerate(rows)})
    return [(r[0], len(sets[i]), least[i]) for i, r in enumerate(rows)], links


def repeated_bytes(texts, length):
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def leaks(texts, items, window=10):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    wins = defaultdict(set)
    for item, t in items:
        w = re.findall(word, (t or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i:i + n])].add(item)
    out = []
    for t in texts:
        w = re.findall(word, (t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


PATTERNS = [("assign", re.compile("((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|"
                                  "(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = [(m.start(), no, name, m.end(), m.group(group)) for no, (name, pattern, group, least) in enumerate(PATTERNS)
             for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def bare_values(text, values):
    """Where values stand as whole tokens: search for each, then look at what surrounds it."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
    found = set()
    for core in {v.rstrip(".=") for v in values}:
        if len(core) < 6 or set(core) - letters or not any(c.isdigit() for c in core) or not any(c.isalpha() for c in core):
            continue
        at = text.find(core)
        while at >= 0:
            end = at + len(core)
            after = text[end:].lstrip(".")[:1]
            if (at == 0 or text[at - 1] not in letters) and after not in letters:
                found.add((at, end))
            at = text.find(core, at + 1)
    return sorted(found)


def held(ident, parts):
    return ident is None or zlib.crc32(str(ident).encode()) % parts == 0
