"""Whole texts as numpy byte arrays inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes of words hashed at a time; one longer word is hashed alone.
HASH_BYTES = 1 << 18


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) of at most about `most` bytes of text each; null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        offsets, data = buffers(texts)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            stop = min(stop, len(texts))
            part = offsets[start:stop + 1]
            yield batch.slice(start, stop - start), part - part[0], data[part[0]:part[-1]]
            start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if offs is None or len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, changed where a table has them already (case aside)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


_rng = np.random.default_rng(20240601)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """BASE ** 0 .. n-1 (or of its inverse) modulo 2**64, kept between calls."""
    name = "down" if down else "up"
    if len(_POWERS[name]) < n:
        grown = np.full(max(n, 1 << 16), INVERSE if down else BASE, np.uint64)
        grown[0] = 1
        _POWERS[name] = np.multiply.accumulate(grown)
    return _POWERS[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits count."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of data[:i]; (P[e] - P[s]) * BASE**-s is that of data[s:e], wherever it stands."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=out[1:])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but digits and letters parts words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text: text i has words first[i]:first[i + 1]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gaps[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        # A word must not run across two texts.
        joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that lie one behind the other; about HASH_BYTES of data are spread into 64-bit numbers at a time."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        s, e = starts[a:b] - base, ends[a:b] - base
        sums = prefix_hashes(data[base:ends[b - 1]])
        out[a:b] = mixed((sums[e] - sums[s]) * powers(len(sums), down=True)[s] + (e - s).astype(np.uint64))
        a = b
    return out
