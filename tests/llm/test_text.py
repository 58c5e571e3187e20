"""Hashes of words: the same in blocks as at once, in memory of the text's order."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ampliq.llm import ngram_join
from ampliq.llm import text as tx


def packed(texts):
    return tx.buffers(pa.array(texts, pa.string()))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 30])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, block):
    texts = ["a Ab  cde", "", "x" * 300 + " ñandú a", " \t ", "cde", "a"]
    offsets, data = packed(texts)
    starts, ends, first = tx.words(offsets, data)
    monkeypatch.setattr(tx, "HASH_BYTES", block, raising=False)
    got = tx.word_hashes(data, starts, ends)
    alone = [tx.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for t in texts for w in t.encode().split()]
    assert got.tolist() == [int(h) for h in alone] and len(set(alone)) == 5
    # Words without letters stand where another ends.
    at = np.array([0, 1, 1, 2])
    assert tx.word_hashes(data, at, np.array([1, 1, 2, 2]))[[1, 3]].tolist() == [int(tx.mixed(np.zeros(1, np.uint64))[0])] * 2
    assert len(tx.word_hashes(data, at[:0], at[:0])) == 0


def test_shingles_take_few_bytes_a_byte_of_text():
    rnd = np.random.default_rng(3)
    words = np.array(["plain", "words", "of", "longer", "texts", "standing", "together"])
    texts = [" ".join(words[rnd.integers(0, len(words), 500)]) for _ in range(1400)]
    offsets, data = packed(texts)
    ngram_join.shingle_sets(offsets, data, 5)
    tracemalloc.start()
    try:
        ngram_join.shingle_sets(offsets, data, 5)
        assert tracemalloc.get_traced_memory()[1] < 14 * len(data)
    finally:
        tracemalloc.stop()
