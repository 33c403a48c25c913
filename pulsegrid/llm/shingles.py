"""Words and word shingles of whole texts as 64-bit hashes, in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once.
BATCH_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(20260101)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``BATCH_BYTES`` of text each; a longer text is a part of its own."""
    ends = np.cumsum(batch.column(column).cast(pa.large_binary()).fill_null(b"").to_pandas().map(len).to_numpy(np.int64)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, A-Z in lower case, the start and stop of every word, and where each text's words begin."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]) if texts else b"", dtype=np.uint8)]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    gap = IS_GAP[data]
    before = np.concatenate(([True], gap[:-1])) if len(gap) else gap
    start = np.flatnonzero(before & ~gap)
    return data, start, np.flatnonzero(gap & ~before), np.searchsorted(start, firsts)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z in lower case), and where each text's words begin.

    The second array has one more entry: the number of words.
    """
    words, bounds, _ = hash_words_and_endings(texts)
    return words, bounds


def hash_words_and_endings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the last two bytes of every word as a number (one-byte words: the byte)."""
    data, start, stop, bounds = _word_bounds(texts)
    if not len(start):
        return np.zeros(0, np.uint64), bounds, np.zeros(0, np.int64)
    length = stop - start
    power = np.cumprod(np.full(int(length.max()), STEP, dtype=np.uint64))
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    value = BYTE_HASH[data[~IS_GAP[data]]] * power[place]
    last = data[stop - 1].astype(np.int64) + 256 * np.where(length > 1, data[stop - 2], 0).astype(np.int64)
    return mix64(np.add.reduceat(value, ends - length) + length.astype(np.uint64)), bounds, last


def hash_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text, sorted; with fewer words the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    if n < size:
        size = n
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += words[i : n - size + 1 + i] * SPREAD[(i + size) % 64]
    return np.unique(mix64(total))
