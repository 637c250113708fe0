"""Words of many texts at once: boundaries and 64-bit hashes by array operations on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once (or one text, if it is longer).
CHUNK_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]  # A-Z count as a-z
_powers = np.ones((2, 1), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        steps = np.empty((2, n), np.uint64)
        steps[0], steps[1] = _STEP, _UNSTEP
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice of bytes, from prefix sums of a polynomial over random byte values."""
    power = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[0, : len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * power[1, start] + (end - start).astype(np.uint64))


def split_words(texts: pa.Array, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a space; starts and ends of words; number of words of each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    if texts.null_count:
        sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    stop = np.cumsum(sizes + 1) - 1  # where the space after each text lies
    data = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[stop] = False
    data[inside] = raw[offsets[0] : offsets[-1]] if not texts.null_count else raw[_slices(offsets[:-1], sizes)]
    word = ~separators[data]
    word[stop] = False
    change = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = change[::2], change[1::2]
    return data, start, end, np.diff(np.append(0, np.searchsorted(start, stop)))


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def chunks(batch: pa.RecordBatch, column: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a text column."""
    offsets = np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)[: len(batch) + 1]
    start = 0
    while start < len(batch):
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(batch))
        yield batch.slice(start, stop - start)
        start = stop
