"""Arrow kernels on words: a whole batch of texts at once, over its byte buffer, without a Python loop per word.

Words are maximal runs of word bytes; the separators of every rule used here are ASCII, so bytes above 0x7F always
belong to a word and UTF-8 sequences are never cut. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Word rules as tables over byte values.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANK
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text that a kernel works on at a time (a longer text is worked on alone).
CHUNK = 2 << 20

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_POWERS = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i; empty ranges give 0."""
    running = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=running[1:])
    return running[first[1:]] - running[first[:-1]]


@dataclass
class Words:
    """Words of a list of texts: word i is ``data[start[i]:end[i]]``, text d has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word: hash of the ``length`` words that start there; whether they lie in one text."""
        n = len(self.hash)
        inside = np.arange(n) + length <= np.repeat(self.first[1:], self.counts)
        return window_hashes(self.hash, length), inside

    def text(self, a: int, b: int) -> bytes:
        """Words a to b of one text, joined by one space."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from each place on, by doubling; near the end it covers what is there."""
    n, out, have = len(h), np.zeros(len(h), dtype=np.uint64), 0
    power, factor, span = h, int(_STEP), 1
    while length:
        if length & 1:
            shifted = np.zeros(n, dtype=np.uint64)
            shifted[: max(n - have, 0)] = power[have:]
            out = out * np.uint64(factor) + shifted
            have += span
        length >>= 1
        if length:
            shifted = np.zeros(n, dtype=np.uint64)
            shifted[: max(n - span, 0)] = power[span:]
            power, factor, span = power * np.uint64(factor) + shifted, factor * factor % 2**64, span * 2
    return mixed(out, have)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = True) -> Words:
    data, offsets = text_buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = word_bytes[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, offsets, start, end, first, np.zeros(0, np.uint64))
    a = start[0]
    values = np.where(inside[a:], _BYTE[data[a:]], np.uint64(0))
    lengths = np.diff(start, append=n)
    place = np.arange(n - a) - np.repeat(start - a, lengths)
    values *= _powers(int(lengths.max()))[place]
    hashes = mixed(np.add.reduceat(values, start - a) + (end - start).astype(np.uint64) * _LENGTH)
    return Words(data, offsets, start, end, first, hashes)


def shingle_sets(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``length``-word hashes of each text, and where each text's part begins.

    A text of fewer words, but not none, has the hash of its whole word sequence as its only element.
    """
    hashes, inside = w.windows(length)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < length))
    keep, values = inside.copy(), hashes.copy()
    for d in short:
        a, b = w.first[d], w.first[d + 1]
        keep[a] = True
        values[a] = window_hashes(w.hash[a:b], int(b - a))[0]
    values = values[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    if not len(values):
        return values, first
    distinct = np.ones(len(values), dtype=bool)
    distinct[1:] = values[1:] != values[:-1]
    distinct[first[:-1][np.diff(first) > 0]] = True
    return values[distinct], np.concatenate([[0], np.cumsum(distinct)])[first]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; no row is split."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    n, a = batch.num_rows, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and where each list begins."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))
