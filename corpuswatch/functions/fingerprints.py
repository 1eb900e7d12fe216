"""SimHash and MinHash. The JVM normalises the text; one Arrow kernel per batch splits it, hashes words and does the bit work.

Both kernels take a slice of an Arrow batch as one flat list of words plus row offsets. A word is hashed once per slice, however often it
occurs; there is no Python loop per row and no shuffle: a fingerprint is a narrow column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswatch.functions.text import normalize_text

MERSENNE_31 = 2147483647
# Bytes of text that are split at a time, and words whose votes one byte can count.
CHUNK_BYTES, BYTE_VOTES = 4_000_000, 255


def _hashed(texts: pa.Array):
    """Slices of normalised texts, of a bounded size: md5 bytes of the distinct words, the place of each word among them, row offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # Without words a row is null, so that it is split into none.
    texts = pc.if_else(pc.equal(texts, ""), None, texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, side="right")))
        lists = pc.split_pattern(texts.slice(start, stop - start), " ")
        named = lists.values.dictionary_encode()
        digests = b"".join([hashlib.md5(w).digest() for w in named.dictionary.cast(pa.binary()).to_pylist()])
        yield np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16), named.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
        start = stop


@F.arrow_udf(T.LongType())
def _simhash_kernel(texts: pa.Array) -> pa.Array:
    out = [np.zeros(0, dtype=np.int64)]
    for digests, places, offsets in _hashed(texts):
        counts = np.diff(offsets)
        result, filled = np.zeros(len(counts), dtype=np.int64), np.flatnonzero(counts)
        if len(filled):
            # The 64 bits of a word as 64 bytes, added eight at a time: a row is cut into runs that a byte can count.
            lanes = np.unpackbits(digests[:, 8:], axis=1).view(np.uint64).T.copy()
            runs = -(-counts[filled] // BYTE_VOTES)
            at = np.cumsum(runs) - runs
            first = np.repeat(offsets[:-1][filled] - BYTE_VOTES * at, runs) + BYTE_VOTES * np.arange(runs.sum())
            sums = np.stack([np.add.reduceat(lane[places], first) for lane in lanes], axis=1)
            votes = np.add.reduceat(sums.view(np.uint8).astype(np.int32), at, axis=0)
            majority = votes * 2 > counts[filled][:, None]
            result[filled] = np.packbits(majority, axis=1).view(">i8").ravel()
        out.append(result)
    return pa.array(np.concatenate(out), type=pa.int64())


def simhash64(text: Column) -> Column:
    """64-bit SimHash: a bit is set when more than half of the word occurrences have it; empty text is 0."""
    return _simhash_kernel(normalize_text(text))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def permutation_constants(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the MinHash permutations, from the md5 of ``a0, a1, .. b0, b1, ..``."""

    def constant(name: str) -> int:
        return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) & MERSENNE_31

    a = np.array([max(constant(f"a{i}") % MERSENNE_31, 1) for i in range(num_perm)], dtype=np.uint64)
    b = np.array([constant(f"b{i}") % MERSENNE_31 for i in range(num_perm)], dtype=np.uint64)
    return a, b


def minhash(text: Column, num_perm: int = 128) -> Column:
    """MinHash signature over the distinct words; an empty text has every slot at 2^31 - 1."""
    a, b = permutation_constants(num_perm)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def kernel(texts: pa.Array) -> pa.Array:
        rows = [np.zeros((0, num_perm), dtype=np.int64)]
        for digests, places, offsets in _hashed(texts):
            base = (digests[:, :4].copy().view(">u4").ravel() & MERSENNE_31).astype(np.uint64)
            n_rows, n_words = len(offsets) - 1, max(len(base), 1)
            signature = np.full((n_rows, num_perm), MERSENNE_31, dtype=np.int64)
            # Each word of a row once.
            once = np.repeat(np.arange(n_rows), np.diff(offsets)) * n_words + places
            once.sort()
            row, place = np.divmod(once[np.flatnonzero(np.diff(once, prepend=-1))], n_words)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            for i in range(num_perm if len(row) else 0):
                signature[row[starts], i] = np.minimum.reduceat(((base * a[i] + b[i]) % MERSENNE_31).astype(np.int32)[place], starts)
            rows.append(signature)
        flat_out = np.concatenate(rows)
        out_offsets = np.arange(len(flat_out) + 1, dtype=np.int32) * num_perm
        return pa.ListArray.from_arrays(pa.array(out_offsets), pa.array(flat_out.ravel()))

    return kernel(normalize_text(text))


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """One 64-bit key per band of the signature."""
    return F.array(*[F.xxhash64(F.lit(i), F.slice(signature, i * rows + 1, rows)) for i in range(bands)])


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two duplicate-free arrays; two empty arrays are equal."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)
