"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

1. Every text is cut into words. Texts with the same words are one sequence; all but its first document are copies.
2. Level 0 looks at windows of ``first_length`` words. Of those in each window of the final length only the one with the smallest
   hash is looked at (equal windows pick equal ones), so about one in six is shuffled. Those found in two sequences survive.
3. Each next level forms the windows of twice the length that hold a survivor, until the final length or until none survives.
4. Windows of the final length that an earlier document also has are sent to their documents, which cover their words. Repeats
   inside one document are found in its own pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm import words as W
from corpuswatch.llm.tables import stored

LAST = 2**63 - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on (near the end, of what is there)."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _picked(w: W.Words, small: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the smallest hash of ``small``-word windows in the ``large``-word window from there; whether that lies in one text."""
    grams, _ = w.windows(small)
    inside = np.arange(len(w.hash)) + large <= np.repeat(w.first[1:], w.counts)
    return _sliding_min(grams, large - small + 1), inside


def _distinct(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, flat, and where each document's part begins."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def _again(w: W.Words, length: int) -> np.ndarray:
    """Whether the window from each word also starts earlier in the same text."""
    hashes, inside = w.windows(length)
    at = np.flatnonzero(inside)
    keys = W.mixed(hashes[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out = np.zeros(len(w.hash), dtype=bool)
    out[at] = True
    out[at[first]] = False
    return out


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(len(starts) + length, dtype=np.int64)
    edge[: len(starts)] += starts
    edge[length:] -= starts
    return np.cumsum(edge)[: len(starts)] > 0


def _results(w: W.Words, removed: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words removed, and sha256 of the kept words joined by one space, of each text."""
    kept = ~removed
    edge = np.zeros(len(w.data) + 2, dtype=np.int32)
    edge[w.start[kept]] += 1
    # A word that is kept brings the byte behind it, which becomes its space; the last one of a text does not.
    number = np.flatnonzero(kept)
    doc = w.doc[number]
    last = np.ones(len(number), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    space = w.end[number[~last]]
    np.subtract.at(edge, np.where(last, w.end[number], w.end[number] + 1), 1)
    bytes_kept = np.cumsum(edge)[: len(w.data)] > 0
    data = w.data.copy()
    data[space] = 0x20
    out = data[bytes_kept].tobytes()
    at = np.concatenate([[0], np.cumsum(bytes_kept)])[w.offsets]
    return W.sums(removed.astype(np.int64), w.first), [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _sequences(w: W.Words) -> np.ndarray:
    """A hash of each text's whole word sequence; 0 for no words."""
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
    total = W.sums(W.mixed(w.hash + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), w.first)
    return np.where(w.counts > 0, W.mixed(total + w.counts.astype(np.uint64)), np.uint64(0))


def _first_pass(first_length: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.words_of(part.column("text"), lower=False)
                n = part.num_rows
                grams, inside = _picked(w, first_length, length)
                flat, at = _distinct(w.doc[inside], grams[inside], n)
                removed, digest = _results(w, _covered(_again(w, length), length))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(W.signed(_sequences(w))), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(digest, pa.string()), W.lists(W.signed(flat), at, pa.int64()),
                    ],
                    ["doc_id", "sequence", "n_words", "n_removed", "kept_sha256", "grams"],
                )

    return run


def _alive(part: pa.RecordBatch, w: W.Words):
    """A test whether values, one for each word, are among those that the word's document got from the level before."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    given = part.column("grams")
    owner = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(given).to_numpy()).astype(np.uint64)
    known = np.sort(given.flatten().to_numpy().view(np.uint64) ^ W.mixed(owner * salt))
    own = W.mixed(w.doc.astype(np.uint64) * salt)
    return lambda values: _member(values ^ own, known)


def _extended(small: int, large: int, sampled: bool, final: int):
    """Windows of ``large`` words that hold surviving windows of ``small`` words, distinct per document.

    ``sampled``: the survivors are the picks of windows of the final length, so all windows of ``large`` words inside those go on;
    else both halves must have survived.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.words_of(part.column("text"), lower=False)
                alive = _alive(part, w)
                hashes, inside = w.windows(large)
                if sampled:
                    grams, whole = _picked(w, small, final)
                    inside &= _covered(alive(grams) & whole, final - large + 1)
                else:
                    ok = alive(w.windows(small)[0])
                    inside[: len(ok) - small] &= ok[small:]
                    inside &= ok
                flat, at = _distinct(w.doc[inside], hashes[inside], part.num_rows)
                ids = np.repeat(part.column("doc_id").to_numpy(), np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(flat)), pa.array(ids, pa.int64())], ["gram", "doc_id"])

    return run


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _last_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.words_of(part.column("text"), lower=False)
                hashes, inside = w.windows(length)
                starts = _again(w, length) | (inside & _alive(part, w)(hashes))
                removed, digest = _results(w, _covered(starts, length))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(W.signed(_sequences(w))), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                    ["doc_id", "sequence", "n_removed", "kept_sha256"],
                )

    return run


def repeated_words(documents: DataFrame, length: int = 20, first_length: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of ``documents`` (doc_id, text; other columns are ignored).

    Words are runs without ASCII blanks, unchanged. A word is removed if a window of ``length`` consecutive words of one document covers
    it whose words also start earlier: in a document of smaller doc_id, or earlier in the same document. ``kept_sha256`` is
    the digest of the kept words joined by one space. Null, empty and short texts (fewer than ``length`` words) lose nothing.
    A null doc_id comes last; rows that share a doc_id count as one place in that order and are not compared with each other. An empty table gives no rows.
    ``length`` must be ``first_length`` times a power of two.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), "text")
    known = stored(
        source.mapInArrow(_first_pass(first_length, length), "doc_id long, sequence long, n_words long, n_removed long, kept_sha256 string, grams array<bigint>"), "first"
    )
    docs = known.drop("grams")
    firsts = stored(docs.groupBy("sequence").agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words")), "firsts")

    texts = source.repartition(partitions, "doc_id")
    rows = known.select("sequence", F.explode("grams").alias("gram")).repartition(partitions, "gram")
    shared = rows.groupBy("gram").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).where("low < high").select("gram")
    alive = rows.join(shared, "gram").groupBy("sequence").agg(F.collect_set("gram").alias("grams"))
    alive = stored(alive.join(firsts, "sequence").select("doc_id", "grams"), "alive")
    size = first_length
    while size < length:
        at, size = size, 2 * size
        windows = texts.join(alive.groupBy("doc_id").agg(F.flatten(F.collect_list("grams")).alias("grams")), "doc_id")
        windows = windows.mapInArrow(_extended(at, size, at == first_length, length), "gram long, doc_id long").repartition(partitions, "gram")
        first = windows.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "low")
        alive = windows.join(first, "gram")
        alive = alive.where("doc_id > low") if size == length else alive
        alive = alive.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
        if size < length:
            alive = stored(alive, "alive")
    hit = texts.join(alive, "doc_id").mapInArrow(
        _last_pass(length), "doc_id long, sequence long, n_removed long, kept_sha256 string"
    ).dropDuplicates(["doc_id", "sequence"])
    return _assembled(docs, firsts, hit, length)


def _assembled(docs: DataFrame, firsts: DataFrame, hit: DataFrame, length: int) -> DataFrame:
    """Copies lose all words, documents with hits get their new results, the others keep those of their own pass."""
    first = firsts.select("sequence", F.col("doc_id").alias("first_id"))
    hit = hit.select("doc_id", "sequence", F.col("n_removed").alias("hit_removed"), F.col("kept_sha256").alias("hit_sha256"))
    joined = docs.join(first, "sequence").join(hit, ["doc_id", "sequence"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= length)
    return joined.select(
        F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("hit_removed", "n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("hit_sha256", "kept_sha256")).alias("kept_sha256"),
    )
