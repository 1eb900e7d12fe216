"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every window of the training texts.

The set of benchmark windows is broadcast in parts of at most ``max_windows`` windows; a benchmark of more is scanned for part by
part, and the hits are united. Each hash hit is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm import words as W
from corpuswatch.llm.arrow_rows import veiled
from corpuswatch.llm.tables import stored

#: Benchmark windows that one broadcast holds (about 100 bytes each).
MAX_WINDOWS = 1_000_000
NAMES = {"n_words": "bigint", "n_hit": "bigint", "items": "array<bigint>", "spans": "array<struct<first:int,last:int>>"}


class GramIndex:
    """Windows of benchmark items by length: sorted hashes, the words of each, and the items it occurs in."""

    def __init__(self, items: list[tuple[int | None, str]], length: int):
        self.length = length
        found: dict[int, dict[bytes, set[int]]] = {}
        for item, text in items:
            w = W.words_of(pa.array([text], pa.large_string()), W.LETTERS)
            n = len(w.hash)
            size = min(n, length)
            for a in range(n - size + 1 if n else 0):
                found.setdefault(size, {}).setdefault(w.text(a, a + size), set()).update([] if item is None else [item])
        self.sizes = {}
        for size, grams in found.items():
            texts = list(grams)
            w = W.words_of(pa.array([t.decode() for t in texts], pa.large_string()), W.LETTERS)
            hashes = w.windows(size)[0][w.first[:-1]]
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = (hashes[order], [texts[i] for i in order], [grams[texts[i]] for i in order])

    def hits(self, w: W.Words) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, size, items) of each verified occurrence in a batch of texts."""
        for size, (hashes, texts, items) in self.sizes.items():
            own, inside = w.windows(size)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in np.flatnonzero(inside & (hashes[at] == own)):
                words, j = w.text(i, i + size), at[i]
                while j < len(hashes) and hashes[j] == own[i]:
                    if texts[j] == words:
                        yield int(i), size, items[j]
                        break
                    j += 1


def _scanned(index, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = index.value
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.words_of(part.column("text"), W.LETTERS)
                hit = np.zeros(len(w.hash) + 1, dtype=np.int64)
                items: list[set[int]] = [set() for _ in range(part.num_rows)]
                for i, size, which in grams.hits(w):
                    hit[i] += 1
                    hit[i + size] -= 1
                    items[int(np.searchsorted(w.first, i, side="right")) - 1] |= which
                covered = np.cumsum(hit)[:-1] > 0
                n_hit = W.sums(covered.astype(np.int64), w.first)
                spans = [[] for _ in range(part.num_rows)]
                for d in np.flatnonzero(n_hit):
                    own = np.concatenate([[False], covered[w.first[d] : w.first[d + 1]], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    spans[d] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    ],
                    [*[f"c{i}" for i in range(len(keep))], *NAMES],
                )

    return run


def _parts(benchmark: DataFrame, length: int, max_windows: int) -> list[list[tuple[int, str]]]:
    """The items in parts of at most ``max_windows`` windows (an item of more is a part of its own)."""
    n = F.greatest((F.length("text") + 1) / 2, F.lit(1)).cast("bigint")  # no text has more words than that
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(n)).first()[0] or 0
    count = -(-total // max_windows)
    if count <= 1:
        return [[tuple(r) for r in items.collect()]]
    dealt = stored(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), "items")
    return [[(r[0], r[1]) for r in dealt.where(F.col("part") == i).collect()] for i in range(count)]


def scan(documents: DataFrame, benchmark: DataFrame, length: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``documents`` (with all its columns) plus n_words, n_hit, items and spans, row by row, without a shuffle.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. An item's windows are its
    runs of ``length`` words; an item of fewer, but not none, is one window. ``n_hit`` counts the words inside any
    occurrence of a window, ``items`` the item_ids with an occurring window, ``spans`` the runs of hit words by number
    (0-based, inclusive), for removal of spans. Null and empty texts have no words and no hits; null items and items without words are no
    window; repeated items and documents count as they come; an item without an item_id hits words but is not listed. Columns of ``documents``
    named like the new ones are replaced. More than ``max_windows`` benchmark windows need one scan per part.
    """
    spark = documents.sparkSession
    keep = [c for c in documents.columns if c not in NAMES]
    source = documents.select(*keep)
    types = dict(source.dtypes)
    schema = ", ".join([f"c{i} {types[c]}" for i, c in enumerate(keep)] + [f"{c} {t}" for c, t in NAMES.items()])
    parts = _parts(benchmark, length, max_windows)
    renamed = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    out = None
    for items in parts:
        index = spark.sparkContext.broadcast(GramIndex(items, length))
        if out is None:
            out = source.mapInArrow(_scanned(index, keep), schema).select(*renamed, *NAMES)
        else:
            before = {c: f"_{c}" for c in ("items", "spans")}
            kept = [c for c in out.columns if c not in NAMES] + list(before.values())
            types = dict(out.withColumnsRenamed(before).dtypes)
            again = ", ".join([f"c{i} {types[c]}" for i, c in enumerate(kept)] + [f"{c} {t}" for c, t in NAMES.items()])
            out = out.withColumnsRenamed(before).drop("n_words", "n_hit").mapInArrow(_scanned(index, kept), again)
            out = out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *NAMES)
            out = out.withColumn("items", F.array_sort(F.array_union("items", "_items"))).withColumn("spans", merged("spans", "_spans"))
            out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)).drop("_items", "_spans")
    return out


def merged(a: str, b: str):
    """Two lists of word spans as one list without overlaps."""
    empty = F.slice(F.col(a), 1, 0)

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(F.concat(a, b)), empty, add)


def remove_documents(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``documents`` without any hit, with their own columns."""
    plain, restored = veiled(documents, ("text",))
    return restored(scan(plain, benchmark, **parameters).where("n_hit = 0"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = W.words_of(batch.column("text"), W.LETTERS)
        data, _ = W.text_buffers(batch.column("text"))
        out = []
        for d, spans in enumerate(batch.column("spans").to_pylist()):
            at, kept = int(w.offsets[d]), []
            for s in spans:
                kept.append(data[at : w.start[w.first[d] + s["first"]]].tobytes())
                at = int(w.end[w.first[d] + s["last"]])
            kept.append(data[at : w.offsets[d + 1]].tobytes())
            out.append(b"".join(kept).decode())
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, batch.column(i).type))


def digest_ids(items: str):
    """sha256 of the ids as strings, sorted as strings, joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def remove_spans(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """All rows of ``documents``, their texts without the runs of hit words (what stands between the words of a run goes too)."""
    plain, restored = veiled(documents, ("text",))
    found = scan(plain, benchmark, **parameters).drop("n_words", "n_hit", "items")
    clean = found.where(F.size("spans") == 0).drop("spans")
    cut = found.where(F.size("spans") > 0)
    cut = cut.mapInArrow(_cut, cut.schema).drop("spans")
    return restored(clean.unionByName(cut))
