"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Each text becomes its set of distinct shingle hashes, sorted. Texts with equal sets are one node.
2. Sizes fall into bands. Within a band the hash range is cut into segments. Two sets with similarity t differ in at most
   ``n (1 - t) / t`` elements (n: either size), so of the first that many plus two non-empty segments at least two are the same in
   both. A tile is (band, segment, content of the segment); a set enters a tile for each of those segments, and also the
   tiles of the next band if a partner may be there. Small bands use each element as a segment of its own.
3. Tiles of one node are dropped: tile keys and nodes meet as packed pairs of eight bytes, each node once. Small tiles give their pairs, and those met in two of them are candidates. In a large tile
   each member is first compared with the tile's least node; then components are built, and large tiles that still hold several
   are compared pair by pair inside a task, as a grid of blocks, so that no pair is written unless its bitmaps allow a link.
   A tile with more blocks than its members have other tiles is first split by those, since linked pairs share two.
4. For every candidate the bitmaps come first: equal bits plus the collisions bound the overlap from above.
5. What passes is decided by intersecting the sorted arrays.

No link is lost but for chance events of hashing (64-bit collisions; a set that leaves so many segments empty that too few
are left and whose differences then hit all of them: below 1e-15 per document).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm import words as W
from corpuswatch.llm.arrow_rows import veiled
from corpuswatch.llm.components import components
from corpuswatch.llm.prefilter import Prefilter
from corpuswatch.llm.tables import discard, stored

#: First size of each band. Below the second, every shingle is a segment of its own.
BAND_EDGES = np.array([1, 48, *np.unique(np.round(116 * 2.4 ** np.arange(0, 24)).astype(np.int64))])
SHINGLES_PER_SEGMENT = 2.5
#: Pairs of a tile's key and a node that a task holds before it packs them; pairs of one part, on average; bits of a node in a pair.
PAIRS_HELD, PART_PAIRS, NODE_BITS = 300_000, 500_000, 36
#: Members of a tile whose pairs are written out, at most 15 for each of its members.
SMALL_TILE = 32
#: Members times shingles of the largest member that one block of a tile holds: bounds a task's bit matrix to 25 MB.
BLOCK = 500_000
#: Members of one block: bounds a task's matrices of members times members to 32 MB each.
MEMBERS = 2_000


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start[i], start[i] + length[i])``."""
    if not length.sum():
        return np.zeros(0, dtype=np.int64)
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def nodes_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each whole set; equal sets have equal hashes."""
    return W.mixed(W.sums(W.mixed(values, 11), first), 12)


def tile_keys(values: np.ndarray, first: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Tile keys of each set, flat, and where each set's part begins."""
    sizes = np.diff(first)
    own = np.searchsorted(BAND_EDGES, sizes, side="right") - 1
    differ = np.floor(sizes * (1 - similar) / similar + 1e-9).astype(np.int64)
    whose, keys = [], []
    for step in (0, 1):
        bands = own + step
        there = sizes > 0
        if step:
            there &= (bands < len(BAND_EDGES)) & (sizes >= np.ceil(BAND_EDGES[np.minimum(bands, len(BAND_EDGES) - 1)] * similar - 1e-9))
        for band in np.unique(bands[there]):
            sets = np.flatnonzero(there & (bands == band))
            length = sizes[sets]
            element = values[_ranges(first[sets], length)]
            owner = np.repeat(np.arange(len(sets)), length)
            if band:
                top = BAND_EDGES[band + 1] if band + 1 < len(BAND_EDGES) else 2 * BAND_EDGES[band]
                segment = ((element >> np.uint64(32)) * np.uint64(int(top / SHINGLES_PER_SEGMENT))) >> np.uint64(32)
            else:
                segment = element
            new = np.ones(len(element), dtype=bool)
            new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
            run = np.flatnonzero(new)
            content = np.add.reduceat(W.mixed(element, 21), run)
            of = owner[run]
            rank = np.arange(len(run)) - np.searchsorted(of, of)
            keep = rank <= differ[sets][of] + 1
            keys.append(W.mixed(content[keep] + segment[run][keep] * np.uint64(0x9E3779B97F4A7C15), 31 + int(band)))
            whose.append(sets[of[keep]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    whose, keys = np.concatenate(whose), np.concatenate(keys)
    order = np.argsort(whose, kind="stable")
    return keys[order], np.searchsorted(whose[order], np.arange(len(first)))


def bitmap(elements: np.ndarray) -> bytes:
    """Hashed bitmap of a power of two of bits, six for each element at least: few collisions, so a tight bound."""
    bits = 64
    while bits < 6 * len(elements):
        bits *= 2
    out = np.zeros(bits, dtype=np.uint8)
    out[elements & np.uint64(bits - 1)] = 1
    return np.packbits(out).tobytes()


def _fold(bits: np.ndarray, length: int) -> np.ndarray:
    """A bitmap of fewer bits that a larger one contains (bit positions are low bits of the hash)."""
    return bits.reshape(-1, length).any(axis=0)


def may_link(n_a, n_b, filled_a, filled_b, common, similar: float):
    """Upper bound of the overlap from bit counts, against what the similarity needs."""
    most = common + np.minimum(n_a - filled_a, n_b - filled_b)
    return most * (1 + similar) >= similar * (n_a + n_b) - 1e-9


def _sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                values, first = W.shingle_sets(W.words_of(part.column("text")), length)
                bits = [bitmap(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array(W.signed(nodes_of(values, first))), pa.array(np.diff(first), pa.int32()),
                        pa.array(bits, pa.binary()),
                    ],
                    ["doc_id", "text_key", "node", "n", "bits"],
                )

    return run


def pack(pairs: np.ndarray) -> bytes:
    """Sorted pairs; bytes of a rank stand together, so the first ones, those of the keys, compress well."""
    return np.sort(pairs).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _wanted_sets(part: pa.RecordBatch, length: int, wanted: Prefilter, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shingles, where each set begins, nodes, and which sets are not empty and may be those that speak for their node."""
    values, first = W.shingle_sets(W.words_of(part.column("text")), length)
    node = nodes_of(values, first)
    doc = part.column("doc_id").cast(pa.int64()).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
    return values, first, node, np.flatnonzero((np.diff(first) > 0) & wanted.holds(seen, node ^ doc.view(np.uint64)))


def _packed_tiles(similar: float, length: int, shift: int, low: int, wanted: Prefilter):
    """Rows (part, pairs): tile keys dealt by their first ``shift`` bits; a pair of 64 bits holds the next ones of the key and the ``low`` last of the node."""
    below = np.uint64(low)

    def blocks(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key)
        key, node = key[order], node[order] & np.uint64((1 << low) - 1)
        parts = (key >> np.uint64(64 - shift)).astype(np.int32)
        pairs = ((key << np.uint64(shift)) >> below << below) | node
        edges = np.flatnonzero(np.diff(parts, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(parts[edges]), pa.array([pack(x) for x in np.split(pairs, edges[1:])], pa.binary())], ["part", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, held = wanted.table(), [], [], 0
        for batch in batches:
            for part in W.chunks(batch, "text"):
                values, first, node, keep = _wanted_sets(part, length, wanted, seen)
                size = np.diff(first)[keep]
                key, at = tile_keys(values[_ranges(first[keep], size)], np.concatenate([[0], np.cumsum(size)]), similar)
                keys.append(key)
                nodes.append(np.repeat(node[keep], np.diff(at, append=len(key))[: len(keep)]))
                held += len(key)
                if held >= PAIRS_HELD:
                    yield blocks(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield blocks(keys, nodes)

    return run


def _shared_tiles(low: int):
    """Over rows (part, pairs): rows (key, low, size) of the tiles that hold several nodes; a part is settled where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                held.setdefault(part, []).append(unpack(block))
        for part in sorted(held):
            pairs = np.concatenate(held.pop(part))
            pairs.sort()
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
            key = pairs >> np.uint64(low)
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(edges, append=len(key))
            size = np.repeat(size, size).astype(np.int32)
            pairs, key, size = (x[size > 1] for x in (pairs, key, size))
            key = (np.int64(part) << np.int64(64 - low)) | key.astype(np.int64)
            node = (pairs & np.uint64((1 << low) - 1)).astype(np.int64)
            for at in range(0, len(key), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(node[cut]), pa.array(size[cut])], ["key", "low", "size"])

    return run


def _elements(length: int, wanted: Prefilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = wanted.table()
        for batch in batches:
            for part in W.chunks(batch, "text"):
                values, first, node, keep = _wanted_sets(part, length, wanted, seen)
                size = np.diff(first)[keep]
                flat = values[_ranges(first[keep], size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(node[keep])), W.lists(W.signed(flat), np.concatenate([[0], np.cumsum(size)]), pa.int64())], ["node", "elements"]
                )

    return run


def _bounded(similar: float):
    """Keep pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (n_a, n_b, x, y) in enumerate(zip(*columns, strict=True)):
                x, y = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
                length = min(len(x), len(y))
                x, y = _fold(x, length), _fold(y, length)
                keep[i] = min(n_a, n_b) >= similar * max(n_a, n_b) - 1e-9 and may_link(n_a, n_b, x.sum(), y.sum(), (x & y).sum(), similar)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _exact(similar_num: int, similar_den: int):
    """Keep pairs whose sorted arrays overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in ("elements_a", "elements_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = similar_den * both >= similar_num * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _compared(similar: float):
    """All pairs of a tile's block (or of two blocks) whose components differ and whose bitmaps allow a link.

    A pair is written by the first of the tiles that both are in, so once.
    """

    def pairs(same: bool, sides: list[tuple]) -> np.ndarray:
        length = 8 * min(min(map(len, raw)) for _, _, _, raw in sides)
        (node_a, comp_a, n_a, bits_a), (node_b, comp_b, n_b, bits_b) = [
            (*arrays, np.stack([_fold(np.unpackbits(np.frombuffer(x, np.uint8)), length) for x in raw]).astype(np.float32)) for *arrays, raw in sides
        ]
        filled_a, filled_b = bits_a.sum(axis=1), bits_b.sum(axis=1)
        ok = may_link(n_a[:, None], n_b[None, :], filled_a[:, None], filled_b[None, :], bits_a @ bits_b.T, similar)
        ok &= comp_a[:, None] != comp_b[None, :]
        ok &= np.minimum(n_a[:, None], n_b[None, :]) >= similar * np.maximum(n_a[:, None], n_b[None, :]) - 1e-9
        if same:
            ok &= node_a[:, None] < node_b[None, :]
        i, j = np.nonzero(ok)
        return np.stack([np.minimum(node_a[i], node_b[j]), np.maximum(node_a[i], node_b[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), dtype=np.int64)]
            same, members, keys = (batch.column(c) for c in ("same", "members", "key"))
            for k in range(batch.num_rows):
                rows = members[k].values
                node, component, n, side = (rows.field(c).to_numpy() for c in ("node", "component", "n", "side"))
                raw = rows.field("bits").to_pylist()
                halves = [np.arange(len(node))] * 2 if same[k].as_py() else [np.flatnonzero(side == x) for x in (0, 1)]
                if len(halves[0]) and len(halves[1]):
                    met, key = pairs(same[k].as_py(), [(node[h], component[h], n[h], [raw[i] for i in h]) for h in halves]), keys[k].as_py()
                    tiles = dict(zip(node.tolist(), map(set, rows.field("tiles").to_pylist()), strict=True)) if met.size else {}
                    for part in np.array_split(met, 1 + met.shape[1] // 100_000, axis=1):
                        found.append(part[:, [min(tiles[a] & tiles[b]) == key for a, b in part.T.tolist()]])
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _paired(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _only(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """``nodes`` with few others than those of ``named``, chosen where they are read: a join would shuffle the bitmaps of all."""
    return nodes.where(Prefilter.of(named, F.col("node")).may_hold(F.col("node")))


def _links(pairs: DataFrame, nodes: DataFrame, source: DataFrame, length: int, numerator: int, denominator: int) -> DataFrame:
    """Those of the (stored) pairs that are links: bitmap bound first; whole arrays, made anew from the texts, for the nodes of what passes."""
    passed = stored(_paired(pairs, nodes, ["n", "bits"]).mapInArrow(_bounded(numerator / denominator), "a long, b long"), "bounded")
    named = passed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = nodes.select("node", "rep").join(named, "node", "left_semi")
    wanted = Prefilter.of(chosen, F.col("node").bitwiseXOR(F.col("rep")))
    elements = source.mapInArrow(_elements(length, wanted), "node long, elements array<bigint>")
    elements = stored(elements.join(named, "node", "left_semi").dropDuplicates(["node"]), "elements")
    links = stored(_paired(passed, elements, ["elements"]).mapInArrow(_exact(numerator, denominator), "a long, b long"), "links")
    discard(passed, elements)
    return links


def _labelled(members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Tile members with their sizes and the components that the links make."""
    label = nodes.select("node", "n").join(components(links), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    return stored(members.join(label, "node").select("key", "node", "n", "component"), "labelled")


def _open_tiles(members: DataFrame, similar: float) -> DataFrame:
    """Rows (key, blocks, others) of the tiles that hold several components; others: no member has more other tiles."""
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.max("n").alias("top")]
    blocks = F.greatest(F.ceil(F.col("size") * F.col("top") / BLOCK), F.ceil(F.col("size") / MEMBERS))
    others = 2 * (F.floor(F.col("top") * ((1 - similar) / similar) + 1e-9) + 2)
    return members.groupBy("key").agg(*ends).where("low < high").select("key", blocks.cast("int").alias("blocks"), others.alias("others"))


def _places(open_members: DataFrame, small: DataFrame, similar: float) -> DataFrame:
    """Rows (key, node, n, component, blocks): where the members of open tiles are compared; a key is a tile or a part of one.

    A tile with more blocks than its members have other tiles is split by their second tile: a small one or another of
    these large ones. A pair whose second tile is any other has one component, or is compared in that tile. Where the
    parts would compare more pairs than the tile, the tile stays whole.
    """
    columns = ["key", "node", "n", "component"]
    whole = open_members.select(*columns, "blocks")
    hot = open_members.where("blocks > others")
    if hot.isEmpty():
        return whole
    near = small.join(hot.select("node").distinct(), "node", "left_semi").select("node", F.col("key").alias("second"), F.lit(False).alias("hot"))
    second = near.unionByName(hot.select("node", F.col("key").alias("second"), F.lit(True).alias("hot")))
    parts = stored(hot.join(second, "node").where("not hot or second > key").select(*columns, "second"), "parts")
    square = F.col("size").cast("double") * F.col("size")
    work = parts.groupBy("key", "second").agg(F.count("*").alias("size")).groupBy("key").agg(F.sum(square).alias("work"))
    tiles = hot.groupBy("key").agg(F.count("*").alias("size")).join(work, "key", "left")
    cut = stored(tiles.where(F.coalesce("work", F.lit(0.0)) < square).select("key"), "cut")
    split = parts.join(cut, "key").withColumn("key", F.xxhash64("key", "second")).select(*columns)
    split = split.join(_open_tiles(split, similar).select("key", "blocks"), "key")
    return stored(whole.join(cut, "key", "left_anti").unionByName(split), "places")


def _members(source: DataFrame, nodes: DataFrame, similar: float, length: int) -> DataFrame:
    """Rows (key, node, size) of the tiles that several nodes share; size is the same for all rows of a key.

    Each tile of a node meets the others as eight bytes: bits of its key within a part of all keys, and the last ``NODE_BITS`` of the node. The
    few nodes and keys that are alike in these share tiles that they need not; what links is decided later, so that adds candidates only.
    """
    spark = source.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = nodes.agg(F.sum(F.col("n") * F.lit((1 - similar) / similar) + 2)).first()[0] or 0
    shift = max(1, math.ceil(math.log2(max(4 * partitions, 1.25 * shingles / PART_PAIRS))))
    wanted = Prefilter.of(nodes, F.col("node").bitwiseXOR(F.col("rep")))
    packed = source.mapInArrow(_packed_tiles(similar, length, shift, NODE_BITS, wanted), "part int, pairs binary")
    shared = packed.repartition(max(partitions, 2**shift // 4), "part").mapInArrow(_shared_tiles(NODE_BITS), "key long, low long, size int")
    return shared.join(nodes.select("node", F.col("node").bitwiseAND(F.lit((1 << NODE_BITS) - 1)).alias("low")), "low").select("key", "node", "size")


def _classified(documents: DataFrame, length: int, numerator: int, denominator: int) -> DataFrame:
    """Rows (doc_id, text_key, n, class, component_id), one for each row: class is null for an empty set, which links with nothing."""
    if 2 * numerator <= denominator:
        raise ValueError("the similarity must be above one half")
    spark = documents.sparkSession
    similar = numerator / denominator
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    sets = stored(source.mapInArrow(_sets(length), "doc_id long, text_key long, node long, n int, bits binary"), "sets")
    known = sets.where("n > 0").select("node", "n", "bits", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rep"))
    nodes = stored(known.groupBy("node").agg(F.min("rep").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    docs = stored(sets.select("doc_id", "text_key", "node", "n"), "docs")
    discard(sets)

    members = stored(_members(source, nodes, similar, length), "members")
    large = members.where(F.col("size") > SMALL_TILE)
    large_members = stored(large.join(large.groupBy("key").agg(F.min("node").alias("lead")), "key").select("key", "node", "lead"), "large")
    small_members = members.where(F.col("size") <= SMALL_TILE).select("key", "node")
    small = small_members.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met_twice = small.select(F.explode(pairs).alias("pair")).groupBy("pair.a", "pair.b").agg(F.count("*").alias("tiles")).where("tiles > 1")
    stars = large_members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    candidates = stored(met_twice.select("a", "b").unionByName(stars).distinct(), "candidates")
    links = _links(candidates, nodes, source, length, numerator, denominator)
    labelled = _labelled(large_members, nodes, links)
    # What is left are pairs of members of different components in tiles that still hold several.
    open_members = stored(labelled.join(_open_tiles(labelled, similar), "key"), "open")
    places = _places(open_members, small_members, similar)
    near = stored(_only(nodes, places), "near")
    discard(nodes)
    seen_in = places.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("tiles"))
    placed = (
        places
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("key", "node", "component", "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"))
    )
    member = F.struct("node", "component", "n", "bits", "tiles", (F.col("block") != F.col("row")).cast("int").alias("side"))
    sketches = near.select("node", "n", "bits").join(seen_in, "node")
    met = placed.join(sketches, "node").groupBy("key", "row", "col").agg(F.collect_list(member).alias("members"))
    open_pairs = (
        met.select("key", (F.col("row") == F.col("col")).alias("same"), "members").mapInArrow(_compared(similar), "a long, b long")
        .distinct().join(candidates, ["a", "b"], "left_anti")
    )
    more = _links(stored(open_pairs, "pairs"), near, source, length, numerator, denominator)
    discard(near)
    component = components(links.unionByName(more))

    ids = docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(component, "node", "left")
    ids = ids.withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = ids.join(least, "component").select("node", F.col("component").alias("class"), "component_id")
    return docs.join(classes, "node", "left").select(
        "doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def jaccard_classes(documents: DataFrame, length: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``documents`` (doc_id, text; other columns are ignored).

    Two texts link when ``denominator * |x & y| >= numerator * |x | y|`` for their sets of ``length``-word shingles (words:
    no ASCII blanks, A-Z lower-cased). ``component_id`` is the smallest doc_id reachable by links. A null, empty or blank text has
    an empty set, links with nothing and is its own component. A text of fewer than ``length`` words is one shingle. Rows
    that repeat, also with the same doc_id, are separate rows of one class; a null doc_id joins its class but never names it, so
    a class of null ids alone has a null component. An empty table gives no rows.
    """
    return _classified(documents, length, numerator, denominator).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def _row_key(doc_id: Column, text_key: Column) -> dict[str, Column]:
    """What tells rows apart, without nulls and in the order in which a class takes its least row."""
    return {"_unnamed": doc_id.isNull(), "_id": F.coalesce(doc_id, F.lit(0)), "_text_key": text_key}


ROW = ["_unnamed", "_id", "_text_key"]


def _sure_and_unsure(rows: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the rows that stay for certain, and those that only a join can judge: repeats, and what the bitmaps mix up.

    Each row of ``judged`` (the row key, copies, keeper) is in the bitmap of those that stay, of those that go, or in both if it
    repeats. A row that only one of them may hold is settled where it is read, so its text meets no shuffle.
    """
    hashed = F.xxhash64(*ROW)
    may_stay = Prefilter.of(judged.where("keeper"), hashed).may_hold(hashed)
    may_go = Prefilter.of(judged.where("keeper is null or copies > 1"), hashed).may_hold(hashed)
    some = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.where(~some | (may_stay & ~may_go)), rows.where(some & may_stay & may_go)


def one_per_class(documents: DataFrame, length: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The rows of ``documents`` that stay when each class keeps one: the least by doc_id (null last), then by a hash of the text.

    Rows are judged one by one: two unrelated texts under one doc_id are two classes and both stay; a row without a doc_id stays only
    if no row of its class has one. Of rows that repeat doc_id and text one stays. A null, empty or blank text links with
    nothing, so all such rows stay.
    """
    named = _classified(documents, length, numerator, denominator).where("class is not null")
    classes = stored(named.withColumns(_row_key(F.col("doc_id"), F.col("text_key"))).select("class", *ROW), "classes")
    keepers = classes.groupBy("class").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*", F.lit(True).alias("keeper"))
    judged = stored(classes.groupBy(*ROW).agg(F.count("*").alias("copies")).join(keepers, ROW, "left"), "judged")
    plain, restored = veiled(documents, ("doc_id", "text"))
    rows = plain.withColumns(_row_key(F.col("doc_id").cast("bigint"), F.xxhash64("text")))
    sure, unsure = _sure_and_unsure(rows, judged)
    # Repeats go first, and before the shuffle as well as after it; the join then finds the rows dealt by its own key.
    settled = unsure.dropDuplicates(ROW).join(judged.where("keeper").select(*ROW), ROW, "left_semi")
    return restored(sure.unionByName(settled))
