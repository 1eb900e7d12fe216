"""The join against all pairs, also with every tile cut into blocks; components against union-find."""

import random
import time
from pathlib import Path

import brute as B
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswatch.llm import jaccard_join as J
from corpuswatch.llm.components import components
from corpuswatch.llm.prefilter import BITS


def check(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, J.jaccard_classes(df, **parameters).collect()), key=B.key)
    assert got == sorted(B.classes(rows, **parameters), key=B.key)


def test_awkward_rows(spark, awkward, empty):
    got = sorted(map(tuple, J.jaccard_classes(awkward).collect()), key=B.key)
    assert got == sorted(B.classes([r[:2] for r in B.awkward_rows()]), key=B.key)
    assert J.jaccard_classes(empty).count() == 0


def test_hot_tiles_in_blocks(spark, monkeypatch):
    """Near copies around the threshold: many tiles whose members are not linked to their lead."""
    monkeypatch.setattr(J, "BLOCK", 300)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(60)}"
        rows.append((i * 3 + 1, " ".join(words)))
    check(spark, rows)
    check(spark, rows[:40], length=3, numerator=60, denominator=100)


def hot_texts(n, phrases):
    """Different short texts that all begin with one phrase whose shingle has a low hash; each fifth has a near copy."""
    rng = random.Random(3)
    named = [f"p{i} q r s t" for i in range(4_000)]
    values, _ = J.W.shingle_sets(J.W.words_of(pa.array(named)), 5)
    low = [named[i] for i in (values < 2**64 // 400).nonzero()[0][:phrases]]
    assert len(low) == phrases
    rows = []
    for i in range(n):
        text = " ".join([*low, *(f"w{rng.randrange(10**6)}" for _ in range(9))])
        rows += [(3 * i, text), (3 * i + 1, f"{text} more")][: 2 - (i % 5 > 0)]
    return rows


@pytest.mark.parametrize("phrases", [1, 2])
def test_short_texts_with_one_phrase(spark, monkeypatch, phrases):
    """No task gets more members at a time than two blocks have, and the result is that of all pairs."""
    compared = J._compared

    def bounded(similar):
        inner = compared(similar)

        def run(batches):
            for batch in batches:
                assert max(map(len, batch.column("members"))) <= 80
                yield from inner(iter([batch]))

        return run

    monkeypatch.setattr(J, "_compared", bounded)
    monkeypatch.setattr(J, "MEMBERS", 16, raising=False)
    monkeypatch.setattr(J, "SMALL_TILE", 3)
    check(spark, hot_texts(200, phrases))


def test_hot_tile_is_split_by_the_second_tile(spark):
    """Only members that share a second tile are compared, once each, wherever that costs less than the grid."""
    members = [(1, node, 10, node, 20, 8) for node in range(40)]
    tile = spark.createDataFrame(members, "key long, node long, n int, component long, blocks int, others long")
    second = spark.createDataFrame([(100 + node // 2, node) for node in range(0, 30)], "key long, node long")
    got = J._places(tile, second, 0.8).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).collect()
    assert sorted(r.nodes for r in got) == [[node, node + 1] for node in range(0, 30, 2)]
    one = spark.createDataFrame([(100, node) for node in range(40)], "key long, node long")
    assert {r.key for r in J._places(tile, one, 0.8).collect()} == {1}


def test_every_size_around_the_threshold(spark):
    """Sets of all small sizes and of band borders, each with partners just at and just below the threshold."""
    rows, doc = [], 0
    for n in [*range(1, 30), 38, 39, 47, 48, 49, 92, 93, 115, 116, 117, 277, 278, 279, 345]:
        words = [f"n{n}w{i}" for i in range(n + 4)]
        for m in {n, -(-4 * n // 5), -(-4 * n // 5) - 1}:
            if m > 0:
                rows.append((doc, " ".join(words[: m + 4])))
                doc += 1
    check(spark, rows)


def test_one_document_per_class(spark, awkward, empty):
    kept = J.one_per_class(awkward)
    assert kept.columns == awkward.columns
    rows = [tuple(r)[:2] for r in kept.collect()]
    assert J.one_per_class(empty).count() == 0
    assert sorted(rows, key=B.key) == sorted(one_per_class([r[:2] for r in B.awkward_rows()]), key=B.key)


def one_per_class(rows):
    """Plain version: classes of row numbers, then one row of each by (id, hash of the text is replaced by: any)."""
    named = [(i, t) for i, (_, t) in enumerate(rows)]
    component = {i: c for i, _, c in B.classes(named)}
    out, groups = [], {}
    for i, (doc, text) in enumerate(rows):
        if B.BLANK.search(text or ""):
            groups.setdefault(component[i], []).append((doc is None, doc or 0, text))
        else:
            out.append((doc, text))
    for members in groups.values():
        unnamed, doc, text = min(members, key=lambda m: m[:2])
        assert len({m[2] for m in members if m[:2] == (unnamed, doc)}) == 1, "a tie that the text decides"
        out.append((None if unnamed else doc, text))
    return out


def test_one_per_class_judges_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows = [(5, " ".join(base)), (5, "quite another text of some words"), (7, "third unrelated text with its own words"), (None, " ".join(near)), (None, ""), (3, ""), (None, "a text that only a row without id has"), (5, " ".join(base))]
    got = [tuple(r) for r in J.one_per_class(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5], rows[6]], key=repr)


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_steps_leave_no_shuffle_files_and_few_tables(spark):
    """What a step has shuffled goes when its table is written, and tables go when nothing reads them any more."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    rows = [(i, f"{texts[i % 60]} {'more' * (i // 60)}") for i in range(120)]
    root, before = Path(J.stored(spark.range(1), "probe").inputFiles()[0].removeprefix("file://")).parent.parent, shuffle_files(spark)
    known = set(root.iterdir())
    result = J.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for _ in range(50):
        time.sleep(0.1)
        try:
            left = sum(size for f, size in shuffle_files(spark).items() if f not in before)
        except FileNotFoundError:  # one that goes just now
            continue
        if left < 20_000:
            break
    assert left < 20_000, "more than a few counts"
    assert not {"sets", "tiles", "bounded", "elements"} & {p.name.partition("-")[0] for p in set(root.iterdir()) - known}
    assert {r.doc_id: r.component_id for r in result.collect()} == {i: i % 60 for i in range(120)}


def test_shared_tiles_are_those_of_plain_keys():
    """Blocks of packed pairs give the tiles of several nodes, however the pairs are cut into blocks."""
    rng = J.np.random.default_rng(6)
    keys, nodes = rng.integers(0, 300, 2_000), rng.integers(0, 50, 2_000)
    pairs = (keys.astype("u8") << J.np.uint64(36)) | nodes.astype("u8")
    blocks = [J.pack(x) for x in J.np.array_split(pairs, 7)]
    assert sorted(x for b in blocks for x in J.unpack(b)) == sorted(pairs)
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 7, pa.int32()), pa.array(blocks, pa.binary())], ["part", "pairs"])
    got = sorted((r["key"], r["low"], r["size"]) for b in J._shared_tiles(36)(iter([batch])) for r in b.to_pylist())
    tiles = {k: {n for j, n in zip(keys, nodes) if j == k} for k in set(keys)}
    assert got == sorted(((3 << 28) + k, n, len(t)) for k, t in tiles.items() if len(t) > 1 for n in t)


@pytest.mark.parametrize("bits", [5, 52])
def test_nodes_and_keys_alike_in_what_travels(spark, awkward, monkeypatch, bits):
    """Pairs with too few bits of the node or of the key add candidates and take no link."""
    monkeypatch.setattr(J, "NODE_BITS", bits)
    test_every_size_around_the_threshold(spark)
    got = sorted(map(tuple, J.jaccard_classes(awkward).collect()), key=B.key)
    assert got == sorted(B.classes([r[:2] for r in B.awkward_rows()]), key=B.key)


def test_one_per_class_leaves_texts_where_they_are(spark):
    """Five of 155 rows repeat; the texts of the others meet no shuffle, neither of those that stay nor of those that go."""
    rng = random.Random(4)
    rows = []
    for i in range(100):
        words = [rng.randbytes(900).hex() for _ in range(12)]
        rows.append((2 * i, " ".join(words)))
        if i % 2:
            rows.append((2 * i + 1, " ".join(words)))
    rows += rows[:5]
    before = shuffle_files(spark)
    kept = J.one_per_class(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    written = sum(size for f, size in shuffle_files(spark).items() if f not in before)
    assert sorted(map(tuple, kept)) == sorted({r for r in rows if r[0] % 2 == 0})
    assert written < sum(len(text) for _, text in rows) / 4


def test_one_per_class_with_full_bitmaps(spark, awkward, monkeypatch):
    """The join alone settles every row when the bitmaps know nothing."""
    wanted = sorted(map(tuple, J.one_per_class(awkward).select("doc_id", "text").collect()), key=B.key)
    full = J.Prefilter(spark.sparkContext.broadcast(b"\xff" * (BITS // 8)))
    monkeypatch.setattr(J.Prefilter, "of", staticmethod(lambda df, value: full))
    assert sorted(map(tuple, J.one_per_class(awkward).select("doc_id", "text").collect()), key=B.key) == wanted
    test_one_per_class_judges_rows(spark)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long").where(F.lit(True))).count() == 0
