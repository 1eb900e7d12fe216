"""Operators that reach over batches, windows and buckets, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswatch.operators import clusters as C
from corpuswatch.operators import dedup as D
from corpuswatch.operators import vectors as V
from corpuswatch.operators.components import connected_components

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("closed", [False, True])
def test_memory_windows(spark, closed):
    rng = random.Random(1)
    rows = {(f"k{k}", START + dt.timedelta(seconds=rng.choice([1, 10, 50, 3600]) * rng.randint(0, 400))) for k in range(6) for _ in range(60)}
    rows |= {("dense", START + dt.timedelta(seconds=10 * i)) for i in range(200)}  # a start falls on every end
    want = {}
    for key in {k for k, _ in rows}:
        anchor = None
        for t in sorted(t for k, t in rows if k == key):
            covered = anchor is not None and ((t - anchor).total_seconds() <= 100 if closed else (t - anchor).total_seconds() < 100)
            anchor = anchor if covered else t
            want[key, t] = anchor
    df = spark.createDataFrame([*rows, (None, START), ("k1", None)], "k string, t timestamp")
    got = D.anchored_windows(df.unionByName(df), ["k"], "t", 100, closed).collect()
    assert len(got) == len(want) and {(r.k, r.t): r.anchor for r in got} == want
    assert D.anchored_windows(df.limit(0), ["k"], "t", 100, closed).count() == 0


def test_memory_windows_take_few_rounds(spark, monkeypatch):
    written = []
    real = D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: written.append(name) or real(df, name))
    times = spark.range(3000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 21_600).alias("t"))  # two years, a window each
    assert D.anchored_windows(times, ["k"], "t", 21_600, False).where("t = anchor").count() == 3000
    assert len(written) <= 2 * 13 + 3


def test_components(spark):
    rng = random.Random(2)
    links = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(100)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    links += [(None, "p000"), ("x", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = connected_components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_clusters_of_two_batches_merge(spark):
    rows = [
        (0, "c0", "spatial", "SAME", 0.6, ["a", "b", "c", "d"]), (1, "c1", "entity_match", "SAME_ENTITY", 0.9, ["c", "d", "e", "f"]), (2, "c2", "spatial", None, 0.7, ["e", "c", "q"]),
        (2, "c3", "temporal", None, 0.8, ["f", "x", "y", "z", "w"]), (3, "c4", "spatial", None, 0.5, ["m", "n"]), (4, None, None, None, 0.0, None),
    ]
    found = spark.createDataFrame(rows, "batch_id long, cluster_id string, cluster_type string, relationship string, confidence double, events array<string>")
    membership, merged = C.merge_across_batches(found)
    assert {(r.merged_id, r.cluster_id) for r in membership.collect()} == {("c0", "c0"), ("c0", "c1"), ("c0", "c2"), ("c3", "c3"), ("c4", "c4")}
    top = merged.where("merged_id = 'c0'").first()
    assert (top.clusters, top.events, top.cluster_types, top.relationship, top.confidence, top.first_batch, top.last_batch) == (3, 7, "entity_match+spatial", "SAME_ENTITY", 0.9, 0, 2)
    assert merged.count() == 3 and merged.where("merged_id = 'c3'").first().events == 5
    assert C.cluster_overlaps(found).count() == 2


def test_sliding_batches_hold_each_event_twice(spark):
    events = spark.range(50).select(F.col("id").cast("string").alias("article_hash"), F.timestamp_seconds("id").alias("published_at"))
    got = C.assign_sliding_batches(events, 10, 5).collect()
    by = {}
    for r in got:
        by.setdefault(int(r.article_hash), []).append(r.batch_id)
    assert all(sorted(b) == ([i // 5 - 1, i // 5] if i >= 5 else [0]) for i, b in by.items()) and len(by) == 50


def test_close_pairs_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 48))
    rows = np.concatenate([centres[rng.integers(0, 150, 1200)] + rng.normal(size=(1200, 48)) * rng.uniform(0.2, 0.8, (1200, 1)), centres[:5], centres[:5]])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(None, rows[0].tolist()), (5000, None)], "id long, embedding array<double>")
    sims = rows @ rows.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(sims >= 0.82, k=1)), strict=True)}
    got = V.close_pairs(df, 0.82).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got) and pairs <= want and len(pairs) >= 0.95 * len(want) > 1000
    assert all(abs(r.similarity - sims[r.a, r.b]) < 1e-9 for r in got)
    assert {(1200 + i, 1205 + i) for i in range(5)} <= pairs  # equal vectors
    assert V.close_pairs(df.limit(0), 0.82).count() == 0


@pytest.mark.parametrize("tile_bytes", [4000, 1 << 20])
def test_close_pairs_of_a_crowd_are_whole_and_not_shuffled(spark, tile_bytes):
    """Nearly parallel vectors in one or many tiles: every pair, as by brute force, and no exchange between tiles and pairs."""
    rng = np.random.default_rng(4)
    rows = np.abs(np.concatenate([1 + rng.normal(size=(150, 24)) * 0.2, rng.normal(size=(150, 24)) ** 3]))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(rows)], "id string, embedding array<float>")
    sims = rows.astype(np.float64) @ rows.astype(np.float64).T
    want = {(f"v{i:03d}", f"v{j:03d}") for i, j in zip(*np.nonzero(np.triu(sims >= 0.95, k=1)), strict=True)}
    pairs = V.close_pairs(df, 0.95, tile_bytes)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) > 1000 and set(got) == want
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_tables_for_a_recall():
    for n in (100, 10_000, 10_000_000):
        bits, tables = V.hash_tables(n, 0.82, 0.98)
        same = 1 - np.arccos(0.82) / np.pi
        assert 1 - (1 - same**bits - bits * same ** (bits - 1) * (1 - same)) ** tables >= 0.98


def test_snapshots_over_four_micro_batches(spark, tmp_path):
    """Each batch rewrites the lists: the reader gets the last one alone, old ones go, and a restart goes on from it."""
    from corpuswatch.operators.insights import rule_insights
    from corpuswatch.operators.trends import compute_trends, top_trends
    from corpuswatch.streaming import jobs as S

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng = random.Random(4)
    rows = [("cat", rng.choice(["energy", "finance", "technology", "war_conflict"]), START + dt.timedelta(minutes=m // 6)) for m in range(1600)]
    kind = "kind string, name string, ts timestamp"

    def feed(k):
        spark.createDataFrame(rows[k * 400 : (k + 1) * 400], kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        S.refresh_top_trends(stream, out, state, every=None).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        feed(k)
    run()
    feed(3)
    run()  # a new query on the same state
    whole = spark.createDataFrame(rows, kind)
    recent = whole.where(F.col("ts") >= max(r[2] for r in rows) - dt.timedelta(hours=2))
    columns = ["kind", "name", "velocity"]
    want = sorted(tuple(r) for r in top_trends(compute_trends(recent)).select(*columns).collect())
    assert sorted(tuple(r) for r in S.newest_snapshot(spark, f"{out}/top").select(*columns).collect()) == want and want
    assert S.snapshot_ids(spark, f"{out}/top") == S.snapshot_ids(spark, f"{out}/mentions") == [2, 3]
    assert S.newest_snapshot(spark, f"{out}/insights").count() == rule_insights(compute_trends(recent)).count()
    assert S.newest_snapshot(spark, f"{out}/none") is None
