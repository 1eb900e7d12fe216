"""Mixing and sharding against their laws and plain Python; both without Python on the executors."""

import zlib
from collections import Counter, defaultdict

import brute as B
import pytest
from pyspark.sql import functions as F

from corpuswatch.llm import mixing as M
from corpuswatch.llm import sharding as S
from corpuswatch.llm.tables import running


def mix_rows():
    return [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(i, "a b c", "tiny") for i in range(700, 704)]


def test_targets_and_shares(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = M.plan(df).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = B.targets(dict(sizes))
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 37 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(got) == sorted(M.plan(df.repartition(5)).collect())


def test_mix_of_awkward_rows(awkward, empty):
    plan = M.plan(awkward).collect()
    assert len(plan) == len(B.awkward_rows())
    mixed = M.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    assert sum(r.copies for r in plan) == mixed.count()
    counts = Counter(r.text for r in mixed.select("text").collect())
    assert None not in counts and "" not in counts
    assert M.plan(empty).count() == M.mixed_documents(empty).count() == 0
    blank = awkward.where("text is null or text = ''")
    assert [r.taken for r in M.plan(blank).collect()] == [0] * blank.count()


def test_sharding_laws(spark):
    rows = [(i, "t" * (50 + i % 90) + str(i % 400), ("en", "de")[i % 2], "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(5000 + i, "copy " * 20, "en", "hot") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = S.shard_rows(df, shards=16).collect()
    text = {r[0]: r[1] for r in rows}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        by[r.shard].append(r)
    total = [sum(r["size"] for r in x) for x in by.values()]
    assert sorted(by) == list(range(16)) and max(total) <= 1.05 * sum(total) / 16 and min(total) >= 0.95 * sum(total) / 16
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    together = defaultdict(set)
    for r in got:
        together[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in together.items() if not t.startswith("copy"))
    assert sorted(got) == sorted(S.shard_rows(df.repartition(3), shards=16).collect())
    leaves = S.shard_rows(df, target_bytes=30_000).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    assert len(leaves) == -(-sum(total) // 30_000) and max(r["size"] for r in leaves) < 33_000


def test_sharding_of_awkward_rows(awkward, empty):
    got = S.shard_rows(awkward, shards=16)
    assert got.count() == len(B.awkward_rows()) and got.where("shard is null or shard < 0 or shard > 15").count() == 0
    whole = S.sharded_documents(awkward, shards=4)
    assert whole.columns == [c for c in awkward.columns if c != "shard"] + ["shard"] and whole.count() == len(B.awkward_rows())
    assert S.shard_rows(empty, shards=16).count() == S.sharded_documents(empty, shards=16).count() == 0


def test_no_python_in_native_plans(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id bigint, text string, source string")
    for out in (M.plan(df), M.mixed_documents(df), S.shard_rows(df, shards=4), S.sharded_documents(df, shards=4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_running_sums(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v int, w int")
    want, at = {}, defaultdict(lambda: (0, 0))
    for g, v, w in sorted(rows):
        want[g, v, w] = at[g]
        at[g] = (at[g][0] + 1, at[g][1] + w)
    got = running(df, [F.col("v"), F.col("w")], F.col("w"), within=["g"]).collect()
    assert {(r.g, r.v, r.w): (r.n_before, r.sum_before) for r in got} == want
