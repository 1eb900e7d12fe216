import datetime as dt
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswatch.operators import graph as H
from corpuswatch.operators import insights as I
from corpuswatch.operators import tables as TB
from corpuswatch.operators import vectors as V
from corpuswatch.operators.identity import with_time_rank
from corpuswatch.session import broadcast_if_small, checkpoint_root, cut_lineage, spread

T0 = dt.datetime(2024, 1, 1)


def test_upsert_keeps_first_text_and_last_labels(spark):
    ddl = "content_hash string, url string, title string, categories array<string>, processed_at timestamp"
    base = spark.createDataFrame([("h1", "u1", "old", ["a"], T0), ("h9", "u9", "stay", ["z"], T0)], ddl)
    new = spark.createDataFrame(
        [("h1", "u1b", "new", ["b"], T0 + dt.timedelta(1)), ("h2", "u2", "first", ["c"], T0), ("h2", "u2b", "second", ["d"], T0 + dt.timedelta(2))], ddl
    )
    got = {r["content_hash"]: (r["url"], r["title"], r["categories"]) for r in TB.upsert_articles(base, new).collect()}
    assert got == {"h1": ("u1", "old", ["b"]), "h2": ("u2", "first", ["d"]), "h9": ("u9", "stay", ["z"])}


def test_facts_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("h", None, "t" * 600, None, None, None, None, T0, None)], "content_hash string, url string, title string, source string, source_type string, language string, region string, crawled_at timestamp, content string")
    df = df.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("categories", F.array(F.lit("a")))
    df = df.withColumn("sentiment", F.lit(None).cast("struct<label:string,score:double>")).withColumn("entities", F.lit(None).cast("array<string>"))
    r = TB.to_fact_rows(df).first()
    assert (len(r["title"]), r["region"], r["language"], r["sentiment_label"], r["sentiment_score"], r["entity_count"], r["word_count"], r["month"]) == (500, "", "en", "neutral", 0.5, 0, 0, "202401")
    TB.write_facts(TB.to_fact_rows(df), str(tmp_path / "facts"))
    assert (tmp_path / "facts" / "month=202401").is_dir()
    trends = spark.createDataFrame([("cat", "a", 3, 1, 3.0, True, T0)], "kind string, name string, current_count long, prev_count long, velocity double, is_spike boolean, computed_at timestamp")
    for _ in range(2):
        TB.write_trend_snapshot(trends, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).where("day = 20240101").count() == 2


def unit_rows(spark, n, dim=6, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")


@pytest.mark.parametrize("block", [1000, 7])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    """Both ways: all queries as one matrix, and query blocks against vector blocks."""
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 20 if block == 7 else 50_000)
    m, df = unit_rows(spark, 50)
    got = {(r["query_id"], r["rank"]): r["id"] for r in V.knn(df, df, 4).collect()}
    sims = m @ m.T
    assert got == {(q, r + 1): int(i) for q in range(50) for r, i in enumerate(np.argsort(-sims[q])[:4])}


def test_knn_small_sets(spark):
    _, df = unit_rows(spark, 3)
    assert V.knn(df, df, 10).count() == 9
    assert V.knn(df.where("id < 0"), df, 10).count() == 0


def test_cells_find_most_neighbours(spark):
    _, df = unit_rows(spark, 200, seed=2)
    model = V.train_cells(df, 5)
    exact = {(r["query_id"], r["id"]) for r in V.knn(df, df, 3).collect()}
    near = {(r["query_id"], r["id"]) for r in V.knn_by_cell(df, V.with_cell(df, model), model, 3, n_probe=3).collect()}
    every = {(r["query_id"], r["id"]) for r in V.knn_by_cell(df, V.with_cell(df, model), model, 3, n_probe=5).collect()}
    assert len(exact & near) > 0.7 * len(exact) and every == exact


def test_retrieval_without_hits(spark):
    _, df = unit_rows(spark, 3)
    v = df.withColumn("title", F.concat(F.lit("t"), F.col("id").cast("string")))
    r = V.retrieve(df.where("id = 0"), v, 2).first()
    assert r["context_count"] == 2 and r["answer"].startswith("LLM unavailable. Found 2 relevant articles: t0, ") and len(r["sources"]) == 2
    assert V.retrieve(df, v.where("id < 0"), 2).first()["answer"] == V.NO_HIT


def test_vector_upsert(spark):
    ddl = "id string, embedding array<float>, updated_at int"
    base = V.upsert_vectors(None, spark.createDataFrame([("a", [3.0, 4.0], 1), ("z", [0.0, 0.0], 1)], ddl))
    got = {r["id"]: [round(x, 3) for x in r["embedding"]] for r in V.upsert_vectors(base, spark.createDataFrame([("a", [0.0, 2.0], 2)], ddl)).collect()}
    assert got == {"a": [0.0, 1.0], "z": [0.0, 0.0]}


def test_graph(spark):
    ddl = (
        "content_hash string, url string, title string, source string, source_type string, published_at timestamp, crawled_at timestamp, region string, "
        "sentiment_label string, sentiment_score double, categories array<string>, entities array<struct<name:string,type:string>>"
    )
    rows = [
        ("h1", "u1", "t", "s", "web", T0, T0, None, "positive", 0.9, ["a", "b"], [("Bob", "person"), ("bob", "person"), ("Rome", "country_city")]),
        ("h2", "u2", "t", "s", "web", T0, T0 + dt.timedelta(1), "GB", "neutral", 0.5, ["a"], [("Bob", "person")]),
    ]
    df = spark.createDataFrame(rows, ddl)
    nodes, edges = H.build_nodes(df), H.build_edges(df)
    by_id = {r["id"]: r for r in nodes.collect()}
    assert set(by_id) == {"h1", "h2", "s", "a", "b", "person:bob", "country_city:rome"}
    assert by_id["person:bob"]["props"]["mention_count"] == "3" and by_id["person:bob"]["props"]["name"] == "Bob"
    assert {r["id"]: r["props"]["mention_count"] for r in H.build_nodes(df, "reference").where("label = 'Topic'").collect()} == {"a": "1", "b": "0"}
    assert edges.groupBy("type").count().where("type = 'MENTIONS' and count = 3").count() == 1
    kept, links = H.filter_labels(nodes, edges, ["Article", "Topic"])
    assert kept.count() == 4 and links.count() == 3
    keys = df.select(F.transform("entities", lambda e: H.entity_key(e["type"], e["name"])).alias("entity_keys"))
    pairs = {(r["src"], r["dst"]): r["weight"] for r in H.co_occurrence(H.entity_pairs(keys), "RELATES_TO").collect()}
    assert pairs == {("person:bob", "person:bob"): 1, ("person:bob", "country_city:rome"): 2}
    nodes = spark.createDataFrame([("person:bob", "Entity", {"name": "Bob", "type": "person"}), ("country_city:rome", "Entity", {"name": "Rome", "type": "country_city"})], "id string, label string, props map<string,string>")
    near = H.entity_connections(nodes, H.co_occurrence(H.entity_pairs(keys), "RELATES_TO"), "Rome").collect()
    assert [tuple(r) for r in near] == [("Bob", "person", 2)]


def test_k_hop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("x", "y")], "src string, dst string")
    assert {(r["id"], r["hops"]) for r in H.k_hop(edges, "a", 2).collect()} == {("b", 1), ("c", 2)}
    assert {(r["id"], r["hops"]) for r in H.k_hop(edges, "d", 3).collect()} == {("c", 1), ("b", 2), ("a", 3)}


def test_insights(spark):
    rows = [("cat", "technology", 4.0, True, 8), ("cat", "war_conflict", 3.0, True, 6), ("ent", "person:Bob", 2.9, True, 5), ("cat", "energy", 2.6, True, 4), ("cat", "finance", 1.0, False, 1)]
    df = spark.createDataFrame(rows, "kind string, name string, velocity double, is_spike boolean, current_count int")
    got = {(r["section"], r["place"]): (r["title"], r["confidence"]) for r in I.rule_insights(df).collect()}
    assert got[("market_opportunities", 1)] == ("Surge in Technology News Coverage", "high")
    assert got[("emerging_risks", 2)] == ("Elevated War Conflict Activity", "high")
    assert got[("viral_topics", 3)][0] == "person → Bob" and len(got) == 6  # energy is fourth: only a viral topic


def test_time_rank_equals_row_number(spark):
    rows = [(f"i{i:03d}", T0 + dt.timedelta(seconds=(i * 37) % 5000), None if i % 3 else "k") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, k string")
    got = {r["id"]: r["time_rank"] for r in with_time_rank(df, "ts", "id").collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[1], x[0])))}
    assert with_time_rank(df, "ts", "id", ["k"]).where("time_rank = 1").count() == 2


def test_session_helpers(spark):
    df = spark.range(10)
    assert cut_lineage(df).count() == 10 and checkpoint_root(spark)
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == 8
    assert "ResolvedHint (strategy=broadcast)" in broadcast_if_small(df)._jdf.queryExecution().toString()
    assert "merge" in broadcast_if_small(df, 5)._jdf.queryExecution().toString().lower()


def test_time_rank_of_one_timestamp_is_split(spark):
    """All rows at one time, and some without any: positions are those of a plain sort, and no range holds most of them."""
    df = spark.range(4000).select(F.format_string("u%05d", "id").alias("id"), F.when(F.col("id") % 10 > 0, F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    got = [r["id"] for r in with_time_rank(df.repartition(8), "ts", "id").orderBy("time_rank").collect()]
    want = sorted(((i % 10 > 0, f"u{i:05d}") for i in range(4000)))
    assert got == [name for _, name in want]


def test_probes_reach_the_recall_asked_for(spark):
    _, df = unit_rows(spark, 400, seed=4)
    model = V.train_cells(df, 12)
    celled = V.with_cell(df, model)
    n = V.probes_for(df, celled, model, 5, 0.9)
    exact = {(r["query_id"], r["id"]) for r in V.knn(df, df, 5).collect()}
    near = {(r["query_id"], r["id"]) for r in V.knn_by_cell(df, celled, model, 5, n).collect()}
    fewer = {(r["query_id"], r["id"]) for r in V.knn_by_cell(df, celled, model, 5, n - 1).collect()}
    assert len(exact & near) >= 0.9 * len(exact) > len(exact & fewer)


def test_exact_search_with_copies_lengths_and_nulls(spark, monkeypatch):
    """Vectors of other lengths than one, a third of them copies, ids as text, nulls left out: the same rows as with one matrix."""
    rng = np.random.default_rng(6)
    rows = [(f"v{i:03d}", [float(x) for x in (np.ones(8) if i % 3 == 0 else rng.normal(size=8) * (1 + i % 5))]) for i in range(240)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), ("none", None)], "id string, embedding array<double>")
    one = sorted(map(tuple, V.knn(df, df, 4).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_SLICE", 5)
    assert sorted(map(tuple, V.knn(df, df, 4).select("query_id", "rank", "id").collect())) == one
    celled = df.where("id is not null and embedding is not null").withColumn("cell", F.lit(0))
    parted = V._ranked(V.visited(celled, celled.select(F.col("id").alias("query_id"), "embedding", "cell"), 4, block=30), 4)
    assert sorted(map(tuple, parted.select("query_id", "rank", "id").collect())) == one
    assert V.knn(df, df.limit(0), 4).count() == 0


def test_best_of_a_block_scores_few_candidates_in_double_precision(monkeypatch):
    """Single precision and floors leave the exact rows: crowds of copies, near ties, zero vectors and queries; only crowds meet the whole block."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3000, 16))
    m[1000:1400] = m[7] * (1 + rng.integers(0, 3, (400, 1)) * 1e-9)
    m[1500:1540], m[2000] = m[11], 0
    q = np.concatenate([m[:40], m[1000:1002], np.zeros((1, 16)), 1e3 * m[50:60]])
    ids, queries = rng.permutation(3000), np.arange(len(q))
    asked, real = [], V._best
    monkeypatch.setattr(V, "_best", lambda names, *rest: asked.append(len(names)) or real(names, *rest))
    order = np.argsort(ids)
    want = {}
    for i, scores in enumerate(np.round(q @ m.T, 12)):
        want[i] = [(int(ids[j]), scores[j]) for j in sorted(range(3000), key=lambda j: (-scores[j], ids[j]))[:5]]

    def rows(found):
        by = {i: [] for i in range(len(q))}
        for r in found.itertuples(index=False):
            by[r.query_id].append((int(r.id), r.score))
        return {i: sorted(x, key=lambda p: (-p[1], p[0])) for i, x in by.items()}

    block = V._prepared(ids, m)
    assert (block[0] == ids[order]).all()
    got = rows(V._best_of_block(queries, q, block, 5))
    assert {i: [p[0] for p in x] for i, x in got.items()} == {i: [p[0] for p in x] for i, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for i in got for a, b in zip(got[i], want[i], strict=True))
    assert sum(asked) <= 8
    floor = np.array([want[i][2][1] for i in queries])
    kept = rows(V._best_of_block(queries, q, block, 5, floor))
    assert all(kept[i][:3] == got[i][:3] for i in kept)


def test_tasks_follow_the_rows_of_a_table(spark, monkeypatch):
    """Ranks, batches, links and counted pairs are dealt by their number of rows, whatever number of partitions the session has."""
    from corpuswatch import session
    from corpuswatch.operators import clusters as C

    def tasks(df):
        df.collect()
        return max(map(int, re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())))

    def made(n):
        lists = spark.range(n).select(F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: (i * 7 + F.col("id") % 5).cast("string")).alias("entity_keys"))
        return lists, H.co_occurrence(H.entity_pairs(lists), "R", H.n_pairs(lists))

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    lists, counted = made(2000)
    want = Counter((x, y) for r in lists.collect() for i, x in enumerate(r.entity_keys) for y in r.entity_keys[i + 1 :])
    assert {(r.src, r.dst): r.weight for r in counted.collect()} == want and H.n_pairs(lists) == sum(want.values()) == 5000
    assert tasks(counted) == 50 and tasks(made(4000)[1]) == 100
    assert H.n_pairs(lists.limit(0)) == 0 and H.co_occurrence(H.entity_pairs(lists.limit(0)), "R", 0).count() == 0

    events = spark.range(3000).select(F.col("id").cast("string").alias("article_hash"), F.timestamp_seconds(F.col("id") % 900).alias("published_at"))
    ranked = with_time_rank(events, "published_at", "article_hash")
    order = sorted((i % 900, str(i)) for i in range(3000))
    assert [r.article_hash for r in ranked.orderBy("time_rank").collect()] == [name for _, name in order] and tasks(ranked) == 30
    batched = C.assign_batches(events, 40)
    assert batched.groupBy("batch_id").count().where("count = 40").count() == 75 and tasks(batched) == 30
    found = spark.createDataFrame([("c", "R", 0.5, [str(i) for i in range(500)]), ("d", None, 0.9, ["1", "2"]), (None, None, 0.0, None)], "cluster_id string, relationship string, confidence double, events array<string>")
    links = C.cluster_links(found)
    assert links.count() == 4 * 500 - 10 + 1 and tasks(links) == 21
