import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswatch.operators import clusters as C
from corpuswatch.operators import verdicts as J

T0 = dt.datetime(2024, 1, 1)
DDL = (
    "batch_id long, article_hash string, title string, published_at timestamp, anomaly_score double, credibility_score double, "
    "region string, subcategory string, entities array<struct<name:string,type:string>>"
)


def events(spark, rows):
    """Rows (hash, hours, region, entity names) of one batch."""
    data = [
        (0, h, f"title {h}", T0 + dt.timedelta(hours=t), 0.9, 0.8, region, "odd", [(n, "person") for n in names])
        for h, t, region, names in rows
    ]
    return spark.createDataFrame(data, DDL)


def test_temporal_windows_restart(spark):
    ev = events(spark, [("a", 0, "R", []), ("b", 72, None, []), ("c", 10, "S", []), ("d", 73, None, []), ("e", 144, None, []), ("f", 145.5, None, [])])
    anchored = {r["article_hash"]: r["anchor"] for r in C.with_time_anchor(ev).collect()}
    first, second = T0, T0 + dt.timedelta(hours=73)
    assert anchored["b"] == first and anchored["d"] == second and anchored["e"] == second and anchored["f"] == T0 + dt.timedelta(hours=145.5)
    got = C.with_cluster_columns(C.temporal_clusters(ev)).collect()
    assert [(r["events"], r["regions"]) for r in got] == [(["a", "c", "b"], ["R", "S"])]  # the pair d, e is used up without a cluster
    assert got[0]["confidence"] == 1.0 and got[0]["avg_credibility"] == 0.8


def test_entity_and_spatial(spark):
    ev = events(spark, [("a", 0, "R", ["Bob ", "bob"]), ("b", 1, "R", ["BOB"]), ("c", 2, "R", []), ("d", 3, None, ["Ann"])])
    ent = C.with_cluster_columns(C.link_by_entity(ev)).collect()
    assert [(r["entity"], r["events"], r["size"]) for r in ent] == [("person:bob", ["a", "b"], 2)]
    assert ent[0]["confidence"] == 1.0
    assert C.link_by_entity(ev.withColumn("credibility_score", F.lit(0.5))).count() == 0  # 0.9 * 0.5 * 1.4 < 0.70
    sp = C.with_cluster_columns(C.spatial_clusters(ev)).collect()
    assert [(r["region"], r["events"]) for r in sp] == [("R", ["a", "b", "c"])]


def test_semantic_pairs(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(30, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    base = events(spark, [(f"e{i:02d}", i, None, []) for i in range(30)])
    emb = spark.createDataFrame([(f"e{i:02d}", [float(x) for x in v]) for i, v in enumerate(vecs)], "article_hash string, embedding array<double>")
    got = {(r["a"], r["b"]) for r in C.semantic_pairs(base.join(emb, "article_hash"), 0.5).collect()}
    sims = vecs @ vecs.T
    assert got == {(f"e{i:02d}", f"e{j:02d}") for i in range(30) for j in range(i + 1, 30) if sims[i, j] >= 0.5}
    linked = C.link_by_semantics(base.join(emb, "article_hash"), 0.5, 0.0).count()
    assert linked == len(got)


def test_merge_order_and_relationship(spark):
    ev = events(spark, [("a", 0, "R", ["Bob"]), ("b", 1, "R", ["Bob"]), ("c", 2, "R", []), ("d", 200, None, [])])
    merged = C.with_cluster_columns(C.merge_clusters(C.union_clusters(C.link_by_entity(ev), C.temporal_clusters(ev), C.spatial_clusters(ev)))).collect()
    assert len(merged) == 1
    m = merged[0]
    assert m["cluster_type"] == "entity_match+temporal+spatial" and m["relationship"] == "SAME_ENTITY" and m["events"] == ["a", "b", "c"]
    no_entity = C.with_cluster_columns(C.merge_clusters(C.union_clusters(C.temporal_clusters(ev), C.spatial_clusters(ev)))).first()
    assert no_entity["relationship"] == "SAME_PATTERN"


def test_link_events_reports_empty_batches(spark):
    ev = events(spark, [("a", 0, None, []), ("b", 500, None, [])])
    r = C.link_events(ev, semantics=False).collect()
    assert len(r) == 1 and r[0]["verdict"] == C.NO_CONNECTION and r[0]["confidence"] == 0.0
    d = J.default_verdicts(C.link_events(ev, semantics=False), F.current_timestamp()).first()
    assert d["verdict"] == "no strong connection" and d["reasoning"] == J.NO_LINKS


def test_batches(spark):
    rows = [(f"e{i:03d}", i / 60, None, []) for i in range(430)]
    got = C.assign_batches(events(spark, rows).drop("batch_id")).groupBy("batch_id", "pending").count().orderBy("batch_id").collect()
    assert [(r["batch_id"], r["pending"], r["count"]) for r in got] == [(0, False, 200), (1, False, 200), (2, True, 30)]
    keyed = events(spark, rows).drop("batch_id").withColumn("k", F.when(F.col("article_hash") < "e100", "x"))
    per_key = C.assign_batches(keyed, keys=["k"]).groupBy("k", "batch_id").count().orderBy("k", "batch_id").collect()
    assert [(r["k"], r["count"]) for r in per_key] == [(None, 200), (None, 130), ("x", 100)]


def verdict(spark, confidence, anomaly, credibility, n, mode="intended"):
    ev = spark.createDataFrame(
        [(0, f"h{i}", f"t{i}", T0, anomaly, credibility, None, "odd", []) for i in range(n)] or [(0, "other", "t", T0, 0.5, 0.5, None, "odd", [])], DDL
    )
    cl = spark.createDataFrame([("c", 0, [f"h{i}" for i in range(max(n, 1))], confidence)], "cluster_id string, batch_id long, events array<string>, confidence double")
    return J.rule_verdicts(cl, ev, F.current_timestamp(), mode).first()


@pytest.mark.parametrize("args,want", [
    ((0.9, 0.8, 0.34, 6), "no strong connection"), ((0.75, 0.65, 0.35, 4), "weak signal"), ((0.85, 0.75, 0.5, 6), "strong signal"),
    ((0.85, 0.75, 0.5, 5), "weak signal"), ((0.74, 0.9, 0.9, 9), "no strong connection"), ((0.9, 0.64, 0.9, 9), "no strong connection"),
])
def test_verdict_rules(spark, args, want):
    assert verdict(spark, *args)["verdict"] == want


def test_reference_mode_hides_strong(spark):
    assert verdict(spark, 0.9, 0.9, 0.9, 8, "reference")["verdict"] == "weak signal"


def test_empty_cluster(spark):
    v = verdict(spark, 0.9, 0.9, 0.9, 0)
    assert (v["verdict"], v["confidence"], v["reasoning"]) == ("no strong connection", 0.0, J.NO_EVENTS)


def test_cap(spark):
    df = spark.createDataFrame([(0.9, 0.3, "n"), (0.4, 0.3, "n"), (0.9, 0.35, "n"), (0.9, 0.1, None)], "confidence double, mean_credibility double, credibility_note string")
    got = [(r["confidence"], r["credibility_note"]) for r in J.cap_confidence(df).collect()]
    assert got == [(0.4, "n" + J.CAPPED), (0.4, "n"), (0.9, "n"), (0.4, J.CAPPED)]


def test_cluster_graph(spark):
    cl = spark.createDataFrame(
        [("c", 0, [f"h{i}" for i in range(12)], 0.7, "temporal", None), ("c2", 0, ["h0", "h1"], 0.9, "spatial", None)],
        "cluster_id string, batch_id long, events array<string>, confidence double, cluster_type string, relationship string",
    )
    ev = spark.createDataFrame([(0, f"h{i}") for i in range(12) if i != 3], "batch_id long, article_hash string")
    links = {(r["src"], r["dst"]): r["confidence"] for r in C.cluster_links(cl).collect()}
    assert len(links) == 4 * 8 + 3 + 2 + 1 and links[("h0", "h1")] == 0.9 and ("h0", "h5") not in links
    assert C.cluster_membership(cl, ev, first=10).where("dst = 'c'").count() == 9
    members = C.cluster_membership(cl, ev)
    assert members.where("dst = 'c'").count() == 11 and members.where("dst = 'c2'").count() == 2


def test_merge_against_the_definition():
    """Random memberships: a leader absorbs, in order, every later free row that holds half of what it has by then."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n, events_, share in ((40, 12, 0.3), (60, 20, 0.15), (25, 6, 0.5), (1, 3, 1.0)):
        holds = rng.random((n, events_)) < share
        sets = [frozenset(np.flatnonzero(h)) for h in holds]
        want, left = {}, list(range(n))
        while left:
            head, *rest = left
            have, left = set(sets[head]), []
            want[head] = head
            for j in rest:
                if have and 2 * len(sets[j] & have) >= len(have):
                    have |= sets[j]
                    want[j] = head
                else:
                    left.append(j)
        assert C._groups(holds).tolist() == [want[i] for i in range(n)]


def test_many_equal_clusters_merge_fast():
    import time

    import numpy as np

    pairs = np.zeros((19_900, 200), dtype=bool)
    i, j = np.triu_indices(200, 1)
    pairs[np.arange(len(i)), i] = pairs[np.arange(len(i)), j] = True
    start = time.perf_counter()
    leader = C._groups(pairs)
    assert (leader >= 0).all() and time.perf_counter() - start < 10


def test_pending_batches_wait(spark):
    ev = events(spark, [("a", 0, "R", ["Bob"]), ("b", 1, "R", ["Bob"])])
    assert C.link_events(ev.withColumn("pending", F.lit(True)), semantics=False).count() == 0
    assert C.link_events(ev.withColumn("pending", F.lit(False)), semantics=False).count() > 0


def test_semantics_are_never_skipped_in_silence(spark):
    import pytest

    ev = events(spark, [("a", 0, "R", ["Bob"]), ("b", 1, "R", ["Eve"]), ("c", 2, "R", ["Ann"])])
    with pytest.raises(ValueError):
        C.link_events(ev)
    texts = ev.withColumn("title", F.lit("the same words of one title")).withColumn("content_snippet", F.lit("and of one snippet"))
    found = C.link_events(C.with_event_embedding(texts), semantic_link=0.9, min_confidence=0.0)
    assert found.where("cluster_type like '%semantic%'").count() > 0


def test_equal_scores_give_no_more_than_k_rows():
    import numpy as np

    from corpuswatch.operators.vectors import _best

    got = _best(np.arange(3), np.zeros((3, 4)), np.arange(500)[::-1], np.zeros((500, 4)), 10)
    assert len(got) == 30 and sorted(set(got["id"])) == list(range(10))
