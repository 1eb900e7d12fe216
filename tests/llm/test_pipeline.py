"""The pipeline stage by stage against brute force on the smallest documents."""

from collections import Counter

import brute as B

import corpus_pipeline as P
from corpuswatch.llm import quality_rules as Q
from corpuswatch.llm.tables import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        docs_before, docs = docs, stored(stage(spark, docs, SF), name)
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in Q.judged(docs_before).collect()}
            failed = {r.doc_id for r in before for n in [B.base_counts(r.text)] if n[0] < 50 or 100 * n[4] > 50 * n[0] or not verdict[r.doc_id]}
            assert len(ids) == len(set(ids)) and set(ids) == {r.doc_id for r in before} - failed
        elif name == "ngram_jaccard_join":
            assert sorted(ids) == sorted({c for _, _, c in B.classes([(r.doc_id, r.text) for r in before])})
        elif name == "benchmark_decontamination":
            assert sorted(ids) == sorted(r[0] for r in B.contaminated([(r.doc_id, r.text) for r in before], items) if not r[2])
        elif name == "source_mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(B.BLANK.findall(r.text))
            for r in after:
                taken[r.source] += len(B.BLANK.findall(r.text))
            largest = max(len(B.BLANK.findall(r.text)) for r in before)
            assert all(abs(taken[s] - t) <= largest for s, t in B.targets(dict(sizes)).items()) and max(Counter(ids).values()) <= 3
        else:
            assert Counter(ids) == Counter(r.doc_id for r in before) and {r.shard for r in after} <= set(range(16))
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard"])
        before = after
    assert P.run(spark, SF).count() == len(before)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_awkward_documents(spark, awkward):
    """Null ids and texts, repeated rows and ids, very long texts and clashing columns pass every stage."""
    from pyspark.sql import functions as F

    docs = awkward.drop("shard")
    columns = docs.columns
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 3000 and lang = 'en'").orderBy("doc_id").limit(30).collect()]
    more = [(900 + i, text, "en", "s1", 1) for i, text in enumerate(prose)]
    docs = docs.unionByName(spark.createDataFrame([*more, (None, more[0][1], None, None, None), more[1]], B.SCHEMA).withColumns({c: F.lit(f"own {c}") for c in columns if c in B.CLASHES}))
    for name, stage in P.STAGES:
        before, docs = docs.count(), stored(stage(spark, docs, SF), name)
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard"]) and docs.count() > 0
        assert name == "source_mixing" or docs.count() <= before
