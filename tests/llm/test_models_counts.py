"""Quality classifier on held-out labels; token rollups against plain counts."""

from collections import Counter

import brute as B
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswatch.llm import quality_classifier as Q
from corpuswatch.llm import token_rollups as R
from corpuswatch.session import scratch_path

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    model = Q.fitted(documents, labels.where(seen))
    assert model["held_out_right"] >= 0.9 * model["held_out"] > 0
    unseen = Q.scored(documents, model).join(labels.where(~seen), "doc_id").select("quality", (F.col("score") >= 0.5).alias("good")).collect()
    good, bad = [r.good for r in unseen if r.quality], [r.good for r in unseen if not r.quality]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.3
    assert model == Q.fitted(documents.repartition(7), labels.where(seen))


def plain_rounds(views, y, order, source, fit):
    """Co-training in memory: ``y`` is -1 where there is no label; each view hands its surest rows over, sources in turn."""
    labelled = np.flatnonzero(y >= 0)
    free = np.flatnonzero(y < 0)
    rows, label, view = labelled, y[labelled], np.full(len(labelled), -1)
    for turn in range(fit.rounds + 1):
        model = Q.co_fit([x[rows] for x in views], label, order[rows], view, fit)
        if turn == fit.rounds or not model["text_weights"]:
            return model
        more = []
        for by, name in enumerate(("text_weights", "meta_weights")):
            odds = np.round(Q._odds(views[by][free].astype(np.float64), np.array(model[name])) * model["calibration"][2 * by] + model["calibration"][2 * by + 1], 6)
            given = set(order[rows[view == 1 - by]].tolist())
            for wanted, quota in Q.quotas(model["prior"], fit).items():
                sure = {}
                for i, x in zip(free, odds, strict=True):
                    if abs(x) >= Q._logit(fit.confident) and (x > 0) == wanted and order[i] not in given:
                        sure[order[i]] = (abs(x), i)
                ranked, at = [], Counter()
                for x, i in sorted(sure.values(), key=lambda e: (-e[0], order[e[1]])):
                    at[source[i]] += 1
                    ranked.append((at[source[i]], -x, order[i], i))
                more += [(i, wanted, 1 - by) for *_, i in sorted(ranked)[:quota]]
        if more:
            i, wanted, to = map(np.array, zip(*more, strict=True))
            rows, label, view = np.concatenate([rows, i]), np.concatenate([label, wanted]), np.concatenate([view, to])


def test_a_view_learns_from_the_other():
    """Few labels, a clear metadata view: pseudo-labels must lift the text view."""
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 3000)
    text = (rng.normal(size=(3000, 40)) + 0.35 * (2 * truth - 1)[:, None]).astype(np.float32)
    meta = (rng.normal(size=(3000, 3)) + 2.5 * (2 * truth - 1)[:, None]).astype(np.float32)
    y = truth.copy()
    y[60:] = -1
    order = rng.integers(0, 2**60, 3000)

    def right(rounds):
        m = plain_rounds([text, meta], y, order, np.zeros(3000), Q.Fit(rounds=rounds, per_round=300))
        return ((Q._odds(text, np.array(m["text_weights"])) > 0) == (truth == 1))[60:].mean()

    assert right(4) > right(0)


def test_rounds_over_the_whole_table_equal_plain_ones(spark):
    """Every unlabelled document takes part: the model is that of the plain version over all rows in memory."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fit = Q.Fit(rounds=2, per_round=20, confident=0.8)
    quality = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    rows = {}
    for r in Q._keyed(documents).collect():
        if r.doc_id in quality:
            rows[r.order, quality[r.doc_id]] = r
        elif (r.text or "").strip(" \t\n\r\v\f"):
            rows[r.order, -1] = r
    keys, found = zip(*sorted(rows.items()), strict=True)
    part = pa.RecordBatch.from_pylist([r.asDict() for r in found])
    order, y = (np.array(x) for x in zip(*keys, strict=True))
    want = plain_rounds([Q.text_features(part.column("text")), Q.meta_features(part)], y, order, [r.source for r in found], fit)
    got = Q.fitted(documents, labels, fit)
    assert want["held_out"] > 0 and want["text_weights"] != Q.fitted(documents, labels, Q.Fit(rounds=0))["text_weights"]
    assert set(got) == set(want)
    for c in want:
        assert got[c] == pytest.approx(want[c], abs=1e-3), c


def test_hot_source_and_copies_leave_room_for_others(spark):
    """A source with nearly all rows, and one text with thousands of copies: small sources still hand rows over, the text once."""
    rows = [(i, "good plain words " * 20 if i % 2 else "$$ ## 1234 " * 20, "en", "hot") for i in range(3000)]
    rows += [(3000 + i, f"more plain words {i} " * 18 if i % 2 else f"## $$ {i} 999 " * 18, "en", "small") for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = documents.where("doc_id >= 3020 or doc_id < 40").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    fit = Q.Fit(per_round=10, confident=0.6)
    keyed, truth = Q._keyed(documents), labels.withColumnRenamed("quality", "label")
    model = Q.fitted(documents, labels, Q.Fit(rounds=0))
    none = spark.createDataFrame([], "order bigint, view int")
    chosen = Q._surest(keyed, truth, none, model, fit)
    assert chosen.count() == chosen.select("order", "view").distinct().count() <= 2 * fit.per_round
    by_text = chosen.where("view = 1").join(keyed.select("order", "source").distinct(), "order").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in by_text}["small"] >= 5


def test_awkward_documents_and_labels(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 34)] + [(None, 1, 0), (1, None, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = Q.judged(awkward, labels)
    assert set(awkward.columns) <= set(out.columns) and out.count() == awkward.count()
    assert out.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert {r.score for r in out.where("text is null or trim(text) = ''").collect()} == {0.0}
    prior = Q.judged(awkward, labels.limit(0)).where("n_chars > 10").select("score").distinct().collect()
    assert [r.score for r in prior] == pytest.approx([0.5])
    assert Q.judged(empty, labels).count() == 0


def encoders():
    return {v: R._encoder(f"{R.TOKENIZERS}/{f}") for v, f in R.VOCABULARIES.items()}


def test_rollup_over_batches(spark, awkward):
    rollup = R.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    one = R.counted(awkward, "byte-bpe-50k")
    two = R.counted(awkward.where("lang = 'fr'"), "byte-bpe-multi-50k")
    gone = one.where("source = 's0'")
    encode = encoders()
    want = Counter()
    for _, text, lang, source, _ in B.awkward_rows():
        version = "byte-bpe-multi-50k" if lang == "fr" else "byte-bpe-50k"
        if not (source == "s0" and lang != "fr"):
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += len(encode[version].encode_ordinary(text or ""))
    want = {k: v for k, v in want.items() if v}

    def totals():
        return {(r.source, r.lang, r.version, k): r[k] for r in rollup.totals().collect() for k in ("docs", "tokens") if r[k]}

    rollup.commit(1, R.signed(one, 1))
    rollup.commit(2, R.signed(gone.where("lang is null or lang <> 'fr'"), -1))
    rollup.commit(3, R.revised(one.where("lang = 'fr'"), two))
    assert totals() == want
    rollup.commit(2, R.signed(gone.where("lang is null or lang <> 'fr'"), -1))
    assert totals() == want
    rollup.compact()
    assert totals() == want and rollup.applied() == {1, 2, 3}
    rollup.commit(1, R.signed(one, 1))  # already in the base
    rollup.commit(3, R.revised(one.where("lang = 'fr'"), two))
    rollup.compact()
    rollup.compact()
    rollup.commit(4, R.signed(one.limit(0), 1))
    assert totals() == want
    rollup.commit(5, R.revised(one.where("lang is null or lang <> 'fr'").where("source is null or source <> 's0'"), one.limit(0)))
    rollup.commit(6, R.signed(two, -1))
    assert totals() == {}


def test_long_blanks_count_as_in_one_piece(spark):
    encode = encoders()["byte-bpe-50k"]
    for text in (" " * 3_999, "a" + " " * 5_000 + "b", "\n" * 4_500, " \n" * 3_000 + "end", "x " + "\u3000" * 4_001 + " y" + "\t" * 6_000):
        assert R.token_count(encode, text) == len(encode.encode_ordinary(text))
    rows = spark.createDataFrame([(1, " " * 2_000_000, "s", "en"), (2, "\n" * 2_000_000 + "word", "s", "en")], "doc_id bigint, text string, source string, lang string")
    assert R.counted(rows, "byte-bpe-50k").where("tokens > 0").count() == 2


def test_cut_off_attempts_and_late_batches(spark, awkward):
    root = scratch_path(spark, "rollup")
    rollup = R.Rollup(spark, root)
    rows = R.counted(awkward.where("doc_id < 12"), "byte-bpe-50k")
    rollup.commit(7, R.signed(rows, 1))
    want = sorted(map(tuple, rollup.totals().collect()), key=repr)
    # A base that was cut off: files, but no row in the log.
    R.signed(rows, 5).write.parquet(f"{root}/data/base-cut-off")
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == want
    rollup.compact()
    rollup.commit(3, R.signed(rows, 1))  # late: the base does not name it
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == [(*r[:3], 2 * r[3], 2 * r[4]) for r in want]
    # Two attempts at one batch that both reached the log count once.
    rollup._write(rollup._summed(R.signed(rows, 1)), "batch", [3], 3)
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == [(*r[:3], 2 * r[3], 2 * r[4]) for r in want]
