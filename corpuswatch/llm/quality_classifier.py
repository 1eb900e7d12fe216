"""Quality classifier by co-training: a text view and a metadata view teach each other, then both score every document.

The text view sees hashed byte trigrams of the whole text, the metadata view source, language, both together, size and lines (no word of the text).
On a bounded sample of labelled rows each view starts with the same labels. In each round both views score every unlabelled document
of the corpus; the ones a view is surest of are handed to the other view with its label. A view is as sure as its calibration on rows held
back from training allows, so one that knows nothing hands nothing over. They are taken by a distributed top-k that goes
through the sources in turn, so small sources take part too. The calibrated
log odds (a logistic fit of each view's) are added at the end, less the prior that both hold.

Fitting is one task over the labelled sample and what was handed over: both are bounded by parameters (``Fit``). Scoring, in the rounds and
at the end, is one pass over all documents with the weights in a broadcast: no shuffle of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.llm import words as W
from corpuswatch.llm.arrow_rows import with_measures
from corpuswatch.llm.tables import stored

TRIGRAMS = 1024
CATEGORIES = 64
#: Powers of two of a text's bytes that are told apart.
SIZES = 32
META = 3 * CATEGORIES + SIZES + 3
METADATA = ("source", "lang")
NAMES = {"text_score": "double", "meta_score": "double", "score": "double"}
VIEW = "order long, label int, text_view array<float>, meta_view array<float>"
MODEL = "text_weights array<double>, meta_weights array<double>, calibration array<double>, prior double, held_out long, held_out_right long"
NO_MODEL = {"text_weights": [], "meta_weights": [], "calibration": [], "prior": 0.5, "held_out": 0, "held_out_right": 0}


@dataclass(frozen=True)
class Fit:
    """What bounds and steers the fit: at most ``max_labelled`` rows with labels, and ``per_round`` that a view hands over in each round."""

    max_labelled: int = 6_000
    rounds: int = 4
    confident: float = 0.95
    per_round: int = 600
    held_out: float = 0.25
    penalty: float = 1e-3


def text_features(texts: pa.Array) -> np.ndarray:
    """Share-normalised square roots of hashed byte trigram counts, one row per text."""
    data, offsets = W.text_buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, TRIGRAMS), dtype=np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(22)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        same = doc[:-2] == doc[2:]
        key = doc[:-2][same] * TRIGRAMS + code[same]
        out = np.bincount(key, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS).astype(np.float32)
    total = np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out / total)


def meta_features(part: pa.RecordBatch) -> np.ndarray:
    """Hashed source, language and their pair, size in bytes, lines and bytes a line, one row per document. Null metadata has no category."""
    n = part.num_rows
    out = np.zeros((n, META), dtype=np.float32)
    pair, whole = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k, name in enumerate(METADATA):
        there = np.zeros(n, dtype=bool)
        if name in part.schema.names:
            hashes = W.words_of(part.column(name).cast(pa.string()), np.ones(256, dtype=bool), lower=False)
            there = hashes.counts > 0
            value = hashes.hash[hashes.first[:-1][there]]
            out[np.flatnonzero(there), k * CATEGORIES + (value % np.uint64(CATEGORIES)).astype(np.int64)] = 1
            pair[there] += W.mixed(value, 7 + k)
        whole &= there
    out[np.flatnonzero(whole), len(METADATA) * CATEGORIES + (pair[whole] % np.uint64(CATEGORIES)).astype(np.int64)] = 1
    data, offsets = W.text_buffers(part.column("text"))
    size = np.diff(offsets)
    lines = W.sums((data == 0x0A).astype(np.int64), offsets) + 1
    out[np.arange(n), 3 * CATEGORIES + np.minimum(np.log2(size + 1).astype(np.int64), SIZES - 1)] = 1
    out[:, -3:] = np.stack([np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10], axis=1)
    return out


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Logistic regression with an intercept (last weight): accelerated gradient steps on the weighted mean loss."""
    share = weight / weight.sum()
    top = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(15):  # largest eigenvalue of the second moments, which bounds the curvature
        top = x.T @ (share.astype(x.dtype) * (x @ (top / np.linalg.norm(top))))
    bound = 0.25 * (1.2 * float(np.linalg.norm(top)) + 1) + penalty
    at = old = np.zeros(x.shape[1] + 1) if start is None else start
    for k in range(steps):
        ahead = at + (k / (k + 3)) * (at - old)
        error = share * (1 / (1 + np.exp(-_odds(x, ahead))) - y)
        slope = np.append(x.T @ error.astype(x.dtype), error.sum())
        slope[:-1] += penalty * ahead[:-1]
        old, at = at, ahead - slope / bound
    return at


def _odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((x @ weights[:-1].astype(x.dtype)).astype(np.float64) + weights[-1], -30, 30)


def _standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with mean 0 and deviation 1, their means, and their deviations (small ones are raised: rare columns stay small)."""
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation = np.maximum(deviation, deviation.mean() / 4 + 1e-6)
    return (x - mean) / deviation, mean, deviation


def quotas(prior: float, fit: Fit) -> dict[int, int]:
    """How many rows of each label a view hands over in a round: as the prior says."""
    return {1: max(1, int(fit.per_round * prior)), 0: max(1, int(fit.per_round * (1 - prior)))}


def co_fit(views: list[np.ndarray], y: np.ndarray, order: np.ndarray, view: np.ndarray, fit: Fit) -> dict:
    """Both views fitted on the labelled rows (``view`` -1) and on those that each got from the other (``view``: 0 text, 1 metadata), which count half.

    ``order``: a hash of each row; the labelled rows with the smallest are held back for the calibration.
    """
    labelled = np.flatnonzero(view < 0)
    labelled = labelled[np.argsort(order[labelled], kind="stable")]
    held = labelled[: int(len(labelled) * fit.held_out)]
    known = labelled[len(held) :]
    views, shift, scale = zip(*[_standardised(x) for x in views], strict=True)
    prior = float(np.clip(y[labelled].mean(), 0.01, 0.99)) if len(labelled) else 0.5
    out = NO_MODEL | {"prior": prior}
    if len(set(y[known].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return out
    weights, calibration, total = [], [], -_logit(prior)
    for v in (0, 1):
        rows = np.concatenate([known, np.flatnonzero(view == v)])
        weight = np.where(view[rows] < 0, 1.0, 0.5)
        weights.append(_fit(views[v][rows], y[rows], weight, fit.penalty))
        odds = _odds(views[v][held], weights[v])
        slope, offset = _fit(odds[:, None] / 10, y[held], np.ones(len(held)), 1e-4, steps=2000)
        if slope <= 0:  # the view knows nothing of the held-out rows
            slope, offset = 0.0, _logit(float(np.mean(y[held])))
        calibration += [slope / 10, offset]
        total = total + odds * slope / 10 + offset
    plain = [np.append(w[:-1] / s, w[-1] - (w[:-1] / s * m).sum()) for w, m, s in zip(weights, shift, scale, strict=True)]
    right = int(((total >= 0) == (y[held] == 1)).sum())
    return out | {
        "text_weights": plain[0].tolist(), "meta_weights": plain[1].tolist(), "calibration": calibration, "held_out": len(held), "held_out_right": right
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.chunks(batch, "text"):
            views = [text_features(part.column("text")), meta_features(part)]
            yield pa.RecordBatch.from_arrays(
                [part.column("order"), part.column("label"), *[pa.array(list(x), pa.list_(pa.float32())) for x in views]], ["order", "label", "text_view", "meta_view"]
            )


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, order, text, source, lang): ``order`` is a hash of text and metadata, so copies are one row to the fit."""
    given = [F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string") for c in METADATA]
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text", *given, F.lit(5)).alias("order"), "text", *[g.alias(c) for g, c in zip(given, METADATA, strict=True)]
    )


def _trained(rows: DataFrame, fit: Fit) -> dict:
    """The model of ``rows`` (order, label, view, text_view, meta_view): one task, as they are bounded."""

    def train(table: pa.Table) -> pa.Table:
        y, order, view = (table.column(c).to_numpy() for c in ("label", "order", "view"))
        at = np.lexsort((y, view, order))
        views = [np.stack(table.column(c).to_numpy(zero_copy_only=False))[at] for c in ("text_view", "meta_view")]
        return pa.Table.from_pylist([co_fit(views, y[at], order[at], view[at], fit)], schema=pa.schema([
            *[(c, pa.list_(pa.float64())) for c in ("text_weights", "meta_weights", "calibration")], ("prior", pa.float64()), ("held_out", pa.int64()), ("held_out_right", pa.int64()),
        ]))

    found = rows.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(train, MODEL).collect()
    return found[0].asDict() if found else dict(NO_MODEL)


def _surest(keyed: DataFrame, truth: DataFrame, given: DataFrame, model: dict, fit: Fit) -> DataFrame:
    """Rows (order, view, label) that each view hands to the other (``view``), from all unlabelled documents; ``given``: those of earlier rounds.

    The surest come first within each source, and sources take turns. A row counts once, whatever its copies.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(model)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.array(shared.value[name]) for name in ("text_weights", "meta_weights")]
        a, b, c, d = shared.value["calibration"]
        for batch in batches:
            for part in W.chunks(batch, "text"):
                # In double precision and rounded, so that no partitioning changes the order.
                views = [text_features(part.column("text")), meta_features(part)]
                found = [np.round(_odds(x.astype(np.float64), w) * by + to, 6) for x, w, by, to in zip(views, weights, (a, c), (b, d), strict=True)]
                some = pa.array(W.words_of(part.column("text")).counts > 0)
                rows = pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "order", "source")], *map(pa.array, found)], ["doc_id", "order", "source", "text", "meta"])
                yield rows.filter(some)

    scores = keyed.mapInArrow(odds, "doc_id long, order long, source string, text double, meta double")
    each = F.explode(F.array(F.struct(F.lit(1).alias("view"), F.col("text").alias("odds")), F.struct(F.lit(0).alias("view"), F.col("meta").alias("odds"))))
    sure = scores.select("doc_id", "order", "source", each.alias("e")).select("doc_id", "order", "source", "e.*").where(F.abs("odds") >= _logit(fit.confident))
    sure = sure.join(truth.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(given), ["order", "view"], "left_anti")
    once = sure.groupBy("view", (F.col("odds") > 0).cast("int").alias("label"), "source", "order").agg(F.max(F.abs("odds")).alias("sure"))
    quota = quotas(model["prior"], fit)

    def best(rows: DataFrame, keys: list[str], *first: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*first, F.col("sure").desc(), "order"))
        return rows.withColumn("place", place).where(F.col("place") <= max(quota.values()))

    turns = best(once, ["view", "label", "source"]).withColumnRenamed("place", "turn")
    chosen = best(turns, ["view", "label"], F.col("turn"))
    return chosen.where(F.col("place") <= F.when(F.col("label") == 1, quota[1]).otherwise(quota[0])).select("order", "view", "label")


def fitted(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> dict:
    """The model: weights of both views, calibration, prior, and how many held-out rows it judged right.

    A document's label is 1 if the mean of its non-null ``quality`` values is at least one half. About ``fit.max_labelled`` labelled rows
    are used, picked by a hash of text and metadata; copies count once. The unlabelled documents that the views label for each other are
    all of ``documents`` but those with a label. A doc_id with several texts labels each of them; a null doc_id has no label.
    """
    truth = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    truth = stored(truth.agg((F.avg("quality") >= 0.5).cast("int").alias("label")), "truth")
    keyed = _keyed(documents)
    n_labelled = keyed.select("doc_id").join(truth, "doc_id").count()
    share = min(1.0, fit.max_labelled / max(1, n_labelled))
    # Rows that the share cannot pick are dropped before the join, so little text is shuffled.
    known = keyed.where(F.pmod("order", F.lit(1 << 30)) < int(share * 2**30)).join(truth, "doc_id").dropDuplicates(["order", "label"])
    rows = stored(known.mapInArrow(_features, VIEW), "features").withColumn("view", F.lit(-1))
    given = documents.sparkSession.createDataFrame([], "order bigint, view int")
    for turn in range(fit.rounds + 1):
        model = _trained(rows, fit)
        if turn == fit.rounds or not model["text_weights"]:
            break
        chosen = stored(_surest(keyed, truth, given, model, fit), "handed")
        # At most twice ``per_round`` rows and two.
        texts = keyed.join(F.broadcast(chosen.select("order").distinct()), "order", "left_semi").dropDuplicates(["order"])
        seen = texts.withColumn("label", F.lit(0)).mapInArrow(_features, VIEW).drop("label")
        rows = rows.unionByName(stored(chosen.join(seen, "order"), "pseudo"))
        given = given.unionByName(chosen.select("order", "view"))
    return model


def scored(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with all its columns plus text_score, meta_score and score (probabilities of good quality), row by row.

    Texts without a word (null, empty, blank) score 0. A model without weights (no labels, or of one class alone) gives
    every other document its prior. Null metadata has no category. Columns named like the scores are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value
        text, meta = np.array(m["text_weights"]), np.array(m["meta_weights"])
        prior = _logit(m["prior"])

        def measure(part: pa.RecordBatch) -> list:
            n = part.num_rows
            if len(text):
                a, b, c, d = m["calibration"]
                odds = [_odds(text_features(part.column("text")), text) * a + b, _odds(meta_features(part), meta) * c + d]
                odds.append(odds[0] + odds[1] - prior)
            else:
                odds = [np.full(n, prior)] * 3
            some = W.words_of(part.column("text")).counts > 0
            return [pa.array(np.where(some, 1 / (1 + np.exp(-np.clip(x, -30, 30))), 0.0)) for x in odds]

        return measure

    return with_measures(documents, NAMES, kernel, named=[c for c in METADATA if c in documents.columns])


def judged(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, fit: Fit = Fit()) -> DataFrame:
    """``scored`` with a model fitted on ``labels``, plus ``kept``: score at least ``threshold``."""
    return scored(documents, fitted(documents, labels, fit)).withColumn("kept", F.col("score") >= threshold)
