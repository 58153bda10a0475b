"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training reads labelled documents only, at most ``max_rows`` of them, those with the smallest hash of their id (a
documented bound; nothing else is sampled). N-grams of ``ORDERS`` bytes of the lower-cased text are hashed to
``2**BITS`` features. Spark counts, per feature, the toxic and the other documents that hold it; the log ratio of the
smoothed shares is the feature's scale. Features whose ratio is ``min_z`` standard errors or more away from even are
ranked by their information; the first ``n_features`` of them enter Spark's logistic regression on presence x scale with
an l2 penalty, in which toxic rows together weigh ``toxic_share``. Counts and gradients are sums of bounded vectors over
tasks, so no task and not the driver ever holds the rows.

Scoring is one pass without shuffle; the weights (at most 2**BITS floats) are broadcast; a very long text is hashed
whole, in memory that grows with it. Every document gets a score in 0..1: ``score >= 0.5`` is toxic. Null and empty texts
have no features and get the score of the intercept; documents with null labels are not learned from; of repeated
doc_ids one text is learned from; no labels at all (or of one class only) give the share of the class, 0 at least and 1
at most; repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_windows import gram_hash, groups_up_to, joined, prefix_sums
from tidemark.llm.frames import keep_plan_short, map_slices, of_texts, texts_of, with_small_batches

ORDERS = (4, 5, 6)
BITS = 20
CHUNK_BYTES = 1 << 18
#: Tasks that the training rows (a bounded sample) are dealt to, and so vectors that are added up in a step.
TRAINING_TASKS = 48
#: Features whose counts travel together.
SLICE = 1 << 16
SCORE_SCHEMA = "doc_id long, score double"


@dataclass(frozen=True)
class Toxicity:
    """weight[f]: what the presence of feature f adds (0: not a feature); log-odds = bias + sum."""

    weight: np.ndarray
    bias: float


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, by document; ``keep`` is a mask of the features wanted."""
    pairs = [np.zeros(0, np.int64)]
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    for a, b in groups_up_to([len(t) for t in raw], CHUNK_BYTES):
        data, starts = joined([b" " + t + b" " for t in raw[a:b]], gap=max(ORDERS))
        sums = prefix_sums(data)
        real = data != 0
        found = []
        for k in ORDERS:
            code = (gram_hash(sums, k) >> np.uint64(64 - BITS)).astype(np.int64)
            good = real[: len(code)] & real[k - 1 : k - 1 + len(code)]
            if keep is not None:
                good &= keep[code]
            at = np.flatnonzero(good)
            found.append((np.searchsorted(starts, at, side="right") - 1 + a) << BITS | code[at])
        pairs.append(np.unique(np.concatenate(found)))  # texts don't go on in the next chunk
    pair = np.concatenate(pairs)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic 0/1) of at most ``max_rows`` labels. The labels picked are broadcast: texts are not shuffled."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, clean, toxic: how many texts of ``rows`` (text, toxic 0/1) hold each feature. Counted per task, summed per slice."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                toxic = np.asarray(part.column("toxic"))
                doc, feature = features(texts_of(part))
                np.add.at(seen, (toxic[doc], feature), 1)
        slices = np.flatnonzero(seen.reshape(2, -1, SLICE).any(axis=(0, 2)))
        blobs = [zstandard.compress(_blob(seen[:, i * SLICE : (i + 1) * SLICE]), 1) for i in slices]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, SLICE), np.int64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(blob), np.int32).reshape(2, SLICE)
        keys = np.flatnonzero(total.any(axis=0))
        return pa.table([pa.array(keys + table.column("slice")[0].as_py() * SLICE, pa.int64()), pa.array(total[0, keys].astype(float)), pa.array(total[1, keys].astype(float))], names=["feature", "clean", "toxic"])

    return rows.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "feature long, clean double, toxic double")


def informative(counted: DataFrame, n_clean: int, n_toxic: int, n_features: int, min_z: float) -> DataFrame:
    """feature, scale (log-count ratio) of the features that tell most, among ratios well clear of chance."""
    p, q = (F.col("toxic") + 1) / (n_toxic + 2), (F.col("clean") + 1) / (n_clean + 2)
    scale = F.log(p / q)
    error = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    told = counted.where(F.abs(scale) >= min_z * error).select("feature", scale.alias("scale"), ((p - q) * scale).alias("worth"))
    return told.orderBy(F.desc("worth"), "feature").limit(n_features).select("feature", "scale")


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 1 << 12, min_z: float = 4.0, steps: int = 30, l2: float = 1e-3, toxic_share: float = 0.3) -> Toxicity:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    weight = np.zeros(1 << BITS, np.float64)
    rows = keep_plan_short(training_rows(docs, labels, max_rows).repartition(TRAINING_TASKS))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        share = n_toxic / max(1.0, n_clean + n_toxic)
        return Toxicity(weight, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    best = informative(feature_counts(rows), n_clean, n_toxic, n_features, min_z).toPandas()  # n_features rows at most
    if not len(best):
        return Toxicity(weight, float(np.log(n_toxic / n_clean)))
    known = np.zeros(1 << BITS, bool)
    known[best["feature"].to_numpy()] = True
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, feature = features(texts_of(batch), shared.value)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature).cast(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("toxic"), words], ["toxic", "words"])

    words = map_slices(rows, present, "toxic int, words array<string>")
    vectors = CountVectorizerModel.from_vocabulary([str(f) for f in best["feature"]], inputCol="words", outputCol="present").setBinary(True).transform(words)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(best["scale"].to_numpy()), inputCol="present", outputCol="x").transform(vectors)
    balance = F.when(F.col("toxic") == 1, toxic_share / n_toxic).otherwise((1 - toxic_share) / n_clean) * (n_clean + n_toxic)
    ready = scaled.select("toxic", "x", balance.alias("w"))
    fit = LogisticRegression(featuresCol="x", labelCol="toxic", weightCol="w", regParam=l2, maxIter=steps, standardization=False).fit(ready)
    weight[best["feature"].to_numpy()] = fit.coefficients.toArray() * best["scale"].to_numpy()
    return Toxicity(weight, float(fit.intercept))


def score_texts(model: Toxicity, texts: list[str]) -> np.ndarray:
    doc, feature = features(texts, model.weight != 0)
    z = model.bias + np.bincount(doc, weights=model.weight[feature], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(Toxicity(model.weight.astype(np.float32), model.bias))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score_texts(shared.value, texts_of(batch)))], ["doc_id", "score"])

    return map_slices(docs.select("doc_id", "text"), work, SCORE_SCHEMA)


def drop_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns stay."""
    with_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Toxicity(model.weight.astype(np.float32), model.bias))
    return docs.where(of_texts(F.col("text"), lambda texts: (score_texts(shared.value, [t or "" for t in texts]) < threshold).tolist(), "boolean"))
