"""Toxicity: a linear classifier over character n-grams, its features scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 6 characters, words padded by a space) of the lower-case text, hashed. Counts of
documents with a feature, by label, give each feature's log-count ratio; a logistic regression is then fitted on
presence times ratio. Training reads at most SAMPLE labelled documents of each class, taken by the hash of their id;
both classes weigh the same. Documents whose crc32(doc_id) is divisible by FOLDS are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, kinds, slices
from firmlake.session import settle

SAMPLE = 4000  # documents of each class the model is fitted on, at most
BITS = 18
SIZES = (3, 4, 5, 6)
FEATURES = 1 << 13  # that get a weight: those whose ratio is most certain
FOLDS = 5


def _points(text: str | None) -> np.ndarray:
    clean = " " + " ".join((text or "").lower().split()) + " "
    return np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)


def _features(points: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of each n-gram size, one per place."""
    value = points * np.uint32(0x9E3779B1)
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            return
        value = (value[:-1] ^ (value[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in SIZES:
            yield ((value ^ (value >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text."""
    found = list(_features(_points(text)))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[int(label == 1), features(text)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["f", "pos", "neg"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.used = weights, bias, weights != 0

    def score(self, text: str | None) -> float:
        found = [x[self.used[x]] for x in _features(_points(text))]
        total = self.bias + (float(self.weights[np.unique(np.concatenate(found))].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """A bounded, labelled sample ``text, toxic``, and the share of toxic documents among all labels for training.

    A document with several labels counts as toxic if one says so; labels without an id or a value are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = settle(known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "labels")
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    both = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic")  # 2 * SAMPLE rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(both), F.col("doc_id") == F.col("_id"))
    # Several documents with one id would go past the bound: the one with the least text is taken, in every run.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    return settle(rows, "training"), (0.5 if share is None else float(share))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents; with labels of one class only, or none, every score is that class's share."""
    rows, share = training_rows(docs, labels)
    counted = rows.mapInArrow(_count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = counted.toPandas()  # at most 2^BITS rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(1 << BITS)
    if len(sizes) < 2:
        p = min(max(share if not sizes else float(next(iter(sizes))), 1e-6), 1 - 1e-6)
        return Model(weights, float(np.log(p / (1 - p))))
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pos[table["f"]], neg[table["f"]] = table["pos"], table["neg"]
    ratio = np.log((pos + 1) / (sizes[1] + 2)) - np.log((neg + 1) / (sizes[0] + 2))
    certain = np.abs(ratio) / np.sqrt(1 / (pos + 1) + 1 / (neg + 1))
    columns = np.sort(np.argsort(-certain, kind="stable")[:FEATURES])
    number = np.full(1 << BITS, -1, np.int32)
    number[columns] = np.arange(len(columns))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [number[features(t)] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array([x[x >= 0] for x in own], pa.list_(pa.int32()))], names=["toxic", "f"])

    # The driver gets at most 2 * SAMPLE rows of at most FEATURES numbers.
    data = rows.mapInArrow(select, "toxic int, f array<int>").toArrow()
    lists = data["f"].combine_chunks()
    labels_, bounds, flat = data["toxic"].to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()
    own, bias = regression(flat, bounds, labels_.astype(float), ratio[columns])
    weights[columns] = own
    return Model(weights, bias)


def regression(flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, ratio: np.ndarray, steps: int = 250, penalty: float = 1e-4):
    """Logistic regression on presence * ratio with equal class weights; weights for presence alone, and the bias.

    Row i has the columns ``flat[bounds[i]:bounds[i + 1]]``. Accelerated gradient descent from zero: the same rows give
    the same model.
    """
    rows = np.repeat(np.arange(len(labels)), np.diff(bounds))
    scale = ratio[flat]
    each = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    look, size = np.ones(len(ratio)), 1.0  # the loss's curvature, by power iteration, bounds the step
    for _ in range(20):
        look = np.bincount(flat, (each * np.bincount(rows, look[flat] * scale, minlength=len(labels)))[rows] * scale, minlength=len(ratio))
        size = max(float(np.linalg.norm(look)), 1e-12)
        look /= size
    step = 1 / (0.3 * (size + 1) + penalty)
    w, bias, ahead, ahead_bias, t = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(rows, ahead[flat] * scale, minlength=len(labels)) + ahead_bias
        slope = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        grad = np.bincount(flat, slope[rows] * scale, minlength=len(ratio)) + penalty * ahead
        new, new_bias = ahead - step * grad, ahead_bias - step * float(slope.sum())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w * ratio, bias


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "\x00score"])  # by place

    return run


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``_toxicity`` from 0 to 1; null and empty texts are scored as texts without features.

    If the documents have a column of that name, the new one gets another underscore in front.
    """
    score = fresh(docs.columns, "_toxicity")
    plain = docs.withColumn(fresh([*docs.columns, score], "_text"), F.col("text").cast("string"))
    return plain.mapInArrow(_scorer(model), f"{kinds(docs)}, `{score}` double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. A null ``doc_id`` counts as held out."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below one half, with all their columns."""
    scored = with_scores(docs, fit(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < 0.5).drop(scored.columns[-1])
