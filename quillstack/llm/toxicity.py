"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature says that a hashed n-gram of three to six characters occurs at least once, twice or four
times in the whole lower-cased text.  Its scale is the log ratio of its smoothed document shares among toxic and other
labelled documents.  The model has at most ``features`` features: those whose shares differ by over ``deviations`` standard
deviations, the most significant ones first.  Logistic regression on the scaled
features gives the score.  The fit uses a bounded sample of labelled documents (at most
``per_class`` of each label, the smallest by a hash of the id, with ``fit_bytes`` of text at most); scoring is a narrow job.

Of an id with several texts the fit takes the smallest.

Defined cases: a null text is empty.  A document labelled more than once is toxic if any label
says so; null labels say nothing.  An empty text has the score of no evidence.  Without two labels to learn from
every score is 0.  Repeated rows are scored each.  Empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import ngrams
from quillstack.llm.batches import bounded, release, small_batches, texts, within_bytes
from quillstack.llm.langid import held_out
from quillstack.staging import Stage

SIZES, BITS = (3, 4, 5, 6), 20
LEVELS = (1, 2, 4)
THRESHOLD = 0.7
#: Texts of a slice of the fit, and bytes of text that are scored at a time.
SLICE, SCORED = 200, 1 << 18


@dataclass
class Model:
    chosen: np.ndarray  # level times buckets plus bucket, of each feature
    weight: np.ndarray  # learned weight times log-count ratio
    bias: float

    @cached_property
    def number(self) -> np.ndarray:
        """Feature of each level and bucket, -1 for none; made where it is used, so that the model itself is small."""
        table = np.full(len(LEVELS) << BITS, -1, dtype=np.int16 if len(self.chosen) < 1 << 15 else np.int32)
        table[self.chosen] = np.arange(len(self.chosen))
        return table.reshape(len(LEVELS), -1)

    def scores(self, batch: list[str]) -> np.ndarray:
        row, feature = present(batch, self.number)
        return sigmoid(np.bincount(row, self.weight[feature], minlength=len(batch)) + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def present(batch: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature that a text holds, once each."""
    points, at = ngrams.points_of(batch)
    used, keys = (number >= 0).any(axis=0), []
    for h, first, last in ngrams.hashed(points, at, SIZES, BITS):
        hit = np.flatnonzero(used[h])
        row = np.searchsorted(at, hit, side="right") - 1
        inside = hit < last[row]
        keys.append(row[inside].astype(np.int64) << BITS | h[hit[inside]])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    row, bucket = key >> BITS, key & ((1 << BITS) - 1)
    feature = np.stack([np.where(n >= level, number[k][bucket], -1) for k, level in enumerate(LEVELS)])
    level, at = np.nonzero(feature >= 0)
    return row[at], feature[level, at]


def fit(rows: list[tuple[str, int]], *, features: int = 1 << 14, deviations: float = 3.0, smooth: float = 1.0, l2: float = 3e-3, steps: int = 300) -> Model:
    """Learns from (text, label) with both labels present."""
    label = np.array([y for _, y in rows], dtype=float)
    counts = np.zeros((2, len(LEVELS) << BITS), dtype=np.float32)
    for text, y in rows:
        bucket, times = np.unique(ngrams.buckets(text, SIZES, BITS), return_counts=True)
        for k, level in enumerate(LEVELS):
            counts[int(y), bucket[times >= level] + (k << BITS)] += 1
    n = np.array([(label == 0).sum(), (label == 1).sum()], dtype=np.float32)
    share = counts
    share += smooth
    share /= n[:, None] + 2 * smooth
    spread = np.sqrt(share[1] * (1 - share[1]) / n[1] + share[0] * (1 - share[0]) / n[0])
    strong = np.flatnonzero(np.abs(share[1] - share[0]) > deviations * spread)
    significance = np.abs(share[1] - share[0])[strong] / spread[strong]
    chosen = np.sort(strong[np.argsort(-significance, kind="stable")[:features]])
    ratio = np.log(share[1, chosen] / share[0, chosen])
    made = Model(chosen, np.zeros(0), 0.0)
    # Presences stay in small types, by slices of texts: a step holds the numbers of one slice at a time.
    begins, parts = range(0, len(rows), SLICE), []
    for i in begins:
        row, feature = present([t for t, _ in rows[i : i + SLICE]], made.number)
        parts.append((row.astype(np.uint8), feature.astype(made.number.dtype)))
    w, speed, bias, bias_speed = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), 0.0, 1e-8
    balance = np.where(label == 1, len(label) / (2 * n[1]), len(label) / (2 * n[0])) / len(rows)
    for _ in range(steps):
        value, g, shift = w * ratio, l2 * w, 0.0
        for i, (row, feature) in zip(begins, parts):
            truth = label[i : i + SLICE]
            error = (sigmoid(np.bincount(row, value[feature], minlength=len(truth)) + bias) - truth) * balance[i : i + SLICE]
            g += ratio * np.bincount(feature, error[row], minlength=len(chosen))
            shift += error.sum()
        speed += g * g
        bias_speed += shift**2
        w -= 0.1 * g / np.sqrt(speed)
        bias -= 0.1 * shift / np.sqrt(bias_speed)
    return Model(chosen.astype(np.int32), (w * ratio).astype(np.float32), float(bias))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, *, per_class: int, fit_bytes: int, features: int, deviations: float) -> Model | None:
    """Fits in one task over the bounded sample; only its ids pass the driver."""
    told = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    told = told.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(9))
    sample = told.filter("label = 1").orderBy(order).limit(per_class).unionByName(told.filter("label = 0").orderBy(order).limit(per_class))
    # At most twice `per_class` ids: small enough to send to every task, so texts need no shuffle.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted({(d, t or "", y) for b in batches for d, t, y in zip(*(b.column(i).to_pylist() for i in range(3)))})
        if len({y for *_, y in known}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1:] for r in known], features=features, deviations=deviations))], pa.binary())], names=["model"])
        release()

    found = within_bytes(Stage(spark, "toxicity"), rows, fit_bytes).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def score(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 4000,
    fit_bytes: int = 1 << 26,
    features: int = 1 << 14,
    deviations: float = 3.0,
    threshold: float = THRESHOLD,
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    ``learn_from`` holds the texts of labelled documents; it is ``docs`` itself by default.
    """
    small_batches(spark)
    learn = docs if learn_from is None else learn_from
    model = train(spark, learn, labels, id_col, text_col, label_col, per_class=per_class, fit_bytes=fit_bytes, features=features, deviations=deviations)
    held = spark.sparkContext.broadcast(model)  # bounded by the number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held.value
        for batch in bounded(batches, limit=SCORED):
            p = made.scores(texts(batch.column("text"))) if made else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(float)), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 4000,
    fit_bytes: int = 1 << 26,
    features: int = 1 << 14,
    deviations: float = 3.0,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Documents that score below the threshold; columns unchanged, no shuffle, rows without an id are judged too."""
    small_batches(spark)
    model = train(spark, docs, labels, id_col, text_col, label_col, per_class=per_class, fit_bytes=fit_bytes, features=features, deviations=deviations)
    if model is None:
        return docs
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        return pd.Series(np.concatenate([held.value.scores(texts(x.column(0))) for x in bounded(iter([batch]), limit=SCORED)] or [np.zeros(0)]))

    return docs.filter(toxic(F.col(text_col).cast("string")) < threshold)
