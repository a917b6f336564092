"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text go to hashed buckets.  A bucket's
value is its share of the text's n-grams times its inverse document frequency, counted over all
learnable documents.  Follow-the-regularised-leader with elastic-net penalties learns the
weights from a bounded sample (about ``per_class`` documents of each language, chosen by a hash of the
id, with ``fit_bytes`` of text at most); one temperature, fitted on sampled documents kept out of the learning, calibrates the scores.

Defined cases: a null text and a text without a letter are ``und`` with score 1 (nothing else
can be said of them).  Ties go to the alphabetically first language.  Repeated rows are scored each.  Without
any learnable document every text is ``und`` with score 0.  Empty tables give no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import ngrams
from quillstack.llm.batches import bounded, small_batches, texts, within_bytes
from quillstack.staging import Stage

SIZES, BITS = (1, 2, 3), 16
SCALE = 40.0
WORD = re.compile(r"[^\W\d_]")

def has_letter(text: str) -> bool:
    """Superscripts and the like look like word characters but are no letters."""
    return any(x[0].isalpha() for x in WORD.finditer(text))


def held_out(id_col: str) -> Column:
    """Documents that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents per bucket and documents in all; tasks send at most a number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in bounded(batches):
            points, at = ngrams.points_of(texts(batch.column(0)))
            parts = list(ngrams.hashed(points, at, SIZES, BITS))
            for i in range(batch.num_rows):
                seen = np.zeros(1 << BITS, dtype=bool)
                for h, first, last in parts:
                    seen[h[first[i] : last[i]]] = True
                count += seen
            n += batch.num_rows
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[count[used], n])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out, total = np.zeros(1 << BITS), 0
    for b, n in zip(found.bucket.to_numpy(), found.n.to_numpy()):
        if b < 0:
            total = int(n)
        else:
            out[b] = n
    return out, total


#: Characters that are looked up at a time.
BLOCK = 1 << 18


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # weight times inverse document frequency, by class and bucket
    bias: np.ndarray
    temperature: float

    def logits(self, batch: list[str]) -> np.ndarray:
        """Sums over all n-grams of each text, ``BLOCK`` places at a time, so that a very long text needs no more room than that."""
        points, at = ngrams.points_of(batch)
        out, n = np.zeros((len(batch), len(self.classes))), np.zeros(len(batch))
        for a in range(0, len(points), BLOCK):
            for h, first, last in ngrams.hashed(points[a : a + BLOCK + max(SIZES) - 1], at, SIZES, BITS):
                first, last = np.clip(first, a, a + BLOCK) - a, np.clip(last, a, a + BLOCK) - a
                n += last - first
                for c in range(len(self.classes)):
                    out[:, c] += ngrams.sums(self.table[c][h], first, last)
        return SCALE * out / np.maximum(n, 1)[:, None] + self.bias

    def scores(self, batch: list[str]) -> np.ndarray:
        return softmax(self.logits(batch) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], idf: np.ndarray, *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 2) -> Model:
    """Learns from (text, language); every fifth row fits the temperature."""
    classes = sorted({lang for _, lang in rows})
    number = {c: k for k, c in enumerate(classes)}
    kept, rest = [r for i, r in enumerate(rows) if i % 5 == 4], [r for i, r in enumerate(rows) if i % 5 != 4]
    features = []
    for text, lang in rest:
        h, n = np.unique(ngrams.buckets(text, SIZES, BITS), return_counts=True)
        features.append((np.r_[h, 1 << BITS], np.r_[SCALE * n / max(1, n.sum()) * idf[h], 1.0], number[lang]))
    z, g2 = np.zeros((len(classes), (1 << BITS) + 1)), np.zeros((len(classes), (1 << BITS) + 1))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(features)):
            at, x, y = features[i]
            zz, nn = z[:, at], g2[:, at]
            w = weights(zz, nn)
            p = softmax((w @ x)[None])[0]
            p[y] -= 1
            g = p[:, None] * x
            grown = nn + g * g
            z[:, at] = zz + g - (np.sqrt(grown) - np.sqrt(nn)) / alpha * w
            g2[:, at] = grown
    w = weights(z, g2)
    model = Model(classes, (w[:, :-1] * idf).astype(np.float32), w[:, -1], 1.0)
    if kept:
        raw, truth = model.logits([t for t, _ in kept]), np.array([number[x] for _, x in kept])
        loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def train(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int, fit_bytes: int) -> Model | None:
    """Fits in one task, over a sample bounded by ``per_class`` and ``fit_bytes``."""
    learn = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = {x["lang"]: x["count"] for x in learn.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    frequency, n = document_frequencies(learn, "text")
    idf = np.log((1 + n) / (1 + frequency)) + 1
    rate = F.lit(0.0)
    for lang, c in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, per_class / c)).otherwise(rate)
    sample = learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < rate * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d or 0, t, lang) for b in batches for d, t, lang in zip(*(b.column(i).to_pylist() for i in range(3))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1:] for r in rows], idf))], pa.binary())], names=["model"])

    fitted = within_bytes(Stage(spark, "langid"), sample.select("doc_id", "text", "lang"), fit_bytes)
    found = fitted.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def identify(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 1500, fit_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    small_batches(spark)
    model = train(spark, docs, id_col, text_col, lang_col, per_class, fit_bytes)
    held = spark.sparkContext.broadcast(model)  # a number per language and bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held.value
        for batch in bounded(batches):
            said = texts(batch.column("text"))
            lang, score = ["und"] * len(said), np.full(len(said), 1.0 if made else 0.0)
            known = [i for i, t in enumerate(said) if has_letter(t)]
            if made and known:
                p = made.scores([said[i] for i in known])
                best = p.argmax(axis=1)
                score[known] = p[np.arange(len(known)), best]
                for i, k in zip(known, best.tolist()):
                    lang[i] = made.classes[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
