"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import importable

#: Features: hashed n-grams of one to so many characters.
ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 16

#: The classifier is fitted on at most so many labelled rows, shared evenly among the labels. It is also the most labels
#: that a model can have (the most frequent ones).
FIT_ROWS = 2000

UNDETERMINED = "und"

_CHUNK = 1 << 17
_PRIMES = (2654435761, 2246822519, 3266489917)


def features(codes: np.ndarray, starts: int) -> np.ndarray:
    """Indexes of the n-grams of lower-cased characters that start in the first ``starts`` places, in order of n; repeats stay."""
    out = []
    hashed = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        hashed = hashed[: max(0, len(codes) - n + 1)]
        hashed = (hashed + codes[n - 1 :]) * np.uint64(_PRIMES[n - 1]) + np.uint64(n)
        out.append(((hashed[:starts] >> np.uint64(13)) ^ hashed[:starts]) % np.uint64(DIMENSIONS))
    return np.concatenate(out).astype(np.int64)


def _chunks(text: str) -> Iterator[np.ndarray]:
    """Features of a text in pieces of bounded size; every n-gram is in the piece in which it starts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(codes)), _CHUNK):
        yield features(codes[at : at + _CHUNK + max(ORDERS) - 1].astype(np.uint64), _CHUNK)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # DIMENSIONS x labels, inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for found in _chunks(text):
            if len(found) < DIMENSIONS:
                total += self.weights[found].sum(axis=0, dtype=np.float64)
            else:  # as many rows of weights as features, however long the piece
                total += np.bincount(found, minlength=DIMENSIONS) @ self.weights
            n += len(found)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best] / p.sum()))


#: Term frequencies are shares; they are scaled so that weights of ordinary size separate them.
SCALE = 100.0


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often each occurs) of a text: at most DIMENSIONS of them, however long it is."""
    total = np.zeros(DIMENSIONS, np.int64)
    for found in _chunks(text):
        total += np.bincount(found, minlength=DIMENSIONS)
    index = np.flatnonzero(total)
    return index, total[index]


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        rows = np.r_[index, DIMENSIONS]
        x = np.r_[value, 1.0]
        w = self.weights(rows)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[label] -= 1.0
        g = x[:, None] * p
        step = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - step * w
        self.n[rows] += g * g


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = 2) -> Model:
    """Fits on rows (features, counts, label); every fifth row calibrates the temperature instead."""
    labels = sorted({label for *_, label in rows})
    number = {label: i for i, label in enumerate(labels)}
    fold = [(index, count / count.sum() * SCALE, number[label]) for index, count, label in rows if len(index)]
    train = [r for i, r in enumerate(fold) if i % 5 or len(fold) < 10]
    model = Ftrl(len(labels))
    for _ in range(epochs):
        for index, value, label in train:
            model.learn(index, value * idf[index], label)
    weights = model.weights(slice(None))
    found = Model(labels, (weights[:-1] * idf[:, None] * SCALE).astype(np.float32), weights[-1], 1.0)
    held = fold[::5]
    if held and len(labels) > 1:
        # logits of held rows from their counted features
        z = np.array([(value / SCALE) @ found.weights[index] + found.bias for index, value, _ in held])
        found.temperature = _temperature(z, np.array([label for *_, label in held]))
    return found


def held_out(id_col: Column) -> Column:
    """Whether a document is never learned from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the features over a partition."""
    total, docs = np.zeros(DIMENSIONS, np.int64), 0
    seen = np.zeros(DIMENSIONS, bool)
    for batch in batches:
        for text in batch.column(0):
            for found in _chunks(text.as_py()):
                seen[found] = True
            total += seen
            seen[:] = False
            docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], docs])], names=["feature", "n"])


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """IDF of every feature over all texts of the rows; the driver gets one row a feature."""
    counted = rows.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    idf, docs = np.zeros(DIMENSIONS), 0
    for feature, n in counted.collect():
        if feature < 0:
            docs = n
        else:
            idf[feature] = n
    return np.where(idf > 0, np.log((1 + docs) / (1 + idf)) + 1.0, 0.0)


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            index, count = _counted(batch.column(2)[at].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), pa.array([index], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))], names=["h", "lang", "index", "count"])


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each label: equal shares of ``most``; what small labels leave goes to the others. At most ``most`` labels, the most frequent ones."""
    out, left = {}, most
    chosen = sorted(sorted(counts, key=lambda k: (-counts[k], k))[:most], key=lambda k: (counts[k], k))
    for i, label in enumerate(chosen):
        out[label] = min(counts[label], left // (len(chosen) - i))
        left -= out[label]
    return out


def _sample(rows: DataFrame, fit_rows: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Counted features of a sample in strata of labels: the rows of each label with the least hash of their id, ties by id and text.

    A first cut by the hash itself, wide enough to leave every label its rows, keeps all other rows from the sort.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "id"), 1))
    most_frequent = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(fit_rows)
    counts = {r["lang"]: r["n"] for r in most_frequent.collect()}
    if not counts:
        return []
    shares = quotas(counts, fit_rows)
    cuts = [(label, k, min(2**63 - 1, int(2**63 * min(1.0, (2 * k + 50) / counts[label])))) for label, k in shares.items()]
    cuts = spark.createDataFrame(cuts, "of string, quota long, cut long")
    near = hashed.join(F.broadcast(cuts), F.col("lang") == F.col("of")).where("h <= cut and text is not null")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "text"))
    chosen = near.withColumn("rank", rank).where("rank <= quota").select("h", "lang", "text")
    found = chosen.mapInArrow(_counts_of, "h long, lang string, index array<long>, count array<long>").collect()
    found = [(r["h"], r["lang"], np.array(r["index"], np.int64), np.array(r["count"], np.int64)) for r in found]
    return [(index, count, label) for _, label, index, count in sorted(found, key=lambda r: (r[0], r[1], r[3].sum()))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows with text and label that are not held out: IDF from all of them, weights from ``fit_rows``.

    The rows to fit are an equal share for each label, so rare labels are learned too. Their features are counted in
    tasks; the driver gets at most DIMENSIONS numbers of a row, however long its text. Without any labelled row the model has no
    labels and says ``und`` for every text.
    """
    importable(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), held_out(docs[id_col]).alias("out"))
    rows = rows.where("not out and lang is not null").drop("out")
    sample = _sample(rows, fit_rows)
    if not sample:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    return fit(sample, inverse_frequencies(rows.where("text is not null").select("text")))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            labels, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], labels, scores], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def _share(spark: SparkSession, model: Model):
    """A broadcast of the model, whose size is fixed: features times labels."""
    importable(spark)
    return spark.sparkContext.broadcast((model.labels, model.weights, model.bias, model.temperature))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score): one per document, from its whole text alone.

    Null text and text without a letter: ``und`` with score 0. Null ids are not held out, and like repeated ids keep
    their rows. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_predictor(_share(docs.sparkSession, model)), "id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.35, labels: list[str] | None = None) -> DataFrame:
    """The documents whose language is among the labels (default: any that the model knows) with at least that score; columns are those of ``docs``."""
    wanted = model.labels if labels is None else labels
    columns = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(columns, docs[text_col].cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(_predictor(_share(docs.sparkSession, model)), schema)
    return found.where(F.col("lang_pred").isin(*wanted) & (F.col("score") >= least_score)).select("row.*")
