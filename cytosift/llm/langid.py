"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows, whole texts, on the executors. The classifier is fitted on the
driver by follow-the-regularised-leader (proximal, per coordinate) with an elastic net: L1 leaves most weights at zero, L2
shrinks the rest. It takes at most PER_LANGUAGE different labelled texts of each language, those of least hash, a documented bound; their n-gram
counts, 8 bytes for each of at most BUCKETS different ones of a text, are what the driver holds of the corpus.
A fifth of them is set aside to fit one temperature that calibrates the scores. Prediction is a narrow pass over whole texts; the
weights go to the workers without the buckets whose weights are all zero.

Cases: a null text or one without any letter is `und` with score 0; so is every text if there are no training rows; a row
without label takes no part in training; a null key is not held out; texts of any length are read whole; repeated rows count each in the frequencies and once in the fit; ties go to the language first in
order; an empty table gives an empty one; extra columns are kept by `identify`, but
for those with the names of its two, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
EPOCHS = 4
#: Of the fit: step size, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.001
#: Letters from which a text is long enough to judge, and the score that it then needs.
ENOUGH, LEAST = 100, 0.45
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - 15)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities of the languages."""
        value = tf_idf(index, count, self.idf)
        return softmax((value @ self.weights[index] + self.bias) / self.temperature)

    def sparse(self) -> SparseModel:
        live = np.flatnonzero((self.weights != 0).any(1))
        at = np.full(len(self.weights), len(live), np.int32)
        at[live] = np.arange(len(live))
        return SparseModel(self.languages, self.idf, np.concatenate((self.weights[live], np.zeros((1, len(self.languages))))), self.bias, self.temperature, at)


@dataclass
class SparseModel(Model):
    """weights holds the rows of live buckets alone, and one of zeros; at is the row of each bucket."""

    at: np.ndarray | None = None

    def scores(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        value, row = tf_idf(index, count, self.idf), self.at[index]
        live = row < len(self.weights) - 1
        return softmax((value[live] @ self.weights[row[live]] + self.bias) / self.temperature)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed character n-grams of a text in lower case, with a space at either end."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashed, found = np.zeros(len(code), np.uint64), []
    for order, mult in zip(ORDERS, _MULT, strict=True):
        if len(code) < order:
            break
        hashed = (hashed[: len(code) - order + 1] + code[order - 1 :] + np.uint64(order)) * mult
        found.append((hashed >> _SHIFT).astype(np.int64))
    count = np.bincount(np.concatenate(found), minlength=BUCKETS)
    index = np.flatnonzero(count)
    return index, count[index]


def tf_idf(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[index]
    return value / np.sqrt((value * value).sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) from rows of (buckets, values, class), the last of which is the bias: bucket BUCKETS, value 1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(0)

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value, c = rows[k]
            own_z, own_n = z[index], n[index]
            w = solved(own_z, own_n)
            error = softmax(value @ w)
            error[c] -= 1
            g = value[:, None] * error
            more = own_n + g * g
            z[index] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / ALPHA * w
            n[index] = more
    w = solved(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden-section search over its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(label)), label] + 1e-12).mean())

    low, high, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _frequencies(rows: DataFrame) -> DataFrame:
    """(bucket, n): in how many texts each bucket occurs, one partial count a task and bucket; bucket -1: texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                seen[ngrams(x.as_py())[0]] += 1
            seen[-1] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at)), pa.array(seen[at])], ["bucket", "n"])

    return by_batches(rows.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _featured(rows: DataFrame) -> DataFrame:
    """Sparse n-gram counts as bytes, which the driver holds at a tenth of what lists take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["lang", "order", "index", "count"])

    return by_batches(rows.select("lang", "order", "text")).mapInArrow(run, "lang string, order long, index binary, count binary")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on all of docs' labelled rows as the module says; leave out held-out rows before."""
    rows = docs.select(docs[text].alias("text"), docs[label].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # of different texts, as copies take no part in the fit; a row a language
    sizes = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("order", 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    frequency, total = np.zeros(BUCKETS), 0
    for bucket, n in _frequencies(rows).collect():  # at most BUCKETS + 1 rows
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # rows of least hash: first by a threshold that leaves a little over the bound, then exactly
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * per_language / n + 20 / n))) for k, n in sizes.items()])
    rows = rows.where(F.col("order") / F.lit(2.0**63) < share)
    rows = rows.dropDuplicates(["lang", "order"])  # else a large group of copies could fill the sample
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    sample = _featured(rows).withColumn("rank", first).where(F.col("rank") <= per_language).drop("rank").collect()  # per_language rows a language
    sample.sort(key=lambda r: (r.order, r.lang))
    at = {k: i for i, k in enumerate(languages)}
    made = []
    for r in sample:  # in 32 bits: the sample is the driver's largest holding
        index, count = np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["count"], "<i4").astype(np.float64)
        made.append((np.append(index, BUCKETS).astype(np.int32), np.append(tf_idf(index, count, idf), 1).astype(np.float32), at[r.lang]))
    del sample
    aside = made[::5] if len(made) >= 50 else []
    used = [x for i, x in enumerate(made) if i % 5 or not aside]
    weights, bias = ftrl(used, len(languages))
    logits = np.array([v[:-1] @ weights[i[:-1]] + bias for i, v, _ in aside]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, temperature(logits, np.array([c for *_, c in aside], np.int64)))


def identify(docs: DataFrame, model: Model, text: str = "text", prediction: str = "lang_pred", score: str = "score", letters: str | None = None) -> DataFrame:
    """docs with two more columns, or with letters a third, the number of letters up to ENOUGH; columns that have these names already are replaced."""
    docs = docs.drop(prediction, score, *([letters] if letters else []))
    shared = docs.sparkSession.sparkContext.broadcast(model.sparse())  # BUCKETS x languages weights at most: its size doesn't follow the corpus
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            label, value, count = [], [], []
            for x in batch.column(at):
                x = x.as_py()
                if letters:
                    count.append(sum(1 for _ in islice(filter(str.isalpha, x or ""), ENOUGH)))
                if not model.languages or not has_letter(x):
                    label.append("und")
                    value.append(0.0)
                    continue
                p = model.scores(*ngrams(x))
                best = int(p.argmax())
                label.append(model.languages[best])
                value.append(float(p[best]))
            made = [pa.array(label, pa.string()), pa.array(value, pa.float64()), *([pa.array(count, pa.int32())] if letters else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, prediction, score, *([letters] if letters else [])])

    more = [T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(letters, T.IntegerType())] if letters else [])]
    return by_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def accepted(prediction: Column, score: Column, letters: Column) -> Column:
    """Whether a document has a language: it has a letter and, if it has ENOUGH of them, a score of LEAST. Shorter texts stay, as what makes
    their score low is often a number or an address; so do all with a letter if no label was there to train on (`und`)."""
    return (letters > 0) & ((letters < ENOUGH) | (prediction == "und") | (score >= LEAST))
