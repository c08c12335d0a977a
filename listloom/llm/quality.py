"""Operator 5: quality classifier on random-indexing word vectors, with a two-layer network and calibrated probabilities.

Every word has a sparse random index vector; a word's vector is the sum of its neighbours' index vectors over the whole
corpus (all documents, one pass). Words are hashed to ``VOCABULARY`` buckets; each word also stands for its shape (case,
punctuation, length, repetition), a token of its own with a vector of its own. A document is the mean of its words' and
of its shapes' vectors. A two-layer network is fitted in numpy on at most ``MAX_LABELLED`` labelled rows (those of the
smallest id hash), a part of which is set aside to fit the temperature of its probabilities. All documents are scored.

What a task holds and what is broadcast is VOCABULARY x DIM floats (4 MB; 8 while it sums), whatever the corpus; texts are
looked at in blocks of BLOCK_BYTES. Tasks' sums are cut into ``SLICES`` slices and added slice by slice, in a stream, so no
task gathers them all.

Defined results: null and blank texts have a zero vector and get the network's score for it; a null id counts as the text
"" for the split; of repeated labels of an id the smallest counts; without labels of both kinds every score is the share
of label 1 (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, ship, table, text_bytes, word_hashes, word_spans

VOCABULARY, DIM, NONZERO, WINDOW = 1 << 15, 32, 2, 2
SHAPES = 1024
SLICES = 64
MAX_LABELLED = 20_000
HIDDEN = 24
BLOCK_BYTES = 1 << 19

_CLASS = np.zeros((4, 256), dtype=np.int32)  # upper, lower or other letter, digit, symbol
_CLASS[0, 65:91] = 1
_CLASS[1, 97:123] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, 33:48] = _CLASS[3, 58:65] = _CLASS[3, 91:97] = _CLASS[3, 123:127] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of each bucket's random index vector: fixed by a seed."""
    random = np.random.default_rng(11)
    return random.integers(0, DIM, (NONZERO, VOCABULARY)), random.choice(np.array([-1.0, 1.0]), (NONZERO, VOCABULARY))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of the words of some documents, and each document's first word."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return starts, starts, first
    hashes = word_hashes(LOWER[data], starts, ends)
    words = (SHAPES + hashes % np.uint64(VOCABULARY - SHAPES)).astype(np.int64)
    counts = []
    for k in range(4):
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(_CLASS[k][data], out=sums[1:])
        counts.append(sums[ends] - sums[starts])
    upper, lower, digit, symbol = counts
    length = ends - starts
    case = np.where(upper == 0, 0, np.where((upper == 1) & (length > 1) & (lower > 0), 1, np.where(lower == 0, 2, 3)))
    again = np.zeros(len(starts), dtype=np.int64)
    for back in (1, 2):
        again[back:] |= hashes[back:] == hashes[:-back]
    shape = case + 4 * np.minimum(symbol, 3) + 16 * (symbol == length) + 32 * (digit > 0) + 64 * again + 128 * np.minimum(length // 4, 3)
    return words, shape.astype(np.int64), first


def _sum_context(total: np.ndarray, words: np.ndarray, shapes: np.ndarray, first: np.ndarray, index) -> None:
    """Adds to each bucket the index vectors of the words and shapes around it."""
    places, signs = index
    n = len(words)
    doc = np.zeros(n, dtype=np.int32)
    inner = first[1:-1][first[1:-1] < n]
    np.add.at(doc, inner, 1)
    doc = np.cumsum(doc)
    pairs = [(words, shapes), (shapes, words)]
    for back in range(1, min(WINDOW, n - 1) + 1):
        same = doc[back:] == doc[:-back]
        pairs += [(a[same], b[same]) for a, b in ((words[back:], words[:-back]), (words[:-back], words[back:]), (shapes[back:], shapes[:-back]))]
    at, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
    for k in range(NONZERO):
        total += np.bincount(at * DIM + places[k][near], weights=signs[k][near], minlength=len(total))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors from the contexts of all documents: VOCABULARY x DIM floats."""
    ship(docs.sparkSession)

    def count(batches):
        total, index = np.zeros(VOCABULARY * DIM), index_vectors()
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in blocks(offsets, BLOCK_BYTES):
                part = offsets[a : b + 1]
                words, shapes, first = tokens(data[part[0] : part[-1]], part - part[0])
                if len(words):
                    _sum_context(total, words, shapes, first, index)
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), dtype=np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    added = docs.select(text).mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema)
    vectors = np.zeros((SLICES, VOCABULARY * DIM // SLICES))
    for row in added.collect():
        vectors[row["slice"]] = np.frombuffer(row["sums"], dtype=np.float64)
    vectors = vectors.reshape(VOCABULARY, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """A row for each text: the mean vectors of its words and of its shapes, and how many words it has."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, 2 * DIM + 1), dtype=np.float32)
    for a, b in blocks(offsets, 1 << 20):
        part = offsets[a : b + 1]
        words, shapes, first = tokens(data[part[0] : part[-1]], part - part[0])
        n = np.diff(first)
        some = np.flatnonzero(n)
        if len(some):
            at = first[:-1][some]
            for k, ids in enumerate((words, shapes)):
                out[a + some, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[ids], at, axis=0) / n[some, None]
            out[a + some, -1] = np.log1p(n[some]) / 10
    return out


class Network:
    """Input standardised, one hidden layer of tanh units, a logistic output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 3):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 0 and 0 < self.share < 1
        if not self.fitted:
            return
        random = np.random.default_rng(seed)
        order = random.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        aside = max(1, len(x) // 5)
        fit_x, fit_y = (z[aside:], y[aside:]) if len(x) > 5 else (z, y)
        d = x.shape[1]
        p = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = random.permutation(len(fit_x))
            for k in range(0, len(order), batch):
                xb, yb = fit_x[order[k : k + batch]], fit_y[order[k : k + batch]]
                h = np.tanh(xb @ p[0] + p[1])
                e = (_logistic(h @ p[2] + p[3]) - yb) / len(yb)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                t += 1
                for i, g in enumerate(grads):  # Adam
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, held = self._logits(z[:aside]), y[:aside]
        loss = lambda s: -np.mean(held * np.log(_logistic(logits / s) + 1e-12) + (1 - held) * np.log(1 - _logistic(logits / s) + 1e-12))
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return _logistic(self._logits((x - self.mean) / self.scale) / self.temperature)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(doc_id, parts: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, vectors, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """The network, from ``labels`` (doc_id, label): at most MAX_LABELLED of them, with one document each."""
    some = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("double").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    rows = docs.select(doc_id, text).join(F.broadcast(some), F.col(doc_id) == F.col("_id")).select(F.col("_y").alias("y"), F.col("_id").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def features(batches):
        for batch in batches:
            x = pooled(vectors.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "y")), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "h", "y", "x"])

    # of rows that share an id one is learnt from, so what is collected is bounded too
    each = rows.mapInArrow(features, f"id {dict(some.dtypes)['_id']}, h long, y double, x binary").groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("of"))
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in each.select("id", "of.*").collect())
    x = np.array([np.frombuffer(r[2], dtype=np.float32) for r in got]).reshape(len(got), 2 * DIM + 1)
    return Network(x, np.array([r[1] for r in got]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` with score (double) and predicted (int); columns of these names are replaced. Only ``labels`` teach."""
    spark = docs.sparkSession
    ship(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
    network = spark.sparkContext.broadcast(fit(spark, docs, labels, vectors, doc_id, text, label))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])

    def score(batches):
        for batch in batches:
            s = network.value.score(pooled(vectors.value, batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(held_out(F.col("doc_id"), 3) != 1)
    scored = classify(docs, labels)
    return scored.select("doc_id", (held_out(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
