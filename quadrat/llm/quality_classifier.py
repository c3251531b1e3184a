"""Quality scores from random-indexing word vectors (operator 9).

Words are hashed to ``BUCKETS`` rows. Every bucket has a sparse random index
vector; a bucket's word vector is the sum of the index vectors of its words'
neighbours over the whole corpus (each task sums what it reads; the sums meet
block by block). A document pools its words' vectors (mean, deviation, likeness
of neighbours). A network with one hidden layer, written in numpy, is trained on
at most ``MAX_TRAIN`` labelled rows per class taken by hash of the id, weighted
back to the classes' shares; one part in five is left out to fit the
temperature that calibrates the probabilities.

Defined results: null and empty texts pool to zeros and get a score; a null id
keeps its row and is not held out; repeated rows are scored each; an empty table
gives an empty result; with labels of one class or none, the score is that
class's share (0.5 without any). Labels are learned only from rows whose crc32
remainder is not 1. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .shared import bounded_sample, ship, shuffle_parts, slices, stored

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
BLOCK = 128                       # buckets whose sums travel in one row
MAX_TRAIN = 10_000                # labelled rows per class
HIDDEN, EPOCHS, BATCH = 32, 60, 256
WIDTH = 2 * DIM + 3

_WORD = B.class_table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
_SIGN = ~_WORD
_SIGN[list(range(33)) + [127]] = False


def held_out() -> Column:
    """Rows never used for learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of letter runs and sign runs in text order."""
    a, s = B.find_words(data, off, _WORD), B.find_words(data, off, _SIGN)
    order = np.argsort(np.concatenate([a.start, s.start]), kind="stable")
    h = np.concatenate([a.hash, s.hash])[order]
    return (h >> np.uint64(64 - 14)).astype(np.int64), np.concatenate([a.doc, s.doc])[order]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    h = B.mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for _, data, off in slices(batches):
        t, doc = tokens(data, off)
        for reach in range(1, REACH + 1):
            pair = np.flatnonzero(doc[reach:] == doc[:-reach]) if len(doc) > reach else np.zeros(0, int)
            a, b = t[pair], t[pair + reach]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(x * DIM + place[y, k], sign[y, k], BUCKETS * DIM)
    rows = total.astype(np.int32).reshape(-1, BLOCK * DIM)
    some = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())],
        ["block", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the rows of each block that came to this task, one block in memory
    for each different block."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            v = np.frombuffer(v.as_buffer(), np.int32).astype(np.int64)
            total[k] = total[k] + v if k in total else v
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())],
        ["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors learned from all texts (2 MB, whatever the input)."""
    spark = docs.sparkSession
    ship(spark)
    parts = docs.select("text").mapInArrow(_context_sums, "block int, sums binary")
    n = shuffle_parts(spark)
    sums = parts.repartition(max(n, BUCKETS // BLOCK), "block").mapInArrow(_add_up, "block int, sums binary").collect()
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for r in sums:
        total[r.block] += np.frombuffer(r.sums, np.int64)
    v = total.reshape(BUCKETS, DIM)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Features of the texts of a slice: mean and deviation of the words'
    vectors, mean likeness of words one and two apart, log of the length."""
    n = len(off) - 1
    t, doc = tokens(data, off)
    count = np.bincount(doc, minlength=n)
    total, square, like = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros((n, 2))
    step = 1 << 16
    for i in range(0, len(t), step):
        v, d = vec[t[i:i + step + 2]].astype(np.float64), doc[i:i + step + 2]
        own, od = v[:step], d[:step]
        at = np.concatenate([[0], np.flatnonzero(np.diff(od)) + 1])
        total[od[at]] += np.add.reduceat(own, at)
        square[od[at]] += np.add.reduceat(own * own, at)
        for r in (1, 2):
            k = min(len(own), len(v) - r)
            if k > 0:
                same = (d[r:r + k] == d[:k]) * np.einsum("ij,ij->i", v[:k], v[r:r + k])
                like[:, r - 1] += np.bincount(d[:k], same, n)
    c = np.maximum(count, 1)[:, None]
    mean = total / c
    dev = np.sqrt(np.maximum(square / c - mean * mean, 0))
    return np.hstack([mean, dev, like / c, np.log1p(count)[:, None]]).astype(np.float32)


class Network:
    """WIDTH inputs, HIDDEN tanh units, one logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        part = rng.permutation(len(y))
        hold, fit = part[:max(1, len(y) // 5)], part[max(1, len(y) // 5):]
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(fit)
            for i in range(0, len(order), BATCH):
                k = order[i:i + BATCH]
                h = np.tanh(z[k] @ p[0] + p[1])
                e = (_logistic(h @ p[2] + p[3]) - y[k]) * weight[k] / len(k)
                back = np.outer(e, p[2]) * (1 - h * h)
                grad = [z[k].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                step += 1
                for j, g in enumerate(grad):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g * g
                    p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(s[j] / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit = self._logit(x[hold])
        grid = np.exp(np.linspace(-2, 3, 101))
        loss = [np.average(_cross_entropy(logit / t, y[hold]), weights=weight[hold]) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x):
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _logistic(self._logit(x.astype(np.float64)) / self.temperature)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _cross_entropy(z, y):
    return np.logaddexp(0, np.where(y == 1, -z, z))


def features(docs: DataFrame, vec: np.ndarray) -> DataFrame:
    """doc_id and its pooled features (float32 bytes)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vec)

    def run(batches):
        for b, data, off in slices(batches):
            x = pooled(data, off, shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, features binary")


def train(feats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network:
    """The network from at most ``max_train`` rows of each class."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = stored(marks.join(feats, "doc_id"), "labelled")
    count = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    x, y, w = [], [], []
    for q in sorted(count):
        took = bounded_sample(rows.where(F.col("quality") == q), max_train, "doc_id", "features")
        x += [np.frombuffer(r.features, np.float32) for r in took]
        y += [q] * len(took)
        w += [count[q] / max(1, len(took))] * len(took)
    if not y:
        return Network(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0))
    w = np.array(w, float)
    return Network(np.array(x, np.float64), np.array(y, float), w / w.mean())


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    feats = stored(features(docs, word_vectors(docs)), "features")
    net = spark.sparkContext.broadcast(train(feats, labels))

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.value.score(x))], ["doc_id", "score"])

    scored = feats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    spark = docs.sparkSession
    vec = word_vectors(docs)
    feats = stored(features(docs, vec), "features")
    shared = spark.sparkContext.broadcast((vec, train(feats, labels)))

    def run(batches):
        vec, net = shared.value
        for b, data, off in slices(batches):
            good = net.score(pooled(data, off, vec)) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
