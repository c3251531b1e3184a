"""Rule statistics per document and an isolation forest over them (operator 3).

One pass computes the rule statistics. An isolation forest is grown from a
bounded sample of these rows (``trees * sample`` rows, picked by hash of the
id): random splits isolate odd rows early, so a short mean path is an anomaly.
The cut on the anomaly score is calibrated on every labelled row: the lowest
cut at which at most ``max_loss`` of the good rows that pass the base rules are
lost, and no lower than needed to reach all bad ones.

Defined results: a null or empty text has no words and fails the base rule; a
null id keeps its row; repeated rows are scored each; an empty table gives an
empty result; without usable labels nothing is rejected beyond the base rules;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .shared import bounded_sample, ship, slices, stored

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate",
            "upper_rate", "punctuation_rate", "distinct_rate")
TREES, SAMPLE, MAX_LOSS = 64, 256, 0.005
BINS = 2000


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _UPPER | _flags(bytes(range(97, 123))) | _flags(bytes(range(128, 256)))
_PUNCT = ~(_LETTER | _flags(b"0123456789") | _flags(bytes(range(33))))


def _distinct_per_text(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each text."""
    own = B.mix(key ^ B.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(own, return_index=True)
    return np.bincount(doc[at], minlength=n)


def _repeat_words(w: B.Words) -> np.ndarray:
    """Words inside a 3-word window that its text holds twice or more."""
    h, doc, at = B.windows(w, 3)
    own = B.mix(h ^ B.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    twin = np.zeros(len(s), bool)
    if len(s) > 1:
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    hit = at[order[twin]]
    covered = np.zeros(len(w.hash), bool)
    for i in range(3):
        covered[hit + i] = True
    return B.per_text(covered, w.first)


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Rule counts and forest features of the texts of one slice."""
    n = len(off) - 1
    w = B.find_words(data, off, B.SPACED)
    lead = (data & 0xC0) != 0x80
    inside = B.SPACED[data]
    n_words = w.counts
    word_chars = B.per_text(inside & lead, off)
    symbols = B.per_text(_SYMBOL[data], off)
    lines = B.find_words(data, off, B.LINES)
    words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    with_word = words_before[lines.end] > words_before[lines.start]
    n_lines = np.bincount(lines.doc[with_word], minlength=n)
    dup_lines = n_lines - _distinct_per_text(lines.hash[with_word], lines.doc[with_word], n)
    repeat = _repeat_words(w)
    chars = np.maximum(word_chars, 1)
    words = np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols,
        "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "log_words": np.log1p(n_words), "word_length": word_chars / words,
        "symbol_rate": symbols / words, "dup_line_rate": dup_lines / np.maximum(n_lines, 1),
        "repeat_rate": repeat / words,
        "upper_rate": B.per_text(_UPPER[data], off) / chars,
        "punctuation_rate": B.per_text(_PUNCT[data], off) / words,
        "distinct_rate": _distinct_per_text(w.hash, w.doc, n) / words,
    }


STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + \
    ", ".join(f"{c} double" for c in FEATURES)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in slices(batches):
        s = statistics(data, off)
        cols = [b.column(0).cast(pa.int64())]
        cols += [pa.array(s[c].astype(np.int64)) for c in COUNTS]
        cols += [pa.array(s[c].astype(np.float64)) for c in FEATURES]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, *FEATURES])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, ``base_failed`` and the forest's features."""
    ship(docs.sparkSession)
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _stats_batches, STATS_SCHEMA)
    return s.withColumn("base_failed", (F.col("n_words") < 50)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


class Forest:
    """Isolation forest: per tree arrays of split feature (-1 in a leaf), cut,
    children and the path length that ends in a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(rows)))
        depth = int(np.ceil(np.log2(self.sample)))
        self.trees = []
        for _ in range(trees if len(rows) else 0):
            take = rng.choice(len(rows), self.sample, replace=len(rows) < self.sample)
            nodes: list[list[float]] = []
            self._grow(rows[take], 0, depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x, level, depth, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, level + average_path(len(x))])
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
        if level < depth and len(x) > 1 and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            left = x[:, f] <= cut
            a = self._grow(x[left], level + 1, depth, rng, nodes)
            b = self._grow(x[~left], level + 1, depth, rng, nodes)
            nodes[me] = [f, cut, a, b, 0.0]
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                node = t[at[go]]
                left = x[go, f[go]] <= node[:, 1]
                at[go] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
            total += t[at, 4]
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.sample), 1e-9))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_forest(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest from at most ``trees * sample`` rows, taken by hash of the id."""
    rows = bounded_sample(stats.select("doc_id", *FEATURES), trees * sample, "doc_id", *FEATURES)
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return Forest(x, trees, sample)


def calibrate(hist: list[tuple[int, int, int]], max_loss: float) -> float:
    """Cut on the score from (bin, quality, rows): scores at or above it are
    rejected. Infinite without bad rows."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, q, n in hist:
        (good if q == 1 else bad)[b] += n
    if not bad.sum():
        return float("inf")
    lost = np.cumsum(good[::-1])[::-1] / max(good.sum(), 1)
    ok = np.flatnonzero(lost <= max_loss)
    if not len(ok):
        return float("inf")
    caught = np.cumsum(bad[::-1])[::-1]
    best = ok[0] + int(np.flatnonzero(caught[ok[0]:] == caught[ok[0]])[-1])  # highest of equal worth
    return best / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE,
                  max_loss: float = MAX_LOSS) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly score and kept."""
    spark = docs.sparkSession
    stats = stored(rule_statistics(docs), "rules")
    forest = spark.sparkContext.broadcast(grow_forest(stats, trees, sample))  # at most trees * sample * 2 nodes

    def scored(batches):
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]) \
                if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[b.column(c) for c in COUNTS], b.column("base_failed"),
                 pa.array(forest.value.score(x))],
                ["doc_id", *COUNTS, "base_failed", "anomaly"])

    out = stored(stats.mapInArrow(scored, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                                  + ", base_failed boolean, anomaly double"), "scored")
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
             .where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")))
    hist = (out.where(~F.col("base_failed")).select("doc_id", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
            .join(marks, "doc_id").groupBy("bin", "quality").count().collect())  # at most 2 * BINS rows
    cut = calibrate([tuple(r) for r in hist], max_loss)
    return out.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) / BINS < F.lit(cut)))
