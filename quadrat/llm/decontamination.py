"""Benchmark decontamination with BM25 and block-max WAND (operator 2).

The test items are the index: per term its BM25 impact on each item, divided by
the item's score for its own text, so that a passage's score for an item is the
share (0 to 1) of the item's weight it covers. Items lie in blocks; a term's
largest impact in each block bounds what it can add there.

Every passage (window) of every document is a query. In the order of block-max
WAND: a passage whose term maxima cannot reach the threshold is dropped, then
every block whose block maxima cannot, then the blocks left are scored exactly;
the steps run over all passages of a batch at once instead of document at a
time, so nothing above the threshold is missed. A retrieved item is verified:
its question and its answer must each have at least 80 % of their five-word
shingles in the passage; an item without an answer is held as a whole against
the 80 %, and has no answer share. Windows are twice the longest item and overlap by half, so an item
that stands in a text lies whole in one of them.

The index is broadcast in shards of bounded size (``SHARD_ITEMS`` items and
``SHARD_BYTES`` of text); a larger benchmark is searched shard by shard, each a
pass over the documents.

Defined results: null or empty texts and items match nothing; a null item id is
reported as null; of repeated items each id is reported; repeated rows are
searched each; an item of fewer than five words is one shingle; empty tables
give an empty result; other columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .shared import ship, slices, text_buffers

K1, B_LENGTH = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 8
SHARD_ITEMS, SHARD_BYTES = 512, 1 << 20


class ItemIndex:
    """BM25 index of at most a shard of items."""

    def __init__(self, ids: list, questions: list[str], answers: list[str | None]):
        texts = [" ".join(x for x in (q or "", a or "") if x) for q, a in zip(questions, answers)]
        data, off = text_buffers(pa.array(texts, pa.string()))
        w = B.find_words(B.LOWER[data], off, B.ALNUM)
        self.ids, self.count = ids, len(ids)
        self.terms = np.unique(w.hash)
        t = np.searchsorted(self.terms, w.hash)
        n, v = self.count, len(self.terms)
        tf = np.bincount(t * max(n, 1) + w.doc, minlength=v * n).reshape(v, n).astype(np.float64) if n else np.zeros((v, 0))
        length = np.maximum(w.counts, 1)
        df = (tf > 0).sum(1)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B_LENGTH + B_LENGTH * length / max(length.mean(), 1)) if n else np.ones(0)
        impact = idf[:, None] * tf * (K1 + 1) / (tf + norm[None, :])
        self.impact = (impact / np.maximum(impact.sum(0), 1e-12)).astype(np.float32)
        blocks = -(-n // BLOCK_ITEMS)
        padded = np.zeros((v, blocks * BLOCK_ITEMS), np.float32)
        padded[:, :n] = self.impact
        self.block_max = padded.reshape(v, blocks, BLOCK_ITEMS).max(2) if n else np.zeros((v, 0), np.float32)
        self.term_max = self.block_max.max(1) if n else np.zeros(v, np.float32)
        self.longest = int(w.counts.max()) if n else 0
        self.parts = []
        for i, (q, a) in enumerate(zip(questions, answers)):
            h = w.hash[w.first[i]:w.first[i + 1]]
            given = len(B.find_words(*_lower([q or ""]), B.ALNUM).hash) if a else len(h)
            self.parts.append((*_shingle_parts(h, given), bool(a)))

    def search(self, term: np.ndarray, passage: np.ndarray, passages: int,
               threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of every pair at or above the threshold; term
        and passage list the different terms of each passage, passage ascending."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not len(term):
            return none
        low = np.float32(threshold - 1e-4)
        bound = np.bincount(passage, self.term_max[term], passages)
        live = bound[passage] >= low
        term, passage = term[live], passage[live]
        if not len(term):
            return none
        cut = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
        who, rows = passage[cut], []
        for a in range(0, len(cut), 2048):          # bounds of 2048 passages at a time
            z = cut[a + 2048] if a + 2048 < len(cut) else len(term)
            rows.append(np.add.reduceat(self.block_max[term[cut[a]:z]], cut[a:a + 2048] - cut[a], axis=0))
        at, block = np.nonzero(np.concatenate(rows) >= low)
        ends = np.append(cut[1:], len(term))
        got = [], [], []
        for p in np.unique(at).tolist():
            items = (block[at == p][:, None] * BLOCK_ITEMS + np.arange(BLOCK_ITEMS)).ravel()
            items = items[items < self.count]
            score = self.impact[np.ix_(term[cut[p]:ends[p]], items)].sum(0, dtype=np.float64)
            hit = score >= threshold - 1e-6
            got[0].extend([int(who[p])] * int(hit.sum()))
            got[1].extend(items[hit].tolist())
            got[2].extend(score[hit].tolist())
        return np.array(got[0], np.int64), np.array(got[1], np.int64), np.array(got[2], np.float32)


def _lower(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_buffers(pa.array(texts, pa.string()))
    return B.LOWER[data], off


def _words_of(h: np.ndarray) -> B.Words:
    n = len(h)
    return B.Words(np.arange(n), np.arange(n) + 1, np.zeros(n, np.int64), h, np.array([0, n]))


def _shingle_parts(h: np.ndarray, question_words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(size, question shingles, answer shingles) of an item; a shingle belongs
    to the answer if it ends there."""
    size = min(SHINGLE, len(h))
    if not size:
        return 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    s, _, at = B.windows(_words_of(h), size)
    in_answer = at + size > question_words
    return size, np.unique(s[~in_answer]), np.unique(s[in_answer])


def _share(part: np.ndarray, have: np.ndarray) -> float:
    """Share of the shingles of a part found; a part without any is found."""
    return float(np.isin(part, have).mean()) if len(part) else 1.0


def find_items(data: np.ndarray, off: np.ndarray, ix: ItemIndex, threshold: float,
               overlap: float) -> dict[tuple[int, int], tuple[float, float, float | None, int]]:
    """(text, item) -> best (score, question share, answer share, first word of
    the passage) of the verified pairs of a slice. Without an answer the first
    share is the whole item's, the second null."""
    w = B.find_words(B.LOWER[data], off, B.ALNUM)
    if not len(w.hash) or not ix.count or not ix.longest:
        return {}
    width = max(2 * ix.longest, 2 * SHINGLE)
    step = width // 2
    known = np.minimum(np.searchsorted(ix.terms, w.hash), len(ix.terms) - 1)
    hit = np.flatnonzero(ix.terms[known] == w.hash)
    place = hit - w.first[w.doc[hit]]
    # Window k of a text has its words k * step to k * step + width.
    windows = np.maximum(1, -(-(w.counts - width) // step) + 1)
    base = np.concatenate([[0], np.cumsum(windows)])
    last = np.minimum(place // step, windows[w.doc[hit]] - 1)
    first = np.maximum(place // step - 1, 0)
    two = np.concatenate([base[w.doc[hit]] + last, (base[w.doc[hit]] + first)[first < last]])
    term = np.concatenate([known[hit], known[hit][first < last]])
    key = np.unique(two * np.int64(len(ix.terms)) + term)
    passage, item, score = ix.search(key % len(ix.terms), key // len(ix.terms), int(base[-1]), threshold)
    found: dict[tuple[int, int], tuple[float, float, float | None, int]] = {}
    text = np.searchsorted(base, passage, side="right") - 1
    for d, p, i, s in zip(text.tolist(), passage.tolist(), item.tolist(), score.tolist()):
        a = int(w.first[d]) + (p - int(base[d])) * step
        z = min(a + width, int(w.first[d + 1]))
        size, question, answer, answered = ix.parts[i]
        have = B.windows(_words_of(w.hash[a:z]), size)[0]
        q, r = _share(question, have), _share(answer, have) if answered else None
        if q >= overlap and (r is None or r >= overlap) and (len(question) or len(answer)):
            best = (s, q, r, a - int(w.first[d]))
            if (d, i) not in found or best[:3] > found[d, i][:3]:
                found[d, i] = best
    return found


def shards(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """The benchmark's items as indexes of bounded size, one at a time."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer"))
    size = F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))
    n, total, largest = items.agg(F.count(F.lit(1)), F.sum(size), F.max(size)).first()
    if not n:
        return
    if largest > SHARD_BYTES:
        raise ValueError(f"a test item of {largest} bytes is larger than a shard ({SHARD_BYTES})")
    parts = max(-(-n // SHARD_ITEMS), -(-int(total) // SHARD_BYTES))
    if parts == 1:
        numbered = items.withColumn("part", F.lit(0))
    else:                                 # ranges of equal length within hash buckets
        parts *= 2
        numbered = items.withColumn("part", F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)).cast("int"))
    for p in range(parts):
        rows = numbered.where(F.col("part") == p).orderBy("item_id", "text").collect()  # a shard
        for a in range(0, len(rows), 2 * SHARD_ITEMS):
            some = rows[a:a + 2 * SHARD_ITEMS]
            yield ItemIndex([r.item_id for r in some], [r.text for r in some], [r.answer for r in some])


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                       overlap: float = OVERLAP) -> DataFrame:
    """One row per document row and test item found in it."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for ix in shards(benchmark):
        index = spark.sparkContext.broadcast(ix)

        def run(batches, index=index):
            ix = index.value
            for b, data, off in slices(batches):
                ids = b.column(0).to_pylist()
                rows = [(ids[d], None if ix.ids[i] is None else int(ix.ids[i]), *found)
                        for (d, i), found in sorted(find_items(data, off, ix, threshold, overlap).items())]
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 [f.split()[0] for f in SCHEMA.split(", ")])

        out = out.union(own.mapInArrow(run, SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
          overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no test item was found, with all columns."""
    spark = docs.sparkSession
    ship(spark)
    for ix in shards(benchmark):
        index = spark.sparkContext.broadcast(ix)

        def run(batches, index=index):
            for b, data, off in slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _ in find_items(data, off, index.value, threshold, overlap)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
