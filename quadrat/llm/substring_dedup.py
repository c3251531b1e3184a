"""Substring dedup by content-defined chunks (operator 7).

A gear hash rolls over the bytes of each text (its value depends on the last
``WINDOW`` bytes only, its tie break on ``TIE`` more); a cut follows the last
byte with the smallest value of every ``REACH`` bytes. Cuts therefore depend on
nearby content alone, an insertion moves the chunks behind it without changing
them, and no stretch, periodic ones included, is without cuts. Chunks of a
period of a few bytes are joined to about ``JOIN`` bytes from the first of their
run, so that they are equal whatever its length. Chunks are deduplicated by
digest, each taken with its successor so that a short chunk of common words is no
match by itself. A run of repeated chunks of at least ``MIN_WORDS`` words is a
repeated passage. A passage loses at most ``MAX_CHUNK`` bytes at its start and
``REACH`` at its end, and a periodic one the joined chunk of its last bytes, so
one of over 50 words holds such a run unless these edges hold over half of its
words, as they can where words are short.

Defined results: null and empty texts have no chunks; rows with a null id take
no part; repeats inside one document do not count, nor do repeated rows of one
id; an empty table gives an empty result; other columns are ignored. Offsets are
code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .shared import ship, slices, stored

WINDOW = 8                     # bytes that the low bits of the gear hash see
TIE = 4                        # bytes further back that break ties
REACH = 64                     # bytes of which one has a cut behind it: chunks of about 33 bytes
MAX_CHUNK = WINDOW + TIE + REACH
JOIN = 32                      # bytes to which chunks of half of that and less are joined in a run of equal ones
MIN_WORDS = 25
GEAR = (B.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 256, for all i at once: sums of
    2, 4, 8 terms by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint8(step)
        h = h + shifted
    return h


def _cuts(data: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The last smallest byte of every ``REACH`` bytes of a text; ``place`` and
    ``left`` count a text's bytes before a byte and from it on."""
    n = len(data)
    if n < MAX_CHUNK:
        return np.zeros(0, np.int64)
    h = gear_hash(data).astype(np.int64)
    low = (h << 48) | np.arange(n - 1, -1, -1)          # of equal ones the last
    low[TIE:] |= h[:-TIE] << 40
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    whole = np.flatnonzero((place[:len(low)] >= WINDOW - 1 + TIE) & (left[:len(low)] >= REACH))
    at = n - 1 - (low[whole] & ((1 << 40) - 1))
    return at[np.diff(at, prepend=-1) > 0]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The chunk ends that stay when runs of equal short chunks are joined."""
    size = end - start
    short = np.flatnonzero(size <= JOIN // 2)
    digest = np.zeros(len(start), np.uint64)
    digest[short] = B.hash_spans(data, start[short], end[short])
    same = np.zeros(len(start), bool)                   # as the chunk before
    same[1:] = ((size[1:] <= JOIN // 2) & (size[1:] == size[:-1]) & (digest[1:] == digest[:-1])
                & (text[1:] == text[:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(start))))
    number = np.arange(len(start)) - first + 1
    return end[~np.append(same[1:], False) | (number % np.maximum(JOIN // size, 1) == 0)]


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every chunk of every text of a slice, in bytes."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    size = np.diff(off)
    place = np.arange(n) - np.repeat(off[:-1], size)
    left = np.repeat(off[1:], size) - np.arange(n)
    ends = np.unique(np.concatenate([_cuts(data, place, left) + 1, off[1:][size > 0]]))
    starts = np.concatenate([[0], ends[:-1]])
    ends = _joined(data, starts, ends, np.searchsorted(off, starts, side="right") - 1)
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in slices(batches):
        start, end, text = chunks(data, off)
        digest = B.hash_spans(data, start, end)
        digest = B.mix(digest ^ (end - start).astype(np.uint64))
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        begins = B.find_words(data, off, B.SPACED, hashes=False).start
        words = np.searchsorted(begins, end) - np.searchsorted(begins, start)
        pair = np.flatnonzero(text[1:] == text[:-1])
        key = B.mix(digest[pair] * np.uint64(3) + digest[pair + 1])
        at = lead[start] - lead[off[text]]
        size = lead[end] - lead[start]
        # place of a pair in one number: start 30 bits, two sizes of 9, two word counts of 8
        spot = at[pair] << 34
        for shift, x in ((25, size[pair]), (16, size[pair + 1]), (8, words[pair]), (0, words[pair + 1])):
            spot |= x << shift
        ids = b.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(ids[text[pair]].astype(np.int64)), pa.array(spot)],
            ["key", "doc_id", "spot"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {c: [] for c in ("doc_id", "start", "end", "n_words", "n_chunks", "first_doc_id")}
        for doc, spots, firsts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            spot = np.array(spots.values)
            order = np.argsort(spot)
            spot, low = spot[order], np.array(firsts.values)[order]
            at, one, two = spot >> 34, (spot >> 25) & 511, (spot >> 16) & 511
            w1, w2 = (spot >> 8) & 255, spot & 255
            new = np.ones(len(spot), bool)          # a pair that does not follow the one before it
            new[1:] = at[1:] != at[:-1] + one[:-1]
            cut = np.concatenate([np.flatnonzero(new), [len(spot)]])
            for a, z in zip(cut[:-1], cut[1:]):
                n = int(w1[a:z].sum() + w2[z - 1])
                if n >= MIN_WORDS:
                    for c, x in (("doc_id", doc), ("start", at[a]), ("end", at[z - 1] + one[z - 1] + two[z - 1]),
                                 ("n_words", n), ("n_chunks", z - a + 1), ("first_doc_id", low[a:z].min())):
                        out[c].append(int(x))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], list(out))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that another document has too: doc_id, start, end,
    n_words, n_chunks, first_doc_id (the smallest id of a document that has some
    of its chunks; that one is the copy to keep)."""
    ship(docs.sparkSession)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
            .mapInArrow(_chunk_rows, "key long, doc_id long, spot long"))
    # Only what is repeated goes on; the minimum and maximum are pre-aggregated.
    twice = (rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
             .where(F.col("low") < F.col("high")).select("key", "low"))
    hits = rows.join(stored(twice, "repeated"), "key")
    runs = hits.groupBy("doc_id").agg(F.collect_list("spot").alias("spots"), F.collect_list("low").alias("lows"))
    return runs.mapInArrow(_runs, "doc_id long, start long, end long, n_words long, n_chunks long, first_doc_id long")
