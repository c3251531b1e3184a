"""Best-fit packing in several dimensions (operator 4).

Documents become pieces of at most ``TOKENS`` ids. A sequence has three
capacities: tokens, number of pieces, and attention cost (the sum of squared
lengths). Pieces go, longest first, to the open sequence that has room in every
dimension and is best by the chosen rule: the smallest weighted norm of what
would be left, or the largest weighted dot product of the piece with what is
left. If none has room a sequence is opened. Each task packs a share of the
pieces dealt out evenly, at most about ``PACK_ROWS`` of them, so memory and time
are bounded whatever the input, at the price of one or two sequences that are
not full per task.

By default a sequence takes any number of pieces and any attention cost its
tokens can give, so the fewest sequences result; smaller capacities are
parameters.

Defined results: a null or empty text is the end id alone; null and repeated
ids keep their rows and pieces; an empty table gives an empty result; a piece
that alone exceeds a capacity gets a sequence of its own only if it exceeds
attention cost (tokens cannot be exceeded); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import ship, slices

TOKENS = 2048
PACK_ROWS = 16_384
WEIGHTS = (1.0, 0.02, 0.02)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, size: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32 bytes). A longer
    document is cut into pieces of ``size`` ids, of which the first may be shorter."""
    ship(docs.sparkSession)
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        for b, data, off in slices(batches):
            ids, off = enc.encode(data, off)
            n = np.diff(off)
            pieces = -(-n // size)
            doc = np.repeat(np.arange(b.num_rows), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - (pieces - 1) * size                 # length of the first piece
            length = np.where(piece == 0, short[doc], size)
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
            at = (off[:-1][doc] + start) * 4
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array([raw[s:s + 4 * k] for s, k in zip(at.tolist(), length.tolist())], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def pack(length: np.ndarray, tokens_max: int = TOKENS, pieces_max: int | None = None, cost_max: int | None = None,
         rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    cap = np.array([tokens_max, pieces_max or tokens_max, cost_max or tokens_max ** 2], np.float64)
    w = np.asarray(weights, float)
    n = len(length)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-length, kind="stable")
    ordered = length[order]
    full = int(np.searchsorted(-ordered, -tokens_max, side="right"))
    sequence[order[:full]] = np.arange(full)              # a piece that fills a sequence
    opened = full
    left = np.zeros((3, 1024))                            # what is left, by share of the capacity
    used = np.zeros(1024, np.int64)
    name = np.zeros(1024, np.int64)
    live = 0
    smallest = int(ordered[-1]) if n else 0
    tight = np.array([smallest, 1, smallest ** 2]) / cap
    for k in range(full, n):
        size = int(ordered[k])
        need = np.array([size, 1, size * size]) / cap
        room = left[:, :live]
        fits = np.flatnonzero((room[0] >= need[0] - 1e-12) & (room[1] >= need[1] - 1e-12) & (room[2] >= need[2] - 1e-12))
        if len(fits):
            rest = room[:, fits]
            if rule == "norm":
                best = int(fits[np.argmin(w @ (rest - need[:, None]) ** 2)])
            else:
                best = int(fits[np.argmax((w * need) @ rest)])
        else:
            if live == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], 1)
                used, name = np.concatenate([used, np.zeros_like(used)]), np.concatenate([name, np.zeros_like(name)])
            best = live
            left[:, best], used[best], name[best] = 1.0, 0, opened
            live += 1
            opened += 1
        i = order[k]
        sequence[i], offset[i] = name[best], used[best]
        used[best] += size
        left[:, best] -= need
        if (left[:, best] < tight - 1e-12).any():         # nothing can follow: closed
            live -= 1
            left[:, best], used[best], name[best] = left[:, live], used[live], name[live]
    return sequence, offset


def assign(pieces: DataFrame, tokens_max: int = TOKENS, pieces_max: int | None = None, cost_max: int | None = None,
           rule: str = "norm", weights=WEIGHTS, rows: int = PACK_ROWS) -> DataFrame:
    """``pieces`` (with a ``length`` column) and sequence_id, offset."""
    spark = pieces.sparkSession
    ship(spark)
    parts = max(1, -(-pieces.count() // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own or not sum(b.num_rows for b in own):
            return
        t = pa.Table.from_batches(own)
        seq, off = pack(t.column("length").to_numpy(), tokens_max, pieces_max, cost_max, rule, weights)
        t = t.append_column("sequence_id", pa.array(seq + (TaskContext.get().partitionId() << 40)))
        yield from t.append_column("offset", pa.array(off)).combine_chunks().to_batches()

    schema = pieces.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")
    # Dealt out evenly, without a key: no id or length can make a share large.
    return pieces.drop("sequence_id", "offset").repartition(parts).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and its ids (uint32 bytes), for pieces
    that carry ``ids``; a sequence is bounded by its token capacity."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
