"""Token-id shard files with a minimal perfect hash index (operator 8).

Documents are encoded where they are read; only their ids are then range-partitioned,
sorted by key and written as shard files of bounded size through Spark's text sink
(one binary cell per file), so any file system and the usual commit protocol work.
A writer holds the ids of one shard and no text. A shard file:

    magic "QTOKENS1", then eleven little-endian int64: id width in bytes,
    partition, number in the partition, rows, ids, rows with a null key (they
    come first), keys, buckets, and three spare
    payload: the ids of all rows, raw, in row order
    row starts (int64, rows + 1), row keys (int64)
    bucket seeds (int64), per slot: fingerprint (uint32), first row (uint32),
    rows (uint32); a final newline from the sink

Keyed access is constant-time: a key's bucket gives a seed, bucket and seed give
its slot, the slot's fingerprint tells whether the key is there, and its rows
lie together. Repeated keys share a slot; rows of one key may go on in the next
shard, whose range then begins with that key. A manifest beside the shards has the
range of keys of each, so that ``lookup`` opens only the shards concerned.

Defined results: a null or empty text is the end id alone; null ids are written
first and cannot be looked up; repeated ids each keep their row; an empty table
writes no shard and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .bytewords import mix
from .shared import arrow_batches, shared_path, ship, shuffle_parts, slices, stored, text_buffers, text_bytes

MAGIC = b"QTOKENS1"
SHARD_IDS = 1 << 20               # ids after which a shard is closed
PART_BYTES = 24 << 20             # of text, in one part
MOST_PARTS = 10_000
BATCH_BYTES = 8 << 20             # of a record batch that goes to a worker
TRIED = 1 << 18                   # slots looked at at once when a hash is built


class PerfectHash:
    """Hash and displace: every bucket of keys has a seed that sends its keys to
    slots of their own; buckets of one key name their slot outright."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @staticmethod
    def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
        return (mix(key.astype(np.int64).view(np.uint64) + np.uint64(0x51ED2701)) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def _slot(key: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        k = key.astype(np.int64).view(np.uint64)
        return (mix(k ^ mix(seed.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """For distinct keys. Buckets of one size are placed together: all that wait
        try some seeds at once, each takes its first one whose slots are free, and of
        those that want the same slot the first bucket gets it."""
        n = len(keys)
        buckets = n // 4 + 1
        b = cls._bucket(keys, buckets)
        order = np.argsort(b, kind="stable")
        first = np.searchsorted(b[order], np.arange(buckets + 1))
        size = np.diff(first)
        taken = np.zeros(n, bool)
        seeds = np.zeros(buckets, np.int64)
        for many in range(int(size.max(initial=0)), 1, -1):
            wait = np.flatnonzero(size == many)
            own = keys[order[first[wait][:, None] + np.arange(many)]]            # (buckets, keys)
            at = np.zeros(len(wait), np.int64)
            while len(wait):
                tries = int(np.clip(TRIED // (len(wait) * many), 1, 4096))
                seed = at[:, None] + np.arange(tries)
                slots = cls._slot(own[:, None, :], seed[:, :, None], n)           # (buckets, tries, keys)
                fits = ~taken[slots].any(2)
                i, t = np.nonzero(fits)
                s = np.sort(slots[i, t], 1)
                fits[i, t] = (s[:, 1:] != s[:, :-1]).all(1)
                has = np.flatnonzero(fits.any(1))
                t = fits[has].argmax(1)
                want = slots[has, t]
                _, owner = np.unique(want.ravel(), return_index=True)             # the first that wants a slot
                gets = np.bincount(owner // many, minlength=len(has)) == many
                done = has[gets]
                seeds[wait[done]] = seed[done, t[gets]]
                taken[want[gets].ravel()] = True
                at += tries
                at[has[~gets]] -= tries - t[~gets] - 1                            # go on behind the seed that was lost
                left = np.ones(len(wait), bool)
                left[done] = False
                wait, own, at = wait[left], own[left], at[left]
        seeds[np.flatnonzero(size == 1)] = -1 - np.flatnonzero(~taken)[:int((size == 1).sum())]
        return cls(seeds, n)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key (of any key: the fingerprint tells if it is there)."""
        seed = self.seeds[self._bucket(keys, len(self.seeds))]
        return np.where(seed < 0, -1 - seed, self._slot(keys, np.maximum(seed, 0), max(self.n, 1)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA5A5F00D12345678)) >> np.uint64(32)).astype(np.uint32)


def make_shard(part: int, number: int, keys: pa.Array, ids: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """The bytes of a shard; keys ascending, nulls first."""
    nulls = keys.null_count
    own = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, first, count = np.unique(own[nulls:], return_index=True, return_counts=True)
    ph = PerfectHash.build(key)
    slots = np.zeros((len(key), 3), np.uint32)
    slots[ph.lookup(key)] = np.stack([fingerprint(key), (first + nulls).astype(np.uint32), count.astype(np.uint32)], 1)
    head = struct.pack("<11q", width, part, number, len(keys), len(ids), nulls, len(key), len(ph.seeds), 0, 0, 0)
    return b"".join([MAGIC, head, ids.astype(f"<u{width}").tobytes(), starts.astype("<i8").tobytes(),
                     own.astype("<i8").tobytes(), ph.seeds.astype("<i8").tobytes(), slots.astype("<u4").tobytes()])


class Shard:
    """A shard read from its bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        (self.width, self.part, self.number, self.rows, n, self.nulls, keys, buckets, *_) = struct.unpack_from("<11q", raw, 8)
        at = 96

        def take(dtype, count):
            nonlocal at
            x = np.frombuffer(raw, dtype, count, at)
            at += x.nbytes
            return x

        self.ids = take(f"<u{self.width}", n)
        self.starts = take("<i8", self.rows + 1)
        self.keys = take("<i8", self.rows)
        self.hash = PerfectHash(take("<i8", buckets), keys)
        self.slots = take("<u4", keys * 3).reshape(keys, 3)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of each key; no rows if it isn't there."""
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        s = self.slots[self.hash.lookup(keys)]
        return s[:, 1].astype(np.int64), np.where(s[:, 0] == fingerprint(keys), s[:, 2], 0).astype(np.int64)

    def row(self, r: int) -> np.ndarray:
        return self.ids[self.starts[r]:self.starts[r + 1]]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key."""
        first, n = self.find(np.array([key], np.int64))
        return [self.row(r) for r in range(int(first[0]), int(first[0] + n[0]))]


def encoded(docs: DataFrame, vocabulary: str | None = None, cuts: np.ndarray | None = None) -> DataFrame:
    """(doc_id, part, ids): the raw ids of every document, with the end id, and its
    part by ``cuts``."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    cuts = np.zeros(0, np.int64) if cuts is None else cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        width = id_width(enc)
        for b, data, off in slices(batches):
            ids, at = enc.encode(data, off)
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [
                None, pa.py_buffer(at * width), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(parts_of(b.column(0), cuts)), own.cast(pa.binary())], ["doc_id", "part", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, part int, ids binary")


def id_width(enc: tokens.Encoder) -> int:
    return 2 if enc.size <= 1 << 16 else 4


def _shard_writer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, pieces, sizes, total = [], [], [], 0

        def close():
            nonlocal keys, pieces, sizes, total, number
            raw = make_shard(part, number, pa.concat_arrays(keys), np.concatenate(pieces),
                             np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), width)
            keys, pieces, sizes, total, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])

        for b in batches:
            data, off = text_buffers(b.column(1))
            off = off // width
            ids, at = data.view(f"<u{width}"), 0
            while at < b.num_rows:
                # Rows until the shard is full, one at least.
                end = min(int(np.searchsorted(off, off[at] + SHARD_IDS - total)), b.num_rows)
                end = max(end, at + 1)
                keys.append(b.column(0).slice(at, end - at))
                pieces.append(ids[off[at]:off[end]].copy())      # the batch can go
                sizes.append(np.diff(off[at:end + 1]))
                total += int(off[end] - off[at])
                if total >= SHARD_IDS:
                    yield close()
                at = end
        if keys:
            yield close()
    return run


def key_cuts(docs: DataFrame, n: int) -> np.ndarray:
    """Quantiles of the keys that cut ``n`` parts (n - 1 numbers, by one sketch)."""
    if n < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return np.sort(np.array(found or [], np.int64))


def parts_of(keys: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The part of each key: parts ascend with the keys, null keys are in the first.
    Rows of a key that fills whole parts are dealt over them in turn."""
    key = keys.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
    at = low + np.arange(len(key)) % np.maximum(high - low, 1)
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32)


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the shard files of ``docs`` under ``path``, in ascending id order. The
    parts are cut by the documents' keys, so that the texts are encoded once: the
    range partitioning of Spark would encode them a second time for its sample."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or tokens.default_vocabulary()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = min(MOST_PARTS, max(shuffle_parts(spark), -(-text_bytes(own) // PART_BYTES)))
    ids = encoded(own, vocabulary, key_cuts(own, n))
    ordered = ids.repartitionById(n, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first()).select("doc_id", "ids")
    cells = ordered.mapInArrow(_shard_writer(id_width(tokens.encoder(vocabulary))), "value binary")
    with arrow_batches(spark, BATCH_BYTES):
        cells.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, cell in zip(b.column(0).to_pylist(), b.column(1)):
            s = Shard(cell.as_py())
            if s.rows > s.nulls:
                yield pa.RecordBatch.from_pylist(
                    [{"part": s.part, "number": s.number, "low": int(s.keys[s.nulls]), "high": int(s.keys[-1]), "path": path}],
                    pa.schema([("part", pa.int64()), ("number", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                               ("path", pa.string())]))


def write_manifest(spark: SparkSession, path: str) -> None:
    """The range of keys of every shard under ``path``, as a table in its ``_manifest``."""
    ship(spark)
    shards = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    shards.mapInArrow(_ranges, "part long, number long, low long, high long, path string").write.parquet(
        f"{path}/_manifest")


def shards_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, path): the shards whose range holds a key. Ranges ascend by partition and
    overlap in their ends only: the driver hands out the partitions' bounds (two
    numbers a partition), the shards of a partition are a join."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    bounds = sorted((r["low"], r["high"], r["part"]) for r in manifest.groupBy("part").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect())
    low, high, part = (np.array([b[i] for b in bounds], np.int64) for i in range(3))
    shared = spark.sparkContext.broadcast((low, high, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, part = shared.value
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, z = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            n = np.maximum(z - a, 0)
            which = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(part[which])], ["key", "part"])

    own = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where(F.col("key").isNotNull()).distinct()
    return own.mapInArrow(run, "key long, part long").join(manifest, "part").where(
        F.col("key").between(F.col("low"), F.col("high"))).select("key", "path")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids): the raw ids of every row whose key is in the first column of
    ``keys``. Only the shards concerned are opened; their names, not their keys, are
    gathered. Keys that no shard has give no row."""
    ship(spark)
    places = stored(shards_of(spark, path, keys), "places")
    paths = [r["path"] for r in places.select("path").distinct().collect()]
    if not paths:
        return places.select(F.col("key").alias("doc_id"), F.lit(b"").alias("ids"))
    asked = places.groupBy("path").agg(F.collect_list("key").alias("keys"))     # at most the keys of one shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, own in zip(b.column(0), b.column(1).to_pylist()):
                s = Shard(cell.as_py())
                rows = [(k, s.row(r).tobytes()) for k, f, n in zip(own, *s.find(np.array(own, np.int64)))
                        for r in range(f, f + n)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()),
                                                  pa.array([x for _, x in rows], pa.binary())], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").join(asked, "path").select(
        "content", "keys").mapInArrow(run, "doc_id long, ids binary")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Raw shards: one row per file with its bytes (bounded by the shard size)."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()),
                               ("ids_crc32", pa.int64())]))
    for b in batches:
        for cell in b.column(0):
            s = Shard(cell.as_py())
            key = s.keys[s.nulls:]
            first, n = s.find(key)          # every row must be found through the index
            row = np.arange(s.nulls, s.rows)
            if not ((first <= row) & (row < first + n)).all():
                raise ValueError(f"the index of shard {s.part}/{s.number} misses a key")
            wide = s.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:z]) for a, z in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
            keys = pa.array(s.keys, mask=np.arange(s.rows) < s.nulls)
            rows = pa.StructArray.from_arrays(
                [keys, pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())],
                ["doc_id", "local", "n_tokens", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.part], pa.int64()), pa.array([s.number], pa.int64()), pa.array([len(s.ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, s.rows], pa.int32()), rows).cast(kind)],
                ["part", "number", "ids", "rows"])


def shard_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files."""
    shard = stored(read_shards(spark, path).mapInArrow(
        _rows, "part long, number long, ids long, "
        "rows array<struct<doc_id:long,local:long,n_tokens:long,ids_crc32:long>>"), "shards")
    # Starts: sums of the shards before, within the partition and over partitions
    # (one row per partition in one task).
    size = shard.select("part", "number", "ids")
    inside = size.withColumn("before", F.coalesce(F.sum("ids").over(
        Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = size.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    start = inside.join(parts, "part").select("part", "number", (F.col("before") + F.col("part_before")).alias("base"))
    return (shard.select("part", "number", "rows").join(start, ["part", "number"])
            .select("base", F.explode("rows").alias("r"))
            .select("r.doc_id", (F.col("base") + F.col("r.local")).alias("start"), "r.n_tokens", "r.ids_crc32"))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the shards to a new shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-shards")
    write_shards(docs, path, vocabulary)
    return shard_rows(spark, path)
