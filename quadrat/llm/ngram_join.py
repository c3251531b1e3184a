"""N-gram Jaccard join by a blocked sparse matrix product (operator 10).

The document by n-gram incidence matrix is never multiplied whole. Its n-gram
columns are cut into blocks (hash ranges); how many is derived from a document's
size so that linked documents, which by their sizes can differ in few n-grams
only, must agree completely in some blocks. So:

1. every different set emits one signature per block of its n-grams (packed by
   shuffle partition; equal sets of a task are emitted once). Sets that agree in
   a block meet there, the numbers of agreeing blocks are accumulated over all
   blocks, and pairs below the bound that follows from their sizes are
   discarded. Blocks in which more than ``FEW`` sets agree are not paired: a set
   whose other blocks suffice for the bound does without them, and the sets
   that need them are linked through one of them only;
2. these candidates form clusters, and inside a cluster the product is computed
   on all n-grams: postings of a row's columns are accumulated into overlap
   counts, pairs below the bound of their sizes are discarded, and only a
   spanning forest of the links is kept. A cluster of more than one block of
   rows is first linked inside each block and to a few pivots; only what is not
   in its main component is then multiplied with the rest;
3. connected components of these links give the groups.

No pair list of a group is ever written. The bounds: linked sets of n and m
n-grams differ in at most (n + m) / 9 of them, so in at most a quarter of
either. A set of size n takes part at level floor(log2 n), and also at the next
when a set of up to n / 0.8 n-grams lies there. Each n-gram that differs spoils at
most one block, so a set with k blocks agrees with a linked one in at least
k - (n + m) / 9 of them, if both emit these blocks. Blocks are made finer, up to one
n-gram each, until k exceeds n / 4; a partner that refines further has also
emitted the coarser blocks, so the bound holds for the one that stops first.

Defined results: a null or empty text has an empty set, is linked with nothing
and is its own component; equal sets are linked; a null id gives a row with
a null component; of repeated ids each row is returned with the component of its
own text, so that texts are never linked by an id alone; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bytewords as B
from .components import components
from .shared import ship, slices, stored, text_buffers, text_bytes

SIZE = 5
LOAD, LOAD_SMALL = 3.0, 1.5   # n-grams per block for the largest sets of a level
SMALL = 6             # levels up to this one (n < 128) use blocks of a single n-gram too
FEW = 16              # sets that agree in a block and are paired
PART_BYTES = 24 << 20  # text bytes whose signatures meet in one task
BLOCK_ROWS = 512      # rows of a block of the product
BLOCK_GRAMS = 400_000
PIVOTS = 8            # expected, per cluster of more than one block
KEY_BYTES = 5         # bytes of a signature that travel, beside its partition
CLASS, GONE_ID, GONE_CLASS = (f"__{x}_of_ngram_join" for x in ("class", "gone_id", "gone_class"))
INFO = np.dtype([("owner", "<u8"), ("n", "<i8"), ("k", "<i4"), ("fine", "<i4")])


def sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text of a slice, and offsets."""
    w = B.find_words(B.LOWER[data], off, B.SPACED)
    h, doc, _ = B.windows(w, SIZE, short=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Id of each set (sum of mixed members, mixed with the size); 0 if empty."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(first).astype(np.uint64)
    d = B.mix((total[first[1:]] - total[first[:-1]]) ^ B.mix(n))
    return np.where(n > 0, d | np.uint64(1), np.uint64(0))


def ranges(level: int) -> int:
    """Blocks at a level."""
    return max(1, int(np.ceil((2 << level) / (LOAD_SMALL if level <= SMALL else LOAD))))


def signatures(own: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """Signatures of one sorted set of n-gram hashes at its own level and, where
    larger partners lie there, at the next: (signatures, blocks of the last
    refinement, number of refinements)."""
    n = len(own)
    level = n.bit_length() - 1
    mixed = B.mix(own ^ np.uint64(0xD6E8FEB86659FD93))
    spot = own >> np.uint64(32)                 # upper half: its place among the blocks
    out = []
    for g in (level, level + 1):
        if g > level and 5 * n < 4 * (2 << level):
            break
        k, fine, got = ranges(g), 0, []
        while True:
            r = (spot * np.uint64(k)) >> np.uint64(32)
            at = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
            tag = B.mix(r[at] * np.uint64(64) + np.uint64(g) + (np.uint64(fine) << np.uint64(48)))
            sig = B.mix(np.add.reduceat(mixed, at) ^ tag)
            if g > SMALL and fine < 2:          # blocks of one n-gram agree too easily
                sig = sig[np.diff(np.concatenate([at, [n]])) > 1]
            got.append(sig)
            if 4 * len(sig) > n or k >= 1 << 31:
                break
            k, fine = k + (k >> 1) + 1 if fine < 1 else 4 * k, fine + 1
        out.append((np.concatenate(got), len(sig), fine))
    return out


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in slices(batches):
        h, first = sets(data, off)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(first)), pa.array(digests(h, first).view(np.int64))],
            ["doc_id", "n_shingles", "cls"])


def _signature_rows(parts: int):
    """Packed rows: per partition the keys of its signatures, whose they are (a
    set's id with the low bit telling the level), and about each owner once its
    size and numbers of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b, data, off in slices(batches):
            h, first = sets(data, off)
            cls = digests(h, first)
            sig, who, info = [], [], []
            for i in range(len(cls)):
                c = int(cls[i])
                if c and c not in seen:
                    if len(seen) < 200_000:     # only saves repeats; the match is the same without
                        seen.add(c)
                    for up, (s, k, fine) in enumerate(signatures(h[first[i]:first[i + 1]])):
                        owner = c - 1 + up
                        sig.append(s)
                        who.append(np.full(len(s), owner, np.uint64))
                        info.append((owner, first[i + 1] - first[i], k, fine))
            if not sig:
                continue
            sig, who, info = np.concatenate(sig), np.concatenate(who), np.array(info, INFO)
            part = (sig % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((who, part))
            sig, who, part = (sig // np.uint64(parts))[order], who[order], part[order]
            raw = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            home = (info["owner"] % np.uint64(parts)).astype(np.int64)
            rows = []
            for p in np.union1d(part, home).tolist():
                a, z = np.searchsorted(part, [p, p + 1])
                own, n = np.unique(who[a:z], return_counts=True)
                wide = len(n) and n.max() >= 1 << 16
                rows.append((p, raw[a:z].tobytes(), own.tobytes(), n.astype("<u4" if wide else "<u2").tobytes(),
                             info[home == p].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)],
                ["part", "keys", "owners", "counts", "info"])
    return run


PAIR, MANY, OWNER = 0, 1, 2       # kinds of rows that a match gives


def _matcher(few: int):
    """(kind, u, v, n): pairs of sets and the number of blocks in which they agree
    here; sets in blocks where more than ``few`` agree (v: the block); sizes and
    numbers of blocks. The task holds the packed signatures of its partition,
    which the number of partitions bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, info = [], [], []
        for b in batches:
            for p, k, o, n, x in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.zeros((len(k) // KEY_BYTES, 8), np.uint8)
                raw[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(-1, KEY_BYTES)
                keys.append(raw.view("<u8").ravel().astype(np.uint64) | (np.uint64(p) << np.uint64(40)))
                owners.append(np.repeat(np.frombuffer(o, np.uint64),
                                        np.frombuffer(n, "<u2" if 4 * len(n) == len(o) else "<u4")))
                info.append(np.frombuffer(x, INFO))
        if not keys:
            return
        key, who, info = np.concatenate(keys), np.concatenate(owners), np.unique(np.concatenate(info))
        del keys, owners
        yield _kind(OWNER, info["owner"], info["n"], info["k"] * np.int64(64) + info["fine"])
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(cut, len(key)))
        size = np.repeat(length, length)
        yield _kind(MANY, who[size > few], B.mix(key[size > few]), None)
        some = (size > 1) & (size <= few)
        key, who = key[some], who[some]
        u, v = [who[:0]], [who[:0]]
        for d in range(1, few):
            same = np.flatnonzero(key[d:] == key[:-d])
            u.append(who[same])
            v.append(who[same + d])
        u, v = np.concatenate(u), np.concatenate(v)
        _, at, n = np.unique(B.mix(u) * np.uint64(3) + v, return_index=True, return_counts=True)
        yield _kind(PAIR, u[at], v[at], n)
    return run


def _kind(kind: int, u, v, n) -> pa.RecordBatch:
    u, v = (np.ascontiguousarray(x).view(np.int64) for x in (u, v))
    n = np.zeros(len(u), np.int64) if n is None else n.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v), pa.array(n)],
                                      ["kind", "u", "v", "n"])


def _candidates(match: DataFrame) -> DataFrame:
    """Edges (u, v) between set ids that the bounds do not rule out."""
    many = match.where(F.col("kind") == MANY)
    owner = (match.where(F.col("kind") == OWNER).groupBy("u").agg(F.max("v").alias("n"), F.max("n").alias("k"))
             .join(many.groupBy("u").agg(F.count(F.lit(1)).alias("h")), "u", "left")
             .select("u", "n", (F.col("k") % 64).alias("fine"), F.coalesce("h", F.lit(0)).alias("h"),
                     (F.floor(F.col("k") / 64) - F.coalesce("h", F.lit(0))).alias("k")))
    owner = stored(owner, "owners")
    a = owner.select("u", F.col("n").alias("na"), F.col("fine").alias("fa"), F.col("k").alias("ka"))
    b = owner.select(F.col("u").alias("v"), F.col("n").alias("nb"), F.col("fine").alias("fb"), F.col("k").alias("kb"))
    differ = F.floor((F.col("na") + F.col("nb")) / 9)
    bound = F.greatest(F.lit(1), F.when(F.col("fa") <= F.col("fb"), F.col("ka") - differ),
                       F.when(F.col("fb") <= F.col("fa"), F.col("kb") - differ))
    pairs = (match.where(F.col("kind") == PAIR).groupBy("u", "v").agg(F.sum("n").alias("agree"))
             .join(a, "u").join(b, "v")
             .where((5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na"))
                    & (F.col("agree") >= bound)).select("u", "v"))
    # Without the crowded blocks too few are left - or the partner may have
    # stopped at an earlier refinement, where only its own number counts.
    needy = owner.where((4 * F.col("k") <= F.col("n")) | ((F.col("fine") > 0) & (F.col("h") > 0))).select("u")
    still = stored(many.join(needy, "u").select("u", "v"), "many")
    stars = (still.join(still.groupBy("v").agg(F.min("u").alias("m")), "v").select("u", F.col("m").alias("v")))
    return pairs.union(stars).select(F.col("u").bitwiseOR(F.lit(1)).alias("u"), F.col("v").bitwiseOR(F.lit(1)).alias("v"))


def linked(n: np.ndarray, m: int, overlap: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union, from sizes and overlap."""
    return (overlap > 0) & (5 * overlap >= 4 * (n + m - overlap))


def linked_rows(own: list[np.ndarray], left: np.ndarray | None = None) -> np.ndarray:
    """Group of each row under the links between the given sets, by accumulated
    overlap counts. Rows marked in ``left`` are multiplied with all rows and the
    others not with each other."""
    n = np.array([len(x) for x in own])
    row = np.repeat(np.arange(len(own)), n)
    col = np.unique(np.concatenate(own), return_inverse=True)[1] if len(row) else np.zeros(0, int)
    order = np.argsort(col, kind="stable")          # postings: rows by column
    postings = row[order]
    start = np.searchsorted(col[order], np.arange(col.max() + 2 if len(col) else 1))
    first = np.concatenate([[0], np.cumsum(n)])
    comp = np.arange(len(own))
    rows = np.arange(len(own)) if left is None else np.flatnonzero(left)
    for x in rows.tolist():
        # bound from the sizes: 0.8 n <= m <= n / 0.8
        other = (comp != comp[x]) & (5 * n >= 4 * n[x]) & (4 * n <= 5 * n[x])
        if not other.any():
            continue
        c = col[first[x]:first[x + 1]]
        length = start[c + 1] - start[c]
        at = np.repeat(start[c] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        overlap = np.bincount(postings[at], minlength=len(own))
        for y in np.flatnonzero(other & linked(n, int(n[x]), overlap)).tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
    return comp


MEMBER, ODD, PIVOT = 0, 1, 2      # roles of the rows of a group


def _product(t: pa.Table) -> pa.Table:
    """Links inside one group of rows (cls, role, text), as stars: u is linked
    to v directly or through others; v is a pivot where there is one."""
    data, off = text_buffers(t.column("text"))
    h, first = sets(data, off)
    cls, role = t.column("cls").to_numpy(), t.column("role").to_numpy()
    comp = linked_rows([h[a:b] for a, b in zip(first[:-1], first[1:])], role == ODD if (role == ODD).any() else None)
    order = np.lexsort((cls, role != PIVOT, comp))
    head = np.ones(len(order), bool)
    head[1:] = comp[order][1:] != comp[order][:-1]
    v = cls[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    u = cls[order]
    return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64())})


def _multiply(rows: DataFrame, *keys: str) -> DataFrame:
    """Links of every group of rows (cls, role, text) under ``keys``."""
    return rows.select(*keys, "cls", "role", "text").groupBy(*keys).applyInArrow(
        _product, "u long, v long")


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set of their class (ids may repeat)."""
    for b, data, off in slices(batches):
        d = digests(*sets(data, off)).view(np.int64)
        yield b.filter(pa.array(d == b.column(b.schema.get_field_index("cls")).to_numpy()))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls) of every row, and of every class of equal sets that
    a row with an id has (cls, low, root, component_id): its smallest id, the class
    that stands for its group, and the smallest id of the group."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = stored(own.mapInArrow(_set_rows, "doc_id long, n_shingles long, cls long"), "sets")
    own = own.where(F.col("doc_id").isNotNull())
    known = (member.where((F.col("cls") != 0) & F.col("doc_id").isNotNull())
             .groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n")))
    # 1. candidate clusters of different sets
    parts = max(6, -(-text_bytes(own) // PART_BYTES))
    packed = own.select("text").mapInArrow(
        _signature_rows(parts), "part int, keys binary, owners binary, counts binary, info binary")
    match = stored(packed.repartition(parts, "part").mapInArrow(
        _matcher(FEW), "kind int, u long, v long, n long"), "matches")
    cluster = stored(components(_candidates(match)).select(
        F.col("vertex").alias("cls"), F.col("component").alias("cluster")), "clusters")
    # 2. product inside the clusters, on one document of each set
    rep = cluster.join(known, "cls")
    blocks = (rep.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"))
              .select("cluster", "rows", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("grams") / BLOCK_GRAMS))
                      .cast("int").alias("blocks")))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("rows")) < PIVOTS)
    placed = (rep.join(blocks, "cluster").select(
        F.col("low").alias("doc_id"), "cluster", "cls", "blocks",
        F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"),
        F.when(pivot, PIVOT).otherwise(MEMBER).alias("role")))
    texts = stored(own.join(placed, "doc_id").select("cluster", "cls", "blocks", "block", "role", "text")
                   .mapInArrow(_of_class, "cluster long, cls long, blocks int, block int, role int, text string")
                   .dropDuplicates(["cls"]), "cluster-texts")
    everywhere = texts.where(F.col("role") == PIVOT).select(
        "cluster", "cls", F.col("block").alias("home"), "role", "text",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where(F.col("block") != F.col("home"))
    links = stored(_multiply(texts.select("cluster", "block", "cls", "role", "text").union(
        everywhere.select("cluster", "block", "cls", "role", "text")), "cluster", "block"), "links")
    large = texts.where(F.col("blocks") > 1)
    if not large.isEmpty():
        links = links.union(_rest(large, links))
    # 3. groups
    named = (components(links).select(F.col("vertex").alias("cls"), F.col("component").alias("root"))
             .join(known.select("cls", "low"), "cls"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    linked_to = named.join(least, "root").select("cls", "root", "component_id")
    # Stored, so that both sides of a later join by class are plain exchanges, of
    # which Spark splits the parts that hold a text with very many copies.
    return member, stored(known.join(linked_to, "cls", "left").select(
        "cls", "low", F.coalesce("root", "cls").alias("root"),
        F.coalesce("component_id", "low").alias("component_id")), "classes")


def _alone() -> Column:
    """Rows that are linked with nothing: without words, or without an id."""
    return (F.col("cls") == 0) | F.col("doc_id").isNull()


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    member, classes = _classes(docs)
    return (member.where(~_alone()).join(classes, "cls").select("doc_id", "n_shingles", "component_id")
            .union(member.where(_alone()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def _rest(large: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the rows of large clusters that are not linked to the cluster's
    main pivot (the one with most rows) with all rows of the cluster."""
    pivots = large.where(F.col("role") == PIVOT).select("cluster", F.col("cls").alias("v"))
    main = (links.join(pivots, "v").groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("cluster").agg(F.max(F.struct("n", "v")).getField("v").alias("v")))
    done = links.join(main, "v").select(F.col("u").alias("cls")).union(main.select(F.col("v").alias("cls"))).distinct()
    odd = large.join(done, "cls", "left_anti").select(
        "cluster", "cls", "blocks", "text", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int").alias("strip"))
    odd = stored(odd, "odd")
    strips = odd.select("cluster", "strip").distinct()
    return _multiply(
        odd.select("cluster", "strip", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                   "cls", F.lit(ODD).alias("role"), "text")
        .union(large.join(strips, "cluster").select("cluster", "strip", "block", "cls", F.lit(MEMBER).alias("role"), "text")),
        "cluster", "strip", "block")


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, as ``name``, the class of each row's text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in slices(batches):
            yield b.append_column(name, pa.array(digests(*sets(data, off)).view(np.int64)))

    assert docs.schema[at].name == "text"
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns: of the rows with its smallest id,
    one. Rows without an id or without words are linked with nothing and stay. Rows
    are told apart by id and text, so that a repeated id loses none of its texts."""
    member, classes = _classes(docs)
    first = classes.groupBy("root").agg(F.min(F.struct("low", "cls")).alias("w")).select("w.cls", "w.low")
    pairs = member.where(~_alone()).groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("rows"))
    kept = F.col("low").isNotNull() & (F.col("low") == F.col("doc_id"))
    marked = stored(pairs.join(first, "cls", "left").select(
        F.col("doc_id").alias(GONE_ID), F.col("cls").alias(GONE_CLASS), kept.alias("kept"), "rows")
        .where(~F.col("kept") | (F.col("rows") > 1)), "marked")
    own = _with_class(docs, CLASS)
    this = (F.col("doc_id").cast("long") == F.col(GONE_ID)) & (F.col(CLASS) == F.col(GONE_CLASS))
    out = own.join(marked.select(GONE_ID, GONE_CLASS), this, "left_anti").drop(CLASS)
    again = marked.where("kept")
    if not again.isEmpty():               # the group's first row stands there more than once
        out = out.union(own.join(again.select(GONE_ID, GONE_CLASS), this, "left_semi")
                        .dropDuplicates(["doc_id", CLASS]).drop(CLASS))
    return out
