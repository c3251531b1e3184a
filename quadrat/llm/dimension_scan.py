"""Approximate nearest neighbours by an adaptive scan over the dimensions.

Vectors of length 1 are dealt into lists by their nearest centroid, turned by one
random orthogonal matrix, and kept in blocks of columns. A query probes its nearest
lists. In each, the distance over the first columns is known for all members at
once; as the columns are turned at random, D / d times the distance over d of the D
columns estimates the whole one, and a member is abandoned as soon as that exceeds
the distance of the worst neighbour found by more than the test at d allows,
(1 + EPSILON / sqrt(d)) times. Only survivors are looked at in the next block. What
is left after the last block is scored anew on the original vectors in double
precision.

The centroids are fitted on a bounded sample (at most ``SAMPLE`` vectors and
``SAMPLE_BYTES``); every row is in the index. On the same sample the number of
lists to probe is set so that ``TARGET`` of the true neighbours of sample vectors
lie in probed lists; that share is lower in the sample than among all rows, whose
neighbours are nearer.

Spark shares the work: lists are put together or split into cells of about
``CELL`` vectors, and of a cell's queries at most about ``ASKED`` go to one task,
so that neither a list with a third of all rows nor one that all queries probe is
one task's. Equal vectors are one vector with its smallest ids: no query can have
more than k + 1 of them among its k nearest rows, so nothing is lost.

Rows: vectors that are null, empty or all zero, or hold null or non-finite
components, take no part. Vectors are compared with those of their own length. A
null vec_id is no query and stands behind all others in a tie. Of rows that share a
vec_id, each is a row of its own: a query's own row is one with its id and vector.
Of a query row that stands in the table twice, both have their answers. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, ship, stored

K = 5
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
MOST_LISTS = 1024
ROUNDS = 10              # of k-means
PROBED = 400             # sample vectors that the number of probes is set with
TARGET = 0.97
EPSILON = 2.1            # of the test: larger abandons less and errs less
BLOCK = 16               # columns, at least
CELL = 2048
ASKED = 2048
PAIRS = 1 << 18          # (query, member) pairs looked at at once
TIE = 1e-9               # squared distances this near are told apart by the exact score


# ---------------------------------------------------------------- vectors

def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. Powers of two keep very large and
    very small components in range."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -e)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and the same row of ``b``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a = np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1])
    b = np.ldexp(b, -np.frexp(np.abs(b).max(axis=1, keepdims=True))[1])
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def column_blocks(x: np.ndarray) -> list[np.ndarray]:
    """Turned unit vectors, in blocks of columns."""
    d = x.shape[1]
    width = max(BLOCK, -(-d // 16))
    y = unit(x) @ rotation(d)
    return [np.ascontiguousarray(y[:, i:i + width]) for i in range(0, d, width)]


# ---------------------------------------------------------------- the scan

class Scan:
    """Neighbours of some queries among members that are looked at list by list."""

    def __init__(self, members: list[np.ndarray], queries: list[np.ndarray], k: int):
        self.y, self.q, self.k = members, queries, k
        self.least = np.full((len(queries[0]), k), np.inf)      # squared distances of the nearest so far
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.looked = 0                                          # components read

    def _further(self, i: np.ndarray, j: np.ndarray, block: int) -> np.ndarray:
        """Squared distance of query i and member j over one block."""
        step = self.q[block][i] - self.y[block][j]
        self.looked += step.size
        return np.einsum("ij,ij->i", step, step)

    def _take(self, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        """Neighbours found, and what the tests are held against from now on."""
        order = np.lexsort((far, i))
        rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        first = order[rank < self.k]
        new = np.full_like(self.least, np.inf)
        new[i[first], rank[rank < self.k]] = far[first]
        self.least = np.sort(np.concatenate([self.least, new], axis=1), axis=1)[:, :self.k]
        self.found.append((i, j, far))

    def look(self, queries: np.ndarray, members: np.ndarray) -> None:
        """Hold some queries against one list."""
        step = max(1, PAIRS // len(members))
        for a in range(0, len(queries), step):
            self._look(queries[a:a + step], members)

    def _look(self, queries: np.ndarray, members: np.ndarray) -> None:
        total = sum(b.shape[1] for b in self.y)
        y, q = self.y[0][members], self.q[0][queries]
        part = np.maximum((q * q).sum(1)[:, None] + (y * y).sum(1) - 2 * (q @ y.T), 0)
        self.looked += part.size * y.shape[1]
        # The nearest by the first columns give the tests something to be held against.
        k = min(self.k, len(members))
        pilot = np.argpartition(part, k - 1, axis=1)[:, :k]
        i, j = np.repeat(np.arange(len(queries)), k), pilot.ravel()
        far = part[i, j]
        for block in range(1, len(self.y)):
            far = far + self._further(queries[i], members[j], block)
        self._take(queries[i], members[j], far)
        part[i, j] = np.inf
        seen = y.shape[1]
        alive = (part <= self._limit(queries, seen, total)[:, None]) & np.isfinite(part)
        i, j = np.nonzero(alive)
        far, i, j = part[i, j], queries[i], members[j]
        for block in range(1, len(self.y)):
            far = far + self._further(i, j, block)
            seen += self.y[block].shape[1]
            keep = far <= self._limit(i, seen, total)
            i, j, far = i[keep], j[keep], far[keep]
        self._take(i, j, far)

    def _limit(self, i: np.ndarray, seen: int, total: int) -> np.ndarray:
        """The largest squared distance over ``seen`` columns that passes the test."""
        slack = 1.0 if seen == total else (1 + EPSILON / np.sqrt(seen)) ** 2
        return self.least[i, -1] * slack * (seen / total) + TIE

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs of at least the k nearest found, ties included."""
        i, j, far = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, int),) * 3
        keep = far <= self.least[i, -1] + TIE
        return i[keep], j[keep]


# ---------------------------------------------------------------- the index

def fit(sample: np.ndarray, count: int, k: int = K) -> tuple[np.ndarray, int]:
    """(centroids, lists to probe) from sample vectors, for ``count`` vectors."""
    x = unit(sample)
    lists = max(1, min(MOST_LISTS, int(np.sqrt(count)), len(x) // 8))
    r = np.random.default_rng(7)
    c = x[r.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    if lists == 1:
        return c, 1
    own = (x @ c.T).argmax(1)
    asked = r.choice(len(x), min(PROBED, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = (-(x[asked] @ c.T)).argsort(1).argsort(1)            # of each list in the query's order
    needed = np.sort(place[np.arange(len(asked))[:, None], own[true]].ravel())
    return c, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def cells_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each list: large lists are split over cells
    of their own, small ones share one with their neighbours."""
    first, many = np.zeros(len(sizes), int), np.ones(len(sizes), int)
    cell, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > CELL:
            cell += held > 0
            first[i], many[i] = cell, -(-n // CELL)
            cell, held = cell + many[i], 0
        else:
            if held + n > CELL:
                cell, held = cell + 1, 0
            first[i], held = cell, held + n
    return first, many


def _vectors(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _mapped(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from make(b)

    return df.mapInArrow(run, schema)


def _valid(v: str = "embedding") -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _rows(embeddings: DataFrame, dtype: str) -> DataFrame:
    """(vec_id, cid, vec): valid vectors as bytes, and the digest that equal ones share."""
    kind = dict(embeddings.dtypes)["vec_id"]

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Adding zero makes a negative zero a plain one.
        raw = [(np.asarray(x, dtype) + np.zeros(1, dtype)).tobytes() for x in b.column(1).to_numpy(zero_copy_only=False)]
        cid = [hashlib.sha256(x).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid, pa.binary()), pa.array(raw, pa.binary())],
                                         names=["vec_id", "cid", "vec"])

    return _mapped(embeddings.where(_valid()).select("vec_id", "embedding"), make,
                   f"vec_id {kind}, cid binary, vec binary")


def _asked(every: int) -> Column:
    return F.coalesce(F.col("vec_id") % every == 0, F.lit(False))


def vector_classes(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(cid, vec, ids, asked): one row for each different vector with its k + 1
    smallest ids, and whether a query has it. The limit is applied before the
    shuffle, so a vector that a third of all rows hold is a few rows of each task."""
    asked = _asked(every)
    rank = F.row_number().over(Window.partitionBy("cid", "asked").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("asked", asked).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ident = F.struct(F.col("vec_id").isNull().alias("missing"), F.col("vec_id").alias("id"))
    return few.groupBy("cid").agg(F.first("vec").alias("vec"), F.max("asked").alias("asked"),
                                  F.slice(F.array_sort(F.collect_list(ident)), 1, k + 1).alias("ids"))


def _listed(classes: DataFrame, centroids: np.ndarray, dtype: str) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(centroids)     # bounded by SAMPLE_BYTES / 8

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = (unit(_vectors(b.column("vec"), dtype)) @ shared.value.T).argmax(1)
        yield b.append_column("list", pa.array(own.astype(np.int32)))

    return _mapped(classes, make, f"{_schema(classes)}, list int")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def _probing(index: DataFrame, centroids: np.ndarray, probes: int, sizes: np.ndarray, first: np.ndarray,
             many: np.ndarray, dtype: str, k: int) -> DataFrame:
    """(cid, vec, cell, lists): a row for each cell that has a list a query probes.
    At least so many lists are probed as hold k + 1 vectors."""
    shared = index.sparkSession.sparkContext.broadcast((centroids, sizes, first, many))

    def make(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, sizes, first, many = shared.value
        near = np.argsort(-(unit(_vectors(b.column("vec"), dtype)) @ c.T), axis=1, kind="stable")
        held = np.cumsum(sizes[near], axis=1)
        row, cell, lists = [], [], []
        for i in range(b.num_rows):
            n = max(probes, int(np.searchsorted(held[i], k + 1)) + 1)
            by_cell: dict[int, list[int]] = {}
            for x in near[i, :n].tolist():
                for part in range(many[x]):
                    by_cell.setdefault(int(first[x]) + part, []).append(x)
            row += [i] * len(by_cell)
            cell += by_cell
            lists += by_cell.values()
        taken = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column("cid").take(taken), b.column("vec").take(taken), pa.array(cell, pa.int32()),
             pa.array(lists, pa.list_(pa.int32()))], names=["cid", "vec", "cell", "lists"])

    return _mapped(index.where("asked").select("cid", "vec"), make, "cid binary, vec binary, cell int, lists array<int>")


def search_cell(members: np.ndarray, member_list: np.ndarray, queries: np.ndarray, lists: list[list[int]],
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score): at least the k nearest members of each query in the
    lists that it probes."""
    scan = Scan(column_blocks(members), column_blocks(queries), k)
    by_list: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for x in own:
            by_list.setdefault(x, []).append(i)
    order = np.argsort(member_list, kind="stable")
    for x, asking in sorted(by_list.items()):
        a, z = np.searchsorted(member_list[order], [x, x + 1])
        if z > a:
            scan.look(np.array(asking), order[a:z])
    i, j = scan.nearest()
    return i, j, cosines(queries[i], members[j])


def _neighbours(embeddings: DataFrame, dtype: str, every: int, k: int) -> DataFrame:
    """Answers for the vectors of one length."""
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)["vec_id"]
    rows = _rows(embeddings, dtype)
    classes = stored(vector_classes(rows, every, k), "vectors")
    count = classes.count()
    if not count:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                                    F.lit(0.0).alias("score"))
    width = len(classes.first()["vec"])
    many_sampled = max(1, min(SAMPLE, SAMPLE_BYTES // width))
    sample = bounded_sample(classes.select("cid", "vec"), many_sampled, "cid")
    centroids, probes = fit(np.frombuffer(b"".join(r["vec"] for r in sample), dtype).reshape(len(sample), -1), count, k)

    index = stored(_listed(classes, centroids, dtype), "index")
    sizes = np.zeros(len(centroids), int)
    for r in index.groupBy("list").count().collect():            # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    first, many = cells_of(sizes)
    probing = stored(_probing(index, centroids, probes, sizes, first, many, dtype, k), "probes")

    # A cell's members go to as many tasks as its queries need.
    deal = F.xxhash64("cid", F.lit(5))
    parts = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    places = spark.createDataFrame([(i, int(f), int(m)) for i, (f, m) in enumerate(zip(first, many))],
                                   "list int, first int, many int")
    members = index.join(F.broadcast(places), "list")            # at most MOST_LISTS rows
    members = members.withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("cid"), F.col("many"))).cast("int"))
    members = members.join(parts, "cell").select(
        "cell", "cid", "vec", "ids", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = probing.join(parts, "cell").select(
        "cell", F.col("cid").alias("asking"), "vec", "lists", F.pmod(deal, F.col("parts")).cast("int").alias("part"))
    idents = dict(members.dtypes)["ids"]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["asking", "cid", "ids", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([right.column("asking").slice(0, 0), left.column("cid").slice(0, 0),
                             left.column("ids").slice(0, 0), pa.array([], pa.float64())], names=names)
        i, j, score = search_cell(_vectors(left.column("vec"), dtype), left.column("list").to_numpy(),
                                  _vectors(right.column("vec"), dtype), right.column("lists").to_pylist(), k + 1)
        least = [(x[0]["missing"], x[0]["id"]) for x in left.column("ids").to_pylist()]
        rank = {x: n for n, x in enumerate(sorted(set(least), key=lambda x: (x[0], x[1] or 0)))}
        tie = np.array([rank[x] for x in least])
        order = np.lexsort((tie[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
        i, j = pa.array(i[keep]), pa.array(j[keep])
        return pa.table([right.column("asking").take(i), left.column("cid").take(j), left.column("ids").take(j),
                         pa.array(score[keep])], names=names)

    found = members.groupBy("cell", "part").cogroup(queries.groupBy("cell", "part")).applyInArrow(
        scan, f"asking binary, cid binary, ids {idents}, score double")
    found = found.select("asking", "score", (F.col("cid") == F.col("asking")).alias("own"),
                         F.explode("ids").alias("x")).select("asking", "score", "own", "x.*")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "missing", "id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("asking").agg(
        F.array_sort(F.collect_list(F.struct("n", "score", "own", "id"))).alias("top"))
    # Every query row leaves out one row: itself.
    asked = rows.where(_asked(every)).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("asking"))
    answers = asked.join(top, "asking").withColumn(
        "self", F.array_position(F.transform("top", lambda t: t["own"] & t["id"].eqNullSafe(F.col("query_id"))), True))
    others = F.slice(F.filter("top", lambda t, n: n + 1 != F.col("self")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "t")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").cast(kind).alias("vec_id"),
        F.col("t.score").alias("score"))


def neighbours(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest cosine found
    for every row whose vec_id is divisible by ``every``, its own row apart."""
    ship(embeddings.sparkSession)
    inner = dict(embeddings.dtypes)["embedding"]
    dtype = "<f4" if inner == "array<float>" else "<f8"
    table = embeddings.select("vec_id", "embedding" if dtype == "<f4" else F.col("embedding").cast("array<double>"))
    lengths = sorted(r["n"] for r in table.where(_valid()).groupBy(F.size("embedding").alias("n")).count().collect())
    out = None
    for n in lengths or [0]:
        own = table.where(F.size("embedding") == n) if len(lengths) != 1 else table
        own = _neighbours(own, dtype, every, k)
        out = own if out is None else out.unionByName(own)
    return out
