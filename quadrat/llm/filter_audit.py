"""Filter interaction audit: what every order of five filters removes, per part.

Spark reduces the documents to one count for each part and failure mask (at most
32 for a part, whatever the input). From these a decision diagram is built for
each part: a node tests one filter, its two branches hold the documents that pass
and that fail it, equal subdiagrams are one node, and every node carries the
counts of the documents below. Another order of the filters is reached by swapping
two neighbouring levels; adjacent transpositions visit all orders, one swap
each. Along the path on which every filter passes, the fail branch of a step is
what the step removes and the pass branch what it keeps.

Failure conditions (words: maximal runs of anything but white space, case counts):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` >
10 * code points; D any of ``#$%&*|``; E the text of any smaller doc_id.

Rows: nulls in ``text`` and ``lang`` count as empty. A row without doc_id is in no
order: it neither fails E nor makes another fail, and has no label. Repeated rows
count each; of several rows of the smallest id with one text none fails E. A
document is labelled good (toxic) if any of its label rows says so. Very long
texts are read whole. Empty tables give no rows. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80        # percent of the words
MAX_UPPER = 10           # percent of the code points
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


# ---------------------------------------------------------------- the diagram

class Diagram:
    """A count-weighted decision diagram over ``order``. Level ``len(order)`` has
    the leaves, vectors of counts; a node above is (pass, fail) and has the sum of
    both. Equal nodes of a level are one, and what holds nothing is node 0, the
    same at every level."""

    def __init__(self, order: str, masks: dict[int, tuple[int, ...]], width: int):
        self.order = list(order)
        self.zero = (0,) * width
        self.nodes: list[tuple[int, int] | None] = [None]       # 0: nothing
        self.sums: list[tuple[int, ...]] = [self.zero]
        self.unique: dict[tuple, int] = {}
        self.root = self._build(0, masks)

    def leaf(self, counts: tuple[int, ...]) -> int:
        return 0 if counts == self.zero else self._kept(("leaf", counts), None, counts)

    def node(self, passed: int, failed: int) -> int:
        if not passed and not failed:
            return 0
        both = tuple(map(sum, zip(self.sums[passed], self.sums[failed])))
        return self._kept((passed, failed), (passed, failed), both)

    def _kept(self, key: tuple, branches: tuple[int, int] | None, counts: tuple[int, ...]) -> int:
        at = self.unique.get(key)
        if at is None:
            at = self.unique[key] = len(self.nodes)
            self.nodes.append(branches)
            self.sums.append(counts)
        return at

    def _build(self, level: int, masks: dict[int, tuple[int, ...]]) -> int:
        """``masks``: failure mask (bit i: the i-th filter of the order) to counts."""
        if not masks:
            return 0
        if level == len(self.order):
            return self.leaf(masks[0])
        bit = 1 << level
        return self.node(self._build(level + 1, {m: c for m, c in masks.items() if not m & bit}),
                         self._build(level + 1, {m & ~bit: c for m, c in masks.items() if m & bit}))

    def branches(self, at: int) -> tuple[int, int]:
        return self.nodes[at] if at else (0, 0)

    def swap(self, level: int) -> None:
        """Let the filters at ``level`` and ``level + 1`` change places: the two
        middle grandchildren of every node at ``level`` change theirs. Nodes above
        are rebuilt where a branch changed, nodes below stay as they are."""
        done: dict[tuple[int, int], int] = {}

        def rebuilt(at: int, depth: int) -> int:
            if not at:
                return 0
            if (at, depth) not in done:
                passed, failed = self.branches(at)
                if depth == level:
                    (pp, pf), (fp, ff) = self.branches(passed), self.branches(failed)
                    done[at, depth] = self.node(self.node(pp, fp), self.node(pf, ff))
                else:
                    done[at, depth] = self.node(rebuilt(passed, depth + 1), rebuilt(failed, depth + 1))
            return done[at, depth]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def passing_path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) for each step of the order."""
        at = self.root
        for name in self.order:
            passed, failed = self.branches(at)
            yield name, self.sums[passed], self.sums[failed]
            at = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, visit every order of ``n`` filters
    once: the last one walks through each order of the others, to and fro."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step       # the walker stands before or after the others
        down = not down


def audit(masks: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every order of the filters; ``masks`` has for each failure mask the
    counts of documents, good ones and toxic ones."""
    n = len(filters)
    fails = {f: sum(c[0] for m, c in masks.items() if m >> i & 1) for i, f in enumerate(filters)}
    only = {f: masks.get(1 << i, (0,))[0] for i, f in enumerate(filters)}
    diagram = Diagram(filters, masks, len(MEASURES))
    swaps = adjacent_swaps(n)
    rows, total = [], dict.fromkeys(filters, 0)
    while True:
        order = "".join(diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.passing_path(), 1):
            total[f] += removed[0]
            rows.append((order, step, f, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2]))
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    return [(o, s, *counts, total[f]) for o, s, f, *counts in rows]


# ---------------------------------------------------------------- on Spark

def _words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the text's digest and the bits of A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"),
                 F.regexp_count("text", F.lit("[A-Z]")).alias("upper"),
                 F.col("text").rlike("[#$%&*|]").alias("symbol"), _words(F.col("text")).alias("words"))
    d = d.select("doc_id", "part", "digest", "chars", "upper", "symbol", F.size("words").cast("long").alias("n"),
                 F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    conditions = [F.col("n") < MIN_WORDS, F.col("distinct") * 100 < F.col("n") * MIN_DISTINCT,
                  F.col("upper").cast("long") * 100 > F.col("chars").cast("long") * MAX_UPPER, F.col("symbol")]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return d.select("doc_id", "part", "digest", mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and failure mask. Texts
    are read once and leave the scan as digests; all groups are counted before they
    are shuffled, so copies of one text, whatever their number, are few rows."""
    light = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("c"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = light.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "mask", "c", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Of each text, only rows of its smallest id pass E: their number is carried
    # along the counts, so no document is joined back to its copies.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    by_text = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("free"),
        least.alias("least"))
    cells = by_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    passed = F.col("free") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.c")).otherwise(0)
    sides = F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")),
                    F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passed).alias("n")))
    rows = cells.select("part", "good", "toxic", F.explode(sides).alias("s"))
    return rows.where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "filter_order", "step", *COUNTS]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = audit({c["mask"]: tuple(c[m] for m in MEASURES) for c in cells})
            columns = [[part] * len(rows), *map(list, zip(*rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    ship(docs.sparkSession)
    parts = mask_counts(docs, labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))      # at most 32 of a part
    return parts.mapInArrow(_audited, OUT)
