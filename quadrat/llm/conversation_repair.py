"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``.

A row is kept (K, 0), given another role (R, 3) or deleted (D, 4); an empty row of
the user or the assistant may be put in anywhere (I, 3). Blank and duplicate rows
must go; a truncated row that stays costs 3 more. Of the cheapest repairs the one
whose letters are ASCII-least is taken.

Cost and letters are one integer: the high digits are the cost, the low ones the
letters, of fixed width, the first letter highest and zeros after the last one. A
smaller integer is a cheaper repair or, at equal cost, an ASCII-less one, so that
the integer minimum over a DAG decides everything. Its nodes are a row and a state of
the pattern's automaton; an edge's weight has its letter at the next free place.

For long conversations the integers stay small: a block of at most ``BLOCK`` rows
gives, for each state before and after it, the least integer. All letters of a
block end with a row's own letter and hold one such letter a row, so none begins
another: their order decides that of anything put together from them, and a block
is again one digit, the rank of its letters, in the next DAG. Conversations of any
length are cut where Spark's range partitions end; parts of one conversation are
summed up in different tasks and then put together in the same way.

Spark does the rest: rows are counted per (conversation, turn, role, digest of the
text), the first turn of each text is a grouped minimum, parts are range partitions.
Texts are moved once, for the repaired rows, in order through a task that holds one
row; a conversation's digest needs its rows one after the other. The audit of
a conversation is one cell: its task holds a byte for each row, and some for each
candidate while they are compared.

Rows are ordered by turn (nulls first), then role, then the text's SHA-256; equal
rows stand together. Nulls in role and text are one space. A null conv_id is a
conversation of its own. Roles other than system, user and assistant can only be
given another role or deleted; a role counts by its first letter, an empty one has
none. Empty tables give no rows; conversations that lose all rows give an empty
repair. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_parts, ship, stored

# States of the pattern: nothing yet, after a system row, after a user row, after a pair.
START, SYSTEM, USER, PAIR = range(4)
STATES = 4
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = " DIKR"                     # digit of a letter: its place; 0 pads the end
LETTER_BITS = 3
BLOCK = 32                            # rows, or blocks, put together at once
GAP = 2                               # rows put in before one row: more is never cheapest
# Faults of a row.
SOUND, CUT, DOOMED = range(3)
#: What a row becomes: next state for a user row, for an assistant row, for a system row.
AS_USER = {START: USER, SYSTEM: USER, PAIR: USER}
AS_ASSISTANT = {USER: PAIR}
AS_SYSTEM = {START: SYSTEM}
KEEP = {"u": AS_USER, "a": AS_ASSISTANT, "s": AS_SYSTEM}
GIVEN = {**AS_USER, **AS_ASSISTANT}   # a row whose role is free: the one that the pattern wants

#: Least (cost, letters) from state to state, 16 of them; None where there is none.
Matrix = tuple
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal")


# ---------------------------------------------------------------- the DAG

@lru_cache(maxsize=10_000)
def block_matrix(rows: tuple[tuple[str, int], ...]) -> Matrix:
    """Least edits of at most ``BLOCK`` rows (initial, fault), from each state to
    each, ended by the last row's letter."""
    width = (GAP + 1) * len(rows)
    unit = 1 << LETTER_BITS * width              # one of cost
    digit = {x: i for i, x in enumerate(LETTERS)}

    def put(layer: dict, state: int, value: int, place: int, cost: int, letter: str) -> None:
        value += cost * unit + (digit[letter] << LETTER_BITS * (width - 1 - place))
        if state not in layer or value < layer[state][0]:
            layer[state] = (value, place + 1)

    out = []
    for first in range(STATES):
        layer = {first: (0, 0)}                  # state: integer, letters so far
        for initial, fault in rows:
            fresh = layer
            for _ in range(GAP):
                more: dict[int, tuple[int, int]] = {}
                for state, (value, place) in fresh.items():
                    if state in GIVEN:
                        put(more, GIVEN[state], value, place, INSERT, "I")
                layer = {s: min(x for x in (layer.get(s), more.get(s)) if x) for s in {*layer, *more}}
                fresh = more
            after: dict[int, tuple[int, int]] = {}
            extra = TRUNCATED if fault == CUT else 0
            for state, (value, place) in layer.items():
                put(after, state, value, place, DELETE, "D")
                if fault != DOOMED:
                    if state in KEEP.get(initial, ()):
                        put(after, KEEP[initial][state], value, place, extra, "K")
                    if state in GIVEN:
                        put(after, GIVEN[state], value, place, RETITLE + extra, "R")
            layer = after
        out += [_spelled(layer[last][0], width) if last in layer else None for last in range(STATES)]
    return tuple(out)


def _spelled(value: int, width: int) -> tuple[int, str]:
    """(cost, letters) of an integer."""
    letters = []
    for place in range(width):
        digit = value >> LETTER_BITS * (width - 1 - place) & (1 << LETTER_BITS) - 1
        if not digit:
            break
        letters.append(LETTERS[digit])
    return value >> LETTER_BITS * width, "".join(letters)


def chained(parts: list[Matrix]) -> Matrix:
    """One matrix for at most ``BLOCK`` consecutive ones: the same DAG, in which a
    part is a digit, the rank of its letters among the part's candidates."""
    if len(parts) == 1:
        return parts[0]
    bits = 5                                     # ranks 1 to 16
    unit = 1 << bits * len(parts)
    ranked = []
    for p in parts:
        order = {a: i + 1 for i, a in enumerate(sorted({x[1] for x in p if x is not None}))}
        ranked.append([None if x is None else (x[0], order[x[1]]) for x in p])
    out = []
    for first in range(STATES):
        layer = {first: (0, ())}                 # state: integer and the states passed
        for i, p in enumerate(ranked):
            after: dict[int, tuple[int, tuple]] = {}
            for state, (value, way) in layer.items():
                for to in range(STATES):
                    x = p[state * STATES + to]
                    if x is not None:
                        v = value + x[0] * unit + (x[1] << bits * (len(parts) - 1 - i))
                        if to not in after or v < after[to][0]:
                            after[to] = (v, (*way, state))
            layer = after
        for last in range(STATES):
            if last not in layer:
                out.append(None)
                continue
            value, way = layer[last]
            ends = (*way[1:], last)
            out.append((value // unit, "".join(p[s * STATES + t][1] for p, s, t in zip(parts, way, ends))))
    return tuple(out)


class Chain:
    """Matrices put together as they come, ``BLOCK`` at a time and level by level."""

    def __init__(self):
        self.levels: list[list[Matrix]] = []

    def add(self, m: Matrix, level: int = 0) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(m)
        if len(self.levels[level]) == BLOCK:
            full, self.levels[level] = self.levels[level], []
            self.add(chained(full), level + 1)

    def matrix(self) -> Matrix | None:
        """Of all that was added; None of nothing."""
        whole = None
        for level in self.levels:                # low levels hold what came last
            own = [*([chained(level)] if level else []), *([whole] if whole else [])]
            whole = chained(own) if own else None
        return whole


#: What the end still needs is put in; every conversation ends in one state.
_END: Matrix = tuple({(START, PAIR): (0, ""), (PAIR, PAIR): (0, ""), (USER, PAIR): (INSERT, "I"),
                      (SYSTEM, PAIR): (2 * INSERT, "II")}.get((s, t)) for s in range(STATES) for t in range(STATES))


def best(whole: Matrix | None) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    return chained([whole, _END] if whole else [_END])[START * STATES + PAIR]


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every row that stands in the repair, and (D, role,
    text) of those deleted, for the (role, text) of the rows in order."""
    state, at = START, 0

    def put_in() -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield "I", "assistant" if state == USER else "user", ""
            state, at = GIVEN[state], at + 1

    for role, text in rows:
        yield from put_in()
        letter = audit[at]
        at += 1
        if letter == "K":
            state = KEEP[role[:1]][state]
        elif letter == "R":
            role = "assistant" if state == USER else "user"
            state = GIVEN[state]
        yield letter, role, text
    yield from put_in()


# ---------------------------------------------------------------- on Spark

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): every row as its fault of the query
    leaves it; ``copies`` is 0 for a dropped one and 2 for a repeated one."""
    blank = F.lit(" ")
    c = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                             F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    c = c.withColumn("fault", F.crc32(key) % 20)
    return c.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def as_given(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for :func:`repair` without damage."""
    blank = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                                F.coalesce("text", blank).alias("text"), F.lit(1).alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _order(*before: str) -> list[Column | str]:
    """Rows of a conversation in their order."""
    return [F.col("conv_id").asc_nulls_first(), *before, F.col("turn").asc_nulls_first(), "role", "digest"]


def row_features(rows: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn, role, digest): ``copies``, blank, truncated,
    and whether the text stood in an earlier turn."""
    ended = F.rlike("text", F.lit(r"[.!?][ \x09-\x0D]*\z"))
    light = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), "copies",
                        (~F.rlike("text", F.lit(r"[^ \x09-\x0D]"))).alias("blank"), (~ended).alias("cut"))
    light = light.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # The first turn of a text: null stands before all others.
    there = F.col("copies") > 0
    firsts = light.where(there).groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("first"), F.count(F.lit(1)).alias("turns"))
    again = firsts.where(F.col("turns") > 1).select(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                                                    F.col("digest").alias("d"), "untimed", "first")
    both = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                      & (F.col("digest") == F.col("d")), "left")
    later = F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first")))
    return both.select("conv_id", "turn", "role", "digest", "copies", "blank", "cut",
                       F.coalesce(later, F.lit(False)).alias("later"))


class _Part:
    """What a task knows of the consecutive rows that it has of a conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.rows: list[tuple[str, int]] = []
        self.chain = Chain()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.initials = ["", ""]
        self.any = False

    def add(self, turn, role: str, copies: int, blank: bool, cut: bool, later: bool) -> None:
        initial = role[:1]
        if copies and turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        for copy in range(copies):
            repeat = not blank and (later or copy > 0)
            fault = DOOMED if blank or repeat else CUT if cut else SOUND
            self.blank += blank
            self.duplicate += repeat
            self.truncated += fault == CUT
            if self.any:
                self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
            else:
                self.initials[0], self.any = initial, True
            self.initials[1] = initial
            self.rows.append((initial if initial in KEEP else "", fault))
            if len(self.rows) == BLOCK:
                self._close()

    def _close(self) -> None:
        if self.rows:
            self.chain.add(block_matrix(tuple(self.rows)))
            self.rows = []

    def summary(self) -> tuple:
        self._close()
        m = self.chain.matrix()
        return (self.conv, [None if x is None else x[0] for x in m] if m else None,
                [None if x is None else x[1] for x in m] if m else None, self.blank, self.duplicate, self.truncated,
                self.illegal, self.turns, self.low, self.high, *self.initials)


_PARTS = ("costs array<long>, letters array<string>, blank long, duplicate long, truncated long, illegal long, "
          "turns long, low long, high long, head string, tail string")


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
            "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "int": pa.int32()}[kind]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[str], many: int = 2000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), _arrow(k)) for c, k in zip(zip(*held), kinds)], names=names)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == many or size > 4 << 20:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _columns(schema: str) -> tuple[list[str], list[str]]:
    pairs = [x.strip().split(" ") for x in schema.split(", ")]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, at, matrix and counts) of the rows of a conversation that a range
    partition holds; ``at`` orders the parts of a conversation."""
    features = stored(row_features(rows), "turns")
    kind = dict(features.dtypes)["conv_id"]
    schema = f"conv_id {kind}, at long, {_PARTS}"
    names, kinds = _columns(schema)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            part = None
            for b in batches:
                for conv, at, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                    if part is None or part.conv != conv:
                        if part is not None:
                            yield part.conv, place, *part.summary()[1:]
                        part, place = _Part(conv), at
                    part.add(*row)
            if part is not None:
                yield part.conv, place, *part.summary()[1:]

        return _batches(found(), names, kinds)

    dealt = features.repartitionByRange(shuffle_parts(rows.sparkSession), *_order()).sortWithinPartitions(*_order())
    return dealt.select("conv_id", F.spark_partition_id().cast("long").alias("at"), "turn", "role", "copies", "blank",
                        "cut", "later").mapInArrow(sum_up, schema)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation that has a row, dropped ones included."""
    ship(rows.sparkSession)
    parts = summaries(rows)
    kind = dict(parts.dtypes)["conv_id"]
    fields = [c for c in parts.columns if c not in ("conv_id", "at")]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", cost long, audit string"
    names, kinds = _columns(schema)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    found = sorted(b.column(1)[i].as_py(), key=lambda p: p["at"])
                    chain, last, turns, high, low, illegal = Chain(), None, 0, None, None, 0
                    for p in found:
                        if p["costs"] is not None:
                            chain.add(tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["letters"])))
                            if last is not None:
                                illegal += last + p["head"] not in ("su", "ua", "au")
                            last = p["tail"]
                        illegal += p["illegal"]
                        turns += p["turns"] - (p["low"] is not None and p["low"] == high)
                        low = p["low"] if low is None else low
                        high = high if p["high"] is None else p["high"]
                    counts = [sum(p[c] for p in found) for c in ("blank", "duplicate", "truncated")]
                    gaps = 0 if low is None else high - low + 1 - turns
                    yield b.column(0)[i].as_py(), gaps, *counts, illegal, *best(chain.matrix())

        return _batches(found(), names, kinds)

    whole = parts.groupBy("conv_id").agg(F.collect_list(F.struct("at", *fields)).alias("parts"))
    return whole.mapInArrow(put_together, schema)


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in their order, in one partition."""
    kind = dict(rows.dtypes)["turn"]
    texts = rows.where(F.col("copies") > 0).select(
        "conv_id", F.lit(1).alias("later"), "turn", "role", _digest("text").alias("digest"), "text", "copies")
    heads = found.select("conv_id", F.lit(0).alias("later"), F.lit(None).cast(kind).alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
                         F.lit(1).alias("copies"))
    return heads.union(texts).repartition(shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions(
        *_order("later")).select("conv_id", "later", "role", "text", "copies")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """(conv_id, its repaired rows) one conversation after the other; the rows of one
    are to be used up before the next is asked for."""
    def flat() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(b.column(c)[i].as_py() for c in range(5))

    source = flat()
    ahead = [next(source, None)]

    def rows_of() -> Iterator[tuple[str, str]]:
        while ahead[0] is not None and ahead[0][1]:
            _, _, role, text, copies = ahead[0]
            for _ in range(copies):
                yield role, text
            ahead[0] = next(source, None)

    while ahead[0] is not None:
        conv, _, _, audit, _ = ahead[0]
        ahead[0] = next(source, None)
        yield conv, repaired(audit, rows_of())


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), places from 0;
    deleted rows are left out. ``found`` is what :func:`audits` gives for ``rows``."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, place long, edit string, role string, text string"
    names, kinds = _columns(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for conv, edits in _walk(batches):
                place = 0
                for edit, role, text in edits:
                    if edit != "D":
                        yield conv, place, edit, role, text
                        place += 1

        return _batches(lines(), names, kinds)

    return _in_order(rows, found).mapInArrow(write, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text`` lines."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, repaired_sha256 string"
    names, kinds = _columns(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for conv, edits in _walk(batches):
                h, first = hashlib.sha256(), True
                for edit, role, text in edits:
                    if edit != "D":
                        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
                yield conv, h.hexdigest()

        return _batches(lines(), names, kinds)

    return _in_order(rows, found).mapInArrow(hashed, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``rows`` (the columns
    of :func:`damaged` or :func:`as_given`)."""
    found = stored(audits(rows), "audits")
    d = digests(rows, found)
    return found.alias("a").join(d.alias("d"), F.col("a.conv_id").eqNullSafe(F.col("d.conv_id"))).select(
        "a.*", "d.repaired_sha256")
