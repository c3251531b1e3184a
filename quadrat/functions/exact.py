"""Sums, means and standard errors whose bits do not depend on the order of
addition (A2-A5, A8, A10).

A distributed sum of doubles adds in the order in which partitions arrive, so its
last bits change with partitioning and retries. Here every value is rounded to a
multiple of 2^-72 and cut into five digits of 24 bits; each digit is summed as a
long, which is exact in any order (for up to 2^39 rows a group), and the digit
sums are put together once, after the aggregate. The result is the same for any
number of partitions, and all of it stays in partial and final hash aggregates.

For the sum of squares of a standard error a value is cut into a float and the
rest; the three products are exact to 2^-100 of the square and are summed down to
2^-120. The difference to the squared sum is worked out with twice the digits of a
double. Missing values are left out, as Spark's aggregates do. A group with a value
that is not finite, or over 2^42, gets Spark's own aggregate.

An aggregate here is an :class:`Exact`, an SQL expression over the sums of its input.
:func:`aggregate` puts such ones and plain columns into one grouped aggregate: the
digits are columns made before it, each once, and the expressions are worked out
after it, on one row a group.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

BITS = 24
DIGITS, SQUARE_DIGITS = 5, 7
LIMIT = 2.0 ** 42
SPLIT = float((1 << 27) + 1)


@dataclass(frozen=True)
class Exact:
    """An aggregate of one input: an expression over ``$total`` (the exact sum),
    ``$plain`` (Spark's sum), ``$n`` (values), ``$odd`` (values that the digits
    cannot hold), ``$rows``, and ``$error`` and ``$std`` for standard errors."""

    text: str
    of: ColumnOrName
    name: str = ""

    def alias(self, name: str) -> "Exact":
        return replace(self, name=name)

    def within(self, text: str) -> "Exact":
        """This aggregate in place of ``@`` in a larger expression."""
        return replace(self, text=text.replace("@", f"({self.text})"))

    def __neg__(self) -> "Exact":
        return self.within("-@")


def exact_sum(x: ColumnOrName) -> Exact:
    """Sum of the non-missing values; NULL where there is none."""
    return Exact("CASE WHEN $odd > 0 THEN $plain ELSE $total END", x)


def exact_mean(x: ColumnOrName) -> Exact:
    """Mean of the non-missing values; NULL where there is none."""
    return Exact("CASE WHEN $odd > 0 THEN $plain / $n WHEN $n > 0 THEN $total / $n END", x)


def exact_std_error(x: ColumnOrName) -> Exact:
    """Sample standard deviation of the non-missing values / sqrt(n); NULL
    for fewer than two."""
    return Exact("CASE WHEN $odd > 0 THEN $std / sqrt($n) WHEN $n > 1 THEN $error END", x)


#: For :meth:`Exact.within`: missing as soon as one value is.
COMPLETE = "CASE WHEN $n = $rows THEN @ END"


def _num(x: float) -> str:
    return f"{x!r}D"


def _rounded(x: str, count: int) -> list[str]:
    """A value rounded to each of its digits."""
    return [f"rint({x} * {_num(2.0 ** (BITS * k))})" for k in range(-1, count - 1)]


def _digits(r: list[str]) -> list[str]:
    """The digits of a value from its roundings; they add up to the last one."""
    return [r[0]] + [f"({b} - {a} * {_num(2.0 ** BITS)})" for a, b in zip(r, r[1:])]


def _placed(sums: list[str]) -> list[str]:
    """Digit sums as doubles of their place."""
    return [f"double({d}) * {_num(2.0 ** (BITS * (1 - k)))}" for k, d in enumerate(sums)]


def _total(sums: list[str]) -> str:
    """The digit sums added, the smallest first."""
    out = ""
    for t in reversed(_placed(sums)):
        out = f"({t} + {out})" if out else t
    return out


def _pair(terms: list[str]) -> str:
    """The sum of the terms as a double ``s``, and ``l``, what it leaves out."""
    error = "(acc.s - ((acc.s + t) - ((acc.s + t) - acc.s))) + (t - ((acc.s + t) - acc.s))"
    return (f"aggregate(array({', '.join(terms)}), named_struct('s', 0D, 'l', 0D), "
            f"(acc, t) -> named_struct('s', acc.s + t, 'l', acc.l + ({error})))")


def _halves(a: str) -> tuple[str, str]:
    """A double as two of at most 26 bits."""
    high = f"({_num(SPLIT)} * {a} - ({_num(SPLIT)} * {a} - {a}))"
    return high, f"({a} - {high})"


def _product_error(a: str, b: str, p: str) -> str:
    """``a * b - p`` for the rounded product p."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return f"((({ah} * {bh} - {p}) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"


# The steps to the sum of squared deviations, b - a * a / n for the pairs a (sum) and
# b (sum of squares). Written as one fold, each is worked out once, from those before.
_STEPS = {
    "p": "v.a.s * v.a.s",
    "e": _product_error("v.a.s", "v.a.s", "v.p") + " + 2D * v.a.s * v.a.l",
    "q": "v.p / v.n",
    "m": "v.q * v.n",
    "r": "((v.p - v.m) - " + _product_error("v.q", "v.n", "v.m") + " + v.e) / v.n",
    "d": "v.b.s - v.q",
    "k": "v.d - v.b.s",
    "x": "v.d + ((v.b.s - (v.d - v.k)) + (-v.q - v.k) + (v.b.l - v.r))",
}


def _error(one: list[str], two: list[str], n: str) -> str:
    steps = ", ".join(f"'{name}', CASE i WHEN {k} THEN {rule} ELSE v.{name} END"
                      for k, (name, rule) in enumerate(_STEPS.items()))
    # What is left of equal values is below the digits carried here.
    end = f"CASE WHEN v.x > v.b.s * {_num(2.0 ** -94)} THEN sqrt(v.x / (v.n - 1)) / sqrt(v.n) ELSE 0D END"
    return (f"aggregate(sequence(0, {len(_STEPS) - 1}), named_struct('a', {_pair(_placed(one))}, "
            f"'b', {_pair(_placed(two))}, 'n', double({n}), " + ", ".join(f"'{name}', 0D" for name in _STEPS)
            + f"), (v, i) -> named_struct('a', v.a, 'b', v.b, 'n', v.n, {steps}), v -> {end})")


def _ordinary(x: str) -> str:
    return f"CASE WHEN abs({x}) < {_num(LIMIT)} THEN {x} END AS {x}"


def _float(x: str) -> str:
    return f"double(float(__ordinary.{x})) AS {x}"


def _sums(x: str, squared: bool) -> dict[str, str]:
    """Aggregates that everything about an input is worked out from."""
    u, high = f"__ordinary.{x}", f"__float.{x}"
    sums = {f"{x}_sum": f"sum({x})", f"{x}_n": f"count({x})", f"{x}_odd": f"count({x}) - count({u})"}

    def digits(name: str, values: list[str], count: int) -> None:
        for k, same in enumerate(zip(*(_digits(_rounded(v, count)) for v in values))):
            sums[f"{x}{name}{k}"] = f"sum(bigint({' + '.join(same)}))"

    digits("a", [u], DIGITS)
    if squared:
        low = f"({u} - {high})"
        sums[f"{x}_std"] = f"stddev_samp({x})"
        digits("b", [f"({high} * {high})", f"(2D * {high} * {low})", f"({low} * {low})"], SQUARE_DIGITS)
    return sums


def _places(x: str, state: str, squared: bool) -> dict[str, str]:
    """What the names in an :class:`Exact` stand for, over the struct ``state``."""
    own = {"$plain": f"{state}.{x}_sum", "$n": f"{state}.{x}_n", "$odd": f"{state}.{x}_odd", "$std": f"{state}.{x}_std",
           "$rows": f"{state}.rows"}
    one = [f"{state}.{x}a{k}" for k in range(DIGITS)]
    own["$total"] = _total(one)
    if squared:
        own["$error"] = _error(one, [f"{state}.{x}b{k}" for k in range(SQUARE_DIGITS)], f"{state}.{x}_n")
    return own


def aggregate(df: DataFrame, keys: Sequence[str], *aggs: Column | Exact) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggs)`` for plain columns and exact aggregates."""
    if not any(isinstance(a, Exact) for a in aggs):
        return df.groupBy(*keys).agg(*aggs)
    inputs: dict[int | str, list] = {}
    for a in aggs:
        if isinstance(a, Exact):
            own = inputs.setdefault(a.of if isinstance(a.of, str) else id(a.of), [f"__x{len(inputs)}", a.of, False])
            own[2] |= "$error" in a.text
    made, ordinary, floats = {}, [], []
    sums: dict[str, str] = {}
    known: dict[str, dict[str, str]] = {}
    for x, of, squared in inputs.values():
        made[x] = (F.col(of) if isinstance(of, str) else of).cast("double")
        ordinary.append(_ordinary(x))
        floats += [_float(x)] if squared else []
        own = _sums(x, squared)
        sums |= own
        known[x] = _places(x, "__s", squared)
    # A struct each, so that the texts are few; Spark takes the structs apart again.
    if made:
        df = df.withColumns(made).withColumn("__ordinary", F.expr(f"struct({', '.join(ordinary)})"))
    if floats:
        df = df.withColumn("__float", F.expr(f"struct({', '.join(floats)})"))
    plain = {id(a): f"__p{i}" for i, a in enumerate(aggs) if not isinstance(a, Exact)}
    g = df.groupBy(*keys).agg(F.expr("struct(" + ", ".join(["count(1) AS rows", *(f"{e} AS {n}" for n, e in sums.items())])
                                     + ") AS __s"), *[a.alias(plain[id(a)]) for a in aggs if id(a) in plain])
    out = []
    for a in aggs:
        if isinstance(a, Exact):
            own = known[inputs[a.of if isinstance(a.of, str) else id(a.of)][0]]
            out.append(F.expr(re.sub(r"\$\w+", lambda m: own[m.group()], a.text)).alias(a.name))
        else:
            out.append(F.col(plain[id(a)]).alias(_name_of(a)))
    return g.select(*keys, *out)


def _name_of(a: Column) -> str:
    """The alias of a plain aggregate."""
    m = re.search(r" AS `?([^`' ]+)`?'>$", str(a))
    if m is None:
        raise ValueError(f"an aggregate beside exact ones needs a name: {a}")
    return m.group(1)


# ---------------------------------------------------------------- kept states

def exact_state(df: DataFrame, keys: Sequence[str], x: ColumnOrName) -> DataFrame:
    """``keys`` and ``state``: the sums of a measure that can be kept as a table and
    merged, in any order and with the same bits as if all rows had been read at once."""
    own = df.withColumn("__x", (F.col(x) if isinstance(x, str) else x).cast("double")).withColumn(
        "__ordinary", F.expr(f"struct({_ordinary('__x')})")).withColumn("__float", F.expr(f"struct({_float('__x')})"))
    sums = {"rows": "count(1)"} | {n: e for n, e in _sums("__x", True).items() if n != "__x_std"}
    return own.groupBy(*keys).agg(F.expr(f"struct({', '.join(f'{e} AS {n}' for n, e in sums.items())})").alias("state"))


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser ``keys``, or of the same keys from several tables."""
    fields = states.schema["state"].dataType.names
    return states.groupBy(*keys).agg(F.expr(f"struct({', '.join(f'sum(state.{n}) AS {n}' for n in fields)})").alias("state"))


def state_stats(states: DataFrame, keys: Sequence[str], mean: str, error: str) -> DataFrame:
    """Mean and standard error of every state. A group with values that the digits
    cannot hold has no error: it cannot be merged from sums."""
    own = _places("__x", "state", True)
    of = {mean: exact_mean("").text, error: "CASE WHEN $odd = 0 AND $n > 1 THEN $error END"}
    return states.select(*keys, *[F.expr(re.sub(r"\$\w+", lambda m: own[m.group()], t)).alias(n) for n, t in of.items()])
