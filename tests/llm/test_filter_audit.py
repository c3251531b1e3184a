import itertools
import random
import re
from collections import Counter

import pytest

from quadrat.llm import filter_audit as A

from .common import corpus, frame, odd_rows

LABELS = "doc_id long, quality int, toxic int, n string"


def brute(rows, labels):
    """Every document through every order. rows: (doc_id, text, part)."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        mine = [x for x in labels if i is not None and x[0] == i]
        fails.append((part or "", {k for k in f if f[k]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                total[k] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def answers(df):
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in A.COUNTS] for r in got}
    assert len(out) == len(got)
    return out


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for i in A.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        swaps = len(list(A.adjacent_swaps(n)))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == swaps + 1


@pytest.mark.parametrize("seed", range(4))
def test_diagram_keeps_its_function(seed):
    r = random.Random(seed)
    masks = {m: (r.randint(1, 3), r.randint(0, 1), 0) for m in range(32) if r.random() < 0.6}
    d = A.Diagram("ABCDE", masks, 3)
    total = tuple(map(sum, zip(*masks.values())))
    for i in A.adjacent_swaps(5):
        d.swap(i)
        assert d.sums[d.root] == total
        for m in range(32):
            at = d.root
            for name in d.order:
                at = d.branches(at)[m >> "ABCDE".index(name) & 1]
            assert d.sums[at] == masks.get(m, (0, 0, 0))
    assert d.order == list("BACDE") or sorted(d.order) == list("ABCDE")


def test_equals_brute_force(spark):
    r = random.Random(5)
    texts = list(corpus(3, 120).values())
    rows = [(i, r.choice(["", "# ", "A&B "]) + t, r.choice(["en", "de", None])) for i, t in enumerate(texts)]
    rows += [(1000 + i, (t.upper() if r.random() < .3 else t) + " word" * r.choice([0, 300]), "fr")
             for i, (_, t, _) in enumerate(rows[:40])]
    rows += [(i, t, "en") for i, t in odd_rows()] + [(2000, rows[0][1], "en"), (None, rows[0][1], "en"), (-5, "", None)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1), "x") for i in range(0, 1040, 2)] + [(4, 1, 0, "x"), (4, 0, None, "x"),
                                                                                    (None, 1, 1, "x")]
    docs = spark.createDataFrame([(*x, "x", "y", "z") for x in rows],
                                 "doc_id long, text string, lang string, mask string, part string, words string")
    got = answers(A.filter_audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)


def test_clashing_columns_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.filter_audit(frame(spark, []), none).count() == 0
    got = answers(A.filter_audit(frame(spark, odd_rows()), none))
    assert got == brute([(i, t, "en") for i, t in odd_rows()], [])
