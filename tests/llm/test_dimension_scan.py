import math

import numpy as np
import pytest

from quadrat.llm import dimension_scan as D

SCHEMA = "vec_id long, embedding array<float>, label int, list string, cid string, score string, rank string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, *"abcd")
                                  for i, v in rows], schema).repartition(4)


def exact(rows, every=50, k=5):
    """{query row: [(score, vec_id)]} by comparing all pairs."""
    good = [(i, np.float32(v).astype(float)) for i, v in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            other = [(float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), j) for m, (j, w) in enumerate(good)
                     if m != n and len(w) == len(v)]
            other.sort(key=lambda x: (-round(x[0], 12), x[1] is None, x[1] or 0))
            out.append((i, other[:k]))
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v, key=lambda x: x[0]) for q, v in out.items()}


def recall(got, want):
    found = total = 0
    for q, near in want:
        ids = {v for _, v, _ in got.get(q, [])}
        found, total = found + sum(j in ids for _, j in near), total + len(near)
        for (n, v, s), m in zip(got.get(q, []), range(1, 6)):
            assert n == m
    return found / total


def test_whole_table_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    got, want = answers(D.neighbours(e)), exact(rows)
    assert set(got) == {q for q, _ in want} and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    by = dict(rows)
    for q, near in got.items():
        a = np.float32(by[q]).astype(float)
        for _, j, s in near:
            b = np.float32(by[j]).astype(float)
            assert j != q and s == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-14)
        assert [(-round(s, 13), j) for _, j, s in near] == sorted((-round(s, 13), j) for _, j, s in near)


def test_hot_vector_ties_and_cells(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 40)
    monkeypatch.setattr(D, "ASKED", 3)
    r = np.random.default_rng(2)
    centre = r.standard_normal((6, 12))
    rows = [(i, centre[i % 6] + 0.1 * r.standard_normal(12)) for i in range(900)]
    rows += [(1000 + i, centre[0]) for i in range(300)]                       # copies
    rows += [(2000 + i, centre[1] + 1e-4 * r.standard_normal(12)) for i in range(300)]
    got, want = answers(D.neighbours(table(spark, rows))), exact(rows)
    assert set(got) == {q for q, _ in want} and recall(got, want) >= 0.9
    for q, near in want:
        if 1000 <= q < 1300:        # the copies with the smallest ids, without the query
            assert [v for _, v, _ in got[q]] == [x for x in range(1000, 1010) if x != q][:5] == [j for _, j in near]


def test_few_rows_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(3)) for i in [0, 50, 51, 52, 100, 101]]
    rows += [(150, None), (200, []), (250, [0, 0, 0]), (300, [1, None, 2]), (350, [1, math.nan, 2]), (400, [1, math.inf, 0]),
             (None, [1, 2, 3]), (450, [1, 2]), (451, [2, 1]), (500, [1, 2, 3, 4]), (52, [9, 9, 1]), (50, [1, 2, 3.5])]
    df = D.neighbours(table(spark, rows))
    want = exact(rows)
    got = [(x.query_id, x["rank"], x.vec_id, round(x.score, 12)) for x in df.collect()]
    assert sorted(got, key=str) == sorted(((q, n, j, round(s, 12)) for q, near in want
                                           for n, (s, j) in enumerate(near, 1)), key=str)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}


def test_repeated_rows_and_empty(spark):
    rows = [(0, [1, 2])] * 2 + [(3, [2, 1]), (50, [1, 2]), (7, [2, 4])]
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in D.neighbours(table(spark, rows)).collect())
    one = [(0, 1, 0), (0, 2, 7), (0, 3, 50), (0, 4, 3)]
    assert got == sorted(one * 2 + [(50, 1, 0), (50, 2, 0), (50, 3, 7), (50, 4, 3)])
    for none in ([], [(1, [1, 2])], [(0, None)], [(0, [1, 1])]):
        assert D.neighbours(table(spark, none)).count() == 0


def test_double_vectors_of_any_size(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in sorted(D.neighbours(df).collect(), key=lambda x: x["rank"])]
    assert [v for v, _ in got] == [1, 2]
    assert got[0][1] == pytest.approx(3 / math.sqrt(10)) and got[1][1] == pytest.approx(0, abs=1e-15)


def test_scan_abandons_and_keeps_the_nearest():
    r = np.random.default_rng(4)
    x = r.standard_normal((50, 128))[r.integers(0, 50, 4000)] + 0.4 * r.standard_normal((4000, 128))
    x[:40] = x[40:80] + 0.05 * r.standard_normal((40, 128))
    scan = D.Scan(D.column_blocks(x), D.column_blocks(x[:40]), 6)
    for part in np.array_split(np.arange(4000), 7):
        scan.look(np.arange(40), part)
    i, j = scan.nearest()
    s = D.unit(x[:40]) @ D.unit(x).T
    true = np.argsort(-s, axis=1)[:, :6]
    found = {(a, b) for a, b in zip(i.tolist(), j.tolist())}
    assert np.mean([(a, b) in found for a in range(40) for b in true[a].tolist()]) > 0.98
    assert scan.looked < 0.5 * 40 * x.size            # most dimensions were never read


def test_cells():
    first, many = D.cells_of(np.array([10, 5000, 3, 2048, 2000, 100, 0]))
    assert many.tolist() == [1, 3, 1, 1, 1, 1, 1]
    assert first.tolist() == [0, 1, 4, 5, 6, 7, 7]
