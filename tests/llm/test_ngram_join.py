import random

import numpy as np
import pytest

from quadrat.llm import ngram_join as N
from quadrat.llm.components import components

from .common import corpus, frame, linked_groups, odd_rows, shingles, twins


def _answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block_rows, few", [(512, 16), (3, 16), (4, 2)])
def test_equals_all_pairs(spark, monkeypatch, block_rows, few):
    monkeypatch.setattr(N, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(N, "FEW", few)
    texts = corpus(2)
    got = _answers(N.ngram_join(frame(spark, texts.items())))
    want = linked_groups(texts)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in texts.items()}


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(4)
    for _ in range(1500):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        n = len(x)
        drop = int(r.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([r.choice(x, n - drop, replace=False),
                                      r.integers(0, 1 << 63, int(r.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 5 * both >= 4 * (n + len(y) - both):
            a, b = (np.concatenate([s for s, _, _ in N.signatures(z)]) for z in (x, y))
            assert len(np.intersect1d(a, b)), (n, len(y), both)


def test_odd_rows(spark):
    got = N.ngram_join(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[4] == [(1, 4)] and by[7] == [(2, 6)] and {c for _, c in by[6]} == {6}
    assert by[None] == [(3, None)] and by[9][0][1] == 8 and by[8][0][1] == 8


def test_empty_and_keep_first(spark):
    assert N.ngram_join(frame(spark, [])).count() == 0
    df = frame(spark, odd_rows())
    kept = N.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 7 not in ids and 9 not in ids and {1, 2, 3, 4, 5, 6, 8, None} <= set(ids)


def test_repeated_ids(spark):
    """Ids that repeat with equal, near and unrelated texts, against all pairs of rows."""
    r = random.Random(9)
    texts = list(corpus(6, 90).values())
    rows = [(r.randrange(40), r.choice(texts)) for _ in range(150)] + [(None, texts[0]), (None, texts[0]), (3, ""), (3, None)]
    groups = linked_groups(dict(enumerate(t if i is not None else "" for i, t in rows)))
    low = {}
    for n, (i, t) in enumerate(rows):
        if i is not None:
            low[groups[n]] = min(i, low.get(groups[n], i))
    want = sorted((i, len(shingles(t)), i if i is None or not shingles(t) else low[groups[n]])
                  for n, (i, t) in enumerate(rows) if i is not None)
    got = [tuple(x) for x in N.ngram_join(frame(spark, rows)).collect()]
    assert sorted(x for x in got if x[0] is not None) == want and sum(x[0] is None for x in got) == 2

    kept = [(x.doc_id, x.text) for x in N.keep_first(frame(spark, rows)).collect()]
    assert sorted(map(str, (x for x in kept if x[0] is None or not shingles(x[1])))) == sorted(
        map(str, (x for x in rows if x[0] is None or not shingles(x[1]))))
    left = [x for x in kept if x[0] is not None and shingles(x[1])]
    at = {}
    for n, (i, t) in enumerate(rows):
        if i is not None and shingles(t):
            at.setdefault(groups[n], []).append((i, t))
    assert len(left) == len(at)
    for members in at.values():
        mine = [x for x in left if x in members]
        assert len(mine) == 1 and mine[0][0] == min(i for i, _ in members)


def test_nothing_is_lost_to_a_repeated_id(spark):
    a, b, c = ("one text of its own here", "another text that two rows have", "a third text which stands twice")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c)]
    kept = sorted((x.doc_id, x.text) for x in N.keep_first(frame(spark, rows)).collect())
    assert kept == [(3, b), (5, a), (7, c)]


def test_regular_words_are_told_apart(spark):
    got = _answers(N.ngram_join(frame(spark, enumerate(twins()))))
    assert got == {0: (1, 0), 1: (1, 1)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {v: v for e in edges if e[0] != e[1] for v in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
