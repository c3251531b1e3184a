import random

import numpy as np
import pyarrow as pa

from quadrat.llm import bytewords as B
from quadrat.llm import decontamination as D
from quadrat.llm import substring_dedup as S
from quadrat.llm.shared import text_buffers

from .common import frame, odd_rows


def _prose(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_gear_hash_rolls():
    raw = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in raw.tolist():
        h = (2 * h + int(S.GEAR[b])) % 256
        want.append(h)
    assert S.gear_hash(raw).tolist() == want


def test_chunks_cover_texts_and_resist_shifts():
    r = random.Random(2)
    base = _prose(r, 400)
    texts = ["", base, "An insertion. " + base, base[:300] + " inserted " + base[300:], "x" * 3000, "é" * 10]
    data, off = text_buffers(pa.array(texts))
    start, end, text = S.chunks(data, off)
    for i, t in enumerate(texts):
        own = [bytes(data[a:z]) for a, z, d in zip(start, end, text) if d == i]
        assert b"".join(own) == t.encode() and all(0 < len(x) <= S.MAX_CHUNK for x in own)
    chunk = [{bytes(data[a:z]) for a, z, d in zip(start, end, text) if d == i} for i in range(4)]
    assert len(chunk[1] & chunk[2]) >= len(chunk[1]) - 3 and len(chunk[1] & chunk[3]) >= len(chunk[1]) - 5


def test_repeated_passages_are_found(spark):
    r = random.Random(7)
    rows, planted = [], {}
    for i in range(120):
        passage = _prose(r, 60)
        for k in range(2):
            doc = 1000 * k + i
            before = _prose(r, r.randint(0, 80))
            rows.append((doc, (before + " " if before else "") + passage + " " + _prose(r, r.randint(1, 80))))
            planted[doc] = (len(before) + bool(before), passage)
    rows += [(5000 + i, _prose(r, 150)) for i in range(100)] + [(6000, "a short line " * 3), (6001, "a short line " * 3)]
    got = S.repeated_passages(frame(spark, rows + odd_rows()[:5])).collect()
    hit = {}
    for x in got:
        hit.setdefault(x.doc_id, []).append((x.start, x.end, x.first_doc_id))
    assert sum(d in hit for d in planted) >= 0.95 * len(planted)
    assert not [d for d in hit if 5000 <= d < 7000]
    text = dict(rows)
    for d, spans in hit.items():
        if d in planted:
            for a, z, first in spans:
                assert text[d][a:z] in text[d - 1000 if d >= 1000 else d + 1000] and first == d % 1000


def test_repeated_phrases_and_passages_just_over_fifty_words(spark):
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(240):
        if i % 4 == 0:
            passage = " ".join(word(5) for _ in range(51))
        else:                                      # a word, a phrase or a slogan over and over
            phrase = " ".join(word(r.randint(4, 7)) for _ in range(r.randint(1, 8)))
            passage = " ".join([phrase] * (-(-70 // len(phrase.split()))))
        for k in range(2):
            rows.append((1000 * k + i, f"{_prose(r, r.randint(5, 80))} {passage} {_prose(r, r.randint(5, 80))}"))
    hit = {x.doc_id for x in S.repeated_passages(frame(spark, rows)).select("doc_id").collect()}
    assert hit == {i for i, _ in rows}


def test_substring_odd_rows(spark):
    got = S.repeated_passages(frame(spark, odd_rows())).collect()
    assert {r.doc_id for r in got} == {8, 9} and {r.first_doc_id for r in got} == {8}
    assert S.repeated_passages(frame(spark, [])).count() == 0


def _items(r, n):
    return [(i, _prose(r, r.choice([3, 8, 20, 45]), 800)) for i in range(n)]


def test_search_equals_exhaustive_scoring(monkeypatch):
    r = random.Random(3)
    items = _items(r, 60)
    ix = D.ItemIndex([i for i, _ in items], [t for _, t in items], [None] * 60)
    pairs = []
    for p in range(300):
        words = set(r.sample(range(len(ix.terms)), r.randint(0, 60)))
        if p % 3 == 0:
            t = r.choice(items)[1]
            w = B.find_words(*text_buffers(pa.array([t])), B.ALNUM).hash
            words |= set(np.searchsorted(ix.terms, w).tolist())
        pairs += [(p, t) for t in sorted(words)]
    passage, term = np.array([p for p, _ in pairs]), np.array([t for _, t in pairs])
    a, b, s = ix.search(term, passage, 300, 0.5)
    score = np.zeros((300, 60))
    np.add.at(score, passage, ix.impact[term].astype(float))
    want = {(p, i) for p, i in zip(*np.nonzero(score >= 0.5 - 1e-6))}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 60
    assert np.allclose(s, score[a, b], atol=1e-5)


def test_contaminated_pairs(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, t) for i, t in _items(r, 40)] + [(90, None), (91, ""), (3, "a repeated id for another item text here")]
    rows, want = [], set()
    for i in range(200):
        before, after = _prose(r, r.randint(0, 300), 800), _prose(r, r.randint(0, 100), 800)
        if i % 4 == 0:
            k, t = items[i // 4 % 40]
            rows.append((i, f"{before} {t.upper()}. {after}"))
            want.add((i, k))
        else:
            rows.append((i, f"{before} {after}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows + odd_rows()[:3])
    for size in (512, 16):
        monkeypatch.setattr(D, "SHARD_ITEMS", size)
        got = {(x.doc_id, x.item_id) for x in D.contaminated_pairs(docs, bench).collect()}
        short = {k for k, t in items if t and len(t.split()) < 8}
        assert want <= got and all(k in short for _, k in got - want)
    left = {x.doc_id for x in D.clean(docs, bench).select("doc_id").collect()}
    assert left == {i for i, _ in rows + odd_rows()[:3]} - {d for d, _ in got}
    assert D.clean(docs, bench).schema == docs.schema
    assert D.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert D.contaminated_pairs(frame(spark, []), bench).count() == 0
    assert D.contaminated_pairs(frame(spark, odd_rows()), bench).count() == 0


def test_question_and_answer_must_both_stand(spark):
    question, answer = "which river flows through the old capital of the north", "it is the long grey river of stones"
    bench = spark.createDataFrame([(1, question, answer)], "item_id long, text string, answer string")
    docs = frame(spark, [(1, f"x {question} {answer} y"), (2, f"x {question} y"), (3, f"{answer}"), (4, f"{question}? {answer}!")])
    assert sorted(r.doc_id for r in D.contaminated_pairs(docs, bench).collect()) == [1, 4]


def test_near_copies_of_items_without_answers(spark):
    r = random.Random(12)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(45))) for i in range(20)]
    rows, want = [], set()
    for i, t in items:
        w = t.split()
        for k, words in enumerate([w[:36] + ["other"] + w[37:], w[:8] + ["other"] + w[9:], w[:41], w[4:],
                                   w[:20] + ["other"] + w[21:30] + ["other"] + w[31:]]):
            rows.append((10 * i + k, f"{_prose(r, r.randint(0, 200))} {' '.join(words)} {_prose(r, 40)}"))
            if k < 4:                              # the last has 31 of 41 shingles
                want.add((10 * i + k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated_pairs(frame(spark, rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.answer_overlap is None and 0.8 <= x.question_overlap < 1 for x in got)
    left = D.clean(frame(spark, rows), bench).select("doc_id").collect()
    assert {x.doc_id for x in left} == {10 * i + 4 for i, _ in items}
