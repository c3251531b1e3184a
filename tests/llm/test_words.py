import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.llm import bytewords as B
from quadrat.llm.shared import text_buffers
import pyarrow as pa

from .common import twins

TEXT = st.text(alphabet=list("ab1 .\n\té中\x0b-"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_of_many_texts(texts):
    data, off = text_buffers(pa.array(texts, pa.string()))
    for table, pattern in ((B.SPACED, rb"[^\x20\x09-\x0D]+"), (B.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                           (B.LINES, rb"[^\n]+")):
        w = B.find_words(data, off, table)
        want = [(i, m) for i, t in enumerate(texts) for m in re.findall(pattern, t.encode())]
        assert [(int(d), bytes(data[a:z])) for d, a, z in zip(w.doc, w.start, w.end)] == want
        names = {}
        for (_, m), h in zip(want, w.hash):
            assert names.setdefault(m, h) == h == B.word_hash(m)
        for short in (False, True):
            h, doc, at = B.windows(w, 3, short)
            got = {}
            for x, d, a in zip(h, doc, at):
                end = min(a + 3, int(w.first[d + 1]))
                assert got.setdefault(tuple(m for _, m in want[a:end]), x) == x
            assert len(set(got.values())) == len(got)


def test_long_spans_hash_alike():
    raw = np.frombuffer(b"x" * 3_000_000 + b" y", np.uint8)
    w = B.find_words(raw, np.array([0, len(raw)]), B.SPACED)
    assert len(w.hash) == 2 and w.hash[0] == B.word_hash(b"x" * 3_000_000) and w.hash[1] == B.word_hash("y")


def test_regular_words_and_parts_of_texts():
    a, b = twins()
    assert B.word_hash(a) != B.word_hash(b) and B.word_hash(a[:1024]) != B.word_hash(b[:1024])
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 200_000, dtype=np.uint8)
    end = np.cumsum(r.choice([0, 1, 7, 8, 9, 63, 64, 65, 511, 512, 513, 5000, 40_000], 60))
    end = end[end <= len(data)]
    start = np.concatenate([[0], end[:-1]])
    got = B.hash_spans(data, start, end)
    for x, a, z in zip(got, start, end):           # alike, whatever else is hashed
        assert x == B.hash_spans(data[a:z], np.array([0]), np.array([z - a]))[0]
    pairs = {data[a:z].tobytes(): x for x, a, z in zip(got, start, end)}
    assert len(set(pairs.values())) == len(pairs)


def test_same_bytes():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"abcabd", b"xxabc"))
    got = B.same_bytes(a, np.array([0, 3, 5, 0]), b, np.array([2, 2, 0, 0]), np.array([3, 3, 0, 1]))
    assert got.tolist() == [True, False, True, False]
