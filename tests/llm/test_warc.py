import hashlib
import random

import pytest

from quadrat.llm import warc as W
from quadrat.llm.shared import shared_path


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        x = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert W.unchunked(W.chunked(x)) == x
        assert W.http_payload(W.HTTP + W.chunked(x, 100)) == x
    assert W.unchunked(b"3;name=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert W.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3"):
        with pytest.raises(ValueError):
            W.unchunked(bad)


def test_segments():
    x = b"0123456789" * 1000
    digest = hashlib.sha256(x).hexdigest()
    raw = b"".join(r + b"\r\n\r\n" for r in W.page_records("urn:a", 1, "http://x", x, digest, None, 777))
    got = list(W.parse(raw))
    assert len(got) == -(-len(W.HTTP + W.chunked(x)) // 777) and got[0][0]["warc-type"] == "response"
    assert {f["warc-type"] for f, _ in got[1:]} == {"continuation"}
    blocks, numbers = [b for _, b in got], list(range(1, len(got) + 1))
    total = int(got[-1][0]["warc-segment-total-length"])
    assert W.http_payload(W._check_segments(numbers, blocks, total)) == x
    for n, b, t in ((numbers[:-1], blocks[:-1], total), (numbers[1:], blocks[1:], total), (numbers, blocks, total + 1),
                    (numbers, blocks, None), ([1, 1, *numbers[2:]], blocks, total)):
        with pytest.raises(ValueError):
            W._check_segments(n, b, t)
    with pytest.raises(ValueError):
        list(W.parse(raw[:-5]))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_RECORDS", 7)
    r = random.Random(4)
    long = "".join(r.choice("abc é\r\n<>") for _ in range(60_000))
    rows = [(i, f"http://h/{i % 3} \r\nX: y", r.choice(["<p>é</p>", "y" * 150, "z" * 99, None, "", long, "WARC/1.1\r\n\r\n" * 40]))
            for i in range(60)] + [(5, "again", "y" * 150), (5, "again", "y" * 150), (None, None, "y" * 150), (None, "u", "w" * 200), (70, None, long)]
    got = W.round_trip(_pages(spark, rows)).collect()
    want = []
    first = {}
    for i, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        x = (h or "").encode()
        again = len(x) >= 100 and x in first
        want.append((i, len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", first[x] if again else None))
        first.setdefault(x, i)
    key = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    assert sorted(map(key, (tuple(x) for x in got))) == sorted(map(key, want))
    assert W.round_trip(_pages(spark, [])).count() == 0


def test_records_carry_payloads(spark):
    path = shared_path(spark, "warc")
    W.write_archives(_pages(spark, [(1, "http://a b", "x" * 50_000), (2, "http://b", "x" * 50_000), (3, "c", "short")]), path)
    got = {r.page_id: r for r in W.read_archives(spark, path).collect()}
    assert bytes(got[1].payload) == b"x" * 50_000 and got[1].url == "http://a%20b"
    assert got[2].payload is None and got[2].refers_to_id == got[1].record_id and bytes(got[3].payload) == b"short"


def test_equals_sql(spark):
    """The registered query against DuckDB SQL."""
    from quadrat.llm.queries import ORACLE, QUERIES
    from tests.oracle_check import duck
    sf = "/root/testdata/sf0.001"
    rel = duck(sf).execute(ORACLE["op1_warc"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in QUERIES["op1_warc"](spark, sf).collect())
    assert got == want
