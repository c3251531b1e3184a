import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import packing, token_files, tokens
from quadrat.llm.shared import shared_path

from .common import frame, odd_rows, twins

ALPHABET = ["a", "Word", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "<|endoftext|>", "　", "\u0085", "\xa0", "!", "中",
            "\x1c", "'ll ", "\r\n", "🙂", "​", "\0", "½ ", " |", "...", "##", " été,"]


def _plain(enc, t):
    return enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_plain_pipeline():
    enc, r = tokens.encoder(tokens.default_vocabulary()), random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    ids, off = enc.encode_texts(texts)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == _plain(enc, t), t
    assert len(enc.encode_texts([])[0]) == 0


@pytest.mark.parametrize("value", [lambda n: n * 0, lambda n: n % 3])
def test_ids_do_not_rest_on_hashes(monkeypatch, value):
    # Only stretches of one length up to 8 bytes are sure to have different hashes.
    real = tokens.hash_spans
    monkeypatch.setattr(tokens, "hash_spans", lambda data, a, z: np.where(
        z - a > 8, value((z - a).astype(np.uint64)), real(data, a, z) % np.uint64(1 << 60)))
    monkeypatch.setattr(tokens, "RECENT", 5)
    enc, r = tokens.Encoder(tokens.default_vocabulary()), random.Random(2)
    for _ in range(4):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(60)] + list(twins())
        ids, off = enc.encode_texts(texts)
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == _plain(enc, t), t


def test_regular_texts():
    enc = tokens.encoder(tokens.default_vocabulary())
    ids, off = enc.encode_texts(list(twins()))
    assert [ids[off[i]:off[i + 1]].tolist() for i in (0, 1)] == [_plain(enc, t) for t in twins()]


def test_other_vocabulary_goes_text_by_text():
    import public_tokenizers
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.split
    ids, off = enc.encode_texts(["Some words", ""])
    assert ids[off[0]:off[1]].tolist() == _plain(enc, "Some words") and ids[off[1]:].tolist() == [0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(np.int64) - (1 << 59)
    ph = token_files.PerfectHash.build(keys)
    assert sorted(ph.lookup(keys)) == list(range(n))


def _want(rows):
    enc = tokens.encoder(tokens.default_vocabulary())
    return [(i, np.array(_plain(enc, t), "<u4")) for i, t in rows]


def test_shards_round_trip(spark, monkeypatch):
    rows = odd_rows()
    got = token_files.round_trip(frame(spark, rows)).collect()
    want = _want(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == sorted(
        (i is not None, i or 0, zlib.crc32(x.tobytes()), len(x)) for i, x in want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    keys = [r.doc_id for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert token_files.round_trip(frame(spark, [])).count() == 0


def test_keyed_access(spark):
    rows = [(i * 7 % 1009, f"text number {i} " * (i % 5)) for i in range(400)]
    path = shared_path(spark, "shards")
    token_files.write_shards(frame(spark, rows), path)
    want = {i: x.tolist() for i, x in _want(rows)}
    shards = [token_files.Shard(bytes(r.content)) for r in token_files.read_shards(spark, path).collect()]
    found = {}
    for s in shards:
        for key in [*want, 5000, -3]:
            for ids in s.get(key):
                found.setdefault(key, []).append(ids.tolist())
    assert {k: v[0] for k, v in found.items()} == want and all(len(v) == 1 for v in found.values())


def test_parts_ascend_and_split_a_hot_key():
    cuts = np.array([3, 7, 7, 7, 9])
    key = pa.array([0, 3, 4, None, 7, 7, 7, 7, 8, 9, 10], pa.int64())
    got = token_files.parts_of(key, cuts)
    assert got[[0, 1, 2, 3, 8, 9, 10]].tolist() == [0, 0, 1, 0, 4, 4, 5]
    assert set(got[4:8].tolist()) == {1, 2, 3}


def test_hash_is_built_fast():
    keys = np.arange(80_000) * 977 + 5
    began = time.process_time()
    ph = token_files.PerfectHash.build(keys)
    assert time.process_time() - began < 4 and sorted(ph.lookup(keys)) == list(range(len(keys)))


def test_lookup_opens_the_shards_concerned(spark, monkeypatch):
    rows = [(i * 3, f"text number {i} " * (i % 40)) for i in range(600)] + [(900, f"again {i}") for i in range(200)]
    path = shared_path(spark, "shards")
    monkeypatch.setattr(token_files, "SHARD_IDS", 300)
    token_files.write_shards(frame(spark, rows + [(None, "no key")]), path)
    token_files.write_manifest(spark, path)
    files = token_files.read_shards(spark, path).count()
    want = _want(rows)
    asked = [0, 3, 4, 900, 1797, -5, 10_000, None]
    keys = spark.createDataFrame([(k,) for k in asked + asked], "k int")
    got = token_files.lookup(spark, path, keys).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted(
        (i, x.astype("<u2").tobytes()) for i, x in want if i in asked)
    opened = token_files.shards_of(spark, path, keys.where("k < 10")).select("path").distinct().count()
    assert files > 20 and 1 <= opened <= 2
    assert token_files.lookup(spark, path, keys.where("k = 4")).count() == 0
    assert token_files.lookup(spark, path, keys.limit(0)).count() == 0


def _check(rows, pieces, size):
    want = {i: x for i, x in _want(rows)}
    for i, x in want.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        assert b"".join(p.ids for p in own) == x.tobytes()
        assert all(p.length == size for p in own[1:]) and own[0].length == len(x) - size * (len(own) - 1)
        assert [p.start for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])])[:-1].tolist()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])])[:-1].tolist()
        assert sum(p.length for p in own) <= size
    return by


def test_packing(spark):
    rows = [(i, "some words and more " * (i * i % 90)) for i in range(300)] + [(300, None), (301, "")]
    pieces = packing.token_pieces(frame(spark, rows), size=128)
    packed = packing.assign(pieces, tokens_max=128).collect()
    by = _check(rows, packed, 128)
    assert len(by) <= 1.02 * sum(p.length for p in packed) / 128 + 1
    again = {r.sequence_id: r.ids for r in packing.sequences(packing.assign(pieces, tokens_max=128)).collect()}
    assert sum(map(len, again.values())) == 4 * sum(p.length for p in packed)


def test_packing_odd_rows(spark):
    got = packing.assign(packing.token_pieces(frame(spark, odd_rows()))).collect()
    assert {r.doc_id for r in got} == {i for i, _ in odd_rows()}
    assert sum(r.length for r in got) == sum(len(x) for _, x in _want(odd_rows()))
    assert packing.assign(packing.token_pieces(frame(spark, []))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    r = np.random.default_rng(2)
    length = r.integers(1, 100, 500)
    seq, off = packing.pack(length, 100, 4, 5000, rule)
    for s in np.unique(seq):
        own = length[seq == s]
        assert own.sum() <= 100 and len(own) <= 4
        assert (own ** 2).sum() <= 5000 or len(own) == 1
    a, _ = packing.pack(length, 100, rule=rule)
    assert len(np.unique(a)) <= len(np.unique(seq))
    assert len(packing.pack(np.zeros(0, int))[0]) == 0
