import re

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402

from quadrat.llm import pii, quality_classifier, queries, tokens  # noqa: E402

from .common import frame, linked_groups, odd_rows, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.quality_scores(docs, labels).collect() if r.predicted == 1}
    groups = linked_groups({i: t for i, t in text.items() if i in good})
    left = [i for i in good if groups[i] == i]
    plain = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    items = [set(map(tuple, np.lib.stride_tricks.sliding_window_view(np.array(plain(r.text), object), 5)))
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(plain(r.text)) >= 5]

    def leaks(t):
        w = plain(t)
        have = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        return any(len(x & have) >= 0.8 * len(x) for x in items)

    left = {i: pii.mask(text[i]) for i in left if not leaks(text[i])}
    got = P.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(left)
    enc = tokens.encoder(tokens.default_vocabulary())
    length = {i: len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == length
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert got.sequence_id.nunique() <= -(-sum(length.values()) // 2048) + 2


def test_stages_keep_the_columns(spark):
    docs = frame(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).count() >= 1


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert shingles("a b") == {("a", "b")}
