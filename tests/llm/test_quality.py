import random
import re

import numpy as np

from quadrat.llm import quality_classifier as C
from quadrat.llm import quality_rules as R

from .common import frame, odd_rows, twins

SF = "/root/testdata/sf0.01"


def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_rule_counts(spark):
    r = random.Random(2)
    parts = ["a", "b", "é", "c*", "|", "\n", " ", "word", "\t", "a b c", "same line\n"]
    rows = odd_rows() + [(100 + i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 90))))
                         for i in range(200)]
    got = R.rule_statistics(frame(spark, rows)).collect()
    key = lambda i, c: (i is not None, i or 0, *c)
    assert sorted(key(x.doc_id, [x[c] for c in R.COUNTS]) for x in got) == sorted(key(i, _counts(t)) for i, t in rows)
    for x in got:
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)


def test_forest_and_threshold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = R.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    own = got[~got.base_failed]
    assert own[own.quality == 1].kept.mean() >= 0.99 and own[own.quality == 0].kept.mean() < 0.6
    assert not got[got.base_failed].kept.any()
    assert own[own.quality == 0].anomaly.mean() > own[own.quality == 1].anomaly.mean()


def test_forest_scores_outliers_high():
    x = np.random.default_rng(1).normal(0, 1, (2000, 3))
    x[0] = 12
    s = R.Forest(x).score(x)
    assert s[0] > np.quantile(s, 0.995)
    assert (R.Forest(np.zeros((0, 3))).score(x) == 0).all()
    assert np.isfinite(R.Forest(np.ones((5, 3))).score(x)).all()


def test_rules_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (8, None, 0), (6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = odd_rows()
    assert R.quality_rules(frame(spark, rows), labels).count() == len(rows)
    assert R.quality_rules(frame(spark, []), labels).count() == 0
    got = R.quality_rules(frame(spark, rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_classifier_held_out_accuracy(spark):
    import zlib
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = C.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held.score.between(0, 1).all() and (held.predicted == (held.score >= 0.5)).all()


def test_classifier_learns_nothing_from_held_out_rows(spark):
    from pyspark.sql import functions as F
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = C.quality_scores(docs, labels).toPandas().set_index("doc_id").score
    b = C.quality_scores(docs, turned).toPandas().set_index("doc_id").score
    assert np.allclose(a.sort_index(), b.sort_index())


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (8, None, 0), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = odd_rows()
    got = C.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert C.quality_scores(frame(spark, []), labels).count() == 0
    assert {r.score for r in C.quality_scores(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    df = frame(spark, rows)
    kept = C.keep_good(df, labels.limit(0))
    assert kept.schema == df.schema and kept.count() == len(rows)


def test_regular_lines_are_told_apart(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "\n".join(twins())), (2, "\n".join([twins()[0]] * 2))]
    got = {r.doc_id: r.n_dup_lines for r in R.quality_rules(frame(spark, rows), labels).collect()}
    assert got == {1: 0, 2: 1}
