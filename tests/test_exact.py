"""Exact sums, means and standard errors: bits, values, missing and odd values."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quadrat.functions.exact import COMPLETE, aggregate, exact_mean, exact_std_error, exact_sum

SF = "/root/testdata/sf0.001"


def table(seed=1):
    r, rows = random.Random(seed), []
    for g in range(30):
        scale = 10 ** r.uniform(-5, 6)
        off = r.choice([0, 0, 1, 1000, -500, 1e5]) * scale
        for _ in range(r.choice([1, 2, 3, 50, 400])):
            rows.append((g, None if r.random() < .05 else off + scale * r.gauss(0, 1) if g % 5 else off))
    return rows


def test_same_bits_for_any_partitioning(spark):
    rows = table()
    df = spark.createDataFrame(rows, "g int, x double")
    results = []
    for n in (1, 7, 200):
        got = aggregate(df.repartition(n), ["g"], exact_sum("x").alias("s"), exact_mean("x").alias("m"),
                        exact_std_error("x").alias("e"), F.count(F.lit(1)).alias("rows")).collect()
        results.append({r.g: tuple(r) for r in got})
    assert results[0] == results[1] == results[2]
    for g, (_, s, m, e, n) in results[0].items():
        x = [Fraction(v) for k, v in rows if k == g and v is not None]
        assert n == sum(k == g for k, _ in rows)
        if not x:
            assert s is None and m is None and e is None
            continue
        assert s == pytest.approx(float(sum(x)), rel=4e-16, abs=1e-17)
        assert m == pytest.approx(float(sum(x) / len(x)), rel=6e-16, abs=1e-17)
        if len(x) < 2:
            assert e is None
        else:
            mean = sum(x) / len(x)
            want = math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) / math.sqrt(len(x))
            assert e == pytest.approx(want, rel=1e-12, abs=1e-30)
            if len(set(x)) == 1:
                assert e == 0.0


def test_values_that_digits_cannot_hold(spark):
    rows = [(1, math.inf), (1, 2.0), (2, math.nan), (2, 1.0), (3, 1e300), (3, 1e300), (4, -0.1), (4, 0.1), (5, None),
            (6, 2.0 ** -80), (6, 1.0)]
    got = {r.g: r for r in aggregate(spark.createDataFrame(rows, "g int, x double"), ["g"], exact_sum("x").alias("s"),
                                     exact_mean("x").alias("m"), exact_mean("x").within(COMPLETE).alias("c"),
                                     (-exact_sum("x")).alias("minus")).collect()}
    assert got[1].s == math.inf and math.isnan(got[2].m) and got[3].s == 2e300
    assert got[4].s == 0.0 and got[5].s is None and got[5].c is None and got[6].s == 1.0
    assert got[6].minus == -1.0 and got[6].c == 0.5
    mixed = aggregate(spark.createDataFrame([(1, 2.0), (1, None)], "g int, x double"), ["g"],
                      exact_mean("x").within(COMPLETE).alias("c"), exact_mean(F.col("x") * 2).alias("m")).first()
    assert mixed.c is None and mixed.m == 4.0


def test_queries_equal_the_oracle_without_tolerance(spark):
    from quadrat.queries import QUERIES
    from duckdb_oracle import ORACLE
    from tests.oracle_check import duck
    for name in ("exact_basal_area", "exact_water_quality", "exact_water_table", "exact_tree_height_sparse"):
        got = QUERIES[name](spark, SF)
        want = duck(SF).execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({ORACLE[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_plain_aggregates_in_one_hash_aggregate(spark):
    df = spark.createDataFrame(table(), "g int, x double")
    plan = aggregate(df, ["g"], exact_sum("x").alias("s"), exact_std_error("x").alias("e"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("HashAggregate(") == 2 and plan.count("Exchange") == 1
    assert "Python" not in plan and "ObjectHash" not in plan and "Sort" not in plan


def test_states_merge_to_the_same_bits(spark, tmp_path):
    """A year added to the kept table gives what all rows at once would give; the files
    of other years are not read or written."""
    import os
    from quadrat.operators.state import kept_stats, update_state
    r = random.Random(4)
    rows = [(y, f"s{r.randrange(3)}", r.randrange(4), None if r.random() < .1 else r.gauss(10, 3) * 10 ** r.randrange(3))
            for y in (2020, 2021, 2022) for _ in range(300)]
    df = spark.createDataFrame(rows, "SY int, Site string, Plot int, h double")
    path = str(tmp_path / "state")
    files = {}
    for year in (2021, 2020, 2022):
        update_state(path, df.where(F.col("SY") == year), "SY", ["Site", "Plot"], "h")
        now = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, n in os.walk(path) for f in n if "SY=" in d}
        assert files.items() <= now.items()
        files = now
    for keys in (["Site"], ["SY", "Site"], ["Site", "Plot"]):
        whole = aggregate(df, keys, exact_mean("h").alias("m"), exact_std_error("h").alias("e"))
        got = kept_stats(spark, path, keys, "m", "e").select(*whole.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    update_state(path, df.where("SY = 2020").limit(0), "SY", ["Site", "Plot"], "h")      # nothing new
    assert kept_stats(spark, path, ["Site"], "m", "e").count() == 3
