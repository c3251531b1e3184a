"""Property tests (hypothesis), batched: one DataFrame per example."""

from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.functions import number_text, round_half_even
from quadrat.operators import pivot_wide, share_of_total, unpivot_regex

decimals = st.tuples(st.integers(-10**9, 10**9), st.integers(0, 6)).map(
    lambda t: str(Decimal(t[0]).scaleb(-t[1])))


@settings(max_examples=6, deadline=None)
@given(st.lists(decimals, min_size=1, max_size=200), st.integers(0, 3))
def test_round_half_even_is_decimal_half_even(spark, values, digits):
    """Ties go to the even digit on the decimal value (12.25 -> 12.2,
    0.35 -> 0.4), and the printed text drops a trailing .0 (N15)."""
    df = spark.createDataFrame([(v, float(v)) for v in values], "s string, x double")
    got = df.select("s", round_half_even("x", digits).alias("r"),
                    number_text(round_half_even("x", 1)).alias("t")).collect()
    for s, r, t in got:
        want = Decimal(s).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN)
        assert Decimal(repr(r)) == want or float(want) == r, (s, digits, r, want)
        w1 = Decimal(s).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN)
        text = format(w1, "f")
        text = text[:-2] if text.endswith(".0") else text
        assert t == ("0" if text == "-0" else text), (s, t, text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(1, 50)),
                min_size=1, max_size=60))
def test_share_of_total_sums_to_one(spark, rows):
    df = spark.createDataFrame(rows, "g string, n int")
    out = share_of_total(df, ["g"], "n", "f").groupBy("g").agg(F.sum("f").alias("s")).collect()
    assert len(out) == len({g for g, _ in rows})          # NULL key is its own group
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)),
                          st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)),
                          st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))),
                min_size=1, max_size=30))
def test_unpivot_then_pivot_is_identity(spark, rows):
    cols = ["Calc_N_Veg", "Calc_N_Wood", "Calc_S_Veg"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, " + ", ".join(f"{c} double" for c in cols))
    long = unpivot_regex(df, ["id"], cols, r"Calc_([NSEW])_([A-Za-z]+)", ["Direction", "Type"])
    assert long.count() == 3 * len(rows)                  # missing values kept (N13)
    back = pivot_wide(long.withColumn("name", F.concat_ws("_", F.lit("Calc"), "Direction", "Type")),
                      ["id"], "name", cols, ["value"])
    assert sorted(tuple(r) for r in back.select("id", *cols).collect()) == \
        sorted((i, *r) for i, r in enumerate(rows))
