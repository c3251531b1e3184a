"""Hand fixtures for the NULL/arithmetic rules and small operators
(FIXTURES.md §4; worked by hand from the formulas)."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.functions import (basal_area, bin_index, bin_label, line_intersect_volume,
                               mean_strict, pm_text, round_half_even, sign_label, std_error, sum0)
from quadrat.operators import (natural_full_join, pivot_wide, period_change, recode,
                               unpivot_multi, unpivot_regex)
from quadrat.plans import debris, trees


def test_basal_area_m1(spark):
    v = spark.createDataFrame([(10.0,)], "d double").select(basal_area("d")).first()[0]
    assert v == pytest.approx(0.7853981634, rel=1e-10)


def test_std_error_a5(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", None),
                                ("b", 3.0), ("c", 5.0)], "g string, x double")
    r = {g: v for g, v in df.groupBy("g").agg(std_error("x")).collect()}
    assert r["a"] == pytest.approx(0.5773502692)
    assert r["b"] == pytest.approx(1.0)
    assert r["c"] is None


def test_sum_and_means_n1_n3(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None)],
                               "g string, x double")
    r = {g: (s, m, a) for g, s, m, a in
         df.groupBy("g").agg(sum0("x"), mean_strict("x"), F.avg("x")).collect()}
    assert r["a"][0] == 0.0                      # N1
    assert r["b"][1] is None and r["b"][2] == 1.0  # N3 vs A3


def test_isin_or_null_n8(spark):
    from quadrat.functions import isin_or_null
    df = spark.createDataFrame([("RHMA",), (None,), ("UNK",), ("NA",), ("CONE",)], "s string")
    kept = [r[0] for r in df.where(isin_or_null("s", ["RHMA", "AVGE", "LARA", "UNK"])).collect()]
    assert sorted(kept, key=str) == sorted(["RHMA", None, "UNK"], key=str)


def test_recode_m5(spark):
    df = spark.createDataFrame([("Dying",), ("Alive",), ("Dead",), (None,)], "m string")
    got = [r[0] for r in df.select(recode("m", {"Dying": "Alive"})).collect()]
    assert got == ["Alive", "Alive", "Dead", None]


def test_bins_m3(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (5.4,), (5.5,)], "x double")
    got = [r[0] for r in df.select(bin_index("x", 3.0, 2.5)).collect()]
    assert got == [None, 0, 0, 1]


def test_size_freq_d1(spark):
    t = spark.createDataFrame(
        [(2022, "S", "P", "RHMA", "Alive", 3.0), (2022, "S", "P", "RHMA", "Dying", 3.0),
         (2022, "S", "P", "RHMA", "Dead", 6.0), (2022, "S", "P", "RHMA", "Alive", 1.0)],
        "SY int, Site string, Plot string, Species string, Mortality string, DBH_cm double")
    r = {(m, b): f for m, b, f in trees.size_freq_site_year(t, "S", 3.0)
         .select("Mortality", "bin_lo", "total_freq").collect()}
    assert r == {("Alive", 2.5): 0.5, ("Dead", 5.5): 0.25, ("Alive", None): 0.25}


def test_bin_label_m4(spark):
    df = spark.range(1, 6).select(F.col("id").cast("int").alias("i"))
    got = [r[0] for r in df.select(bin_label("i", 3, 3)).orderBy("i").collect()]
    assert got == ["0-3", "3-6", "6-9", "9-12", None]


def _trees(spark, rows):
    return spark.createDataFrame(
        rows, "SY int, Site string, Plot string, Species string, Mortality string, DBH_cm double")


def test_species_contribution_d13(spark):
    # basal area of 3 RHMA units and 1 AVGE unit: DBH scaled so areas are 3:1.
    d1 = 2 * 100 * math.sqrt(0.01 * 3 / math.pi)
    d2 = 2 * 100 * math.sqrt(0.01 * 1 / math.pi)
    t = _trees(spark, [(2022, "S", "P", "RHMA", "Alive", d1), (2022, "S", "P", "AVGE", "Alive", d2)])
    r = trees.species_contribution(t, "alive").first()
    assert r["RHMA_alive"] == pytest.approx(75)
    assert r["AVGE_alive"] == pytest.approx(25)
    assert r["LARA_alive"] == 0
    # The single-scan report computes the same shares.
    m = trees.tree_metrics(t, spark.createDataFrame([], "SY int, Site string, Plot string, "
                                                        "Species string, Tree_Height_m double")).first()
    assert m["RHMA_alive"] == pytest.approx(75) and m["LARA_alive"] == 0


def test_stem_density_d14(spark):
    rows = [(2022, "S", "A", "RHMA", "Alive", 5.0)] * 4 + [(2022, "S", "B", "RHMA", "Alive", 5.0)] * 2
    r = trees.mean_stem_density(_trees(spark, rows)).first()
    assert r["mean_stem_density"] == pytest.approx(300)
    assert r["mean_stem_density_SE"] == pytest.approx(100)


def test_period_change_d16_d17(spark):
    df = spark.createDataFrame([("A", 2022, 4.0), ("A", 2024, 5.0), ("B", 2024, 5.0), ("C", 2022, 4.0)],
                               "Site string, SY int, v double")
    pct = {r["Site"]: r["p"] for r in period_change(df, ["Site"], "SY", "v", 2022, 2024, "p",
                                                    percent=True, fill_result=False).collect()}
    assert pct["A"] == pytest.approx(25) and pct["B"] is None
    chg = {r["Site"]: r["c"] for r in period_change(df, ["Site"], "SY", "v", 2022, 2024, "c").collect()}
    assert chg["C"] == -4.0 and chg["A"] == 1.0
    # change(a->b) = -change(b->a)
    back = {r["Site"]: r["c"] for r in period_change(df, ["Site"], "SY", "v", 2024, 2022, "c").collect()}
    assert all(back[k] == -v for k, v in chg.items())


def test_pivot_fill_absent_only_n11(spark):
    df = spark.createDataFrame([(2022, "S", "Veg", 40.0, None)],
                               "SY int, Site string, Type string, perc double, perc_SE double")
    r = pivot_wide(df, ["SY", "Site"], "Type", ["Veg", "Wood"], ["perc", "perc_SE"],
                   fill=0.0).first()
    assert r["Veg_perc_SE"] is None and r["Wood_perc"] == 0 and r["Wood_perc_SE"] == 0


def test_sign_label_m13(spark):
    df = spark.createDataFrame([(2.0,), (0.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(sign_label("x")).collect()] == ["pos", "neg", "neg", None]


def test_decay_recode_m6(spark):
    c = spark.createDataFrame([(2022, "S", "P", 1, k, 10.0) for k in ["I", "R, T", "I, R", "T"]],
                              "SY int, Site string, Plot string, Transect_num int, "
                              "Decay_class string, DBH_cm double")
    assert [r[0] for r in debris.decay_clean(c).select("Decay_class").collect()] == ["I", "R", "I"]
    assert debris.decay_invalid(c).count() == 1


def test_line_intersect_m18(spark):
    v = spark.range(1).select(line_intersect_volume(F.lit(0.1 * 0.1), F.lit(20.0))).first()[0]
    assert v == pytest.approx(6.168502751)
    assert v * 0.5 == pytest.approx(3.084251375)


def _wood_rows(spark, rows):
    return spark.createDataFrame(rows, "SY int, Island string, Site string, Plot string, "
                                       "Transect_num int, Transect_m double, Wood_fine_num int, "
                                       "Wood_med_num int, Wood_coarse_num int")


def test_zero_fill_transect_without_pieces_d25(spark):
    w = _wood_rows(spark, [(2022, "I", "S", "P", 1, 20.0, 0, 0, 0), (2022, "I", "S", "P", 2, 20.0, 0, 0, 1)])
    c = spark.createDataFrame([(2022, "S", "P", 2, "S", 10.0)],
                              "SY int, Site string, Plot string, Transect_num int, "
                              "Decay_class string, DBH_cm double")
    r = {x["Transect_num"]: x for x in debris.coarse_volume(w, c).collect()}
    assert r[1]["CoarseVol"] == 0 and r[1]["CoarseMass"] == 0
    assert r[2]["SVol_ha"] == pytest.approx(6.168502751) and r[2]["BMS"] == pytest.approx(3.084251375)
    t = debris.total_debris(w, c).collect()
    for x in t:   # totals equal the sum of the parts
        assert x["TotalVolume"] == pytest.approx(x["FVol"] + x["MVol"] + x["IVol_ha"]
                                                 + x["SVol_ha"] + x["RVol_ha"])


def test_pm_text_m8(spark):
    df = spark.createDataFrame([(12.0, None), (12.25, 0.5), (12345678.04, 1.0)], "m double, s double")
    got = [r[0] for r in df.select(pm_text(round_half_even("m", 1), round_half_even("s", 1))).collect()]
    assert got == ["12 ± NA", "12.2 ± 0.5", "12345678 ± 1"]


def test_rescale_m15(spark):
    from quadrat.operators import with_global_stats
    from quadrat.functions import rescale
    df = spark.createDataFrame([(10.0, 1.0, 1.0), (20.0, 3.0, 0.5)], "h double, m double, se double")
    g = with_global_stats(df, [F.min("h").alias("a"), F.max("h").alias("b"),
                               F.min("m").alias("c"), (F.max("m") + F.max("se")).alias("d")])
    got = sorted(r[0] for r in g.select(rescale("h", F.col("a"), F.col("b"), F.col("c"),
                                                 F.col("d"))).collect())
    assert got == [1.0, 4.0]


def test_null_safe_natural_join_n9(spark):
    a = spark.createDataFrame([(None, "B", 1.0)], "SY int, Site string, x double")
    b = spark.createDataFrame([(None, "B", 2.0)], "SY int, Site string, y double")
    r = natural_full_join([a, b]).collect()
    assert len(r) == 1 and r[0]["x"] == 1.0 and r[0]["y"] == 2.0


def test_unpivot_roundtrip(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, None)], "id int, Calc_N_Veg double, "
                                                      "Calc_N_Wood double, Calc_S_Veg double")
    long = unpivot_regex(df, ["id"], ["Calc_N_Veg", "Calc_N_Wood", "Calc_S_Veg"],
                         r"Calc_([NSEW])_([A-Za-z]+)", ["Direction", "Type"])
    assert long.count() == 3  # NULL kept (N13)
    wide = pivot_wide(long.withColumn("name", F.concat_ws("_", F.lit("Calc"), "Direction", "Type")),
                      ["id"], "name", ["Calc_N_Veg", "Calc_N_Wood", "Calc_S_Veg"], ["value"])
    assert wide.first().asDict() == df.first().asDict()
    m = unpivot_multi(spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "id int, MeanCoarse double, "
                                            "MeanFine double, SEMCoarse double, SEMFine double"),
                      ["id"], r"(Mean|SEM)(Coarse|Fine)", 1, "type")
    assert sorted(tuple(r) for r in m.collect()) == [(1, "Coarse", 1.0, 3.0), (1, "Fine", 2.0, 4.0)]


def test_sampled_length_m17(spark):
    from quadrat.functions import sampled_length
    df = spark.createDataFrame([(8.5,), (3.5,), (1.5,), (None,)], "L double")
    got = [tuple(r) for r in df.select(sampled_length("L", 2.0, 4.0), sampled_length("L", 2.0, 6.0)).collect()]
    assert got == [(2.0, 4.0), (1.5, 1.5), (None, None), (None, None)]


def test_read_table_conforms_and_fails_fast(spark, tmp_path):
    from quadrat.sources.catalog import read_table
    spark.createDataFrame([("2022", "A", "P1", 3.0, "x")], "SY string, Site string, Plot string, "
                          "Water_depth double, extra string").write.parquet(str(tmp_path / "ysi.parquet"))
    with pytest.raises(ValueError, match="missing column"):
        read_table(spark, str(tmp_path), "ysi")
    spark.createDataFrame([("2022", "A", "P1", "3.5")], "SY string, Site string, Plot string, "
                          "Tree_Height_m string").write.parquet(str(tmp_path / "h.parquet"))
    (tmp_path / "h.parquet").rename(tmp_path / "tree_heights.parquet")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "tree_heights")   # Species missing
    spark.createDataFrame([("2022", "A", "P1", "RHMA", "3.5"), ("x", "A", "P1", None, "n/a")],
                          "SY string, Site string, Plot string, Species string, "
                          "Tree_Height_m string").write.mode("overwrite").parquet(
        str(tmp_path / "tree_heights.parquet"))
    df = read_table(spark, str(tmp_path), "tree_heights")
    assert dict(df.dtypes)["SY"] == "int" and dict(df.dtypes)["Tree_Height_m"] == "double"
    assert sorted([tuple(r) for r in df.select("SY", "Tree_Height_m").collect()], key=str) == \
        sorted([(2022, 3.5), (None, None)], key=str)


def test_unpivot_multi_missing_combination(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id int, MeanCoarse double, MeanFine double, "
                                                     "SEMCoarse double")
    m = unpivot_multi(df, ["id"], r"(Mean|SEM)(Coarse|Fine)", 1, "type")
    assert sorted(tuple(r) for r in m.collect()) == [(1, "Coarse", 1.0, 3.0), (1, "Fine", 2.0, None)]


def test_csv_columns_matched_by_name(spark, tmp_path):
    """A sheet with reordered and extra columns reads by header name."""
    from quadrat.sources.catalog import read_table
    (tmp_path / "ysi.csv").write_text(
        "Site,SY,Plot,Extra,Water_depth,Temp,DO_mg_L,Salinity_ppt,TDS\n"
        " A ,2022,P1,x,1.5,25,6,30,n/a\n")
    r = read_table(spark, str(tmp_path), "ysi").first()
    assert (r["SY"], r["Site"], r["Water_depth"], r["TDS"], r["Extra"]) == (2022, "A", 1.5, None, "x")
