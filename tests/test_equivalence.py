"""The single-scan plans equal the literal "one table per metric, then full
join" formulation on sparse random data (absent years, sites with only dead
trees, plots lacking species, missing DBH and SY, unknown species)."""

import random

import pytest

from quadrat.operators import natural_full_join
from quadrat.plans import sites, trees
from tests.oracle_check import rows_equal

SCHEMA = "SY int, Site string, Plot string, Species string, Mortality string, DBH_cm double"
HSCHEMA = "SY int, Site string, Plot string, Species string, Tree_Height_m double"


def _random_trees(seed: int, n: int = 400):
    rnd = random.Random(seed)
    rows, hrows = [], []
    for _ in range(n):
        sy = rnd.choice([2022, 2022, 2024, 2023, None] if rnd.random() < 0.05 else [2022, 2024])
        site = f"S{rnd.randint(0, 9)}"
        plot = f"P{rnd.randint(0, 3)}"
        sp = rnd.choice(["RHMA", "AVGE", "LARA", "UNK", None])
        mort = rnd.choice(["Alive", "Dying", "Dead", "Dead", "NA"])
        if site in ("S8",):          # a site with dead trees only
            mort = "Dead"
        dbh = None if rnd.random() < 0.1 else round(rnd.uniform(1, 40), 1)
        rows.append((sy, site, plot, sp, mort, dbh))
        if site != "S9":             # a site without heights
            hrows.append((sy, site, plot, sp, None if rnd.random() < 0.1 else rnd.uniform(1, 9)))
    return rows, hrows


def _rows(df, cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_metrics_equals_joined_tables(spark, seed):
    rows, hrows = _random_trees(seed)
    t, h = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(hrows, HSCHEMA)
    fast = trees.tree_metrics(t, h)
    slow = natural_full_join([trees.mean_basal_area(t), trees.species_contribution(t, "alive"),
                              trees.species_contribution(t, "dead"), trees.mean_tree_height(h),
                              trees.mean_stem_density(t)])
    cols = sorted(slow.columns)
    assert sorted(fast.columns) == cols
    assert rows_equal(_rows(fast, cols), _rows(slow, cols)) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_site_changes_equals_joined_tables(spark, seed):
    rows, hrows = _random_trees(seed)
    t, h = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(hrows, HSCHEMA)
    fast = sites.site_changes(t, h, 2022, 2024)
    slow = natural_full_join([trees.basal_change(t, 2022, 2024), trees.basal_change_dead(t, 2022, 2024),
                              trees.height_change(h, 2022, 2024), trees.density_change(t, 2022, 2024)])
    cols = sorted(slow.columns)
    assert sorted(fast.columns) == cols
    got, want = _rows(fast, cols), _rows(slow, cols)
    assert rows_equal(got, want) is None
    # the fixture does produce the sparse cases
    by_site = {r[cols.index("Site")]: r for r in got}
    assert by_site["S8"][cols.index("total_change")] is None


def test_canopy_wide_equals_long(spark):
    from quadrat.plans import canopy
    rnd = random.Random(5)
    cols = [f"Calc_{d}_{t}" for d in "NSEW" for t in ("Veg", "Wood", "Open")]
    rows = []
    for _ in range(300):
        vals = [rnd.choice([None, "n/a", " 12.5 ", str(round(rnd.uniform(0, 100), 2))]) for _ in cols]
        rows.append((f"I{rnd.randint(0, 1)}", f"S{rnd.randint(0, 4)}", f"P{rnd.randint(0, 3)}",
                     rnd.choice([2022, 2024]), *vals))
    d = spark.createDataFrame(rows, "Island string, Site string, Plot string, SY int, "
                                    + ", ".join(f"{c} string" for c in cols))
    long = canopy.canopy_cover(d).collect()
    wide = {(r["SY"], r["Site"]): r for r in canopy.canopy_cover_wide(d).collect()}
    assert len(long) == 3 * len(wide)
    for r in long:
        w = wide[(r["SY"], r["Site"])]
        for got, want in ((w[f"{r['Type']}_perc"], r["perc"]), (w[f"{r['Type']}_perc_SE"], r["perc_SE"])):
            assert (got is None and want is None) or got == pytest.approx(want, rel=1e-12)


def test_seedling_stats_equals_long_form(spark):
    """D6's one-aggregate form equals: counts long -> strict plot mean ->
    site mean/SE, full-joined with the two-level tallest-seedling mean."""
    from pyspark.sql import functions as F

    from quadrat.functions import mean_strict
    from quadrat.operators import natural_join, nested_mean_se
    from quadrat.plans import regeneration as R
    rnd = random.Random(11)
    rows = []
    for _ in range(400):
        cnt = lambda: None if rnd.random() < 0.03 else float(rnd.randint(0, 9))
        rows.append((rnd.choice([2022, 2024]), f"S{rnd.randint(0, 5)}", f"P{rnd.randint(0, 3)}",
                     f"Q{rnd.randint(0, 4)}", cnt(), cnt(), cnt(), cnt(), cnt(), cnt(),
                     None if rnd.random() < 0.1 else rnd.uniform(5, 90)))
    regen = spark.createDataFrame(rows, "SY int, Site string, Plot string, Quadrat string, "
                                        "RHMA_seedlings double, RHMA_saplings double, "
                                        "LARA_seedlings double, LARA_saplings double, "
                                        "AVGE_seedlings double, AVGE_saplings double, "
                                        "Tall_seedling_cm double")
    a = nested_mean_se(R.counts_long(regen, "seedlings", ("SY", "Site", "Plot")),
                       ["SY", "Site", "Stage"], ["Plot"], {"mean_plot": mean_strict("Count")},
                       {"mean_plot": ("mean_site", "count_SE")}, strict=["mean_plot"])
    b = nested_mean_se(regen, ["SY", "Site"], ["Plot"], {"height_plot": F.avg("Tall_seedling_cm")},
                       {"height_plot": ("height_site", None)})
    slow = natural_join(a, b, "full", on=["SY", "Site"])
    fast = R.seedling_site_stats(regen)
    cols = sorted(slow.columns)
    assert sorted(fast.columns) == cols
    assert rows_equal(_rows(fast, cols), _rows(slow, cols)) is None
    assert any(r["mean_site"] is None for r in fast.collect())   # N3 exercised


def test_wide_regeneration_tables_equal_the_long_form(spark):
    """D8/D9/D7 on wide rows give what the long form (a row per species first)
    gives, also for a species without a column and for missing counts."""
    from pyspark.sql import functions as F

    from quadrat.functions import std_error, sum0
    from quadrat.operators.aggregate import nested_mean_se, outer_mean_se
    from quadrat.plans import regeneration as R

    rnd = random.Random(8)
    rows = [(rnd.choice([2022, 2024, None]), f"S{rnd.randint(0, 3)}", f"P{rnd.randint(0, 2)}", f"Q{rnd.randint(0, 2)}",
             *[None if rnd.random() < 0.2 else float(rnd.randint(0, 9)) for _ in range(5)]) for _ in range(120)]
    df = spark.createDataFrame(rows, "SY int, Site string, Plot string, Quadrat string, RHMA_seedlings double, "
                                     "RHMA_saplings double, LARA_seedlings double, LARA_saplings double, AVGE_saplings double")
    q = R.counts_long(df, "saplings").groupBy("SY", "Site", "Plot", "Quadrat", "Species").agg(sum0("Count").alias("n"))
    plot = q.groupBy("SY", "Site", "Plot", "Species").agg(F.avg("n").alias("plot_dens"), std_error("n").alias("plot_dens_SE"))
    cols = ["SY", "Site", "Plot", "Species", "plot_dens", "plot_dens_SE"]
    assert rows_equal(_rows(R.sapling_plot_density(df), cols), _rows(plot, cols)) is None

    def report(site):
        got = {}
        for r in site.collect():
            got.setdefault((r["SY"], r["Site"]), {})[r["Species"]] = r
        return got

    saplings = report(outer_mean_se(plot, ["SY", "Site", "Species"], {"plot_dens": ("m", "s")}))
    seedlings = report(nested_mean_se(R.counts_long(df, "seedlings", ("SY", "Site", "Plot")), ["SY", "Site", "Species"],
                                      ["Plot"], {"p": F.avg("Count")}, {"p": ("m", "s")}))
    from quadrat.functions.text import pm_text, round_half_even
    for table, want in ((R.sapling_table(df), saplings), (R.seedling_table(df), seedlings)):
        rows = table.collect()
        assert {(r["SY"], r["Site"]) for r in rows} == set(want)
        flat = [(*k, sp, *((w[sp]["m"], w[sp]["s"]) if sp in w else (None, None))) for k, w in want.items() for sp in R.SPECIES]
        texts = {(r["SY"], r["Site"], r["sp"]): r["t"] for r in spark.createDataFrame(
            flat, "SY int, Site string, sp string, m double, s double").select(
            "SY", "Site", "sp", pm_text(round_half_even("m", 1), round_half_even("s", 1)).alias("t")).collect()}
        assert all(r[sp] == texts[r["SY"], r["Site"], sp] for r in rows for sp in R.SPECIES)
