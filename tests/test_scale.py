"""Plan shape and skew behaviour: the properties that matter at cluster scale."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrat.operators import box_summary, exact_quantiles
from quadrat.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_in_plans(spark, key):
    """Every registered query stays on the JVM (no Python/Pandas UDF nodes)."""
    p = _plan(QUERIES[key](spark, SF))
    assert "EvalPython" not in p and "InPandas" not in p and "PythonUDF" not in p


def test_scan_prunes_columns(spark):
    """Only the columns a query uses are read from lineitem."""
    s = _plan(QUERIES["mean_basal_area"](spark, SF))
    scan = [ln for ln in s.splitlines() if "FileScan" in ln and "lineitem" in ln][0]
    assert "l_quantity" in scan and "l_shipdate" in scan
    assert "l_extendedprice" not in scan and "l_tax" not in scan and "l_discount" not in scan


def test_box_summary_matches_percentile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 10]] +
                               [("b", float(x)) for x in range(1, 101)] + [("b", 1000.0)],
                               "g string, v double")
    q = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"q1": .25, "q2": .5, "q3": .75}).collect()}
    assert (q["a"]["q1"], q["a"]["q2"], q["a"]["q3"]) == (1.75, 2.5, 4.75)
    ref = {r[0]: r[1] for r in df.groupBy("g").agg(
        F.percentile("v", [0.25, 0.5, 0.75])).collect()}
    assert [q["b"]["q1"], q["b"]["q2"], q["b"]["q3"]] == pytest.approx(ref["b"])
    b = {r["g"]: r for r in box_summary(df, ["g"], "v").collect()}["b"]
    assert b["n_outliers"] == 1 and b["ymax"] == 100.0 and b["ymin"] == 1.0


def test_box_summary_hot_group_and_ties(spark):
    """One group with most rows (many tied values) still gives exact results."""
    rows = [("hot", 0.0)] * 3000 + [("hot", float(i)) for i in range(1000)] + \
           [(f"g{i % 50}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"q1": .25, "q2": .5, "q3": .75},
                                              num_partitions=16).collect()}
    ref = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75])).collect()}
    assert set(got) == set(ref)
    for g, qs in ref.items():
        assert [got[g]["q1"], got[g]["q2"], got[g]["q3"]] == pytest.approx(qs)


def test_box_summary_without_skew_join_and_with_any_partitions(spark):
    """The hot group needs no skew handling of joins, and the number of ranges
    changes nothing (row key as tie-break; NULL groups are groups)."""
    rows = [("hot", None, float(i % 7), i) for i in range(4000)] + \
           [(f"g{i % 20}" if i % 3 else None, i % 2, float(i * 37 % 101), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v double, id int")
    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        got = [sorted(map(str, box_summary(df, ["g", "k"], "v", num_partitions=n, row_key=["id"]).collect()))
               for n in (1, 5, 16)]
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)
    assert got[0] == got[1] == got[2]
    ref = df.groupBy("g", "k").agg(F.count("v").alias("n"), F.percentile("v", [0.25, 0.5, 0.75]).alias("q")).collect()
    box = {(r["g"], r["k"]): r for r in box_summary(df, ["g", "k"], "v", row_key=["id"]).collect()}
    assert len(box) == len(ref)
    for r in ref:
        b = box[r["g"], r["k"]]
        assert b["n"] == r["n"] and [b["lower"], b["middle"], b["upper"]] == pytest.approx(r["q"])


def test_values_are_shuffled_on_group_and_range_only(spark):
    """No exchange of values on the bare group key or on a position."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(box_summary(df, ["g"], "v"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", p)
    raw = [ln for ln in p.splitlines() if "hashpartitioning" in ln and "__pid" in ln]
    assert raw and not any("__pos" in k for k in keys)


def test_share_of_total_sums_to_one(spark):
    h = QUERIES["size_freq_site_year"](spark, SF)
    sums = h.groupBy("SY", "Site").agg(F.sum("total_freq").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)


def test_species_contribution_sums_to_100(spark):
    d = QUERIES["species_contribution_alive"](spark, SF)
    for r in d.collect():
        vals = [r["RHMA_alive"], r["AVGE_alive"], r["LARA_alive"]]
        assert all(v is None for v in vals) or abs(sum(vals) - 100) < 1e-9


def test_report_run_writes_every_dataset(spark, tmp_path):
    """One call writes every report dataset; per-site output is one
    partitioned write."""
    import os
    from quadrat.plans.report import export_report
    from quadrat.sources.roles import DriverRoles
    r = DriverRoles(spark, SF)
    tables = {"tree_measurements": r.trees, "tree_heights": r.heights, "coordinates": r.coordinates,
              "densiometer": r.densiometer, "regeneration": r.regeneration, "sapling": r.sapling,
              "ysi": r.ysi, "wood": r.wood, "coarse_wood": r.coarse_wood}
    paths = export_report(tables, str(tmp_path), start=1996, end=1998)
    from quadrat.plans.report import NEEDS
    assert sorted(paths) == sorted(NEEDS)
    site_dirs = [d for d in os.listdir(paths["site_size_frequency"]) if d.startswith("Site=")]
    assert len(site_dirs) == r.trees.select("Site").distinct().count()
    back = spark.read.parquet(paths["tree_measurements_table"])
    assert back.count() == QUERIES["tree_measurement_table"](spark, SF).count()


def test_report_run_with_checkpointed_inputs(spark, tmp_path):
    from quadrat.plans.report import export_report
    from quadrat.sources.roles import DriverRoles
    r = DriverRoles(spark, SF)
    paths = export_report({"wood": r.wood, "coarse_wood": r.coarse_wood}, str(tmp_path),
                          checkpoint_inputs=True)
    assert {"woody_debris", "woody_debris_box", "woody_debris_counts", "woody_debris_mean_sem"} <= set(paths)
    assert spark.read.parquet(paths["woody_debris"]).count() == r.wood.count()


def _role_tables(spark):
    from quadrat.sources.roles import DriverRoles
    r = DriverRoles(spark, SF)
    return {"tree_measurements": r.trees, "tree_heights": r.heights, "coordinates": r.coordinates,
            "densiometer": r.densiometer, "regeneration": r.regeneration, "sapling": r.sapling,
            "ysi": r.ysi, "wood": r.wood, "coarse_wood": r.coarse_wood}


def test_shared_levels_are_made_once_and_released(spark, tmp_path, monkeypatch):
    """A level that several outputs read is computed once; the outputs' plans then
    read its files instead of the sheets, have the same rows, and nothing is left."""
    import os
    from quadrat.plans import report
    made = []
    for name, (need, make, used) in list(report.LEVELS.items()):
        def counting(*a, name=name, make=make):
            made.append(name)
            return make(*a)
        monkeypatch.setitem(report.LEVELS, name, (need, counting, used))
    plans = {}

    def spied(df, path, **kw):
        plans[os.path.basename(path)] = " ".join(df.inputFiles())
        return write(df, path, **kw)

    write = report.write_table
    monkeypatch.setattr(report, "write_table", spied)
    levels = report.SharedLevels
    monkeypatch.setattr(report, "SharedLevels", lambda t, w: levels(t, w, str(tmp_path / "levels")))
    tables, checks = _role_tables(spark), {}
    paths = report.export_report(tables, str(tmp_path / "out"), start=1996, end=1998, checks=checks)
    assert sorted(made) == sorted(report.LEVELS)
    assert os.listdir(tmp_path / "levels") == []
    for name, (_, _, used) in report.LEVELS.items():
        for output in sorted({*used} - {"woody_debris_box"}):        # reads a checkpoint of its own
            assert f"quadrat-{name}-" in plans[output], (name, output)
    for output in ("basal_area_change", "densiometer_table", "densiometer_figure", "woody_debris", "woody_debris_mean_sem",
                   "woody_debris_counts", "check_site_islands"):
        assert "lineitem" not in plans[output], output
    for output, key in (("basal_area_change", "pct_basal_change"), ("densiometer_table", "canopy_table"),
                        ("woody_debris_mean_sem", "debris_mean_sem"), ("seedling_figure", "seedling_density"),
                        ("check_site_islands", "site_island_conflicts"), ("change_map", "change_map_layers")):
        want = QUERIES[key](spark, SF)
        if key != "seedling_density":
            got = spark.read.parquet(paths[output]).select(*want.columns)
            close = [sorted(str([round(v, 7) if isinstance(v, float) else v for v in r]) for r in d.collect()) for d in (got, want)]
            assert close[0] == close[1], output
    coarse = tables["coarse_wood"]
    assert checks == {"coarse_pieces": coarse.count(), "invalid_decay": coarse.where("Decay_class = 'T'").count(),
                      "missing_decay": 0} and checks["invalid_decay"] > 0


def test_one_site_is_written_and_others_stay(spark, tmp_path):
    """Other sites' files are not touched, and a failed write leaves the old ones."""
    import os
    from quadrat.plans.report import export_report
    tables = {"tree_measurements": _role_tables(spark)["tree_measurements"]}
    path = export_report(tables, str(tmp_path))["site_size_frequency"]

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
                if "Site=" in d}

    before = files()
    site = sorted({f.split("Site=")[1].split("/")[0] for f in before})[0]
    doubled = {"tree_measurements": tables["tree_measurements"].union(tables["tree_measurements"].where(F.col("SY") == 1996))}
    assert export_report(doubled, str(tmp_path), sites_only=[site]) == {"site_size_frequency": path}
    after = files()
    assert {f: m for f, m in before.items() if f"Site={site}/" not in f} == {
        f: m for f, m in after.items() if f"Site={site}/" not in f}
    assert set(f for f in after if f"Site={site}/" in f).isdisjoint(before)
    bad = {"tree_measurements": tables["tree_measurements"].withColumn(
        "DBH_cm", F.when(F.col("SY") == 1997, F.raise_error(F.lit("broken"))).otherwise(F.col("DBH_cm")).cast("double"))}
    with pytest.raises(Exception, match="broken"):
        export_report(bad, str(tmp_path), sites_only=[site])
    assert files() == after


def test_totals_come_without_a_join(spark):
    for key in ("share_of_total", "size_freq_site_year", "size_freq_sites"):
        p = _plan(QUERIES[key](spark, SF))
        assert "lineitem" in p and "__total" in p and "Window" not in p
        assert p.split("__total")[0].count("Join") == 0, key
    p = _plan(QUERIES["levels_of_stems"](spark, SF))
    assert p.count("Expand") >= 1 and len(re.findall("FileScan.*lineitem", p)) <= 2


def test_place_needs_no_single_task(spark):
    from quadrat.operators.order import with_place
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b", "c"]), r.randrange(50)) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(6)
    got = sorted((x.place, x.k, x.n) for x in with_place(df, ["k", "n"], "place").collect())
    assert [g[0] for g in got] == list(range(1, 801))
    assert [g[1:] for g in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert with_place(df.limit(0), ["k"], "place").count() == 0


def _raw_shuffles(df) -> list[str]:
    """Hash exchanges not fed by a partial aggregate (nor by a projection or
    filter of one, nor belonging to a join of aggregated sides)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    lines = buf.getvalue().split("\n\n(")[0].splitlines()
    bad = []
    for i, ln in enumerate(lines):
        if not re.search(r"[-:\s]Exchange \(\d+\)", ln):
            continue
        below = "\n".join(lines[i + 1:i + 4])
        if "HashAggregate" not in below:
            bad.append(ln.strip())
    return bad


@pytest.mark.parametrize("key", ["mean_basal_area", "mean_basal_area_dead", "mean_stem_density",
                                 "mean_tree_height", "mean_water_quality", "species_contribution_alive",
                                 "canopy_table", "seedling_table", "coarse_counts_class",
                                 "debris_counts", "tree_measurement_table", "size_freq_site_year"])
def test_shuffles_carry_partial_aggregates(spark, key):
    """Pre-aggregate before shuffling: every hash exchange of these queries is
    fed by a partial HashAggregate (or is a join input of aggregated sides),
    so a hot site or plot is combined in each map task, never shuffled raw."""
    assert _raw_shuffles(QUERIES[key](spark, SF)) == []


def test_raw_shuffle_is_detected(spark):
    from quadrat.sources.roles import DriverRoles
    t = DriverRoles(spark, SF).trees
    bad = t.repartition(8, "Site").groupBy("Site").agg(F.count(F.lit(1)))
    assert _raw_shuffles(bad)


def test_command_line_report(spark, tmp_path):
    """``python -m quadrat report`` over a folder of survey tables."""
    from quadrat.__main__ import main
    from quadrat.sources.roles import DriverRoles
    r = DriverRoles(spark, SF)
    tables = tmp_path / "tables"
    for name, df in {"tree_measurements": r.trees, "tree_heights": r.heights,
                     "coordinates": r.coordinates, "densiometer": r.densiometer,
                     "regeneration": r.regeneration, "sapling": r.sapling, "ysi": r.ysi,
                     "wood": r.wood, "coarse_wood": r.coarse_wood}.items():
        df.write.parquet(str(tables / f"{name}.parquet"))
    paths = main(["report", str(tables), str(tmp_path / "out"), "--start", "1996", "--end", "1998"])
    from quadrat.plans.report import NEEDS
    assert sorted(paths) == sorted(NEEDS)
    got = spark.read.parquet(paths["tree_measurements_table"])
    want = QUERIES["tree_measurement_table"](spark, SF)
    assert got.count() == want.count()
    # Plot was written as bigint by the mapping and is read back as declared (string).
    from quadrat.sources.catalog import read_table
    assert dict(read_table(spark, str(tables), "tree_measurements").dtypes)["Plot"] == "string"


def test_sapling_plots_share_one_uncoalesced_shuffle(spark):
    """Rows go to their plot once, in the session's number of parts: no task holds the
    maps of several levels for what adaptive execution has joined by bytes."""
    p = _plan(QUERIES["sapling_table_sparse"](spark, SF))
    plots = [ln for ln in p.splitlines() if re.search(r"hashpartitioning\(SY#\d+, Site#\d+, Plot#\w+, \d+\)", ln)]
    assert len(plots) == 1 and "REPARTITION_BY_NUM" in plots[0] and ", 8)" in plots[0]


def test_shuffle_partitions_without_a_setting(spark):
    """Where none is set, Spark's default counts, not the number of cores."""
    from quadrat.session import shuffle_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    try:
        assert shuffle_partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert shuffle_partitions(spark) == int(old)


def test_sapling_heights_are_dealt_uncoalesced(spark):
    p = _plan(QUERIES["sapling_density_sparse"](spark, SF))
    heights = [ln for ln in p.splitlines()
               if re.search(r"hashpartitioning\(SY#\d+, Site#\d+, Plot#\w+, Species#\d+, \d+\)", ln)]
    assert heights and all("REPARTITION_BY_NUM" in ln for ln in heights)


def test_groups_of_one_range_take_one_window(spark):
    """Only groups that lie in several ranges are placed by counts and joins; both ways
    give the same as percentile, whatever the number of ranges."""
    from quadrat.operators.quantiles import _sorted_checkpoint, _whole_and_split
    df = spark.range(2000).select(
        F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("v"))
    whole, split = _whole_and_split(_sorted_checkpoint(df, ["g"], "v", 6, ()))
    groups, several = ({r[0][0] for r in x.select("__g").distinct().collect()} for x in (whole, split))
    assert 0 in several and len(several) <= 5 and len(groups | several) == 300 and not groups & several
    assert whole.count() + split.count() == 2000
    ref = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.75])).collect()}
    for n in (1, 6):
        box = {r["g"]: [r["lower"], r["middle"], r["upper"]] for r in box_summary(df, ["g"], "v", num_partitions=n).collect()}
        assert box.keys() == ref.keys() and all(box[g] == pytest.approx(ref[g]) for g in ref)
