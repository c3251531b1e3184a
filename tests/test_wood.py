"""Readers and debris analyses on a small sheet with the dirt of field sheets
(padded names, a site on two islands, NA, quotes, a line break, a transect that
is too short and one that is too long); the results are worked by hand."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quadrat.plans import debris
from quadrat.sources.catalog import find_table, read_csv, read_table
from quadrat.sources.schemas import SCHEMAS

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
A1 = (2022, "Mill Cove", "A", 1)


def _by_transect(df):
    return {(r["SY"], r["Site"], r["Plot"], r["Transect_num"]): r for r in df.collect()}


def test_cells(wood):
    r = _by_transect(wood)
    assert len(r) == wood.count() == 6
    assert {k[1] for k in r} == {"Mill Cove", "Salt Pan"}                # trimmed (N17)
    assert r[A1]["Notes"] == 'said "dense", muddy'                       # doubled quotes
    two = r[(2022, "Mill Cove", "A", 2)]
    assert two["Wood_med_num"] is None and two["Notes"] is None          # NA is missing here
    assert r[(2024, "Mill Cove", "B", 1)]["Transect_m"] is None
    assert dict(wood.dtypes)["SY"] == "int" and dict(wood.dtypes)["Transect_m"] == "double"


def test_na_class_is_dropped_and_not_counted(coarse):
    assert coarse.where(F.col("Decay_class").isNull()).count() == 1
    assert sorted(r["Decay_class"] for r in debris.decay_clean(coarse).collect()) == ["I", "I", "R", "S"]
    assert [r["DBH_cm"] for r in debris.decay_invalid(coarse).collect()] == [9.0]
    n = {(r["SY"], r["Site"], r["Decay_class"]): r["N"] for r in debris.coarse_counts_class(coarse).collect()}
    assert n == {(2022, "Mill Cove", "I"): 2, (2022, "Salt Pan", "R"): 1, (2024, "Mill Cove", "S"): 1}
    n = {(r["SY"], r["Site"]): r["N"] for r in debris.coarse_counts_plot(coarse).collect()}
    assert n == {(2022, "Mill Cove"): 2, (2022, "Salt Pan"): 1, (2024, "Mill Cove"): 1}


def test_na_is_a_text_in_the_worksheets(spark, tmp_path):
    (tmp_path / "tree_measurements.csv").write_text(
        "SY,Island,Site,Plot,Species,Mortality,DBH_cm\n2022,East,Mill Cove,A,RHMA,NA,5\n2022,East,Mill Cove,A,RHMA,,6\n")
    got = {r["DBH_cm"]: r["Mortality"] for r in read_table(spark, str(tmp_path), "tree_measurements").collect()}
    assert got == {5.0: "NA", 6.0: None}


def test_line_break_in_a_cell(spark):
    path = os.path.join(DATA, "coarse_broken.csv")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_csv(spark, path, SCHEMAS["coarse_wood"], "coarse_wood").collect()
    got = read_csv(spark, path, SCHEMAS["coarse_wood"], "coarse_wood", multi_line=True)
    assert sorted(r["Site"] for r in got.collect()) == ["Mill\nCove", "Salt Pan"]


def test_sheet_header_and_odd_extra_column(spark, tmp_path):
    (tmp_path / "coordinates.csv").write_text(
        "Island,Site,Forest type,Latitude,Longitude,no. of trees\nEast,Mill Cove,Basin,18.1,-64.9,7\n")
    df = read_table(spark, str(tmp_path), "coordinates")
    assert df.columns == ["Island", "Site", "Forest_type", "Latitude", "Longitude", "no. of trees"]
    assert df.first()["Forest_type"] == "Basin" and df.first()["no. of trees"] == "7"


def test_inference_without_schema(spark):
    df = read_csv(spark, os.path.join(DATA, "wood.csv"), name="wood")
    types = dict(df.dtypes)
    assert types["SY"] == "int" and types["Transect_m"] == "double" and types["Site"] == "string"
    assert df.select("Site").distinct().count() == 2


def test_paths_with_and_without_a_scheme(spark):
    plain, uri = read_table(spark, DATA, "wood"), read_table(spark, f"file://{DATA}", "wood")
    assert sorted(map(str, plain.collect())) == sorted(map(str, uri.collect()))
    assert find_table(spark, f"file://{DATA}", "ysi") is None
    with pytest.raises(FileNotFoundError):
        read_table(spark, DATA, "ysi")


def test_report_run_on_any_path(spark, tmp_path):
    from quadrat.__main__ import main
    a = main(["report", DATA, str(tmp_path / "a")])
    b = main(["report", f"file://{DATA}", f"file://{tmp_path}/b"])
    assert sorted(a) == sorted(b) == ["check_decay_classes", "check_site_islands", "coarse_counts_class",
                                      "coarse_counts_plot", "woody_debris", "woody_debris_box",
                                      "woody_debris_counts", "woody_debris_mean_sem"]
    for k in a:
        assert spark.read.parquet(a[k]).count() == spark.read.parquet(b[k]).count()
    (tmp_path / "none").mkdir()
    for empty in (str(tmp_path / "none"), f"file://{tmp_path}/none", str(tmp_path / "nowhere")):
        with pytest.raises(SystemExit, match="no survey table"):
            main(["report", empty, str(tmp_path / "c")])


def test_report_lists_what_it_leaves_out(spark, tmp_path, capsys):
    from quadrat.__main__ import main
    main(["report", DATA, str(tmp_path)])
    out = capsys.readouterr().out
    assert "skipped change_map: no table tree_measurements, tree_heights, coordinates" in out
    from quadrat.plans.report import export_report
    with pytest.raises(ValueError, match="unknown"):
        export_report({"woods": read_table(spark, DATA, "wood")}, str(tmp_path))
    with pytest.raises(ValueError, match="no output"):
        export_report({"sapling": spark.range(1)}, str(tmp_path))


def test_site_on_two_islands(wood):
    r = debris.site_island_conflicts(wood).collect()
    assert [(x["Site"], x["n_islands"], x["first_island"], x["last_island"]) for x in r] == [("Mill Cove", 2, "East", "West")]


def test_coarse_volume_by_hand(wood, coarse):
    r = _by_transect(debris.coarse_volume(wood, coarse))
    # A1: two pieces of class I, 10 and 20 cm, over 12 m: pi^2 * (0.01 + 0.04) / (8 * 12) * 10000 m3/ha
    assert r[A1]["I"] == pytest.approx(0.05)
    assert r[A1]["IVol_ha"] == pytest.approx(math.pi ** 2 * 0.05 / (8 * 12) * 10_000)
    assert r[A1]["CoarseVol"] == pytest.approx(r[A1]["IVol_ha"]) and r[A1]["S"] == 0
    # the only valid piece of Salt Pan has no diameter: it adds nothing
    assert r[(2022, "Salt Pan", "A", 1)]["R"] == 0 and r[(2022, "Salt Pan", "A", 1)]["CoarseVol"] == 0
    # no pieces at all: 0, not missing; the length is not filled
    assert r[(2022, "Mill Cove", "A", 2)]["CoarseVol"] == 0
    assert r[(2024, "Mill Cove", "B", 1)]["Transect_m"] is None


def test_small_debris_by_hand(wood, coarse):
    from quadrat.fixed import FINE_DIAMETER_M, MEDIUM_DIAMETER_M
    r = _by_transect(debris.total_debris(wood, coarse))
    volume = lambda n, d, length: math.pi ** 2 * n * d * d / (8 * length) * 10_000
    # fine pieces are counted from metre 2 to 4, medium ones from 2 to 6
    for key, fine, medium, n_fine, n_medium in ((A1, 2, 4, 8, 4), ((2022, "Salt Pan", "A", 1), 2, 4, 10, 6),
                                                ((2022, "Mill Cove", "A", 2), 1.5, 1.5, 3, 0)):
        assert (r[key]["Fine_m"], r[key]["Med_m"]) == (pytest.approx(fine), pytest.approx(medium))
        assert r[key]["FVol"] == pytest.approx(volume(n_fine, FINE_DIAMETER_M, fine))
        assert r[key]["MVol"] == pytest.approx(volume(n_medium, MEDIUM_DIAMETER_M, medium))
    # shorter than 2 m, or not read: no volume
    assert r[(2022, "Mill Cove", "B", 1)]["FVol"] is None and r[(2024, "Mill Cove", "B", 1)]["FVol"] is None


def test_debris_counts_by_hand(wood):
    r = {(x["Island"], x["Site"], x["SY"]): x for x in debris.debris_counts(wood).collect()}
    a = r[("East", "Mill Cove", 2022)]                       # 8, 3, 2
    assert a["meanFine"] == pytest.approx(13 / 3)
    assert a["SEMFine"] == pytest.approx(math.sqrt(((8 - 13 / 3) ** 2 + (3 - 13 / 3) ** 2 + (2 - 13 / 3) ** 2) / 2 / 3))
    assert a["meanMedium"] is None and a["sumSurveyed"] == pytest.approx(17.0)
    assert r[("West", "Mill Cove", 2024)]["sumSurveyed"] is None
    assert r[("North", "Salt Pan", 2022)]["SEMFine"] is None


def test_checkpoint_folder_is_required_on_a_cluster():
    from quadrat.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), Conf()

    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Session(master))
