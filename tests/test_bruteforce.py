"""A second, independent oracle: the survey's rules written directly in
pandas (one group at a time, the way the original scripts compute), compared
with the Spark plans on random data with missing values and one hot site that
holds a third of all rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from quadrat.plans import debris, trees

SPECIES = ["RHMA", "AVGE", "LARA"]


def _se(x: pd.Series):
    x = x.dropna()
    return float(x.std(ddof=1) / math.sqrt(len(x))) if len(x) > 1 else None


def _ba(d):
    return math.pi * ((d / 100) / 2) ** 2 / 0.01


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(42)
    rows = []
    for i in range(3000):
        site = "HOT" if i % 3 == 0 else f"S{rnd.randint(0, 19)}"
        rows.append((rnd.choice([2022, 2024]), site, f"P{rnd.randint(0, 5)}",
                     rnd.choice(SPECIES + ["UNK", None]),
                     rnd.choice(["Alive", "Dying", "Dead", "NA"]),
                     None if rnd.random() < 0.08 else round(rnd.uniform(0.5, 45), 1)))
    return pd.DataFrame(rows, columns=["SY", "Site", "Plot", "Species", "Mortality", "DBH_cm"])


def _spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "SY int, Site string, Plot string, Species string, "
                                 "Mortality string, DBH_cm double")


def _close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_mean_basal_area_vs_pandas(spark, data):
    live = data[data.Species.isin(SPECIES) & data.Mortality.isin(["Alive", "Dying"])].copy()
    live["ba"] = live.DBH_cm.map(lambda d: _ba(d) if pd.notna(d) else np.nan)
    plot = live.groupby(["SY", "Site", "Plot"]).ba.sum(min_count=0).reset_index()
    want = {}
    for (sy, site), g in plot.groupby(["SY", "Site"]):
        se = _se(g.ba)
        want[(sy, site)] = (g.ba.mean(), 0.0 if se is None else se)
    got = {(r.SY, r.Site): (r.mean_basal_area, r.mean_basal_area_SE)
           for r in trees.mean_basal_area(_spark(spark, data)).collect()}
    assert got.keys() == want.keys()
    for k, (m, s) in want.items():
        assert _close(got[k][0], m) and _close(got[k][1], s), k


def test_species_contribution_vs_pandas(spark, data):
    dead = data[data.Species.isin(SPECIES) & (data.Mortality == "Dead")].copy()
    dead["ba"] = dead.DBH_cm.map(lambda d: _ba(d) if pd.notna(d) else np.nan)
    wide = (dead.groupby(["SY", "Site", "Plot", "Species"]).ba.sum(min_count=0)
            .unstack("Species").reindex(columns=SPECIES).fillna(0.0))
    site = wide.groupby(level=["SY", "Site"]).mean()
    got = {(r.SY, r.Site): r for r in trees.species_contribution(_spark(spark, data), "dead").collect()}
    assert set(got) == set(site.index)
    for k, row in site.iterrows():
        tot = row.sum()
        for sp in SPECIES:
            want = row[sp] / tot * 100 if tot != 0 else None
            assert _close(got[k][sp + "_dead"], want), (k, sp)


def test_size_frequency_vs_pandas(spark, data):
    d = data[(data.DBH_cm >= 0) & (data.Mortality != "NA") & data.Mortality.notna()].copy()
    d["Mortality"] = d.Mortality.replace({"Dying": "Alive"})
    want = {}
    for (sy, site), g in d.groupby(["SY", "Site"]):
        n = len(g)
        # cut(DBH, seq(2.5, max + 3, 3), right = FALSE)
        breaks = np.arange(2.5, g.DBH_cm.max() + 3 + 1e-9, 3.0)
        b = pd.cut(g.DBH_cm, breaks, right=False)
        for (mort, interval), cnt in g.groupby(["Mortality", b], observed=True, dropna=False).size().items():
            lo = None if pd.isna(interval) else float(interval.left)
            want[(sy, site, mort, lo)] = cnt / n
    got = {(r.SY, r.Site, r.Mortality, r.bin_lo): r.total_freq
           for r in trees.size_freq_all(_spark(spark, data), 3.0, 2.5).collect()}
    assert got.keys() == want.keys()
    assert all(_close(got[k], v) for k, v in want.items())


def test_total_debris_vs_pandas(spark):
    rnd = random.Random(3)
    wood = pd.DataFrame([(2022, "I", f"S{s}", f"P{p}", t, rnd.choice([1.5, 3.5, 5.0, 12.0, None]),
                          rnd.randint(0, 30), rnd.randint(0, 20), 0)
                         for s in range(4) for p in range(2) for t in range(1, 4)],
                        columns=["SY", "Island", "Site", "Plot", "Transect_num", "Transect_m",
                                 "Wood_fine_num", "Wood_med_num", "Wood_coarse_num"])
    coarse = pd.DataFrame([(2022, f"S{rnd.randint(0, 3)}", f"P{rnd.randint(0, 1)}", rnd.randint(1, 3),
                            rnd.choice(["I", "S", "R", "T", "R, T", "I, R"]), rnd.uniform(7.5, 30))
                           for _ in range(40)],
                          columns=["SY", "Site", "Plot", "Transect_num", "Decay_class", "DBH_cm"])
    w = spark.createDataFrame(wood.astype(object).where(wood.notna(), None),
                              "SY int, Island string, Site string, Plot string, Transect_num int, "
                              "Transect_m double, Wood_fine_num int, Wood_med_num int, "
                              "Wood_coarse_num int")
    c = spark.createDataFrame(coarse, "SY int, Site string, Plot string, Transect_num int, "
                                      "Decay_class string, DBH_cm double")
    got = {(r.Site, r.Plot, r.Transect_num): r for r in debris.total_debris(w, c).collect()}
    cl = coarse[coarse.Decay_class != "T"].replace({"Decay_class": {"R, T": "R", "I, R": "I"}})
    d2 = (cl.assign(d2=(cl.DBH_cm / 100) ** 2)
          .groupby(["Site", "Plot", "Transect_num", "Decay_class"]).d2.sum())
    dens = {"I": 0.35, "S": 0.5, "R": 0.2}
    for _, t in wood.iterrows():
        L = t.Transect_m
        key = (t.Site, t.Plot, t.Transect_num)
        vol = mass = 0.0
        for k, rho in dens.items():
            s = d2.get((t.Site, t.Plot, t.Transect_num, k), 0.0)
            v = math.pi ** 2 * s / (8 * L) * 10000 if L == L and L is not None else None
            vol = None if v is None or vol is None else vol + v
            mass = None if v is None or mass is None else mass + v * rho
        fine = (L - 2 if L < 4 else 2) if L == L else None
        med = (L - 2 if L < 6 else 4) if L == L else None
        fine = fine if fine is not None and fine > 0 else None
        med = med if med is not None and med > 0 else None
        fv = math.pi ** 2 * (0.005 ** 2 * t.Wood_fine_num) / (8 * fine) * 10000 if fine else None
        mv = math.pi ** 2 * (0.0425 ** 2 * t.Wood_med_num) / (8 * med) * 10000 if med else None
        total = None if None in (fv, mv, vol) else fv + mv + vol
        r = got[key]
        assert _close(r.CoarseVol, vol) and _close(r.CoarseMass, mass), key
        assert _close(r.FVol, fv) and _close(r.MVol, mv) and _close(r.TotalVolume, total), key


def test_bins_match_r_cut_for_inexact_width(spark):
    """M3: with a width of 0.1 the bins are those of
    cut(x, seq(o, max + w, w), right = FALSE), break values o + k*w."""
    from pyspark.sql import functions as F

    from quadrat.functions import bin_bounds, bin_index
    rnd = random.Random(9)
    xs = [round(rnd.uniform(0, 5), rnd.choice([1, 2, 3])) for _ in range(2000)] + \
         [i / 10 for i in range(50)] + [0.3, 0.7, 1.1, 2.9]
    for o, w in ((0.0, 0.1), (0.05, 0.1), (2.5, 0.3)):
        # R: seq(from, to, by) = pmin(from + (0:n) * by, to), n = floor((to - from)/by + 1e-10)
        to = max(xs) + w
        n = int((to - o) / w + 1e-10)
        breaks = [min(o + i * w, to) for i in range(n + 1)]
        codes = pd.cut(pd.Series(xs), breaks, right=False).cat.codes   # -1 = no bin
        want = [None if c < 0 else int(c) for c in codes]
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        k = bin_index("x", w, o)
        lo, hi = bin_bounds(k, w, o)
        got = df.select(k.cast("int"), lo, hi).collect()
        assert [r[0] for r in got] == want, (o, w)
        # the edges are seq's break values (R clamps only the last one to `to`)
        assert all(r[0] is None or (r[1] == breaks[r[0]] and math.isclose(r[2], breaks[r[0] + 1]))
                   for r in got)
