"""Tree metrics: size frequency (D1, D2), basal area, density, height, species
contribution and their change between two sampling years (D11-D19), and the
tree measurement report (D3).

Inputs are the ``tree_measurements`` and ``tree_heights`` roles with columns
SY, Site, Plot, Species, Mortality, DBH_cm / Tree_Height_m. Every function
returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (ALIVE, ALL_SITES_BIN_ORIGIN, BIN_SIZE, DEAD, END_YEAR, HEIGHT_SPECIES,
                     MORTALITY_MISSING, MORTALITY_RECODE, SITE_BIN_ORIGIN, SPECIES,
                     START_YEAR)
from ..functions.exact import exact_mean, exact_sum
from ..functions.forestry import PLOT_AREA_HA, basal_area
from ..functions.nulls import fill_zero, isin_or_null, mean_strict, std_error, sum0
from ..functions.text import pm_text, round_half_even
from ..operators.aggregate import counts_with_total, nested_mean_se, totals_by_level
from ..operators.change import period_change, size_histogram
from ..operators.join import natural_full_join
from ..operators.recode import recode


def _lf_rows(trees: DataFrame) -> DataFrame:
    """F1 + M5: measured, classified stems; 'Dying' counts as 'Alive'."""
    return (trees.where((F.col("DBH_cm") >= 0) & (F.col("Mortality") != MORTALITY_MISSING))
            .withColumn("Mortality", recode("Mortality", MORTALITY_RECODE)))


def size_freq_site_year(trees: DataFrame, site: str, bin_size: float = BIN_SIZE,
                        origin: float = SITE_BIN_ORIGIN) -> DataFrame:
    """D1 ``site_LF``: DBH size frequency of one site, per year and mortality.

    ``total_freq`` sums to 1 within each SY (over both mortality classes).
    """
    rows = _lf_rows(trees.where(F.col("Site") == F.lit(site)))
    return size_histogram(rows, ["SY"], ["Mortality"], "DBH_cm", bin_size, origin)


def size_freq_sites(trees: DataFrame, year: int, bin_size: float = BIN_SIZE,
                    origin: float = ALL_SITES_BIN_ORIGIN) -> DataFrame:
    """D2 ``all_sites_LF``: DBH size frequency of every site in one year."""
    rows = _lf_rows(trees.where(F.col("SY") == F.lit(year)))
    return size_histogram(rows, ["Site"], ["Mortality"], "DBH_cm", bin_size, origin)


def size_freq_all(trees: DataFrame, bin_size: float = BIN_SIZE,
                  origin: float = SITE_BIN_ORIGIN) -> DataFrame:
    """D1 for every site at once (the reference's per-site export loop, S4):
    one job grouped by (SY, Site) instead of one job per site."""
    return size_histogram(_lf_rows(trees), ["SY", "Site"], ["Mortality"], "DBH_cm",
                          bin_size, origin)


def _species_status(trees: DataFrame, status: Sequence[str]) -> DataFrame:
    return trees.where(F.col("Species").isin(list(SPECIES)) & F.col("Mortality").isin(list(status)))


def mean_basal_area(trees: DataFrame, exact: bool = False) -> DataFrame:
    """Mean and SE across plots of the plot's living basal area (m^2/ha).

    A plot without living stems of the three species is absent, not 0; a
    missing result (e.g. SE of one plot) is reported as 0 (``replace_na``).
    Only the measures are filled: a missing year stays missing rather than
    becoming year 0, so it still joins with the other tables' rows. With
    ``exact`` the bits do not depend on partitioning.
    """
    live, ba = _species_status(trees, ALIVE), basal_area("DBH_cm")
    r = nested_mean_se(live, ["SY", "Site"], ["Plot"],
                       {"basal_plot": exact_sum(ba).within("coalesce(@, 0D)") if exact else sum0(ba)},
                       {"basal_plot": ("mean_basal_area", "mean_basal_area_SE")}, exact=exact)
    return fill_zero(r, ["mean_basal_area", "mean_basal_area_SE"])


def mean_basal_area_dead(trees: DataFrame) -> DataFrame:
    """As D11 for dead stems; rows with a missing year are dropped."""
    dead = _species_status(trees, DEAD).where(F.col("SY").isNotNull())
    r = nested_mean_se(dead, ["SY", "Site"], ["Plot"],
                       {"basal_plot": sum0(basal_area("DBH_cm"))},
                       {"basal_plot": ("mean_basal_area", "mean_basal_area_SE")})
    return fill_zero(r, ["mean_basal_area", "mean_basal_area_SE"])


def species_contribution(trees: DataFrame, mortality: str = "alive") -> DataFrame:
    """Percent of the site's mean basal area contributed by each species.

    Per plot, a species without stems of the status counts 0 (pivot fill);
    plots without any stem of the status are absent. Columns
    ``RHMA_alive`` ... (or ``_dead``); NULL when the site total is 0.
    The reference's long/window detour is a row-wise expression on the wide
    table here: one aggregate per level, no window.
    """
    alive = mortality.lower() == "alive"   # B4: one normalised test
    suffix = "_alive" if alive else "_dead"
    rows = _species_status(trees, ALIVE if alive else DEAD).withColumn("__ba", basal_area("DBH_cm"))
    plot = rows.groupBy("SY", "Site", "Plot").agg(
        *[sum0(F.when(F.col("Species") == sp, F.col("__ba"))).alias(sp) for sp in SPECIES])
    site = plot.groupBy("SY", "Site").agg(*[mean_strict(sp).alias(sp) for sp in SPECIES])
    total = F.col(SPECIES[0])
    for sp in SPECIES[1:]:
        total = total + F.col(sp)
    return site.select("SY", "Site", *[
        (F.try_divide(F.col(sp), total) * F.lit(100.0)).alias(sp + suffix) for sp in SPECIES])


def mean_stem_density(trees: DataFrame) -> DataFrame:
    """Stems per hectare per plot (0.01 ha plots), mean and SE per site.
    Stems without a DBH still count. The SE of a single plot stays NULL."""
    live = _species_status(trees, ALIVE)
    return nested_mean_se(live, ["SY", "Site"], ["Plot"],
                          {"stem_plot_density": F.count(F.lit(1)) / F.lit(PLOT_AREA_HA)},
                          {"stem_plot_density": ("mean_stem_density", "mean_stem_density_SE")})


def mean_tree_height(heights: DataFrame, exact: bool = False) -> DataFrame:
    """Plot mean height, then mean and SE across plots; missing -> 0.
    Species RHMA/AVGE/LARA/UNK and missing species are kept (F3/N8)."""
    h = heights.where(isin_or_null("Species", HEIGHT_SPECIES))
    r = nested_mean_se(h, ["SY", "Site"], ["Plot"],
                       {"mean_height_plot": (exact_mean if exact else F.avg)("Tree_Height_m")},
                       {"mean_height_plot": ("mean_height", "mean_height_SE")}, exact=exact)
    return fill_zero(r, ["mean_height", "mean_height_SE"])


def pct_basal_change(trees: DataFrame, start=START_YEAR, end=END_YEAR,
                     plots: DataFrame | None = None) -> DataFrame:
    """Percent change of living mean basal area between two years. ``plots``
    passes the plot level (:func:`tree_plots`) where it has been computed already."""
    if plots is None:
        mean = mean_basal_area(trees)
    else:
        mean = fill_zero(plots.where(F.col("n_alive") > 0).groupBy("SY", "Site").agg(
            F.avg("basal_alive").alias("mean_basal_area")), ["mean_basal_area"])
    return period_change(mean, ["Site"], "SY", "mean_basal_area",
                         start, end, "percentage_change", percent=True,
                         fill_result=False, keep_periods=True)


def basal_change(trees: DataFrame, start=START_YEAR, end=END_YEAR) -> DataFrame:
    """Absolute change of living mean basal area (absent year = 0)."""
    return period_change(mean_basal_area(trees), ["Site"], "SY", "mean_basal_area",
                         start, end, "total_change")


def basal_change_dead(trees: DataFrame, start=START_YEAR, end=END_YEAR) -> DataFrame:
    """Absolute change of dead mean basal area."""
    return period_change(mean_basal_area_dead(trees), ["Site"], "SY", "mean_basal_area",
                         start, end, "total_change_dead")


def height_change(heights: DataFrame, start=START_YEAR, end=END_YEAR,
                  mean_heights: DataFrame | None = None) -> DataFrame:
    """Absolute change of mean tree height."""
    return period_change(mean_tree_height(heights) if mean_heights is None else mean_heights, ["Site"], "SY", "mean_height",
                         start, end, "height_change")


def density_change(trees: DataFrame, start=START_YEAR, end=END_YEAR) -> DataFrame:
    """Absolute change of mean stem density."""
    return period_change(mean_stem_density(trees), ["Site"], "SY", "mean_stem_density",
                         start, end, "stem_density_change")


def tree_plots(trees: DataFrame) -> DataFrame:
    """Stems and basal area per (SY, Site, Plot) and status, and per species: the
    plot level that the tree report and the change map share."""
    ba = basal_area("DBH_cm")
    is_sp = F.col("Species").isin(list(SPECIES))
    alive = is_sp & F.col("Mortality").isin(list(ALIVE))
    dead = is_sp & F.col("Mortality").isin(list(DEAD))
    return trees.where(alive | dead).groupBy("SY", "Site", "Plot").agg(
        F.count(F.when(alive, F.lit(1))).alias("n_alive"),
        F.count(F.when(dead, F.lit(1))).alias("n_dead"),
        sum0(F.when(alive, ba)).alias("basal_alive"),
        sum0(F.when(dead, ba)).alias("basal_dead"),
        *[sum0(F.when(alive & (F.col("Species") == sp), ba)).alias(f"{sp}_a") for sp in SPECIES],
        *[sum0(F.when(dead & (F.col("Species") == sp), ba)).alias(f"{sp}_d") for sp in SPECIES])


def tree_metrics(trees: DataFrame, heights: DataFrame, plots: DataFrame | None = None,
                 mean_heights: DataFrame | None = None) -> DataFrame:
    """Raw numbers of the tree report: D11, D13 (alive, dead), D14 and D15 by
    (SY, Site), with the row set and values of their natural full join (J1).

    Instead of five aggregates of the same table and four full outer joins,
    the tree table is scanned once: one plot-level aggregate with conditional
    sums per status and species, then one site-level aggregate. A plot counts
    for a status only if it has stems of that status (``has_*``), which keeps
    D11/D14's "absent plot" and D13's "zero inside a present plot" rules. Only
    the heights (another table) are joined. ``plots`` passes the plot level
    (:func:`tree_plots`) where it has been computed already.
    """
    plot = tree_plots(trees) if plots is None else plots
    has_a, has_d = F.col("n_alive") > 0, F.col("n_dead") > 0
    basal = F.when(has_a, F.col("basal_alive"))
    dens = F.when(has_a, F.col("n_alive") / F.lit(PLOT_AREA_HA))
    site = plot.groupBy("SY", "Site").agg(
        F.count(F.when(has_a, F.lit(1))).alias("__plots_a"),
        F.avg(basal).alias("mean_basal_area"),
        std_error(basal).alias("mean_basal_area_SE"),
        F.avg(dens).alias("mean_stem_density"),
        std_error(dens).alias("mean_stem_density_SE"),
        *[F.avg(F.when(has_a, F.col(f"{sp}_a"))).alias(f"__{sp}_a") for sp in SPECIES],
        *[F.avg(F.when(has_d, F.col(f"{sp}_d"))).alias(f"__{sp}_d") for sp in SPECIES])

    def shares(tag: str, suffix: str):
        total = F.col(f"__{SPECIES[0]}_{tag}")
        for sp in SPECIES[1:]:
            total = total + F.col(f"__{sp}_{tag}")
        return [(F.try_divide(F.col(f"__{sp}_{tag}"), total) * F.lit(100.0)).alias(sp + suffix)
                for sp in SPECIES]

    has_live_plot = F.col("__plots_a") > 0   # D11 row exists -> replace_na(0) applies
    trees_site = site.select(
        "SY", "Site",
        F.when(has_live_plot, F.coalesce("mean_basal_area", F.lit(0.0))).alias("mean_basal_area"),
        F.when(has_live_plot, F.coalesce("mean_basal_area_SE", F.lit(0.0))).alias("mean_basal_area_SE"),
        *shares("a", "_alive"), *shares("d", "_dead"),
        "mean_stem_density", "mean_stem_density_SE")
    return natural_full_join([trees_site, mean_tree_height(heights) if mean_heights is None else mean_heights])


def tree_measurement_table(trees: DataFrame, heights: DataFrame, plots: DataFrame | None = None,
                           mean_heights: DataFrame | None = None) -> DataFrame:
    """D3: the tree report - rounded numbers and ``mean ± SE`` text.

    Every number is rounded to 1 digit; stem density then again to 0 digits
    (the reference rounds twice). Species shares are percent with 1 digit.
    """
    x = tree_metrics(trees, heights, plots, mean_heights)
    num = [c for c, t in x.dtypes if t in ("double", "float") or t.startswith("decimal")]
    x = x.withColumns({c: round_half_even(c, 1) for c in num})
    x = x.withColumns({c: round_half_even(c, 0) for c in
                       ("mean_stem_density", "mean_stem_density_SE")})
    return x.select(
        "SY", "Site",
        pm_text("mean_height", "mean_height_SE").alias("Height"),
        pm_text("mean_basal_area", "mean_basal_area_SE").alias("Basal_Area"),
        pm_text("mean_stem_density", "mean_stem_density_SE").alias("Density"),
        *[f"{sp}_alive" for sp in SPECIES], *[f"{sp}_dead" for sp in SPECIES])


def mortality_share(trees: DataFrame) -> DataFrame:
    """Share of each mortality class among a site's stems in a year."""
    counts = counts_with_total(_lf_rows(trees), ["SY", "Site"], ["Mortality"], "n", "__total")
    share = F.try_divide(F.col("n").cast("double"), F.col("__total").cast("double"))
    return counts.withColumn("freq", share).drop("__total")


def density_levels(trees: DataFrame) -> DataFrame:
    """Living stems and their diameters for every plot, site and year, year,
    and in all, from one pass over the stems. ``level``: 0 plot, 1 site and year, 2
    year, 3 all."""
    live = _species_status(trees, ALIVE)
    return totals_by_level(
        live, [["SY", "Site", "Plot"], ["SY", "Site"], ["SY"], []],
        [F.count(F.lit(1)).alias("stems"), F.count("DBH_cm").alias("measured"),
         F.max("DBH_cm").alias("largest"), F.min("DBH_cm").alias("smallest")])
