"""

Each query takes ``(spark, sf_dir)``, derives the survey roles from the whole
driver tables in ``sf_dir`` (``sources.roles``) and returns the lazy result of
one composite or generic operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import ALL_SITES_BIN_ORIGIN, SITE_BIN_ORIGIN
from .functions.exact import exact_state, merge_states, state_stats
from .functions.nulls import sum0
from .functions.text import bin_label
from .operators.aggregate import nested_mean_se, with_global_stats
from .operators.join import lookup_by_period, natural_full_join
from .operators.order import with_place
from .operators.recode import category_rank
from .operators.reshape import pivot_wide, rename_with, unpivot_list
from .plans import canopy, debris, regeneration, sites, trees, water
from .sources.roles import DriverRoles

# histogram bin width, and the display order of the "islands" (regions); a
# region not listed has no rank, like a value outside a factor's levels.
START, END = 1996, 1998
BIN_SIZE = 3.0
ISLAND_ORDER = ("ASIA", "EUROPE", "AMERICA")

Query = Callable[[SparkSession, str], DataFrame]


def _r(spark: SparkSession, root: str, layout: str = "survey") -> DriverRoles:
    return DriverRoles(spark, root, layout)


def q_size_freq_site_year(spark, root, layout="survey"):
    """D1 for every site (the reference's per-site loop as one job)."""
    return trees.size_freq_all(_r(spark, root, layout).trees, BIN_SIZE, SITE_BIN_ORIGIN)


def q_size_freq_sites(spark, root, layout="survey"):
    """D2 for every year: relative frequency per site, bins from 0."""
    return trees.size_histogram(trees._lf_rows(_r(spark, root, layout).trees), ["SY", "Site"],
                                ["Mortality"], "DBH_cm", BIN_SIZE, ALL_SITES_BIN_ORIGIN)


def q_tree_measurement_table(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return trees.tree_measurement_table(r.trees, r.heights)


def q_canopy_table(spark, root, layout="survey"):
    return canopy.canopy_table(_r(spark, root, layout).densiometer)


def q_canopy_series(spark, root, layout="survey"):
    return canopy.canopy_series(_r(spark, root, layout).densiometer)


def q_seedling_density(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return regeneration.seedling_density(r.regeneration, r.densiometer, ISLAND_ORDER)


def q_sapling_density(spark, root, layout="survey"):
    """D7 for all three species charts at once (rescale over all species)."""
    r = _r(spark, root, layout)
    return regeneration.sapling_site_stats(r.regeneration, r.sapling, r.densiometer, ISLAND_ORDER)


def q_sapling_table(spark, root, layout="survey"):
    return regeneration.sapling_table(_r(spark, root, layout).regeneration)


def q_seedling_table(spark, root, layout="survey"):
    return regeneration.seedling_table(_r(spark, root, layout).regeneration)


def q_water_table(spark, root, layout="survey"):
    return water.water_table(_r(spark, root, layout).ysi)


def q_mean_basal_area(spark, root, layout="survey"):
    return trees.mean_basal_area(_r(spark, root, layout).trees)


def q_mean_basal_area_dead(spark, root, layout="survey"):
    return trees.mean_basal_area_dead(_r(spark, root, layout).trees)


def q_species_contribution_alive(spark, root, layout="survey"):
    return trees.species_contribution(_r(spark, root, layout).trees, "alive")


def q_species_contribution_dead(spark, root, layout="survey"):
    return trees.species_contribution(_r(spark, root, layout).trees, "dead")


def q_mean_stem_density(spark, root, layout="survey"):
    return trees.mean_stem_density(_r(spark, root, layout).trees)


def q_mean_tree_height(spark, root, layout="survey"):
    return trees.mean_tree_height(_r(spark, root, layout).heights)


def q_pct_basal_change(spark, root, layout="survey"):
    return trees.pct_basal_change(_r(spark, root, layout).trees, START, END)


def q_basal_change(spark, root, layout="survey"):
    return trees.basal_change(_r(spark, root, layout).trees, START, END)


def q_basal_change_dead(spark, root, layout="survey"):
    return trees.basal_change_dead(_r(spark, root, layout).trees, START, END)


def q_height_change(spark, root, layout="survey"):
    return trees.height_change(_r(spark, root, layout).heights, START, END)


def q_density_change(spark, root, layout="survey"):
    return trees.density_change(_r(spark, root, layout).trees, START, END)


def q_mean_water_quality(spark, root, layout="survey"):
    return water.mean_water_quality(_r(spark, root, layout).ysi)


def q_site_coordinates(spark, root, layout="survey"):
    return sites.site_coordinates(_r(spark, root, layout).coordinates)


def q_change_map_layers(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return sites.change_map_layers(r.trees, r.heights, r.coordinates, START, END)


def q_decay_clean(spark, root, layout="survey"):
    return debris.decay_clean(_r(spark, root, layout).coarse_all)


def q_decay_invalid(spark, root, layout="survey"):
    return debris.decay_invalid(_r(spark, root, layout).coarse_all)


def q_coarse_counts_class(spark, root, layout="survey"):
    return debris.coarse_counts_class(_r(spark, root, layout).coarse_all)


def q_coarse_counts_plot(spark, root, layout="survey"):
    return debris.coarse_counts_plot(_r(spark, root, layout).coarse_all)


def q_coarse_volume(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return debris.coarse_volume(r.wood, r.coarse_wood)


def q_total_debris(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return debris.total_debris(r.wood, r.coarse_wood)


def q_debris_box(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return debris.debris_box(r.wood, r.coarse_wood)


def q_debris_mean_sem(spark, root, layout="survey"):
    r = _r(spark, root, layout)
    return debris.debris_mean_sem(r.wood, r.coarse_wood)


def q_debris_counts(spark, root, layout="survey"):
    return debris.debris_counts(_r(spark, root, layout).wood)


def q_site_island_conflicts(spark, root, layout="survey"):
    return debris.site_island_conflicts(_r(spark, root, layout).wood)


# -- generic operators on the same roles ---------------------------------------

def q_natural_full_join(spark, root, layout="survey"):
    """The four change tables merged by Site."""
    r = _r(spark, root, layout)
    return sites.site_changes(r.trees, r.heights, START, END)


def q_left_join_zero_fill(spark, root, layout="survey"):
    """Every transect with its coarse diameter sums, 0 where none."""
    r = _r(spark, root, layout)
    return debris.coarse_merge(r.wood, r.coarse_wood)


def q_global_minmax_rescale(spark, root, layout="survey"):
    """The seedling height on the density axis and back."""
    r = _r(spark, root, layout)
    return regeneration.seedling_axis(r.regeneration, r.densiometer, ISLAND_ORDER)


def q_share_of_total(spark, root, layout="survey"):
    """Share of each mortality class in a site's stems per year."""
    return trees.mortality_share(_r(spark, root, layout).trees)


def q_unpivot_regex(spark, root, layout="survey"):
    """Every densiometer reading as a row (Direction, Type from the name)."""
    return canopy.canopy_long(_r(spark, root, layout).densiometer)


def q_unpivot_multi(spark, root, layout="survey"):
    """Counts long by species with a column per stage."""
    return regeneration.counts_by_species(_r(spark, root, layout).regeneration)


def q_pivot_fill_zero(spark, root, layout="survey"):
    """Living basal area per plot and species, 0 for an absent species."""
    t = _r(spark, root, layout).trees
    live = trees._species_status(t, trees.ALIVE)
    per = live.groupBy("SY", "Site", "Plot", "Species").agg(
        F.coalesce(F.sum(trees.basal_area("DBH_cm")), F.lit(0.0)).alias("basal_area_sum"))
    return pivot_wide(per, ["SY", "Site", "Plot"], "Species", trees.SPECIES,
                      ["basal_area_sum"], fill=0.0)


def q_bin_labels(spark, root, layout="survey"):
    """M4: the label of every bin of the all-sites histogram
    (``labeler(length(unique(Bin)), bin_size)[index]``)."""
    h = q_size_freq_sites(spark, root, layout)
    bins = h.select("bin", "bin_lo", "bin_hi").distinct()
    g = with_global_stats(bins, [F.count(F.lit(1)).alias("__bin_num")])
    # bin_num is data-dependent, so it is a column of the one-row aggregate.
    label = bin_label(F.col("bin") + 1, F.col("__bin_num"), BIN_SIZE)
    return g.select("bin", "bin_lo", "bin_hi", F.col("__bin_num").alias("bin_num"),
                    label.alias("label"))


def q_island_sites(spark, root, layout="survey"):
    return regeneration.island_sites(_r(spark, root, layout).densiometer)


def q_recode_map(spark, root, layout="survey"):
    return debris.decay_recoded(_r(spark, root, layout).coarse_all)


def q_category_order(spark, root, layout="survey"):
    s = regeneration.island_sites(_r(spark, root, layout).densiometer)
    return s.withColumn("Island_rank", category_rank("Island", ISLAND_ORDER))


# -- parameters and rules that the keys above do not show ------------------------

ONE_SITE, ONE_YEAR, ONE_SPECIES = "NATION_3", 1997, "AVGE"


def q_size_freq_one_site(spark, root, layout="survey"):
    """One site."""
    return trees.size_freq_site_year(_r(spark, root, layout).trees, ONE_SITE, BIN_SIZE)


def q_size_freq_one_year(spark, root, layout="survey"):
    """One year."""
    return trees.size_freq_sites(_r(spark, root, layout).trees, ONE_YEAR, BIN_SIZE)


def q_sapling_density_one_species(spark, root, layout="survey"):
    """One species, on axes over all species."""
    r = _r(spark, root, layout)
    return regeneration.sapling_density(r.regeneration, r.sapling, ONE_SPECIES, r.densiometer, ISLAND_ORDER)


def q_natural_full_join_n(spark, root, layout="survey"):
    """Four tables computed apart, none with all keys, some keys missing
    (Site is NULL for every seventh plot; missing keys match)."""
    r = _r(spark, root, layout)
    site = F.when(F.col("Plot") % 7 != 0, F.col("Site")).alias("Site")
    t = r.trees.select("SY", site, "Species", "Mortality", "DBH_cm")
    h = r.heights.select("SY", site, "Tree_Height_m")

    def count(df, name):
        return df.groupBy("SY", "Site").agg(F.count(F.lit(1)).alias(name))

    return natural_full_join([
        count(t.where(F.col("Mortality") == "Dead"), "n_dead"),
        count(t.where(F.col("Mortality") == "NA"), "n_unknown"),
        h.where(F.col("SY") % 2 == 0).groupBy("SY", "Site").agg(F.max("Tree_Height_m").alias("max_height")),
        count(t.where(F.col("DBH_cm") >= 50), "n_large")])


def q_pivot_no_fill(spark, root, layout="survey"):
    """Squared diameters per transect and class, a column per class, NULL
    where a transect has no piece of it."""
    clean = debris.decay_clean(_r(spark, root, layout).coarse_all)
    d = F.col("DBH_cm") / F.lit(100.0)
    per = clean.groupBy(*debris.TRANSECT, "Decay_class").agg(sum0(d * d).alias("sumd2"))
    return pivot_wide(per, debris.TRANSECT, "Decay_class", debris.DECAY_CLASSES, ["sumd2"])


def q_pivot_several_values(spark, root, layout="survey"):
    """Seedling means and errors per species, a column for each, by
    the long form (rows per species first), columns renamed."""
    long = regeneration.counts_long(_r(spark, root, layout).regeneration, "seedlings", ("SY", "Site", "Plot"))
    site = nested_mean_se(long, ["SY", "Site", "Species"], ["Plot"], {"plot_mean": F.avg("Count")},
                          {"plot_mean": ("site_mean", "site_SE")})
    wide = pivot_wide(site, ["SY", "Site"], "Species", regeneration.SPECIES, ["site_mean", "site_SE"],
                      glue="{name}_{value}")
    return rename_with(wide, lambda c: c.replace("site_", ""))


def q_unpivot_list(spark, root, layout="survey"):
    """R2: listed water measures as rows."""
    return unpivot_list(_r(spark, root, layout).ysi, ["SY", "Site", "Plot"],
                        ["Water_depth", "Salinity_ppt", "TDS"], "measure")


def q_report_order(spark, root, layout="survey"):
    """O1: the place of every row in the sorted seedling report."""
    table = regeneration.seedling_table(_r(spark, root, layout).regeneration)
    return with_place(table.select("SY", "Site"), ["Site", "SY"], "place")


def q_levels_of_stems(spark, root, layout="survey"):
    """Stems per plot, site, year and in all, by GROUPING SETS."""
    return trees.density_levels(_r(spark, root, layout).trees)


def q_merged_states(spark, root, layout="survey"):
    """A10: mean height per site over all years, from states per year and plot."""
    heights = _r(spark, root, layout).heights
    states = exact_state(heights, ["SY", "Site", "Plot"], "Tree_Height_m")
    return state_stats(merge_states(states, ["Site"]), ["Site"], "mean_height", "mean_height_SE")


def q_island_by_year(spark, root, layout="survey"):
    """Stems per site and year with the island last recorded, in an even year."""
    r = _r(spark, root, layout)
    stems = r.trees.groupBy("SY", "Site").agg(F.count(F.lit(1)).alias("stems"))
    sheets = r.densiometer.select("Site", "SY", "Island").where(F.col("SY") % 2 == 0)
    return lookup_by_period(stems, sheets, ["Site"], "SY", "Island")


# -- sums without an order: the same bits for any partitioning ---------------------

def q_exact_basal_area(spark, root, layout="survey"):
    """A5/A10: D11 from exact sums."""
    return trees.mean_basal_area(_r(spark, root, layout).trees, exact=True)


def q_exact_tree_height(spark, root, layout="survey"):
    """A3/A5/A10: D15 from exact sums."""
    return trees.mean_tree_height(_r(spark, root, layout).heights, exact=True)


def q_exact_water_quality(spark, root, layout="survey"):
    """D20 from exact sums."""
    return water.mean_water_quality(_r(spark, root, layout).ysi, exact=True)


def q_exact_water_table(spark, root, layout="survey"):
    """M8: D10 from exact sums, rounded without snapping."""
    return water.water_table(_r(spark, root, layout).ysi, exact=True)


QUERIES: dict[str, Query] = {
    "size_freq_site_year": q_size_freq_site_year,
    "size_freq_sites": q_size_freq_sites,
    "tree_measurement_table": q_tree_measurement_table,
    "canopy_table": q_canopy_table,
    "canopy_series": q_canopy_series,
    "seedling_density": q_seedling_density,
    "sapling_density": q_sapling_density,
    "sapling_table": q_sapling_table,
    "seedling_table": q_seedling_table,
    "water_table": q_water_table,
    "mean_basal_area": q_mean_basal_area,
    "mean_basal_area_dead": q_mean_basal_area_dead,
    "species_contribution_alive": q_species_contribution_alive,
    "species_contribution_dead": q_species_contribution_dead,
    "mean_stem_density": q_mean_stem_density,
    "mean_tree_height": q_mean_tree_height,
    "pct_basal_change": q_pct_basal_change,
    "basal_change": q_basal_change,
    "basal_change_dead": q_basal_change_dead,
    "height_change": q_height_change,
    "density_change": q_density_change,
    "mean_water_quality": q_mean_water_quality,
    "site_coordinates": q_site_coordinates,
    "change_map_layers": q_change_map_layers,
    "decay_clean": q_decay_clean,
    "decay_invalid": q_decay_invalid,
    "coarse_counts_class": q_coarse_counts_class,
    "coarse_counts_plot": q_coarse_counts_plot,
    "coarse_volume": q_coarse_volume,
    "total_debris": q_total_debris,
    "debris_box": q_debris_box,
    "debris_mean_sem": q_debris_mean_sem,
    "debris_counts": q_debris_counts,
    "site_island_conflicts": q_site_island_conflicts,
    "natural_full_join": q_natural_full_join,
    "left_join_zero_fill": q_left_join_zero_fill,
    "global_minmax_rescale": q_global_minmax_rescale,
    "share_of_total": q_share_of_total,
    "unpivot_regex": q_unpivot_regex,
    "unpivot_multi": q_unpivot_multi,
    "pivot_fill_zero": q_pivot_fill_zero,
    "bin_labels": q_bin_labels,
    "island_sites": q_island_sites,
    "recode_map": q_recode_map,
    "category_order": q_category_order,
    "size_freq_one_site": q_size_freq_one_site,
    "size_freq_one_year": q_size_freq_one_year,
    "sapling_density_one_species": q_sapling_density_one_species,
    "natural_full_join_n": q_natural_full_join_n,
    "pivot_no_fill": q_pivot_no_fill,
    "pivot_several_values": q_pivot_several_values,
    "unpivot_list": q_unpivot_list,
    "report_order": q_report_order,
    "levels_of_stems": q_levels_of_stems,
    "merged_states": q_merged_states,
    "island_by_year": q_island_by_year,
    "exact_basal_area": q_exact_basal_area,
    "exact_tree_height": q_exact_tree_height,
    "exact_water_quality": q_exact_water_quality,
    "exact_water_table": q_exact_water_table,
}

# The rule-heavy analyses again on the sparse layout of the same whole tables
# (Site = part, Plot = order): species absent from plots (zero fill), sites
# without one of the change years, single-plot sites (SE missing), sites on
# several islands.
SPARSE = ("tree_measurement_table", "species_contribution_alive", "species_contribution_dead",
          "mean_stem_density", "pct_basal_change", "basal_change", "basal_change_dead",
          "height_change", "density_change", "natural_full_join", "canopy_table",
          "seedling_table", "sapling_table", "site_island_conflicts", "seedling_density",
          "sapling_density", "left_join_zero_fill", "debris_box", "pivot_fill_zero", "unpivot_multi",
          "coarse_volume", "total_debris", "natural_full_join_n", "exact_basal_area", "exact_tree_height",
          "island_by_year", "merged_states")


def _on_sparse(fn: Query) -> Query:
    def q(spark: SparkSession, root: str) -> DataFrame:
        return fn(spark, root, "sparse")
    q.__doc__ = f"{fn.__name__} on the sparse layout (Site = part, Plot = order)."
    return q


QUERIES.update({f"{k}_sparse": _on_sparse(QUERIES[k]) for k in SPARSE})
