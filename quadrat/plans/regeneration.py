"""Seedlings and saplings.

Inputs: ``regeneration`` (SY, Site, Plot, Quadrat, ``{SP}_{seedlings,saplings}``
counts, Tall_seedling_cm), ``sapling`` (SY, Site, Plot, Quadrat, Species,
Height_cm) and ``densiometer`` (only its Island/Site pairs are used).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import COUNT_PATTERN, ISLAND_ORDER, SPECIES, SPECIES_NAMES
from ..functions.forestry import inverse_rescale, rescale
from ..functions.nulls import mean_strict, std_error, sum0
from ..functions.text import pm_text, round_half_even
from ..operators.aggregate import with_global_stats
from ..operators.join import natural_join
from ..operators.recode import category_rank, distinct_pairs, label_of
from ..operators.reshape import columns_matching, unpivot_multi, unpivot_regex
from ..session import spread


def counts_long(regen: DataFrame, stage: str, ids=("SY", "Site", "Plot", "Quadrat")) -> DataFrame:
    """One row per (quadrat, species) count of one stage.

    The stage filter of the reference is applied to the column names, so only
    that stage's columns are unpivoted.
    """
    cols = [c for c in columns_matching(regen, COUNT_PATTERN) if c.endswith("_" + stage)]
    long = unpivot_regex(regen, list(ids), cols, COUNT_PATTERN, ["Species", "Stage"],
                         "Count", value_type="double")
    return long


def island_sites(densio: DataFrame) -> DataFrame:
    """The Island/Site pairs (``group_by(Island) reframe(unique(Site))``)."""
    return distinct_pairs(densio, ["Island", "Site"])


def _with_island(df: DataFrame, densio: DataFrame,
                 island_order=ISLAND_ORDER) -> DataFrame:
    """J4 + O2: attach the island and its chart order. A site listed under two
    islands appears twice, as a left join does."""
    j = natural_join(df, island_sites(densio), "left", on=["Site"])
    return j.withColumn("Island_rank", category_rank("Island", island_order))


def seedling_site_stats(regen: DataFrame) -> DataFrame:
    """Per (SY, Site): seedling density mean/SE with missing counts propagating
    (N3), and the mean tallest-seedling height.

    The reference builds these as two tables (seedling counts made long, and
    heights) and full-joins them on (SY, Site); both cover exactly the plots of
    the regeneration table, so here they are one two-level aggregate of the wide
    rows - one scan and two shuffles instead of two of each plus a join. A
    plot's density is the mean over all its (quadrat, species) cells, missing
    as soon as one cell is missing.
    """
    cells = [c for c in columns_matching(regen, COUNT_PATTERN) if c.endswith("_seedlings")]
    vals = [F.col(c).cast("double") for c in cells]
    row_sum = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in vals])
    row_present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in vals])
    plot = regen.groupBy("SY", "Site", "Plot").agg(
        F.sum(row_sum).alias("__s"), F.sum(row_present).alias("__k"),
        (F.count(F.lit(1)) * F.lit(len(cells))).alias("__n"),
        F.avg("Tall_seedling_cm").alias("height_plot"))
    mean_plot = F.when(F.col("__k") == F.col("__n"),
                       F.try_divide(F.col("__s"), F.col("__n").cast("double")))
    plot = plot.select("SY", "Site", "Plot", mean_plot.alias("mean_plot"), "height_plot")
    return plot.groupBy("SY", "Site").agg(
        F.lit("seedlings").alias("Stage"),
        mean_strict("mean_plot").alias("mean_site"),
        std_error("mean_plot").alias("count_SE"),
        F.avg("height_plot").alias("height_site"))


def _seedling_chart(regen: DataFrame, densio: DataFrame, island_order) -> DataFrame:
    """Site stats with island, plus the one-row axis ranges of the chart."""
    c = _with_island(seedling_site_stats(regen), densio, island_order)
    return with_global_stats(c, [
        F.min("height_site").alias("__min_h"), F.max("height_site").alias("__max_h"),
        F.min("mean_site").alias("__min_m"),
        (F.max("mean_site") + F.max("count_SE")).alias("__max_m")])


def _axis(g: DataFrame):
    return F.col("__min_h"), F.col("__max_h"), F.col("__min_m"), F.col("__max_m")


def seedling_density(regen: DataFrame, densio: DataFrame,
                     island_order=ISLAND_ORDER) -> DataFrame:
    """Chart data of seedling density with the tallest-seedling height
    rescaled onto the density axis (M15 over all rows, J7)."""
    g = _seedling_chart(regen, densio, island_order)
    return g.select(
        "SY", "Site", "Stage", "mean_site", "count_SE", "height_site", "Island", "Island_rank",
        rescale("height_site", *_axis(g)).alias("height_rescaled"),
        F.col("mean_site").alias("ymin"),
        (F.col("mean_site") + F.col("count_SE")).alias("ymax"))


def seedling_axis(regen: DataFrame, densio: DataFrame,
                  island_order=ISLAND_ORDER) -> DataFrame:
    """M15 both ways (J7): the tallest-seedling height put on the density axis
    and read back through the secondary-axis transform of the chart (same
    one-row axis ranges for both directions)."""
    g = _seedling_chart(regen, densio, island_order)
    r = rescale("height_site", *_axis(g))
    # The density columns are kept: they are the axis the heights map onto, and
    # with them both branches of the plan read the same (shared) aggregate.
    return g.select("SY", "Site", "Stage", "Island", "mean_site", "count_SE", "height_site",
                    r.alias("height_rescaled"), inverse_rescale(r, *_axis(g)).alias("height_axis"))


def _stage_columns(regen: DataFrame, stage: str) -> dict[str, str]:
    """Species and its count column of one stage, as far as the table has them."""
    return {sp: f"{sp}_{stage}" for sp in SPECIES if f"{sp}_{stage}" in regen.columns}


def sapling_plots(regen: DataFrame) -> DataFrame:
    """A11 levels 1-2 on wide rows: quadrat sums, then the plot mean of each
    species (a column each) - no row per species before the aggregates.

    Where plots are small, no level shrinks the rows much, and a task would hold a hash
    map of its rows for each of them. So the rows go to their plot once, in as many
    parts as the session has shuffle partitions (adaptive execution would join parts
    again by their compressed bytes); both levels, and the partial aggregate of a
    next one, then run on one such part."""
    cols = _stage_columns(regen, "saplings")
    rows = spread(regen.select("SY", "Site", "Plot", "Quadrat", *cols.values()), "SY", "Site", "Plot")
    q = rows.groupBy("SY", "Site", "Plot", "Quadrat").agg(
        F.count(F.lit(1)).alias("rows"), *[sum0(F.col(c).cast("double")).alias(sp) for sp, c in cols.items()])
    return q.groupBy("SY", "Site", "Plot").agg(
        F.count(F.lit(1)).alias("quadrats"), *[F.avg(sp).alias(f"{sp}_dens") for sp in cols], *[std_error(sp).alias(f"{sp}_se") for sp in cols])


def sapling_plot_density(regen: DataFrame) -> DataFrame:
    """Sapling density per plot and species, long (from the few plot rows)."""
    cols = _stage_columns(regen, "saplings")
    return sapling_plots(regen).select("SY", "Site", "Plot", F.inline(F.array(*[F.struct(
        F.lit(sp).alias("Species"), F.col(f"{sp}_dens").alias("plot_dens"), F.col(f"{sp}_se").alias("plot_dens_SE"))
        for sp in cols])))


def sapling_site_stats(regen: DataFrame, sapling: DataFrame, densio: DataFrame,
                       island_order=ISLAND_ORDER) -> DataFrame:
    """D7 before the species filter: density and height per (SY, Site, Species)
    with island and the height rescaled over all species (M15, J7)."""
    a = sapling_plot_density(regen)
    quad = sapling.groupBy("SY", "Site", "Plot", "Quadrat", "Species").agg(F.avg("Height_cm").alias("quad_ht"))
    b = (spread(quad, "SY", "Site", "Plot", "Species")      # as for the counts, see sapling_plots
         .groupBy("SY", "Site", "Plot", "Species").agg(F.avg("quad_ht").alias("plot_ht")))
    c = natural_join(a, b, "left", on=["SY", "Site", "Plot", "Species"])   # J3
    c = c.groupBy("SY", "Site", "Species").agg(
        F.avg("plot_dens").alias("mean_dens"), std_error("plot_dens").alias("mean_dens_SE"),
        F.avg("plot_ht").alias("mean_ht"))
    c = _with_island(c, densio, island_order)
    g = with_global_stats(c, [
        F.min("mean_ht").alias("__min_h"), F.max("mean_ht").alias("__max_h"),
        F.min("mean_dens").alias("__min_m"),
        (F.max("mean_dens") + F.max("mean_dens_SE")).alias("__max_m")])
    return g.select(
        "SY", "Site", "Species", label_of("Species", SPECIES_NAMES).alias("Species_name"),
        "mean_dens", "mean_dens_SE", "mean_ht", "Island", "Island_rank",
        rescale("mean_ht", F.col("__min_h"), F.col("__max_h"),
                F.col("__min_m"), F.col("__max_m")).alias("height_rescaled"))


def sapling_density(regen: DataFrame, sapling: DataFrame, species: str,
                    densio: DataFrame, island_order=ISLAND_ORDER) -> DataFrame:
    """Sapling chart data of one species; the axis rescale uses every
    species, as the reference computes it before filtering."""
    return (sapling_site_stats(regen, sapling, densio, island_order)
            .where(F.col("Species") == F.lit(species)))


def _species_report(plots: DataFrame, value: dict[str, str]) -> DataFrame:
    """``mean ± SE`` over plots, one column per species; a species without a
    column prints as missing."""
    out = []
    for sp in SPECIES:
        if sp in value:
            out += [F.avg(value[sp]).alias(f"{sp}_mean"), std_error(value[sp]).alias(f"{sp}_SE")]
        else:
            out += [F.lit(None).cast("double").alias(f"{sp}_{x}") for x in ("mean", "SE")]
    w = plots.groupBy("SY", "Site").agg(*out)
    num = [f"{sp}_{x}" for sp in SPECIES for x in ("mean", "SE")]
    w = w.withColumns({c: round_half_even(c, 1) for c in num})
    # O1: presentation order of the report (a small, final sort).
    return w.select("SY", "Site", *[pm_text(f"{sp}_mean", f"{sp}_SE").alias(sp)
                                    for sp in SPECIES]).orderBy("Site", "SY")


def sapling_table(regen: DataFrame) -> DataFrame:
    """Sapling density ``mean ± SE`` per species (absent species -> NA)."""
    return _species_report(sapling_plots(regen),
                           {sp: f"{sp}_dens" for sp in _stage_columns(regen, "saplings")})


def seedling_table(regen: DataFrame) -> DataFrame:
    """Seedling density ``mean ± SE`` per species; missing counts ignored."""
    cols = _stage_columns(regen, "seedlings")
    plots = regen.groupBy("SY", "Site", "Plot").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(c).cast("double")).alias(sp) for sp, c in cols.items()])
    return _species_report(plots, {sp: sp for sp in cols})


def counts_by_species(regen: DataFrame) -> DataFrame:
    """``names_to = c("Species", ".value")`` - one row per quadrat and
    species with a ``seedlings`` and a ``saplings`` column."""
    return unpivot_multi(regen, ["SY", "Site", "Plot", "Quadrat"], COUNT_PATTERN,
                         value_group=2, name_to="Species")
