"""Site coordinates (D21) and the change-map layer data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (DENSITY_RADIUS_DIVISOR, FOREST_TYPE_LAYER, FOREST_TYPE_RADIUS, LAYERS,
                     POPUP_CHANGE, POPUP_FOREST, POPUP_SITE, RADIUS_OFFSET, RADIUS_SCALE)
from ..functions.nulls import mean_strict
from ..functions.text import round_half_even, sign_label
from ..operators.join import natural_full_join, natural_join
from . import trees as T


def site_coordinates(coords: DataFrame) -> DataFrame:
    """One row per (Island, Site): forest type and mean position.

    ``first(Forest type)`` depends on row order in R; ``min`` is the
    deterministic choice (sites have one type). Means propagate missing (N3).
    """
    return coords.groupBy("Island", "Site").agg(
        F.min("Forest_type").alias("Typology"),
        mean_strict("Latitude").alias("Latitude"),
        mean_strict("Longitude").alias("Longitude"))


def tree_changes(trees: DataFrame, start=T.START_YEAR, end=T.END_YEAR,
                 plots: DataFrame | None = None) -> DataFrame:
    """D17 (alive, dead) and D19 by Site from ONE scan of the tree table.

    Same rows and values as full-joining the three change tables: a site gets
    ``total_change``/``stem_density_change`` only if it has living plots in
    some year (else NULL), ``total_change_dead`` only if it has dead plots in a
    known year; an absent year counts 0 (B8). Three levels of partial
    aggregates (plot, site-year, site); no join.
    """
    plot = T.tree_plots(trees) if plots is None else plots
    has_a, has_d = F.col("n_alive") > 0, (F.col("n_dead") > 0) & F.col("SY").isNotNull()
    sy = plot.groupBy("SY", "Site").agg(
        F.count(F.when(has_a, F.lit(1))).alias("p_a"),
        F.count(F.when(has_d, F.lit(1))).alias("p_d"),
        F.coalesce(F.avg(F.when(has_a, F.col("basal_alive"))), F.lit(0.0)).alias("m_a"),
        F.coalesce(F.avg(F.when(has_d, F.col("basal_dead"))), F.lit(0.0)).alias("m_d"),
        F.avg(F.when(has_a, F.col("n_alive") / F.lit(T.PLOT_AREA_HA))).alias("dens"))

    def at(year, present: str, value: str):
        return F.coalesce(F.max(F.when((F.col("SY") == F.lit(year)) & (F.col(present) > 0),
                                       F.col(value))), F.lit(0.0))

    def change(present: str, value: str):
        d = at(end, present, value) - at(start, present, value)
        return F.when(F.count(F.when(F.col(present) > 0, F.lit(1))) > 0, F.coalesce(d, F.lit(0.0)))

    return sy.groupBy("Site").agg(
        change("p_a", "m_a").alias("total_change"),
        change("p_d", "m_d").alias("total_change_dead"),
        change("p_a", "dens").alias("stem_density_change"))


def site_changes(trees: DataFrame, heights: DataFrame, start=T.START_YEAR,
                 end=T.END_YEAR, plots: DataFrame | None = None,
                 mean_heights: DataFrame | None = None) -> DataFrame:
    """``Reduce(merge(all = TRUE))`` of the four change tables by Site.

    The three tree-based changes come from one scan (:func:`tree_changes`);
    only the height change (another table) is joined, null-safe on Site.
    """
    t = tree_changes(trees, start, end, plots)
    h = T.height_change(heights, start, end, mean_heights)
    j = natural_full_join([t, h])
    return j.select("Site", "total_change", "total_change_dead", "height_change",
                    "stem_density_change")


def _num2(x: Column) -> Column:
    """``round(x, 2)`` as R's ``paste0`` prints it (12, 1.5, -0.25, NA)."""
    t = round_half_even(x, 2).cast("decimal(38,2)").cast("string")
    t = F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")
    t = F.when(t == "-0", F.lit("0")).otherwise(t)
    return F.coalesce(t, F.lit("NA"))


def _txt(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("NA"))



def change_map_layers(trees: DataFrame, heights: DataFrame, coords: DataFrame,
                      start=T.START_YEAR, end=T.END_YEAR,
                      plots: DataFrame | None = None, mean_heights: DataFrame | None = None) -> DataFrame:
    """One row per (layer, site): position, value, direction, radius, popup.

    Radius ``(|change| + 5) * 75`` m; density ``|change| / 3``; the forest type
    layer a fixed 10. Direction 'pos' for change > 0, else 'neg' (0 is 'neg').
    The five layers come from one ``inline`` over the joined site table.
    """
    data = natural_join(site_changes(trees, heights, start, end, plots, mean_heights),
                        site_coordinates(coords), "left", on=["Site"])
    site_txt = F.concat(F.lit(POPUP_SITE), _txt(F.col("Site")))
    layers = []
    for name, col, rule in LAYERS:
        v = F.col(col)
        radius = ((F.abs(v) + F.lit(RADIUS_OFFSET)) * F.lit(RADIUS_SCALE) if rule == "scaled"
                  else F.abs(v) / F.lit(DENSITY_RADIUS_DIVISOR))
        layers.append(F.struct(
            F.lit(name).alias("layer"), v.cast("double").alias("value"),
            sign_label(v).alias("direction"), radius.alias("radius"),
            F.concat(site_txt, F.lit(POPUP_CHANGE), _num2(v)).alias("popup")))
    layers.append(F.struct(
        F.lit(FOREST_TYPE_LAYER).alias("layer"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("direction"), F.lit(FOREST_TYPE_RADIUS).alias("radius"),
        F.concat(site_txt, F.lit(POPUP_FOREST),
                 _txt(F.col("Typology"))).alias("popup")))
    return data.select("Island", "Site", "Typology", "Latitude", "Longitude",
                       F.inline(F.array(*layers)))
