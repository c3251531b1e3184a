"""The report run - every report dataset written in one call.

The reference renders tables to PDF and charts to JPG one by one, and loops
over sites for the size-frequency figures. Here each output is the dataset
behind that table or chart, written by one distributed job; the per-site
figures are one job partitioned by Site (S4), not a loop of jobs. Drawing and
typography are out of scope (see README).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..fixed import ALL_SITES_BIN_ORIGIN, INVALID_DECAY, SITE_BIN_ORIGIN
from ..session import ensure_checkpoint_dir
from ..sources.catalog import write_table
from . import canopy, debris, regeneration, sites, trees, water

# Role tables the run reads.
INPUTS = ("tree_measurements", "tree_heights", "coordinates", "densiometer", "regeneration",
          "sapling", "ysi", "wood", "coarse_wood")

# The tables each output needs; without them it is left out.
NEEDS: dict[str, tuple[str, ...]] = {
    "tree_measurements_table": ("tree_measurements", "tree_heights"),
    "site_size_frequency": ("tree_measurements",),
    "year_size_frequency": ("tree_measurements",),
    "basal_area_change": ("tree_measurements",),
    "change_map": ("tree_measurements", "tree_heights", "coordinates"),
    "site_coordinates": ("coordinates",),
    "densiometer_table": ("densiometer",),
    "densiometer_figure": ("densiometer",),
    "seedling_figure": ("regeneration", "densiometer"),
    "sapling_figures": ("regeneration", "sapling", "densiometer"),
    "seedling_density_table": ("regeneration",),
    "sapling_density_table": ("regeneration",),
    "water_quality_table": ("ysi",),
    "woody_debris": ("wood", "coarse_wood"),
    "woody_debris_mean_sem": ("wood", "coarse_wood"),
    "woody_debris_box": ("wood", "coarse_wood"),
    "woody_debris_counts": ("wood",),
    "coarse_counts_class": ("coarse_wood",),
    "coarse_counts_plot": ("coarse_wood",),
    "check_site_islands": ("wood",),
    "check_decay_classes": ("coarse_wood",),
}

# Outputs in one folder per value of a column.
PARTITIONS = {"site_size_frequency": ["Site"], "year_size_frequency": ["SY"],
              "sapling_figures": ["Species"], "woody_debris": ["SY"]}


# What several outputs have in common: name -> (tables it is made from, how, outputs
# that read it). The islands of the sites stand in for the densiometer sheet in the
# charts that take only these from it.
LEVELS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], tuple[str, ...]]] = {
    "plots": (("tree_measurements",), trees.tree_plots,
              ("tree_measurements_table", "basal_area_change", "change_map")),
    "mean_heights": (("tree_heights",), trees.mean_tree_height, ("tree_measurements_table", "change_map")),
    "canopy": (("densiometer",), canopy.canopy_cover_wide, ("densiometer_table", "densiometer_figure")),
    "islands": (("densiometer",), regeneration.island_sites, ("seedling_figure", "sapling_figures")),
    "total": (("wood", "coarse_wood"), debris.total_debris,
              ("woody_debris", "woody_debris_mean_sem", "woody_debris_box")),
    "wood_counts": (("wood",), debris.debris_counts, ("woody_debris_counts", "check_site_islands")),
}


class SharedLevels:
    """The plan registry of a report run: a level that at least two of the wanted
    outputs read is written once, when the first of them asks for it, and released with
    the last. Others stay lazy inside the one output that reads them."""

    def __init__(self, tables: Mapping[str, DataFrame], outputs: Iterable[str], folder: str | None = None):
        self.tables, self.folder = tables, folder
        self.waiting = {name: {o for o in outputs if o in used} for name, (_, _, used) in LEVELS.items()}
        self.written: dict[str, tuple[str, DataFrame]] = {}

    def get(self, name: str, output: str) -> DataFrame | None:
        """The level for an output; None if no other one shares it."""
        if name not in self.written:
            need, make, _ = LEVELS[name]
            if len(self.waiting[name]) < 2 or any(n not in self.tables for n in need):
                return None
            level = make(*[self.tables[n] for n in need])
            spark = level.sparkSession
            path = f"{(self.folder or ensure_checkpoint_dir(spark)).rstrip('/')}/quadrat-{name}-{uuid.uuid4().hex}"
            level.write.parquet(path)
            self.written[name] = (path, spark.read.schema(level.schema).parquet(path))
        return self.written[name][1]

    def done(self, output: str) -> None:
        """An output is written: levels that nothing waits for any more are deleted."""
        for name, (_, _, used) in LEVELS.items():
            if output in used:
                self.waiting[name].discard(output)
                if not self.waiting[name] and name in self.written:
                    path, df = self.written.pop(name)
                    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
                    target = jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(conf).delete(target, True)


def _makers(t: Mapping[str, DataFrame], level: Callable[[str, str], DataFrame | None], start, end, bin_size,
            island_order) -> dict[str, Callable[[], DataFrame]]:
    def get(table: str) -> DataFrame:
        return t[table]

    def one(output: str, name: str) -> DataFrame | None:
        return level(name, output)

    def islands(output: str) -> DataFrame:
        pairs = one(output, "islands")
        return get("densiometer") if pairs is None else pairs

    def total() -> DataFrame:
        shared = one("woody_debris", "total")
        return debris.total_debris(get("wood"), get("coarse_wood")) if shared is None else shared

    def conflicts() -> DataFrame:
        # The counts have every pair of site and island: no second scan of the sheet.
        counts = one("check_site_islands", "wood_counts")
        return debris.site_island_conflicts(get("wood") if counts is None else counts)

    def counts() -> DataFrame:
        shared = one("woody_debris_counts", "wood_counts")
        return debris.debris_counts(get("wood")) if shared is None else shared

    return {
        "tree_measurements_table": lambda: trees.tree_measurement_table(
            get("tree_measurements"), get("tree_heights"), one("tree_measurements_table", "plots"),
            one("tree_measurements_table", "mean_heights")),
        "site_size_frequency": lambda: trees.size_freq_all(get("tree_measurements"), bin_size, SITE_BIN_ORIGIN),
        "year_size_frequency": lambda: trees.size_histogram(
            trees._lf_rows(get("tree_measurements")), ["SY", "Site"], ["Mortality"], "DBH_cm", bin_size, ALL_SITES_BIN_ORIGIN),
        "basal_area_change": lambda: trees.pct_basal_change(
            get("tree_measurements"), start, end, one("basal_area_change", "plots")),
        "change_map": lambda: sites.change_map_layers(
            get("tree_measurements"), get("tree_heights"), get("coordinates"), start, end, one("change_map", "plots"),
            one("change_map", "mean_heights")),
        "site_coordinates": lambda: sites.site_coordinates(get("coordinates")),
        "densiometer_table": lambda: canopy.canopy_table(get("densiometer"), one("densiometer_table", "canopy")),
        "densiometer_figure": lambda: canopy.canopy_series(get("densiometer"), one("densiometer_figure", "canopy")),
        "seedling_figure": lambda: regeneration.seedling_density(get("regeneration"), islands("seedling_figure"), island_order),
        "sapling_figures": lambda: regeneration.sapling_site_stats(
            get("regeneration"), get("sapling"), islands("sapling_figures"), island_order),
        "seedling_density_table": lambda: regeneration.seedling_table(get("regeneration")),
        "sapling_density_table": lambda: regeneration.sapling_table(get("regeneration")),
        "water_quality_table": lambda: water.water_table(get("ysi")),
        "woody_debris": total,
        "woody_debris_mean_sem": lambda: debris.debris_mean_sem(
            get("wood"), get("coarse_wood"), one("woody_debris_mean_sem", "total")),
        "woody_debris_box": lambda: debris.debris_box(get("wood"), get("coarse_wood"), one("woody_debris_box", "total")),
        "woody_debris_counts": counts,
        "coarse_counts_class": lambda: debris.coarse_counts_class(get("coarse_wood")),
        "coarse_counts_plot": lambda: debris.coarse_counts_plot(get("coarse_wood")),
        "check_site_islands": conflicts,
        "check_decay_classes": lambda: debris.decay_invalid(get("coarse_wood")),
    }


def export_report(tables: Mapping[str, DataFrame], output_dir: str, fmt: str = "parquet",
                  checkpoint_inputs: bool = False, start=trees.START_YEAR, end=trees.END_YEAR,
                  bin_size: float = 3.0, island_order=regeneration.ISLAND_ORDER,
                  only: Sequence[str] | None = None, sites_only: Sequence[str] | None = None,
                  checks: dict[str, int] | None = None) -> dict[str, str]:
    """Write every report dataset whose tables (:data:`NEEDS`) are given under
    ``output_dir``; returns name -> path. An unknown table name, or tables for
    no output at all, is an error. Levels that several outputs share
    (:data:`LEVELS`) are computed once and deleted after the last of them.

    ``checkpoint_inputs`` materialises each input role once in the session's
    shared checkpoint folder before the outputs are computed - worth it when
    the roles are themselves expensive derivations read by several outputs.
    ``only`` names the outputs wanted. ``sites_only`` writes the per-site outputs
    (:data:`PARTITIONS` by Site) of these sites anew and leaves all other files, of
    other sites and other outputs, as they are. ``checks`` receives the data checks'
    counts (rows of the coarse pieces, of those with the invalid decay class, and with a
    missing one), observed while the coarse counts are written: no scan of their own.
    """
    t = {k: df for k, df in tables.items() if df is not None}
    unknown = sorted(set(t) - set(INPUTS))
    if unknown:
        raise ValueError(f"unknown table(s) {unknown}; the report reads {list(INPUTS)}")
    wanted = [n for n, need in NEEDS.items() if all(x in t for x in need) and (only is None or n in only)]
    if sites_only is not None:
        wanted = [n for n in wanted if PARTITIONS.get(n) == ["Site"]]
        t = {k: df.where(F.col("Site").isin(list(sites_only))) if "Site" in df.columns else df for k, df in t.items()}
    if not wanted:
        raise ValueError(f"no output can be made from the tables {sorted(t)}")
    if checkpoint_inputs:
        for k, df in list(t.items()):
            ensure_checkpoint_dir(df.sparkSession)
            t[k] = df.checkpoint(eager=True)
    levels = SharedLevels(t, wanted)
    seen = None
    if checks is not None and "coarse_counts_class" in wanted:
        seen = Observation()
        observed = t["coarse_wood"].observe(
            seen, F.count(F.lit(1)).alias("coarse_pieces"),
            F.count(F.when(F.col("Decay_class") == INVALID_DECAY, 1)).alias("invalid_decay"),
            F.count(F.when(F.col("Decay_class").isNull(), 1)).alias("missing_decay"))
    paths = {}
    for name in wanted:
        own = {**t, "coarse_wood": observed} if seen is not None and name == "coarse_counts_class" else t
        make = _makers(own, levels.get, start, end, bin_size, island_order)[name]
        path = f"{output_dir.rstrip('/')}/{name}"
        write_table(make(), path, fmt=fmt, partition_by=PARTITIONS.get(name) or None, only_touched=sites_only is not None)
        levels.done(name)
        paths[name] = path
    if seen is not None:
        checks.update(seen.get)
    return paths
