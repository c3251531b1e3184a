"""

No field data of the survey's size exists, so every survey role is a lazy
DataFrame over the whole ``lineitem`` table (joined to its supplier, nation and
region), and its work grows with the data. Mapping:

    SY = year(l_shipdate)      Island = r_name       Site = n_name
    Plot = l_suppkey           Quadrat / Transect_num = l_linenumber
    Species from l_returnflag  Mortality from l_linestatus
    DBH_cm = l_quantity        (NULL where l_quantity = 1, to exercise NA rules)

Every derivation below is mirrored, independently, in ``duckdb_oracle.py``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import COVER_TYPES

# Densiometer directions of the mapped readings.
DIRECTIONS = ("N", "S", "E", "W")


def _species(flag: Column, line: Column) -> Column:
    # A -> RHMA; N -> AVGE (line 4 'UNK', line 6 missing); R -> LARA (line 3 'CONE').
    return (F.when(flag == "A", F.lit("RHMA"))
            .when((flag == "N") & (line == 4), F.lit("UNK"))
            .when((flag == "N") & (line == 6), F.lit(None).cast("string"))
            .when(flag == "N", F.lit("AVGE"))
            .when((flag == "R") & (line == 3), F.lit("CONE"))
            .when(flag == "R", F.lit("LARA")))


def _mortality(status: Column, line: Column) -> Column:
    # F -> Dead; O -> Alive, except line 2 'Dying' and line 7 the text 'NA'.
    return (F.when(status == "F", F.lit("Dead"))
            .when(line == 2, F.lit("Dying"))
            .when(line == 7, F.lit("NA"))
            .otherwise(F.lit("Alive")))


def _decay(flag: Column, line: Column) -> Column:
    # I/S/R from A/N/R plus the dirty values seen in field sheets.
    return (F.when((line == 7) & (flag == "N"), F.lit("T"))
            .when((line == 6) & (flag == "R"), F.lit("R, T"))
            .when((line == 5) & (flag == "A"), F.lit("I, T"))
            .when((line == 4) & (flag == "A"), F.lit("I, R"))
            .when(flag == "A", F.lit("I"))
            .when(flag == "N", F.lit("S"))
            .otherwise(F.lit("R")))


def _int_text(x: Column) -> Column:
    return x.cast("int").cast("string")


@dataclass
class DriverRoles:
    """Lazily built survey roles over one folder of driver tables."""

    spark: SparkSession
    root: str
    # "survey": Site = nation, Plot = supplier (dense: 25 sites, 1-10 plots).
    # "sparse": Site = part, Plot = order - the same whole table cut so that
    # plots hold one or two stems, sites miss years and sit on several
    # islands, which exercises the zero-fill, absent-year and fan-out rules.
    layout: str = "survey"

    def _t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))

    @cached_property
    def obs(self) -> DataFrame:
        """lineitem joined to its supplier's nation and region (one row per line)."""
        li = self._t("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        # Star-join order: fact to supplier first, then the tiny nation and
        # region. (Joining the dimensions to each other first makes the
        # non-CBO size estimate - a product of child sizes - look huge, and
        # the planner would broadcast lineitem instead.) No hints: supplier
        # grows with the data; AQE broadcasts it only when it is measured small.
        sup = self._t("supplier").select("s_suppkey", "s_nationkey")
        nat = self._t("nation").select("n_nationkey", "n_name", "n_regionkey")
        reg = self._t("region").select("r_regionkey", "r_name")
        o = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
             .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))
        line = F.col("l_linenumber")
        if self.layout == "sparse":
            site = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
            plot = F.col("l_orderkey")
        else:
            site, plot = F.col("n_name"), F.col("l_suppkey")
        return o.select(
            F.year("l_shipdate").alias("SY"),
            F.col("r_name").alias("Island"),
            site.alias("Site"),
            plot.alias("Plot"),
            line.alias("Line"),
            _species(F.col("l_returnflag"), line).alias("Species"),
            _mortality(F.col("l_linestatus"), line).alias("Mortality"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
        )

    # -- tree tables -------------------------------------------------------
    @property
    def trees(self) -> DataFrame:
        o = self.obs
        return o.select("SY", "Island", "Site", "Plot", "Species", "Mortality",
                        F.when(o.qty != 1.0, o.qty).alias("DBH_cm"))

    @property
    def heights(self) -> DataFrame:
        o = self.obs
        return o.select("SY", "Site", "Plot", "Species",
                        F.when(o.qty != 1.0, o.price / F.lit(1000.0)).alias("Tree_Height_m"))

    # -- canopy --------------------------------------------------------------
    @property
    def densiometer(self) -> DataFrame:
        o = self.obs
        base = {"Veg": o.qty, "Wood": F.round(o.disc * F.lit(100.0)),
                "Open": F.round(o.tax * F.lit(100.0))}
        cols = []
        for k, d in enumerate(DIRECTIONS):
            for t in COVER_TYPES:
                txt = _int_text(base[t] + F.lit(float(k)))
                if d == "N" and t == "Veg":
                    txt = F.when(o.Line == 7, F.lit("n/a")).otherwise(txt)
                cols.append(txt.alias(f"Calc_{d}_{t}"))
        return o.select("Island", "Site", "Plot", "SY", *cols)

    # -- regeneration --------------------------------------------------------
    @property
    def regeneration(self) -> DataFrame:
        o = self.obs
        flags = {"RHMA": "A", "AVGE": "N", "LARA": "R"}
        aggs = []
        for sp, fl in flags.items():
            for st, status in (("seedlings", "O"), ("saplings", "F")):
                n = F.count(F.when((o.flag == fl) & (o.status == status), F.lit(1))).cast("double")
                if sp == "AVGE" and st == "seedlings":
                    # A missing count in some quadrats (N3 propagates it).
                    n = F.when(F.min(o.qty) <= 10.0, n)
                aggs.append(n.alias(f"{sp}_{st}"))
        aggs.append(F.max(o.qty).alias("Tall_seedling_cm"))
        return (o.groupBy("SY", "Site", "Plot", F.col("Line").alias("Quadrat"))
                .agg(*aggs))

    @property
    def sapling(self) -> DataFrame:
        o = self.obs
        return (o.where(o.status == "F")
                .select("SY", "Site", "Plot", F.col("Line").alias("Quadrat"), "Species",
                        F.when(o.qty != 1.0, o.qty).alias("Height_cm")))

    # -- water ---------------------------------------------------------------
    @property
    def ysi(self) -> DataFrame:
        o = self.obs
        return o.select(
            "SY", "Site", "Plot",
            F.when(o.qty != 1.0, o.qty / F.lit(10.0)).alias("Water_depth"),
            (F.lit(20.0) + o.disc * F.lit(100.0)).alias("Temp"),
            (o.tax * F.lit(100.0)).alias("DO_mg_L"),
            (o.price / F.lit(1000.0)).alias("Salinity_ppt"),
            (o.price / F.lit(10.0)).alias("TDS"))

    # -- coordinates -----------------------------------------------------------
    @property
    def coordinates(self) -> DataFrame:
        c = self._t("customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
        n = self._t("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self._t("region").select("r_regionkey", "r_name")
        j = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
        return j.select(
            F.col("r_name").alias("Island"), F.col("n_name").alias("Site"),
            F.col("c_mktsegment").alias("Forest_type"),
            (F.lit(18.0) + F.col("c_acctbal") / F.lit(10000.0)).alias("Latitude"),
            (F.lit(-64.5) - F.abs(F.col("c_acctbal")) / F.lit(10000.0)).alias("Longitude"))

    # -- woody debris ----------------------------------------------------------
    @property
    def wood(self) -> DataFrame:
        """One row per transect (SY, Site, Plot, Transect_num) with counts."""
        o = self.obs
        return (o.groupBy("SY", "Island", "Site", "Plot", F.col("Line").alias("Transect_num"))
                .agg(F.count(F.lit(1)).alias("_n"),
                     F.count(F.when(o.qty > 25.0, F.lit(1))).alias("_med"),
                     F.count(F.when(o.qty > 45.0, F.lit(1))).alias("_coarse"))
                .select("SY", "Island", "Site", "Plot", "Transect_num",
                        (F.lit(2.5) + (F.col("_n") % 18).cast("double")).alias("Transect_m"),
                        F.col("_n").cast("int").alias("Wood_fine_num"),
                        F.col("_med").cast("int").alias("Wood_med_num"),
                        F.col("_coarse").cast("int").alias("Wood_coarse_num")))

    @property
    def coarse_wood(self) -> DataFrame:
        """Coarse pieces: one row per line with l_quantity > 45, so that some
        transects have none (the joins with ``wood`` need such)."""
        return self._pieces(F.col("qty") > 45.0)

    @property
    def coarse_all(self) -> DataFrame:
        """Coarse pieces: one row per line, for what reads only this table."""
        return self._pieces(F.lit(True))

    def _pieces(self, which: Column) -> DataFrame:
        o = self.obs
        return (o.where(which)
                .select("SY", "Site", "Plot", F.col("Line").alias("Transect_num"),
                        _decay(o.flag, o.Line).alias("Decay_class"),
                        (F.lit(7.5) + o.disc * F.lit(100.0)).alias("DBH_cm")))
