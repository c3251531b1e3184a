"""Woody debris: cleaning, counts, line-intersect volume and mass, summaries
(D23-D27).

Inputs: ``wood`` - one row per transect (SY, Island, Site, Plot,
Transect_num, Transect_m, Wood_fine_num, Wood_med_num, Wood_coarse_num) - and
``coarse_wood`` - one row per coarse piece (SY, Site, Plot, Transect_num,
Decay_class, DBH_cm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (DECAY_CLASSES, DECAY_DENSITY, DECAY_RECODE, FINE_DIAMETER_M, FINE_END_M,
                     FINE_START_M, INVALID_DECAY, MEAN_SEM_PATTERN, MEDIUM_DIAMETER_M, MEDIUM_END_M,
                     MEDIUM_START_M, SMALL_DENSITY, WHISKER_COEF)
from ..functions.forestry import count_volume, line_intersect_volume, sampled_length
from ..functions.nulls import mean_strict, std_error
from ..functions.text import join_keys
from ..operators.join import left_join_fill
from ..operators.quantiles import box_summary
from ..operators.recode import recode
from ..operators.reshape import unpivot_multi

TRANSECT = ["SY", "Site", "Plot", "Transect_num"]


def decay_invalid(coarse: DataFrame) -> DataFrame:
    """The pieces whose decay class is the invalid 'T' (quality check)."""
    return coarse.where(F.col("Decay_class") == INVALID_DECAY)


def decay_clean(coarse: DataFrame) -> DataFrame:
    """Drop 'T' (and missing classes, as ``!=`` does), keep the first class
    of a double entry (M6)."""
    return (coarse.where(F.col("Decay_class") != INVALID_DECAY)
            .withColumn("Decay_class", recode("Decay_class", DECAY_RECODE)))


def decay_recoded(coarse: DataFrame) -> DataFrame:
    """M6 alone: every piece with its raw and recoded class."""
    return coarse.select(*TRANSECT, F.col("Decay_class").alias("Decay_class_raw"),
                         recode("Decay_class", DECAY_RECODE).alias("Decay_class"))


def coarse_counts_class(coarse: DataFrame) -> DataFrame:
    """Clean pieces per (SY, Site, Plot, Decay_class) with the
    ``Site Plot`` label (M9)."""
    return (decay_clean(coarse).groupBy("SY", "Site", "Plot", "Decay_class")
            .agg(F.count(F.lit(1)).alias("N"))
            .withColumn("Site_Plot", join_keys("Site", "Plot")))


def coarse_counts_plot(coarse: DataFrame) -> DataFrame:
    """Clean pieces per (SY, Site, Plot)."""
    return decay_clean(coarse).groupBy("SY", "Site", "Plot").agg(F.count(F.lit(1)).alias("N"))


def coarse_d2(coarse: DataFrame) -> DataFrame:
    """A8 + R5: sum of squared diameters (m^2) per transect, one column per class."""
    d = F.col("DBH_cm") / F.lit(100.0)
    square = F.coalesce(d * d, F.lit(0.0))
    # One aggregate per transect, a conditional sum per class: NULL where the
    # transect has no piece of the class, 0 where none of its diameters is known.
    return decay_clean(coarse).groupBy(*TRANSECT).agg(
        *[F.sum(F.when(F.col("Decay_class") == c, square)).alias(c) for c in DECAY_CLASSES])


def coarse_merge(wood: DataFrame, coarse: DataFrame) -> DataFrame:
    """Every transect with its coarse sums; a transect without coarse
    pieces gets 0, not a missing row. The length is never zero-filled (B11)."""
    w = wood.select(*TRANSECT, "Transect_m", "Wood_fine_num", "Wood_med_num")
    return left_join_fill(w, coarse_d2(coarse), TRANSECT,
                          [*DECAY_CLASSES, "Wood_fine_num", "Wood_med_num"])


def coarse_volume(wood: DataFrame, coarse: DataFrame) -> DataFrame:
    """Volume (m^3/ha) and mass (t/ha) per decay class and in total."""
    m = coarse_merge(wood, coarse)
    vols = {f"{c}Vol_ha": line_intersect_volume(F.col(c), F.col("Transect_m"))
            for c in DECAY_CLASSES}
    m = m.withColumns(vols)
    mass = {f"BM{c}": F.col(f"{c}Vol_ha") * F.lit(DECAY_DENSITY[c]) for c in DECAY_CLASSES}
    m = m.withColumns(mass)
    return m.withColumns({
        "CoarseMass": F.col("BMI") + F.col("BMS") + F.col("BMR"),
        "CoarseVol": F.col("IVol_ha") + F.col("SVol_ha") + F.col("RVol_ha"),
    })


def total_debris(wood: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fine and medium volume from counts over the sampled lengths, their
    mass, and total mass / volume per transect."""
    c = coarse_volume(wood, coarse)
    c = c.withColumns({
        "Fine_m": sampled_length("Transect_m", FINE_START_M, FINE_END_M),
        "Med_m": sampled_length("Transect_m", MEDIUM_START_M, MEDIUM_END_M),
    })
    c = c.withColumns({
        "FVol": count_volume("Wood_fine_num", FINE_DIAMETER_M, F.col("Fine_m")),
        "MVol": count_volume("Wood_med_num", MEDIUM_DIAMETER_M, F.col("Med_m")),
    })
    c = c.withColumns({"FMass": F.col("FVol") * F.lit(SMALL_DENSITY),
                       "MMass": F.col("MVol") * F.lit(SMALL_DENSITY)})
    return c.withColumns({
        "TotalMass": F.col("FMass") + F.col("MMass") + F.col("CoarseMass"),
        "TotalVolume": F.col("FVol") + F.col("MVol") + F.col("CoarseVol"),
    })


def debris_box(wood: DataFrame, coarse: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Box-plot statistics of TotalMass and TotalVolume per (SY, Site),
    long by ``measure``. ``total`` passes :func:`total_debris` where it has been
    computed already."""
    t = total_debris(wood, coarse) if total is None else total
    long = t.select(*TRANSECT, F.inline(F.array(
        F.struct(F.lit("TotalMass").alias("measure"), F.col("TotalMass").alias("v")),
        F.struct(F.lit("TotalVolume").alias("measure"), F.col("TotalVolume").alias("v")))))
    return box_summary(long, ["SY", "Site", "measure"], "v", coef=WHISKER_COEF, row_key=["Plot", "Transect_num"])


def debris_mean_sem(wood: DataFrame, coarse: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Diverging chart data - coarse volume up, small (fine + medium)
    volume down: per (SY, Site, type) ``Mean`` (negated for Fine) and ``SEM``."""
    t = (total_debris(wood, coarse) if total is None else total).withColumn("SmallVol", F.col("FVol") + F.col("MVol"))
    s = t.groupBy("SY", "Site").agg(
        mean_strict("CoarseVol").alias("MeanCoarse"),
        (-mean_strict("SmallVol")).alias("MeanFine"),
        std_error("CoarseVol").alias("SEMCoarse"),
        std_error("SmallVol").alias("SEMFine"))
    return unpivot_multi(s, ["SY", "Site"], MEAN_SEM_PATTERN, value_group=1,
                         name_to="type")


def debris_counts(wood: DataFrame) -> DataFrame:
    """Per (Island, Site, SY): mean and SE of the three counts and the
    surveyed length (a plain sum: one missing length makes it missing)."""
    def strict_sum(c):
        return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    return wood.groupBy("Island", "Site", "SY").agg(
        mean_strict("Wood_fine_num").alias("meanFine"), std_error("Wood_fine_num").alias("SEMFine"),
        mean_strict("Wood_med_num").alias("meanMedium"), std_error("Wood_med_num").alias("SEMMedium"),
        mean_strict("Wood_coarse_num").alias("meanCourse"), std_error("Wood_coarse_num").alias("SEMCourse"),
        strict_sum("Transect_m").cast("double").alias("sumSurveyed"))


def site_island_conflicts(wood: DataFrame) -> DataFrame:
    """Data check: sites recorded under more than one island (a lookup join
    by Site would fan out for them)."""
    pairs = wood.select("Site", "Island").distinct()
    return (pairs.groupBy("Site").agg(F.count(F.lit(1)).alias("n_islands"),
                                      F.min("Island").alias("first_island"),
                                      F.max("Island").alias("last_island"))
            .where(F.col("n_islands") > 1))
