"""Water quality (D20 means, D10 report)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_mean
from ..functions.text import pm_text, round_half_even
from ..operators.aggregate import nested_mean_se

# measure column -> (plot column, site mean name, site SE name); fixed names.
MEASURES = {
    "Water_depth": ("plot_depth", "mean_depth", "mean_depth_SE"),
    "Temp": ("plot_temp", "mean_temp", "mean_temp_SE"),
    "DO_mg_L": ("plot_DO", "mean_DO", "mean_DO_SE"),
    "Salinity_ppt": ("plot_SAL", "mean_SAL", "mean_SAL_SE"),
    "TDS": ("plot_TDS", "mean_TDS", "mean_TDS_SE"),
}


def mean_water_quality(ysi: DataFrame, exact: bool = False) -> DataFrame:
    """Five measures, plot means then site mean and SE - all in one
    two-level aggregate (one pass per level, whatever the number of measures).
    With ``exact`` the bits do not depend on partitioning."""
    mean = exact_mean if exact else F.avg
    return nested_mean_se(
        ysi, ["SY", "Site"], ["Plot"],
        {p: mean(m) for m, (p, _, _) in MEASURES.items()},
        {p: (mn, se) for _, (p, mn, se) in MEASURES.items()}, exact=exact)


def water_table(ysi: DataFrame, exact: bool = False) -> DataFrame:
    """``mean ± SE`` text; salinity and TDS rounded to whole numbers after
    the first rounding to one digit (as the reference rounds twice)."""
    a = mean_water_quality(ysi, exact)
    num = [c for _, (_, mn, se) in MEASURES.items() for c in (mn, se)]
    a = a.withColumns({c: round_half_even(c, 1, not exact) for c in num})
    a = a.withColumns({c: round_half_even(c, 0, not exact) for c in
                       ("mean_SAL", "mean_SAL_SE", "mean_TDS", "mean_TDS_SE")})
    return a.select("SY", "Site",
                    pm_text("mean_depth", "mean_depth_SE").alias("Depth"),
                    pm_text("mean_temp", "mean_temp_SE").alias("Temp"),
                    pm_text("mean_DO", "mean_DO_SE").alias("DO"),
                    pm_text("mean_SAL", "mean_SAL_SE").alias("SAL"),
                    pm_text("mean_TDS", "mean_TDS_SE").alias("TDS"))
