"""

Reading with a declared schema avoids an inference pass over the files and
fails fast when a column is missing. ``Plot`` and ``Quadrat`` are strings in
field sheets; the operators accept any key type.
"""

from __future__ import annotations

from pyspark.sql import types as T

from ..fixed import COVER_TYPES, SHEET_HEADERS

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_DIRS = ("N", "S", "E", "W")
_COVER = COVER_TYPES
# Count columns in the order of the field sheet.
_SPECIES = ("RHMA", "LARA", "AVGE")

SCHEMAS: dict[str, T.StructType] = {
    "tree_measurements": _struct(("SY", _I), ("Island", _S), ("Site", _S), ("Plot", _S),
                                 ("Species", _S), ("Mortality", _S), ("DBH_cm", _D)),
    "tree_heights": _struct(("SY", _I), ("Site", _S), ("Plot", _S), ("Species", _S),
                            ("Tree_Height_m", _D)),
    "coordinates": _struct(("Island", _S), ("Site", _S), ("Forest_type", _S),
                           ("Latitude", _D), ("Longitude", _D)),
    "densiometer": _struct(("Island", _S), ("Site", _S), ("Plot", _S), ("SY", _I),
                           *[(f"Calc_{d}_{c}", _S) for d in _DIRS for c in _COVER]),
    "regeneration": _struct(("SY", _I), ("Site", _S), ("Plot", _S), ("Quadrat", _S),
                            *[(f"{s}_{st}", _D) for s in _SPECIES for st in ("seedlings", "saplings")],
                            ("Tall_seedling_cm", _D)),
    "sapling": _struct(("SY", _I), ("Site", _S), ("Plot", _S), ("Quadrat", _S),
                       ("Species", _S), ("Height_cm", _D)),
    "ysi": _struct(("SY", _I), ("Site", _S), ("Plot", _S), ("Water_depth", _D), ("Temp", _D),
                   ("DO_mg_L", _D), ("Salinity_ppt", _D), ("TDS", _D)),
    "wood": _struct(("SY", _I), ("Date", _S), ("Island", _S), ("Site", _S), ("Plot", _S),
                    ("Transect_num", _I), ("Transect_m", _D), ("Azimuth_degree", _I),
                    ("Wood_fine_num", _I), ("Wood_med_num", _I), ("Wood_coarse_num", _I),
                    ("Wood_fine_vol", _D), ("Wood_med_vol", _D), ("Wood_coarse_vol", _D),
                    ("Notes", _S)),
    "coarse_wood": _struct(("SY", _I), ("Site", _S), ("Plot", _S), ("Transect_num", _I),
                           ("Decay_class", _S), ("DBH_cm", _D)),
}

# Sheet headers that differ from the declared names, by table.
ALIASES: dict[str, dict[str, str]] = SHEET_HEADERS

# Columns the analyses read; a table lacking one of these is rejected on read.
# Other declared columns (dates, notes, empty volume fields) are optional.
REQUIRED: dict[str, tuple[str, ...]] = {
    "tree_measurements": ("SY", "Site", "Plot", "Species", "Mortality", "DBH_cm"),
    "tree_heights": ("SY", "Site", "Plot", "Species", "Tree_Height_m"),
    "coordinates": ("Island", "Site", "Forest_type", "Latitude", "Longitude"),
    "densiometer": ("Island", "Site", "Plot", "SY"),
    "regeneration": ("SY", "Site", "Plot", "Quadrat", "Tall_seedling_cm"),
    "sapling": ("SY", "Site", "Plot", "Quadrat", "Species", "Height_cm"),
    "ysi": ("SY", "Site", "Plot", "Water_depth", "Temp", "DO_mg_L", "Salinity_ppt", "TDS"),
    "wood": ("SY", "Island", "Site", "Plot", "Transect_num", "Transect_m", "Wood_fine_num",
             "Wood_med_num", "Wood_coarse_num"),
    "coarse_wood": ("SY", "Site", "Plot", "Transect_num", "Decay_class", "DBH_cm"),
}
