"""Constants that must equal the surveyed analyses' own for the
results to match. Everything else in the library is derived from these or
passed as a parameter.
"""

# --- Fixed values (must equal the reference's) -------------------------------

# Species codes, in report column order, and their display names.
SPECIES = ("RHMA", "AVGE", "LARA")
SPECIES_NAMES = {"RHMA": "R. mangle", "AVGE": "A. germinans", "LARA": "L. racemosa"}
# Tree heights also keep unidentified stems ("UNK") and missing species.
HEIGHT_SPECIES = ("RHMA", "AVGE", "LARA", "UNK")

# Mortality classes: living (dying counts as alive), dead, and the text "NA".
ALIVE = ("Alive", "Dying")
DEAD = ("Dead",)
MORTALITY_RECODE = {"Dying": "Alive"}
MORTALITY_MISSING = "NA"

# Default change years and the island display order of the charts.
START_YEAR, END_YEAR = 2022, 2024
ISLAND_ORDER = ("St Thomas", "St John", "St Croix")

# Canopy: cover types and the reading-column pattern (direction, type).
COVER_TYPES = ("Veg", "Wood", "Open")
CALC_PATTERN = r"Calc_([NSEW])_([A-Za-z]+)"

# Regeneration: count-column pattern (species, stage).
COUNT_PATTERN = r"([A-Z]+)_(seedlings|saplings)"

# Size frequency: bin width of the dashboard, first break for one site, for
# all sites.
BIN_SIZE = 3.0
SITE_BIN_ORIGIN = 2.5
ALL_SITES_BIN_ORIGIN = 0.0

# Plot area (ha) of basal area and stem density; m^2 per hectare.
PLOT_AREA_HA = 0.01
M2_PER_HA = 10000.0

# Woody debris: wood densities (t/m^3) of decay classes sound I,
# intermediate S, rotten R; of fine and medium pieces; assumed diameters (m)
# of fine and medium pieces; sampled stretch (m) of each.
DECAY_DENSITY = {"I": 0.35, "S": 0.5, "R": 0.2}
SMALL_DENSITY = 0.5
FINE_DIAMETER_M = 0.005
MEDIUM_DIAMETER_M = 0.0425
FINE_START_M, FINE_END_M = 2.0, 4.0
MEDIUM_START_M, MEDIUM_END_M = 2.0, 6.0

# Decay classes: the invalid class, the recode of double entries, report order.
INVALID_DECAY = "T"
DECAY_RECODE = {"R, T": "R", "I, T": "I", "I, R": "I"}
DECAY_CLASSES = ("I", "S", "R")

# Box plots: whiskers reach 1.5 IQR beyond the box.
WHISKER_COEF = 1.5

# Change map: layers (name, change column, radius rule), radius constants
# ((|change| + 5) * 75 m; stem density |change| / 3; forest type 10).
LAYERS = (
    ("Living Basal Change", "total_change", "scaled"),
    ("Dead Basal Change", "total_change_dead", "scaled"),
    ("Tree Height Change", "height_change", "scaled"),
    ("Stem Density Change", "stem_density_change", "third"),
)
RADIUS_OFFSET, RADIUS_SCALE, DENSITY_RADIUS_DIVISOR = 5.0, 75.0, 3.0
FOREST_TYPE_LAYER, FOREST_TYPE_RADIUS = "Forest Type", 10.0

# Cell texts that mean "missing": in exported CSV sheets, in worksheets.
MISSING_CSV = ("", "NA")
MISSING_SHEET = ("",)

# Sheet headers and the column names used here.
SHEET_HEADERS = {"coordinates": {"Forest type": "Forest_type"}}

# Text of the map popups.
POPUP_SITE = "<strong>Site:</strong> "
POPUP_CHANGE = "<br><strong>Change:</strong> "
POPUP_FOREST = "<br><strong>Forest Type:</strong> "

# Column names of the debris means and their errors.
MEAN_SEM_PATTERN = r"(Mean|SEM)(Coarse|Fine)"
