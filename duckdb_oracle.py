"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the survey's semantics, not from the Spark code: role tables as
CTEs over the driver's views (lineitem, supplier, nation, region, customer),
then each analysis in plain SQL. Conventions that keep both engines on the
same numbers: decimal literals are cast to DOUBLE; ``x / NULLIF(y, 0)`` for
division (NULL instead of Inf/NaN); ``round_even`` for half-even rounding of the value
snapped to 9 decimals, and ``+ 0.0`` after it so a negative zero prints as
zero, as Spark's ``bround`` returns.
"""

from __future__ import annotations

START, END = 1996, 1998
ISLAND_ORDER = ("ASIA", "EUROPE", "AMERICA")

ROLES_TEMPLATE = r"""
obs AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS SY, r.r_name AS Island, {SITE} AS Site,
         {PLOT} AS Plot, l.l_linenumber AS Line,
         CASE WHEN l.l_returnflag = 'A' THEN 'RHMA'
              WHEN l.l_returnflag = 'N' AND l.l_linenumber = 4 THEN 'UNK'
              WHEN l.l_returnflag = 'N' AND l.l_linenumber = 6 THEN NULL
              WHEN l.l_returnflag = 'N' THEN 'AVGE'
              WHEN l.l_returnflag = 'R' AND l.l_linenumber = 3 THEN 'CONE'
              WHEN l.l_returnflag = 'R' THEN 'LARA' END AS Species,
         CASE WHEN l.l_linestatus = 'F' THEN 'Dead'
              WHEN l.l_linenumber = 2 THEN 'Dying'
              WHEN l.l_linenumber = 7 THEN 'NA'
              ELSE 'Alive' END AS Mortality,
         l.l_quantity AS qty, l.l_extendedprice AS price, l.l_discount AS disc, l.l_tax AS tax,
         l.l_returnflag AS flag, l.l_linestatus AS status
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
trees AS (
  SELECT SY, Island, Site, Plot, Species, Mortality,
         CASE WHEN qty <> 1.0 THEN qty END AS DBH_cm FROM obs
),
heights AS (
  SELECT SY, Site, Plot, Species,
         CASE WHEN qty <> 1.0 THEN price / 1000.0::DOUBLE END AS Tree_Height_m FROM obs
),
densiometer AS (
  SELECT Island, Site, Plot, SY,
    CASE WHEN Line = 7 THEN 'n/a' ELSE CAST(CAST(qty + 0.0::DOUBLE AS INTEGER) AS VARCHAR) END AS Calc_N_Veg,
    CAST(CAST(round(disc * 100.0::DOUBLE) + 0.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_N_Wood,
    CAST(CAST(round(tax * 100.0::DOUBLE) + 0.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_N_Open,
    CAST(CAST(qty + 1.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_S_Veg,
    CAST(CAST(round(disc * 100.0::DOUBLE) + 1.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_S_Wood,
    CAST(CAST(round(tax * 100.0::DOUBLE) + 1.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_S_Open,
    CAST(CAST(qty + 2.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_E_Veg,
    CAST(CAST(round(disc * 100.0::DOUBLE) + 2.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_E_Wood,
    CAST(CAST(round(tax * 100.0::DOUBLE) + 2.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_E_Open,
    CAST(CAST(qty + 3.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_W_Veg,
    CAST(CAST(round(disc * 100.0::DOUBLE) + 3.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_W_Wood,
    CAST(CAST(round(tax * 100.0::DOUBLE) + 3.0::DOUBLE AS INTEGER) AS VARCHAR) AS Calc_W_Open
  FROM obs
),
regeneration AS (
  SELECT SY, Site, Plot, Line AS Quadrat,
    CAST(count(CASE WHEN flag = 'A' AND status = 'O' THEN 1 END) AS DOUBLE) AS RHMA_seedlings,
    CAST(count(CASE WHEN flag = 'A' AND status = 'F' THEN 1 END) AS DOUBLE) AS RHMA_saplings,
    CASE WHEN min(qty) <= 10.0 THEN
      CAST(count(CASE WHEN flag = 'N' AND status = 'O' THEN 1 END) AS DOUBLE) END AS AVGE_seedlings,
    CAST(count(CASE WHEN flag = 'N' AND status = 'F' THEN 1 END) AS DOUBLE) AS AVGE_saplings,
    CAST(count(CASE WHEN flag = 'R' AND status = 'O' THEN 1 END) AS DOUBLE) AS LARA_seedlings,
    CAST(count(CASE WHEN flag = 'R' AND status = 'F' THEN 1 END) AS DOUBLE) AS LARA_saplings,
    max(qty) AS Tall_seedling_cm
  FROM obs GROUP BY SY, Site, Plot, Line
),
sapling AS (
  SELECT SY, Site, Plot, Line AS Quadrat, Species,
         CASE WHEN qty <> 1.0 THEN qty END AS Height_cm
  FROM obs WHERE status = 'F'
),
ysi AS (
  SELECT SY, Site, Plot,
         CASE WHEN qty <> 1.0 THEN qty / 10.0::DOUBLE END AS Water_depth,
         20.0::DOUBLE + disc * 100.0::DOUBLE AS Temp,
         tax * 100.0::DOUBLE AS DO_mg_L,
         price / 1000.0::DOUBLE AS Salinity_ppt,
         price / 10.0::DOUBLE AS TDS
  FROM obs
),
coordinates AS (
  SELECT r.r_name AS Island, n.n_name AS Site, c.c_mktsegment AS Forest_type,
         18.0::DOUBLE + c.c_acctbal / 10000.0::DOUBLE AS Latitude,
         -64.5::DOUBLE - abs(c.c_acctbal) / 10000.0::DOUBLE AS Longitude
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
wood AS (
  SELECT SY, Island, Site, Plot, Line AS Transect_num,
         2.5::DOUBLE + CAST(count(*) % 18 AS DOUBLE) AS Transect_m,
         CAST(count(*) AS INTEGER) AS Wood_fine_num,
         CAST(count(CASE WHEN qty > 25.0 THEN 1 END) AS INTEGER) AS Wood_med_num,
         CAST(count(CASE WHEN qty > 45.0 THEN 1 END) AS INTEGER) AS Wood_coarse_num
  FROM obs GROUP BY SY, Island, Site, Plot, Line
),
coarse_wood AS (
  SELECT SY, Site, Plot, Line AS Transect_num,
         CASE WHEN Line = 7 AND flag = 'N' THEN 'T'
              WHEN Line = 6 AND flag = 'R' THEN 'R, T'
              WHEN Line = 5 AND flag = 'A' THEN 'I, T'
              WHEN Line = 4 AND flag = 'A' THEN 'I, R'
              WHEN flag = 'A' THEN 'I'
              WHEN flag = 'N' THEN 'S'
              ELSE 'R' END AS Decay_class,
         7.5::DOUBLE + disc * 100.0::DOUBLE AS DBH_cm
  FROM obs WHERE qty > 45.0
)"""
# Survey layout: Site = nation, Plot = supplier. Sparse layout of the same
# tables: Site = 'P' || part, Plot = order.
ROLES = ROLES_TEMPLATE.replace("{SITE}", "n.n_name").replace("{PLOT}", "l.l_suppkey")
ROLES_SPARSE = (ROLES_TEMPLATE.replace("{SITE}", "'P' || CAST(l.l_partkey AS VARCHAR)")
                .replace("{PLOT}", "l.l_orderkey"))
SPARSE = ("tree_measurement_table", "species_contribution_alive", "species_contribution_dead",
          "mean_stem_density", "pct_basal_change", "basal_change", "basal_change_dead",
          "height_change", "density_change", "natural_full_join", "canopy_table",
          "seedling_table", "sapling_table", "site_island_conflicts", "seedling_density",
          "sapling_density", "left_join_zero_fill", "debris_box", "pivot_fill_zero", "unpivot_multi",
          "coarse_volume", "total_debris", "natural_full_join_n", "exact_basal_area", "exact_tree_height",
          "island_by_year", "merged_states")


def BA(x: str) -> str:
    """Basal area of one stem, m^2/ha: pi * (d/100/2)^2 / 0.01."""
    r = f"({x} / 100.0::DOUBLE / 2.0::DOUBLE)"
    return f"(pi() * ({r} * {r}) / 0.01::DOUBLE)"


def SE(x: str) -> str:
    return f"(stddev_samp({x}) / sqrt(count({x})))"


def LET(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is worked out once."""
    return f"(list_transform([{value}], lambda {name}: {body})[1])"


# Sums that do not depend on the order of addition: digits of 24 bits, down to 2^-72
# (2^-120 for squares), summed as whole numbers.
def D(x: int | float) -> str:
    return f"{x!r}::DOUBLE"


def DIGITS(x: str, count: int) -> list[str]:
    r = [f"round_even({x} * {D(2.0 ** (24 * k))}, 0)" for k in range(-1, count - 1)]
    return [f"CAST({r[0]} AS BIGINT)"] + [f"CAST({b} - {a} * {D(2.0 ** 24)} AS BIGINT)" for a, b in zip(r, r[1:])]


def DIGIT_SUMS(digits: list[str]) -> list[str]:
    return [f"sum({d})::DOUBLE * {D(2.0 ** (24 - 24 * k))}" for k, d in enumerate(digits)]


def EXACT_SUM(x: str) -> str:
    out = ""
    for t in reversed(DIGIT_SUMS(DIGITS(f"({x})::DOUBLE", 5))):
        out = f"({t} + {out})" if out else t
    return out


def EXACT_AVG(x: str) -> str:
    return f"({EXACT_SUM(x)} / NULLIF(count({x}), 0))"


def HALF(a: str) -> str:
    return f"({D(2.0 ** 27 + 1)} * {a} - ({D(2.0 ** 27 + 1)} * {a} - {a}))"


def ERROR(a: str, b: str, p: str) -> str:
    """a * b - p for the rounded product p."""
    return LET(f"{{'x': {HALF(a)}, 'y': {HALF(b)}}}", "u", (
        f"((u.x * u.y - {p}) + u.x * ({b} - u.y) + ({a} - u.x) * u.y) + ({a} - u.x) * ({b} - u.y)"))


def PAIR(terms: list[str]) -> str:
    """s and l: the sum of the terms as a double, and what it leaves out."""
    out = f"{{'s': {terms[0]}, 'l': {D(0.0)}}}"
    for t in terms[1:]:
        out = LET(out, "o", LET(f"o.s + {t}", "t", LET("t - o.s", "k", (
            f"{{'s': t, 'l': o.l + ((o.s - (t - k)) + ({t} - k))}}"))))
    return out


def EXACT_SE(x: str) -> str:
    """Standard deviation / sqrt(n) from exact sums and sums of squares, in pairs of
    doubles; a value is squared as a float and its rest."""
    c = f"({x})::DOUBLE"
    high = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    low = f"({c} - {high})"
    products = [DIGITS(f"({p})", 7) for p in (f"{high} * {high}", f"{D(2.0)} * {high} * {low}", f"{low} * {low}")]
    sums = [f"[{', '.join(DIGIT_SUMS(d))}]" for d in (DIGITS(c, 5), [" + ".join(t) for t in zip(*products)])]
    pairs = [PAIR([f"v.{name}[{i + 1}]" for i in range(k)]) for name, k in (("one", 5), ("two", 7))]
    spread = LET("w.a.s * w.a.s", "p", LET(f"{ERROR('w.a.s', 'w.a.s', 'p')} + {D(2.0)} * w.a.s * w.a.l", "e", LET(
        "p / w.n", "q", LET("q * w.n", "m", LET(f"((p - m) - {ERROR('q', 'w.n', 'm')} + e) / w.n", "r", LET(
            "w.b.s - q", "d", LET("d - w.b.s", "k", LET("d + ((w.b.s - (d - k)) + (-q - k) + (w.b.l - r))", "g", (
                f"CASE WHEN g > w.b.s * {D(2.0 ** -94)} THEN g ELSE {D(0.0)} END")))))))))
    return LET(f"{{'one': {sums[0]}, 'two': {sums[1]}, 'n': count({x})::DOUBLE}}", "v", LET(
        f"{{'a': {pairs[0]}, 'b': {pairs[1]}, 'n': v.n}}", "w",
        f"CASE WHEN w.n > 1 THEN sqrt({spread} / (w.n - 1)) / sqrt(w.n) END"))


def STRICT_MEAN(x: str) -> str:
    return f"(CASE WHEN count({x}) = count(*) THEN avg({x}) END)"


def R1(x: str, d: int = 1) -> str:
    """Display rounding: snap to 9 decimals (drops summation-order noise), then
    half-even."""
    return f"(round_even(round_even({x}, 9), {d}) + 0.0::DOUBLE)"


def TXT(x: str) -> str:
    return (f"coalesce(regexp_replace(CAST(CAST({x} AS DECIMAL(38,1)) AS VARCHAR), '\\.0$', ''),"
            f" 'NA')")


def PM(m: str, s: str) -> str:
    return f"({TXT(m)} || ' ± ' || {TXT(s)})"


def _with(*ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {ROLES}{extra}\n"


ALIVE = "Species IN ('RHMA','AVGE','LARA') AND Mortality IN ('Alive','Dying')"
DEAD = "Species IN ('RHMA','AVGE','LARA') AND Mortality = 'Dead'"

D11 = f"""d11 AS (
  SELECT SY, Site, coalesce(avg(bp), 0.0::DOUBLE) AS mean_basal_area,
         coalesce({SE('bp')}, 0.0::DOUBLE) AS mean_basal_area_SE
  FROM (SELECT SY, Site, Plot, coalesce(sum({BA('DBH_cm')}), 0.0::DOUBLE) AS bp
        FROM trees WHERE {ALIVE} GROUP BY SY, Site, Plot)
  GROUP BY SY, Site)"""

D12 = f"""d12 AS (
  SELECT SY, Site, coalesce(avg(bp), 0.0::DOUBLE) AS mean_basal_area,
         coalesce({SE('bp')}, 0.0::DOUBLE) AS mean_basal_area_SE
  FROM (SELECT SY, Site, Plot, coalesce(sum({BA('DBH_cm')}), 0.0::DOUBLE) AS bp
        FROM trees WHERE {DEAD} AND SY IS NOT NULL GROUP BY SY, Site, Plot)
  GROUP BY SY, Site)"""


def D13(name: str, cond: str, suffix: str) -> str:
    sums = ",\n".join(
        f"coalesce(sum(CASE WHEN Species = '{sp}' THEN {BA('DBH_cm')} END), 0.0::DOUBLE) AS {sp}"
        for sp in ("RHMA", "AVGE", "LARA"))
    means = ", ".join(f"{STRICT_MEAN(sp)} AS {sp}" for sp in ("RHMA", "AVGE", "LARA"))
    shares = ", ".join(f"{sp} / NULLIF(RHMA + AVGE + LARA, 0) * 100.0::DOUBLE AS {sp}{suffix}"
                       for sp in ("RHMA", "AVGE", "LARA"))
    return f"""{name} AS (
  SELECT SY, Site, {shares}
  FROM (SELECT SY, Site, {means}
        FROM (SELECT SY, Site, Plot, {sums} FROM trees WHERE {cond} GROUP BY SY, Site, Plot)
        GROUP BY SY, Site))"""


D14 = f"""d14 AS (
  SELECT SY, Site, avg(d) AS mean_stem_density, {SE('d')} AS mean_stem_density_SE
  FROM (SELECT SY, Site, Plot, count(*) / 0.01::DOUBLE AS d FROM trees WHERE {ALIVE}
        GROUP BY SY, Site, Plot)
  GROUP BY SY, Site)"""

D15 = f"""d15 AS (
  SELECT SY, Site, coalesce(avg(hp), 0.0::DOUBLE) AS mean_height,
         coalesce({SE('hp')}, 0.0::DOUBLE) AS mean_height_SE
  FROM (SELECT SY, Site, Plot, avg(Tree_Height_m) AS hp FROM heights
        WHERE Species IN ('RHMA','AVGE','LARA','UNK') OR Species IS NULL
        GROUP BY SY, Site, Plot)
  GROUP BY SY, Site)"""


def CHANGE(name: str, src: str, col: str, out: str) -> str:
    return f"""{name} AS (
  SELECT Site, coalesce(y1 - y0, 0.0::DOUBLE) AS {out}
  FROM (SELECT Site,
          coalesce(max(CASE WHEN SY = {START} THEN {col} END), 0.0::DOUBLE) AS y0,
          coalesce(max(CASE WHEN SY = {END} THEN {col} END), 0.0::DOUBLE) AS y1
        FROM {src} GROUP BY Site))"""


CH_ALL = [D11, D12, D14, D15,
          CHANGE("c1", "d11", "mean_basal_area", "total_change"),
          CHANGE("c2", "d12", "mean_basal_area", "total_change_dead"),
          CHANGE("c3", "d15", "mean_height", "height_change"),
          CHANGE("c4", "d14", "mean_stem_density", "stem_density_change")]
CH_JOIN = """chg AS (
  SELECT * FROM c1 FULL JOIN c2 USING (Site) FULL JOIN c3 USING (Site) FULL JOIN c4 USING (Site))"""

D21 = """d21 AS (
  SELECT Island, Site, min(Forest_type) AS Typology,
         CASE WHEN count(Latitude) = count(*) THEN avg(Latitude) END AS Latitude,
         CASE WHEN count(Longitude) = count(*) THEN avg(Longitude) END AS Longitude
  FROM coordinates GROUP BY Island, Site)"""

# Canopy: readings long (NULLs kept), plot mean, site mean/SE.
CANOPY = r"""dl AS (
  SELECT Site, Plot, SY,
         regexp_extract(name, 'Calc_([NSEW])_([A-Za-z]+)', 1) AS Direction,
         regexp_extract(name, 'Calc_([NSEW])_([A-Za-z]+)', 2) AS Type, value
  FROM (SELECT Site, Plot, SY,
          TRY_CAST(trim(Calc_N_Veg) AS DOUBLE) AS Calc_N_Veg, TRY_CAST(trim(Calc_N_Wood) AS DOUBLE) AS Calc_N_Wood,
          TRY_CAST(trim(Calc_N_Open) AS DOUBLE) AS Calc_N_Open, TRY_CAST(trim(Calc_S_Veg) AS DOUBLE) AS Calc_S_Veg,
          TRY_CAST(trim(Calc_S_Wood) AS DOUBLE) AS Calc_S_Wood, TRY_CAST(trim(Calc_S_Open) AS DOUBLE) AS Calc_S_Open,
          TRY_CAST(trim(Calc_E_Veg) AS DOUBLE) AS Calc_E_Veg, TRY_CAST(trim(Calc_E_Wood) AS DOUBLE) AS Calc_E_Wood,
          TRY_CAST(trim(Calc_E_Open) AS DOUBLE) AS Calc_E_Open, TRY_CAST(trim(Calc_W_Veg) AS DOUBLE) AS Calc_W_Veg,
          TRY_CAST(trim(Calc_W_Wood) AS DOUBLE) AS Calc_W_Wood, TRY_CAST(trim(Calc_W_Open) AS DOUBLE) AS Calc_W_Open
        FROM densiometer)
  UNPIVOT INCLUDE NULLS (value FOR name IN (Calc_N_Veg, Calc_N_Wood, Calc_N_Open, Calc_S_Veg,
    Calc_S_Wood, Calc_S_Open, Calc_E_Veg, Calc_E_Wood, Calc_E_Open, Calc_W_Veg, Calc_W_Wood,
    Calc_W_Open))
),
cs AS (
  SELECT SY, Site, Type, avg(pp) AS perc, stddev_samp(pp) / sqrt(count(pp)) AS perc_SE
  FROM (SELECT SY, Site, Plot, Type, avg(value) AS pp FROM dl GROUP BY SY, Site, Plot, Type)
  GROUP BY SY, Site, Type)"""


def FILL_CELL(key: str, val: str, col: str) -> str:
    return (f"CASE WHEN count(CASE WHEN {key} = '{val}' THEN 1 END) = 0 THEN 0.0::DOUBLE "
            f"ELSE max(CASE WHEN {key} = '{val}' THEN {col} END) END")


# Regeneration
SEED_LONG = """sl AS (
  SELECT SY, Site, Plot, Quadrat, regexp_extract(name, '([A-Z]+)_(seedlings|saplings)', 1) AS Species,
         regexp_extract(name, '([A-Z]+)_(seedlings|saplings)', 2) AS Stage, Count
  FROM (SELECT SY, Site, Plot, Quadrat, RHMA_seedlings, LARA_seedlings, AVGE_seedlings FROM regeneration)
  UNPIVOT INCLUDE NULLS (Count FOR name IN (RHMA_seedlings, LARA_seedlings, AVGE_seedlings)))"""

SAP_LONG = """pl AS (
  SELECT SY, Site, Plot, Quadrat, regexp_extract(name, '([A-Z]+)_(seedlings|saplings)', 1) AS Species,
         regexp_extract(name, '([A-Z]+)_(seedlings|saplings)', 2) AS Stage, Count
  FROM (SELECT SY, Site, Plot, Quadrat, RHMA_saplings, LARA_saplings, AVGE_saplings FROM regeneration)
  UNPIVOT INCLUDE NULLS (Count FOR name IN (RHMA_saplings, LARA_saplings, AVGE_saplings))),
sap_plot AS (
  SELECT SY, Site, Plot, Species, avg(regen_sum) AS plot_dens, {se} AS plot_dens_SE
  FROM (SELECT SY, Site, Plot, Quadrat, Species, coalesce(sum(Count), 0.0::DOUBLE) AS regen_sum
        FROM pl GROUP BY SY, Site, Plot, Quadrat, Species)
  GROUP BY SY, Site, Plot, Species)""".format(se=SE("regen_sum"))

ISL = "isl AS (SELECT DISTINCT Island, Site FROM densiometer)"


def RANK(col: str) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(ISLAND_ORDER))
    return f"CAST(CASE {col} {whens} END AS INTEGER)"


SEED_STATS = f"""a1 AS (
  SELECT SY, Site, Plot, Stage, {STRICT_MEAN('Count')} AS mean_plot FROM sl GROUP BY SY, Site, Plot, Stage),
sa AS (
  SELECT SY, Site, Stage, {STRICT_MEAN('mean_plot')} AS mean_site, {SE('mean_plot')} AS count_SE
  FROM a1 GROUP BY SY, Site, Stage),
sb AS (
  SELECT SY, Site, avg(hp) AS height_site
  FROM (SELECT SY, Site, Plot, avg(Tall_seedling_cm) AS hp FROM regeneration GROUP BY SY, Site, Plot)
  GROUP BY SY, Site),
sc AS (
  SELECT x.*, isl.Island, {RANK('isl.Island')} AS Island_rank
  FROM (SELECT * FROM sa FULL JOIN sb USING (SY, Site)) x LEFT JOIN isl USING (Site)),
sg AS (
  SELECT min(height_site) AS mn_h, max(height_site) AS mx_h, min(mean_site) AS mn_m,
         max(mean_site) + max(count_SE) AS mx_m FROM sc),
sd AS (
  SELECT SY, Site, Stage, mean_site, count_SE, height_site, Island, Island_rank,
         (height_site - mn_h) / NULLIF(mx_h - mn_h, 0) * (mx_m - mn_m) + mn_m AS height_rescaled,
         mean_site AS ymin, mean_site + count_SE AS ymax
  FROM sc, sg)"""


def TOTAL_DEBRIS_CTES() -> list[str]:
    pi2 = "(pi() * pi())"
    vol = lambda c: f"{pi2} * {c} / NULLIF(8.0::DOUBLE * Transect_m, 0) * 10000.0::DOUBLE"
    return [
        """clean AS (
  SELECT SY, Site, Plot, Transect_num,
         CASE Decay_class WHEN 'R, T' THEN 'R' WHEN 'I, T' THEN 'I' WHEN 'I, R' THEN 'I'
              ELSE Decay_class END AS Decay_class, DBH_cm
  FROM coarse_wood WHERE Decay_class <> 'T')""",
        """d2 AS (
  SELECT SY, Site, Plot, Transect_num,
    max(CASE WHEN Decay_class = 'I' THEN s END) AS I,
    max(CASE WHEN Decay_class = 'S' THEN s END) AS S,
    max(CASE WHEN Decay_class = 'R' THEN s END) AS R
  FROM (SELECT SY, Site, Plot, Transect_num, Decay_class,
          coalesce(sum((DBH_cm / 100.0::DOUBLE) * (DBH_cm / 100.0::DOUBLE)), 0.0::DOUBLE) AS s
        FROM clean GROUP BY SY, Site, Plot, Transect_num, Decay_class)
  GROUP BY SY, Site, Plot, Transect_num)""",
        """cm AS (
  SELECT w.SY, w.Site, w.Plot, w.Transect_num, w.Transect_m,
         coalesce(w.Wood_fine_num, 0) AS Wood_fine_num, coalesce(w.Wood_med_num, 0) AS Wood_med_num,
         coalesce(d2.I, 0.0::DOUBLE) AS I, coalesce(d2.S, 0.0::DOUBLE) AS S,
         coalesce(d2.R, 0.0::DOUBLE) AS R
  FROM wood w LEFT JOIN d2 ON w.SY IS NOT DISTINCT FROM d2.SY AND w.Site IS NOT DISTINCT FROM d2.Site
    AND w.Plot IS NOT DISTINCT FROM d2.Plot AND w.Transect_num IS NOT DISTINCT FROM d2.Transect_num)""",
        f"""cv AS (
  SELECT *, BMI + BMS + BMR AS CoarseMass, IVol_ha + SVol_ha + RVol_ha AS CoarseVol
  FROM (SELECT *, IVol_ha * 0.35::DOUBLE AS BMI, SVol_ha * 0.5::DOUBLE AS BMS,
               RVol_ha * 0.2::DOUBLE AS BMR
        FROM (SELECT *, {vol('I')} AS IVol_ha, {vol('S')} AS SVol_ha, {vol('R')} AS RVol_ha
              FROM cm)))""",
        f"""td AS (
  SELECT *, FMass + MMass + CoarseMass AS TotalMass, FVol + MVol + CoarseVol AS TotalVolume
  FROM (SELECT *, FVol * 0.5::DOUBLE AS FMass, MVol * 0.5::DOUBLE AS MMass
        FROM (SELECT *,
                {pi2} * ((0.005::DOUBLE * 0.005::DOUBLE) * Wood_fine_num)
                  / NULLIF(8.0::DOUBLE * Fine_m, 0) * 10000.0::DOUBLE AS FVol,
                {pi2} * ((0.0425::DOUBLE * 0.0425::DOUBLE) * Wood_med_num)
                  / NULLIF(8.0::DOUBLE * Med_m, 0) * 10000.0::DOUBLE AS MVol
              FROM (SELECT *,
                      CASE WHEN (CASE WHEN Transect_m < 4.0 THEN Transect_m - 2.0::DOUBLE WHEN Transect_m >= 4.0 THEN 2.0::DOUBLE END) > 0
                           THEN (CASE WHEN Transect_m < 4.0 THEN Transect_m - 2.0::DOUBLE WHEN Transect_m >= 4.0 THEN 2.0::DOUBLE END) END AS Fine_m,
                      CASE WHEN (CASE WHEN Transect_m < 6.0 THEN Transect_m - 2.0::DOUBLE WHEN Transect_m >= 6.0 THEN 4.0::DOUBLE END) > 0
                           THEN (CASE WHEN Transect_m < 6.0 THEN Transect_m - 2.0::DOUBLE WHEN Transect_m >= 6.0 THEN 4.0::DOUBLE END) END AS Med_m
                    FROM cv))))""",
    ]


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    lf = """lf AS (
  SELECT SY, Site, CASE WHEN Mortality = 'Dying' THEN 'Alive' ELSE Mortality END AS Mortality, DBH_cm
  FROM trees WHERE DBH_cm >= 0 AND Mortality <> 'NA')"""

    def hist(origin: float) -> str:
        return _with(lf, f"""cnt AS (
  SELECT SY, Site, Mortality,
         CASE WHEN DBH_cm >= {origin}::DOUBLE THEN CAST(
           CASE WHEN DBH_cm < {origin}::DOUBLE + k * 3.0::DOUBLE THEN k - 1
                WHEN DBH_cm >= {origin}::DOUBLE + (k + 1) * 3.0::DOUBLE THEN k + 1
                ELSE k END AS INTEGER) END AS bin,
         count(*) AS n
  FROM (SELECT *, floor((DBH_cm - {origin}::DOUBLE) / 3.0::DOUBLE) AS k FROM lf)
  GROUP BY SY, Site, Mortality, bin)""", """tot AS (SELECT SY, Site, sum(n) AS total FROM cnt GROUP BY SY, Site)""") + f"""
SELECT c.SY, c.Site, c.Mortality, c.bin,
       {origin}::DOUBLE + c.bin * 3.0::DOUBLE AS bin_lo,
       {origin}::DOUBLE + (c.bin + 1) * 3.0::DOUBLE AS bin_hi,
       CAST(c.n AS DOUBLE) / CAST(t.total AS DOUBLE) AS total_freq
FROM cnt c JOIN tot t USING (SY, Site)"""

    q["size_freq_site_year"] = hist(2.5)
    q["size_freq_sites"] = hist(0.0)

    q["mean_basal_area"] = _with(D11) + "SELECT * FROM d11"
    q["mean_basal_area_dead"] = _with(D12) + "SELECT * FROM d12"
    q["species_contribution_alive"] = _with(D13("d13", ALIVE, "_alive")) + "SELECT * FROM d13"
    q["species_contribution_dead"] = _with(D13("d13", DEAD, "_dead")) + "SELECT * FROM d13"
    q["mean_stem_density"] = _with(D14) + "SELECT * FROM d14"
    q["mean_tree_height"] = _with(D15) + "SELECT * FROM d15"
    q["pct_basal_change"] = _with(D11) + f"""
SELECT Site, y0 AS "{START}", y1 AS "{END}", (y1 - y0) / NULLIF(y0, 0) * 100.0::DOUBLE AS percentage_change
FROM (SELECT Site,
        coalesce(max(CASE WHEN SY = {START} THEN mean_basal_area END), 0.0::DOUBLE) AS y0,
        coalesce(max(CASE WHEN SY = {END} THEN mean_basal_area END), 0.0::DOUBLE) AS y1
      FROM d11 GROUP BY Site)"""
    q["basal_change"] = _with(D11, CHANGE("c", "d11", "mean_basal_area", "total_change")) + "SELECT * FROM c"
    q["basal_change_dead"] = _with(D12, CHANGE("c", "d12", "mean_basal_area", "total_change_dead")) + "SELECT * FROM c"
    q["height_change"] = _with(D15, CHANGE("c", "d15", "mean_height", "height_change")) + "SELECT * FROM c"
    q["density_change"] = _with(D14, CHANGE("c", "d14", "mean_stem_density", "stem_density_change")) + "SELECT * FROM c"

    wq = ", ".join(f"avg({m}) AS {p}" for m, p in (
        ("Water_depth", "pd"), ("Temp", "pt"), ("DO_mg_L", "po"), ("Salinity_ppt", "ps"), ("TDS", "px")))
    d20 = f"""d20 AS (
  SELECT SY, Site,
    avg(pd) AS mean_depth, {SE('pd')} AS mean_depth_SE, avg(pt) AS mean_temp, {SE('pt')} AS mean_temp_SE,
    avg(po) AS mean_DO, {SE('po')} AS mean_DO_SE, avg(ps) AS mean_SAL, {SE('ps')} AS mean_SAL_SE,
    avg(px) AS mean_TDS, {SE('px')} AS mean_TDS_SE
  FROM (SELECT SY, Site, Plot, {wq} FROM ysi GROUP BY SY, Site, Plot)
  GROUP BY SY, Site)"""
    q["mean_water_quality"] = _with(d20) + "SELECT * FROM d20"
    q["water_table"] = _with(d20) + f"""
SELECT SY, Site,
  {PM(R1('mean_depth'), R1('mean_depth_SE'))} AS Depth,
  {PM(R1('mean_temp'), R1('mean_temp_SE'))} AS Temp,
  {PM(R1('mean_DO'), R1('mean_DO_SE'))} AS DO,
  {PM(R1(R1('mean_SAL'), 0), R1(R1('mean_SAL_SE'), 0))} AS SAL,
  {PM(R1(R1('mean_TDS'), 0), R1(R1('mean_TDS_SE'), 0))} AS TDS
FROM d20"""

    d3 = _with(D11, D13("d13a", ALIVE, "_alive"), D13("d13d", DEAD, "_dead"), D15, D14, """x AS (
  SELECT * FROM d11 FULL JOIN d13a USING (SY, Site) FULL JOIN d13d USING (SY, Site)
  FULL JOIN d15 USING (SY, Site) FULL JOIN d14 USING (SY, Site))""")
    sp_cols = ", ".join(f"{R1(c)} AS {c}" for c in (
        "RHMA_alive", "AVGE_alive", "LARA_alive", "RHMA_dead", "AVGE_dead", "LARA_dead"))
    q["tree_measurement_table"] = d3 + f"""
SELECT SY, Site,
  {PM(R1('mean_height'), R1('mean_height_SE'))} AS Height,
  {PM(R1('mean_basal_area'), R1('mean_basal_area_SE'))} AS Basal_Area,
  {PM(R1(R1('mean_stem_density'), 0), R1(R1('mean_stem_density_SE'), 0))} AS Density,
  {sp_cols}
FROM x"""

    wide = ", ".join(f"{FILL_CELL('Type', t, v)} AS {t}_{v}"
                     for t in ("Veg", "Wood", "Open") for v in ("perc", "perc_SE"))
    q["canopy_table"] = _with(CANOPY) + f"""
SELECT SY, Site, {PM(R1('Veg_perc'), R1('Veg_perc_SE'))} AS Alive,
       {PM(R1('Wood_perc'), R1('Wood_perc_SE'))} AS Dead,
       {PM(R1('Open_perc'), R1('Open_perc_SE'))} AS Open
FROM (SELECT SY, Site, {wide} FROM cs GROUP BY SY, Site)"""
    series = ", ".join(f"{FILL_CELL('Type', t, 'perc')} AS {t}" for t in ("Veg", "Wood", "Open"))
    q["canopy_series"] = _with(CANOPY) + f"""
SELECT *, -Wood AS Wood_down
FROM (SELECT SY, Site, {series} FROM cs WHERE Type IN ('Veg','Wood','Open') GROUP BY SY, Site)"""
    q["unpivot_regex"] = _with(CANOPY) + "SELECT Site, Plot, SY, Direction, Type, value FROM dl"

    q["seedling_density"] = _with(SEED_LONG, ISL, SEED_STATS) + "SELECT * FROM sd"
    q["global_minmax_rescale"] = _with(SEED_LONG, ISL, SEED_STATS, """sg2 AS (
  SELECT min(height_site) AS mn_h, max(height_site) AS mx_h, min(mean_site) AS mn_m,
         max(mean_site) + max(count_SE) AS mx_m FROM sd)""") + """
SELECT SY, Site, Stage, Island, mean_site, count_SE, height_site, height_rescaled,
       (height_rescaled - mn_m) / NULLIF(mx_m - mn_m, 0) * (mx_h - mn_h) + mn_h AS height_axis
FROM sd, sg2"""

    q["sapling_density"] = _with(SAP_LONG, ISL, f"""hb AS (
  SELECT SY, Site, Plot, Species, avg(quad_ht) AS plot_ht
  FROM (SELECT SY, Site, Plot, Quadrat, Species, avg(Height_cm) AS quad_ht FROM sapling
        GROUP BY SY, Site, Plot, Quadrat, Species)
  GROUP BY SY, Site, Plot, Species)""", f"""pc AS (
  SELECT x.*, isl.Island, {RANK('isl.Island')} AS Island_rank
  FROM (SELECT SY, Site, Species, avg(plot_dens) AS mean_dens, {SE('plot_dens')} AS mean_dens_SE,
               avg(plot_ht) AS mean_ht
        FROM (SELECT a.*, hb.plot_ht FROM sap_plot a LEFT JOIN hb
              ON a.SY IS NOT DISTINCT FROM hb.SY AND a.Site IS NOT DISTINCT FROM hb.Site
              AND a.Plot IS NOT DISTINCT FROM hb.Plot AND a.Species IS NOT DISTINCT FROM hb.Species)
        GROUP BY SY, Site, Species) x LEFT JOIN isl USING (Site))""", """pg AS (
  SELECT min(mean_ht) AS mn_h, max(mean_ht) AS mx_h, min(mean_dens) AS mn_m,
         max(mean_dens) + max(mean_dens_SE) AS mx_m FROM pc)""") + """
SELECT SY, Site, Species,
       CASE Species WHEN 'RHMA' THEN 'R. mangle' WHEN 'AVGE' THEN 'A. germinans'
                    WHEN 'LARA' THEN 'L. racemosa' END AS Species_name,
       mean_dens, mean_dens_SE, mean_ht, Island, Island_rank,
       (mean_ht - mn_h) / NULLIF(mx_h - mn_h, 0) * (mx_m - mn_m) + mn_m AS height_rescaled
FROM pc, pg"""

    def species_wide(src: str, m: str, s: str) -> str:
        cells = ", ".join(
            f"max(CASE WHEN Species = '{sp}' THEN {m} END) AS {sp}_m, "
            f"max(CASE WHEN Species = '{sp}' THEN {s} END) AS {sp}_s"
            for sp in ("RHMA", "AVGE", "LARA"))
        txt = ", ".join(f"{PM(R1(sp + '_m'), R1(sp + '_s'))} AS {sp}" for sp in ("RHMA", "AVGE", "LARA"))
        return f"SELECT SY, Site, {txt} FROM (SELECT SY, Site, {cells} FROM {src} GROUP BY SY, Site)"

    q["sapling_table"] = _with(SAP_LONG, f"""st AS (
  SELECT SY, Site, Species, avg(plot_dens) AS mean_dens, {SE('plot_dens')} AS mean_dens_SE
  FROM sap_plot GROUP BY SY, Site, Species)""") + species_wide("st", "mean_dens", "mean_dens_SE")
    q["seedling_table"] = _with(SEED_LONG, f"""st AS (
  SELECT SY, Site, Species, avg(pm) AS site_mean, {SE('pm')} AS site_SE
  FROM (SELECT SY, Site, Plot, Species, avg(Count) AS pm FROM sl GROUP BY SY, Site, Plot, Species)
  GROUP BY SY, Site, Species)""") + species_wide("st", "site_mean", "site_SE")

    q["site_coordinates"] = _with(D21) + "SELECT * FROM d21"
    q["natural_full_join"] = _with(*CH_ALL, CH_JOIN) + "SELECT * FROM chg"

    def num2(x: str) -> str:
        t = (f"regexp_replace(regexp_replace(CAST(CAST({R1(x, 2)} AS DECIMAL(38,2))"
             f" AS VARCHAR), '0+$', ''), '\\.$', '')")
        return f"coalesce(CASE WHEN {t} = '-0' THEN '0' ELSE {t} END, 'NA')"

    site_txt = "'<strong>Site:</strong> ' || coalesce(Site, 'NA')"
    layers = []
    for name, col, rule in (("Living Basal Change", "total_change", "s"),
                            ("Dead Basal Change", "total_change_dead", "s"),
                            ("Tree Height Change", "height_change", "s"),
                            ("Stem Density Change", "stem_density_change", "t")):
        radius = (f"(abs({col}) + 5.0::DOUBLE) * 75.0::DOUBLE" if rule == "s"
                  else f"abs({col}) / 3.0::DOUBLE")
        layers.append(f"""SELECT Island, Site, Typology, Latitude, Longitude, '{name}' AS layer,
  CAST({col} AS DOUBLE) AS value,
  CASE WHEN {col} IS NULL THEN NULL WHEN {col} > 0 THEN 'pos' ELSE 'neg' END AS direction,
  {radius} AS radius,
  {site_txt} || '<br><strong>Change:</strong> ' || {num2(col)} AS popup
FROM m""")
    layers.append(f"""SELECT Island, Site, Typology, Latitude, Longitude, 'Forest Type' AS layer,
  CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS direction, 10.0::DOUBLE AS radius,
  {site_txt} || '<br><strong>Forest Type:</strong> ' || coalesce(Typology, 'NA') AS popup
FROM m""")
    q["change_map_layers"] = _with(*CH_ALL, CH_JOIN, D21, """m AS (
  SELECT chg.*, d21.Island, d21.Typology, d21.Latitude, d21.Longitude
  FROM chg LEFT JOIN d21 ON chg.Site IS NOT DISTINCT FROM d21.Site)""") + "\nUNION ALL\n".join(layers)

    td = TOTAL_DEBRIS_CTES()
    q["decay_invalid"] = _with() + "SELECT * FROM coarse_wood WHERE Decay_class = 'T'"
    q["decay_clean"] = _with(td[0]) + "SELECT * FROM clean"
    q["recode_map"] = _with() + """SELECT SY, Site, Plot, Transect_num, Decay_class AS Decay_class_raw,
  CASE Decay_class WHEN 'R, T' THEN 'R' WHEN 'I, T' THEN 'I' WHEN 'I, R' THEN 'I' ELSE Decay_class END AS Decay_class
FROM coarse_wood"""
    q["coarse_counts_class"] = _with(td[0]) + """SELECT SY, Site, Plot, Decay_class, count(*) AS N,
  coalesce(CAST(Site AS VARCHAR), 'NA') || ' ' || coalesce(CAST(Plot AS VARCHAR), 'NA') AS Site_Plot
FROM clean GROUP BY SY, Site, Plot, Decay_class"""
    q["coarse_counts_plot"] = _with(td[0]) + "SELECT SY, Site, Plot, count(*) AS N FROM clean GROUP BY SY, Site, Plot"
    q["left_join_zero_fill"] = _with(*td[:3]) + "SELECT * FROM cm"
    q["coarse_volume"] = _with(*td[:4]) + "SELECT * FROM cv"
    q["total_debris"] = _with(*td) + "SELECT * FROM td"

    def box(measure: str) -> str:
        return f"""SELECT q.SY, q.Site, '{measure}' AS measure, q.n,
  least(q.lower, w.wlo) AS ymin, q.lower, q.middle, q.upper, greatest(q.upper, w.whi) AS ymax,
  w.n_outliers
FROM (SELECT SY, Site, count({measure}) AS n,
        quantile_cont({measure}, 0.25) AS lower, quantile_cont({measure}, 0.5) AS middle,
        quantile_cont({measure}, 0.75) AS upper
      FROM td WHERE {measure} IS NOT NULL AND NOT isnan({measure}) GROUP BY SY, Site) q
JOIN (SELECT t.SY, t.Site,
        min(CASE WHEN t.{measure} >= b.lower - 1.5::DOUBLE * (b.upper - b.lower)
                  AND t.{measure} <= b.upper + 1.5::DOUBLE * (b.upper - b.lower) THEN t.{measure} END) AS wlo,
        max(CASE WHEN t.{measure} >= b.lower - 1.5::DOUBLE * (b.upper - b.lower)
                  AND t.{measure} <= b.upper + 1.5::DOUBLE * (b.upper - b.lower) THEN t.{measure} END) AS whi,
        count(CASE WHEN NOT (t.{measure} >= b.lower - 1.5::DOUBLE * (b.upper - b.lower)
                  AND t.{measure} <= b.upper + 1.5::DOUBLE * (b.upper - b.lower)) THEN 1 END) AS n_outliers
      FROM td t JOIN (SELECT SY, Site, quantile_cont({measure}, 0.25) AS lower,
                             quantile_cont({measure}, 0.75) AS upper
                      FROM td WHERE {measure} IS NOT NULL AND NOT isnan({measure}) GROUP BY SY, Site) b
        ON t.SY IS NOT DISTINCT FROM b.SY AND t.Site IS NOT DISTINCT FROM b.Site
      WHERE t.{measure} IS NOT NULL AND NOT isnan(t.{measure})
      GROUP BY t.SY, t.Site) w
ON q.SY IS NOT DISTINCT FROM w.SY AND q.Site IS NOT DISTINCT FROM w.Site"""

    q["debris_box"] = _with(*td) + box("TotalMass") + "\nUNION ALL\n" + box("TotalVolume")
    q["debris_mean_sem"] = _with(*td, f"""ms AS (
  SELECT SY, Site, {STRICT_MEAN('CoarseVol')} AS MeanCoarse, -{STRICT_MEAN('FVol + MVol')} AS MeanFine,
         {SE('CoarseVol')} AS SEMCoarse, {SE('FVol + MVol')} AS SEMFine
  FROM td GROUP BY SY, Site)""") + """SELECT SY, Site, 'Coarse' AS type, MeanCoarse AS Mean, SEMCoarse AS SEM FROM ms
UNION ALL SELECT SY, Site, 'Fine' AS type, MeanFine AS Mean, SEMFine AS SEM FROM ms"""
    q["debris_counts"] = _with() + f"""SELECT Island, Site, SY,
  {STRICT_MEAN('Wood_fine_num')} AS meanFine, {SE('Wood_fine_num')} AS SEMFine,
  {STRICT_MEAN('Wood_med_num')} AS meanMedium, {SE('Wood_med_num')} AS SEMMedium,
  {STRICT_MEAN('Wood_coarse_num')} AS meanCourse, {SE('Wood_coarse_num')} AS SEMCourse,
  CAST(CASE WHEN count(Transect_m) = count(*) THEN sum(Transect_m) END AS DOUBLE) AS sumSurveyed
FROM wood GROUP BY Island, Site, SY"""
    q["site_island_conflicts"] = _with() + """SELECT Site, count(*) AS n_islands, min(Island) AS first_island,
  max(Island) AS last_island
FROM (SELECT DISTINCT Site, Island FROM wood) GROUP BY Site HAVING count(*) > 1"""

    q["share_of_total"] = _with(lf, """mc AS (SELECT SY, Site, Mortality, count(*) AS n FROM lf GROUP BY SY, Site, Mortality)""") + """
SELECT m.SY, m.Site, m.Mortality, m.n,
  CAST(m.n AS DOUBLE) / NULLIF(CAST(t.total AS DOUBLE), 0) AS freq
FROM mc m JOIN (SELECT SY, Site, sum(n) AS total FROM mc GROUP BY SY, Site) t USING (SY, Site)"""

    q["unpivot_multi"] = _with() + """SELECT SY, Site, Plot, Quadrat, 'RHMA' AS Species, RHMA_seedlings AS seedlings, RHMA_saplings AS saplings FROM regeneration
UNION ALL SELECT SY, Site, Plot, Quadrat, 'LARA', LARA_seedlings, LARA_saplings FROM regeneration
UNION ALL SELECT SY, Site, Plot, Quadrat, 'AVGE', AVGE_seedlings, AVGE_saplings FROM regeneration"""

    pf = ", ".join(f"""CASE WHEN count(CASE WHEN Species = '{sp}' THEN 1 END) = 0 THEN 0.0::DOUBLE
  ELSE max(CASE WHEN Species = '{sp}' THEN s END) END AS {sp}""" for sp in ("RHMA", "AVGE", "LARA"))
    q["pivot_fill_zero"] = _with() + f"""SELECT SY, Site, Plot, {pf}
FROM (SELECT SY, Site, Plot, Species, coalesce(sum({BA('DBH_cm')}), 0.0::DOUBLE) AS s
      FROM trees WHERE {ALIVE} GROUP BY SY, Site, Plot, Species)
GROUP BY SY, Site, Plot"""

    lab = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '')"
    q["bin_labels"] = _with(lf, """b AS (
  SELECT DISTINCT CAST(floor(DBH_cm / 3.0::DOUBLE) AS INTEGER) AS bin FROM lf WHERE DBH_cm >= 0.0)""") + f"""
SELECT bin, 0.0::DOUBLE + bin * 3.0::DOUBLE AS bin_lo, 0.0::DOUBLE + (bin + 1) * 3.0::DOUBLE AS bin_hi, bin_num,
  CASE WHEN bin + 1 >= 1 AND bin + 1 <= bin_num + 1
       THEN {lab('bin * 3.0::DOUBLE')} || '-' || {lab('(bin + 1) * 3.0::DOUBLE')} END AS label
FROM b, (SELECT count(*) AS bin_num FROM b)"""

    q["island_sites"] = _with() + "SELECT DISTINCT Island, Site FROM densiometer"
    q["category_order"] = _with() + f"""SELECT Island, Site, {RANK('Island')} AS Island_rank
FROM (SELECT DISTINCT Island, Site FROM densiometer)"""

    # The analyses of coarse pieces alone read a piece per line.
    every, large = "FROM obs\n)", "FROM obs WHERE qty > 45.0\n)"
    for k in ("decay_clean", "decay_invalid", "recode_map", "coarse_counts_class", "coarse_counts_plot"):
        assert large in q[k]
        q[k] = q[k].replace(large, every)

    # One site, one year, one species.
    q["size_freq_one_site"] = (f"SELECT SY, Mortality, bin, bin_lo, bin_hi, total_freq "
                               f"FROM ({q['size_freq_site_year']}) WHERE Site = 'NATION_3'")
    q["size_freq_one_year"] = (f"SELECT Site, Mortality, bin, bin_lo, bin_hi, total_freq "
                               f"FROM ({q['size_freq_sites']}) WHERE SY = 1997")
    q["sapling_density_one_species"] = f"SELECT * FROM ({q['sapling_density']}) WHERE Species = 'AVGE'"

    # Four tables merged on (SY, Site), missing keys alike.
    q["natural_full_join_n"] = _with("""keyed AS (
  SELECT SY, CASE WHEN Plot % 7 <> 0 THEN Site END AS Site, Mortality, DBH_cm FROM trees)""", """tall AS (
  SELECT SY, CASE WHEN Plot % 7 <> 0 THEN Site END AS Site, Tree_Height_m FROM heights WHERE SY % 2 = 0)""") + """
SELECT SY, Site, max(d) AS n_dead, max(u) AS n_unknown, max(m) AS max_height, max(l) AS n_large FROM (
  SELECT SY, Site, count(*) AS d, CAST(NULL AS BIGINT) AS u, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS BIGINT) AS l
  FROM keyed WHERE Mortality = 'Dead' GROUP BY SY, Site
  UNION ALL SELECT SY, Site, NULL, count(*), NULL, NULL FROM keyed WHERE Mortality = 'NA' GROUP BY SY, Site
  UNION ALL SELECT SY, Site, NULL, NULL, max(Tree_Height_m), NULL FROM tall GROUP BY SY, Site
  UNION ALL SELECT SY, Site, NULL, NULL, NULL, count(*) FROM keyed WHERE DBH_cm >= 50 GROUP BY SY, Site)
GROUP BY SY, Site"""

    q["unpivot_list"] = _with() + """SELECT SY, Site, Plot, 'Water_depth' AS measure, Water_depth AS value FROM ysi
UNION ALL SELECT SY, Site, Plot, 'Salinity_ppt', Salinity_ppt FROM ysi
UNION ALL SELECT SY, Site, Plot, 'TDS', TDS FROM ysi"""

    q["pivot_no_fill"] = (_with(*td[:2]) + "SELECT * FROM d2").replace(large, every)
    cells = ", ".join(f"max(CASE WHEN Species = '{sp}' THEN {v} END) AS {sp}_{n}"
                      for sp in ("RHMA", "AVGE", "LARA") for v, n in (("site_mean", "mean"), ("site_SE", "SE")))
    q["pivot_several_values"] = _with(SEED_LONG, f"""st AS (
  SELECT SY, Site, Species, avg(pm) AS site_mean, {SE('pm')} AS site_SE
  FROM (SELECT SY, Site, Plot, Species, avg(Count) AS pm FROM sl GROUP BY SY, Site, Plot, Species)
  GROUP BY SY, Site, Species)""") + f"SELECT SY, Site, {cells} FROM st GROUP BY SY, Site"

    q["report_order"] = _with() + """SELECT SY, Site, CAST(row_number() OVER (ORDER BY Site, SY) AS INTEGER) AS place
FROM (SELECT DISTINCT SY, Site FROM regeneration)"""
    q["levels_of_stems"] = _with() + f"""
SELECT SY, Site, Plot, count(*) AS stems, count(DBH_cm) AS measured, max(DBH_cm) AS largest, min(DBH_cm) AS smallest,
       CAST(CASE GROUPING_ID(SY, Site, Plot) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS INTEGER) AS level
FROM trees WHERE {ALIVE} GROUP BY GROUPING SETS ((SY, Site, Plot), (SY, Site), (SY), ())"""
    q["merged_states"] = _with() + f"""
SELECT Site, {EXACT_AVG('Tree_Height_m')} AS mean_height, {EXACT_SE('Tree_Height_m')} AS mean_height_SE
FROM heights GROUP BY Site"""
    q["island_by_year"] = _with("""recorded AS (
  SELECT Site, SY, min(Island) AS Island FROM densiometer WHERE SY % 2 = 0 GROUP BY Site, SY)""", """counted AS (
  SELECT SY, Site, count(*) AS stems FROM trees GROUP BY SY, Site)""") + """
SELECT c.SY, c.Site, c.stems, r.Island FROM counted c ASOF LEFT JOIN recorded r ON c.Site = r.Site AND c.SY >= r.SY"""
    # The same analyses with sums that do not depend on order: bits must be equal.
    q["exact_basal_area"] = _with() + f"""
SELECT SY, Site, coalesce({EXACT_AVG('bp')}, 0.0::DOUBLE) AS mean_basal_area,
       coalesce({EXACT_SE('bp')}, 0.0::DOUBLE) AS mean_basal_area_SE
FROM (SELECT SY, Site, Plot, coalesce({EXACT_SUM(BA('DBH_cm'))}, 0.0::DOUBLE) AS bp
      FROM trees WHERE {ALIVE} GROUP BY SY, Site, Plot)
GROUP BY SY, Site"""
    q["exact_tree_height"] = _with() + f"""
SELECT SY, Site, coalesce({EXACT_AVG('hp')}, 0.0::DOUBLE) AS mean_height,
       coalesce({EXACT_SE('hp')}, 0.0::DOUBLE) AS mean_height_SE
FROM (SELECT SY, Site, Plot, {EXACT_AVG('Tree_Height_m')} AS hp FROM heights
      WHERE Species IN ('RHMA','AVGE','LARA','UNK') OR Species IS NULL GROUP BY SY, Site, Plot)
GROUP BY SY, Site"""
    measures = (("Water_depth", "depth"), ("Temp", "temp"), ("DO_mg_L", "DO"), ("Salinity_ppt", "SAL"), ("TDS", "TDS"))
    per_plot = ", ".join(f"{EXACT_AVG(m)} AS p_{n}" for m, n in measures)
    per_site = ", ".join(f"{EXACT_AVG(f'p_{n}')} AS mean_{n}, {EXACT_SE(f'p_{n}')} AS mean_{n}_SE" for _, n in measures)
    q["exact_water_quality"] = _with() + f"""
SELECT SY, Site, {per_site} FROM (SELECT SY, Site, Plot, {per_plot} FROM ysi GROUP BY SY, Site, Plot) GROUP BY SY, Site"""
    plain = {n: f"round_even({{}}, {0 if n in ('SAL', 'TDS') else 1})" for _, n in measures}
    once = "round_even({}, 1)"
    shown = ", ".join(
        PM(*(f"({plain[n].format(once.format(c))} + 0.0::DOUBLE)" for c in (f"mean_{n}", f"mean_{n}_SE")))
        + f" AS {label}" for n, label in (("depth", "Depth"), ("temp", "Temp"), ("DO", "DO"), ("SAL", "SAL"), ("TDS", "TDS")))
    q["exact_water_table"] = f"SELECT SY, Site, {shown} FROM ({q['exact_water_quality']})"
    return q


ORACLE: dict[str, str] = _sql()
ORACLE.update({f"{k}_sparse": ORACLE[k].replace(ROLES, ROLES_SPARSE) for k in SPARSE})
