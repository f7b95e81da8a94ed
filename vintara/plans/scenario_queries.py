"""Queries of the scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.operators import scenarios as s
from vintara.plans import inputs
from vintara.plans.calibration_queries import EDITION, bands
from vintara.plans.inputs import CUT, END, memo
from vintara.plans.longrun_queries import long_bands, population_bounds
from vintara.plans.oracle import CTES
from vintara.plans.panel_queries import report
from vintara.plans.registry import register

LAST = 60
ZONES = {"AFRICA": "F6", "AMERICA": "A9", "EUROPE": "E_S4", "MIDDLE EAST": "F98"}
WIDENED = "EUROPE"
MIN_EDITIONS = 8


def long_run_series(spark, sf):
    """Long-run series of some entities, of most regions and of the world."""
    p = inputs.panel(spark, sf).where(f"period = {END}")
    zone = F.when(~F.col("is_aggregate") & (F.col("nk") % 3 == 0), F.col("entity")).when(F.col("entity") == "G001", "W")
    for region, code in ZONES.items():
        zone = zone.when(F.col("is_aggregate") & (F.col("name") == region), code)
    shift = F.when(F.col("nk") % 2 == 1, F.lit(0.004)).otherwise(F.lit(-0.003))
    rows = p.select(zone.alias("zone"), "volume", shift.alias("shift"), F.explode(F.sequence(F.lit(0), F.lit(LAST - END))).alias("k"))
    return rows.where("zone IS NOT NULL").select("zone", "k", "volume", F.explode(F.array(
        F.struct(F.lit("BAU1").alias("scenario"), F.lit(1.004).alias("rate")),
        F.struct(F.lit("ALT1").alias("scenario"), (F.lit(1.004) + F.col("shift")).alias("rate")),
        F.struct(F.lit("ALT2").alias("scenario"), (F.lit(1.004) - F.col("shift")).alias("rate")))).alias("x")).select(
        "zone", "x.scenario", (F.col("k") + END).alias("period"), (F.col("volume") * F.pow(F.col("x.rate"), F.col("k"))).alias("value"))


def population_variants(spark, sf):
    """Population variants of most entities."""
    p = inputs.panel(spark, sf).where(f"NOT is_aggregate AND period = {CUT} AND nk % 7 <> 0").select(
        "entity", "population", F.explode(F.sequence(F.lit(20), F.lit(LAST))).alias("period"))
    central = F.col("population") * (1 + F.lit(0.0041371) * (F.col("period") - CUT))
    width = F.lit(0.0030713) * F.greatest(F.col("period") - CUT, F.lit(0))
    return p.select("entity", "period", F.explode(F.array(
        F.struct(F.lit("central").alias("variant"), central.alias("population")),
        F.struct(F.lit("low").alias("variant"), (central * (1 - width)).alias("population")),
        F.struct(F.lit("high").alias("variant"), (central * (1 + width)).alias("population")))).alias("x")).select("entity", "period", "x.*")


def dated_bands(spark, sf):
    return bands(spark, sf).withColumn("period", F.col("horizon") + EDITION)


def _build(spark, sf, **options):
    return s.build_scenarios(
        report(spark, sf), dated_bands(spark, sf), long_run_series(spark, sf), population_variants(spark, sf), ZONES,
        CUT, END, LAST, 5, widened_group=WIDENED, min_editions=MIN_EDITIONS, **options)


def _full(spark, sf):
    return _build(spark, sf, long_bands=long_bands(spark, sf), population_bounds=population_bounds(spark, sf))


@memo
def scenarios(spark, sf):
    return _full(spark, sf)[0]


@memo
def scenario_sheet(spark, sf):
    return _full(spark, sf)[1]


CTES["lrseries"] = """
WITH z AS (SELECT CASE WHEN NOT is_aggregate AND nk % 3 = 0 THEN entity WHEN entity = 'G001' THEN 'W' WHEN is_aggregate AND name = 'AFRICA' THEN 'F6' WHEN is_aggregate AND name = 'AMERICA' THEN 'A9'
    WHEN is_aggregate AND name = 'EUROPE' THEN 'E_S4' WHEN is_aggregate AND name = 'MIDDLE EAST' THEN 'F98' END AS zone, volume, CASE WHEN nk % 2 = 1 THEN 0.004::DOUBLE ELSE -0.003::DOUBLE END AS shift
  FROM panel WHERE period = 46),
x AS (SELECT zone, volume, k, 'BAU1' AS scenario, 1.004::DOUBLE AS rate FROM z, range(0, 15) t(k) UNION ALL SELECT zone, volume, k, 'ALT1', 1.004::DOUBLE + shift FROM z, range(0, 15) t(k)
  UNION ALL SELECT zone, volume, k, 'ALT2', 1.004::DOUBLE - shift FROM z, range(0, 15) t(k))
SELECT zone, scenario, (46 + k)::INTEGER AS period, volume * pow(rate, k) AS value FROM x WHERE zone IS NOT NULL"""
CTES["unvar"] = """
WITH p AS (SELECT entity, t::INTEGER AS period, population * (1 + 0.0041371::DOUBLE * (t - 40)) AS c, 0.0030713::DOUBLE * greatest(t - 40, 0) AS w FROM panel, range(20, 61) r(t)
  WHERE NOT is_aggregate AND period = 40 AND nk % 7 <> 0)
SELECT entity, period, 'central' AS variant, c AS population FROM p UNION ALL SELECT entity, period, 'low', c * (1 - w) FROM p UNION ALL SELECT entity, period, 'high', c * (1 + w) FROM p"""
CTES["lrgrowth"] = """
WITH r AS (SELECT zone, scenario, period, value / lag(value) OVER (PARTITION BY zone, scenario ORDER BY period) AS ratio FROM lrseries),
t AS (SELECT zone, scenario, product(ratio) AS total FROM r WHERE period > 46 GROUP BY 1, 2),
b AS (SELECT zone, arg_min(scenario, (total, scenario)) AS scenario_low, arg_max(scenario, (total, scenario)) AS scenario_high FROM t GROUP BY 1),
c AS (SELECT zone, scenario, period, product(ratio) OVER (PARTITION BY zone, scenario ORDER BY period ROWS UNBOUNDED PRECEDING) AS path FROM r WHERE period > 46)
SELECT b.zone, a.period, scenario_low, scenario_high, a.path AS g_central, l.path AS g_low, h.path AS g_high FROM b JOIN c a ON a.zone = b.zone AND a.scenario = 'BAU1'
JOIN c l ON l.zone = b.zone AND l.scenario = scenario_low AND l.period = a.period JOIN c h ON h.zone = b.zone AND h.scenario = scenario_high AND h.period = a.period"""
CTES["zoned"] = """
SELECT s.entity, s.grp, coalesce(o.zone, r.zone, 'W') AS zone, CASE WHEN o.zone IS NOT NULL THEN 'own' WHEN r.zone IS NOT NULL THEN 'region' ELSE 'world' END AS zone_level
FROM suppliers s LEFT JOIN (SELECT DISTINCT zone FROM lrseries) o ON o.zone = s.entity
LEFT JOIN (SELECT DISTINCT zone FROM lrseries) r ON r.zone = CASE grp WHEN 'AFRICA' THEN 'F6' WHEN 'AMERICA' THEN 'A9' WHEN 'EUROPE' THEN 'E_S4' WHEN 'MIDDLE EAST' THEN 'F98' END"""
CTES["sfactors"] = """
SELECT entity, horizon + 41 AS period, 1.0::DOUBLE AS central, 1 / (1 + error_median / 100) AS corrected, 1 + low_pct / 100 AS low, 1 + high_pct / 100 AS high,
  1 / (1 + coalesce(error_median_crisis, error_median) / 100) AS world_crisis, 1 + low_pct_group / 100 AS low_group, 1 + high_pct_group / 100 AS high_group,
  1 + low_pct / 100 AS low_wide, 1 + high_pct / 100 AS high_wide FROM bands"""
CTES["sbase"] = """
WITH e AS (SELECT entity, volume_per_capita AS hab_end, population AS pop_end FROM report WHERE period = 46 AND NOT is_aggregate AND volume_per_capita IS NOT NULL AND population IS NOT NULL),
u AS (SELECT r.entity, name, grp, period, per_capita, volume_per_capita AS hab, population, hab_end, pop_end FROM report r JOIN e USING (entity)
  UNION ALL SELECT r.entity, name, grp, t::INTEGER, NULL, NULL, NULL, hab_end, pop_end FROM report r JOIN e USING (entity), range(47, 61) x(t) WHERE period = 46),
v AS (SELECT entity, period, max(population) FILTER (variant = 'central') AS c, max(population) FILTER (variant = 'low') AS l, max(population) FILTER (variant = 'high') AS h FROM unvar GROUP BY 1, 2),
p AS (SELECT u.*, CASE WHEN u.period > 46 THEN pop_end * v.c / v46.c ELSE population END AS pop_central,
    CASE WHEN u.period <= 40 THEN 1 ELSE coalesce(v.l / v.c, 1) END AS rl, CASE WHEN u.period <= 40 THEN 1 ELSE coalesce(v.h / v.c, 1) END AS rh,
    b.low_calibrated AS bl, b.high_calibrated AS bh, EXISTS (SELECT 1 FROM pobounds k WHERE k.entity = u.entity) AS cal, v46.c IS NOT NULL AS un
  FROM u LEFT JOIN v ON v.entity = u.entity AND v.period = u.period LEFT JOIN v v46 ON v46.entity = u.entity AND v46.period = 46 LEFT JOIN pobounds b ON b.entity = u.entity AND b.period = u.period)
SELECT p.* EXCLUDE (rl, rh, bl, bh), pop_central * rl AS pop_low, pop_central * rh AS pop_high,
  CASE WHEN cal THEN pop_central * CASE WHEN p.period <= 40 THEN 1 ELSE coalesce(bl, 1) END ELSE pop_central * rl END AS pop_low_calibrated,
  CASE WHEN cal THEN pop_central * CASE WHEN p.period <= 40 THEN 1 ELSE coalesce(bh, 1) END ELSE pop_central * rh END AS pop_high_calibrated,
  z.zone, z.zone_level, g.g_central, g.g_low, g.g_high, g.scenario_low, g.scenario_high
FROM p JOIN zoned z ON z.entity = p.entity LEFT JOIN lrgrowth g ON g.zone = z.zone AND g.period = p.period"""
_names = s.SCENARIOS


def _level(n, growth):
    return f"CASE WHEN b.period > 46 THEN hab_end * coalesce(f.{n}, 1) * {growth} WHEN b.period > 40 THEN hab * coalesce(f.{n}, 1) ELSE hab END AS l_{n}"


CTES["swide"] = f"""
WITH k AS (SELECT a.member, a.horizon, (1 + b.p90_smooth / 100) / (1 + a.p90_smooth / 100) AS wl, (1 + b.p10_smooth / 100) / (1 + a.p10_smooth / 100) AS wh
  FROM lbands a JOIN lbands b ON a.member = b.member AND b.horizon = 5),
mem AS (SELECT DISTINCT member FROM lbands), fit AS (SELECT member, max(horizon) AS fitted FROM lbands WHERE edition_periods >= 8 GROUP BY 1),
w AS (SELECT b.*, m.member IS NOT NULL AS known, fitted, {', '.join(_level(n, 'g_central * wl' if s.SIDE.get(n) == 'low' else 'g_central * wh' if s.SIDE.get(n) == 'high' else 'g_central') for n in _names)}
  FROM sbase b LEFT JOIN sfactors f ON f.entity = b.entity AND f.period = least(b.period, 46) LEFT JOIN mem m ON m.member = b.grp LEFT JOIN fit ON fit.member = b.grp
  LEFT JOIN k ON k.member = coalesce(m.member, 'all') AND k.horizon = least(greatest(b.period - 41, 5), 20)),
x AS (SELECT *, CASE WHEN grp = 'EUROPE' AND period > 46 THEN (ln(l_low / l_central) + ln(l_high / l_central)) / 2 END AS mid,
    CASE WHEN grp = 'EUROPE' AND period > 46 THEN greatest((ln(l_high / l_central) - ln(l_low / l_central)) / 2, 1.2815515655446008 * (0.021 / (2 * 0.974113877059309)) * (period - 41)) END AS half FROM w),
y AS (SELECT *, CASE WHEN period - 41 > fitted THEN coalesce(arg_max(mid, period) FILTER (mid IS NOT NULL AND period - 41 <= fitted) OVER (PARTITION BY entity), mid) ELSE mid END AS mm FROM x)
SELECT * REPLACE (CASE WHEN mid IS NOT NULL THEN l_central * exp(mm - half) ELSE l_low_wide END AS l_low_wide, CASE WHEN mid IS NOT NULL THEN l_central * exp(mm + half) ELSE l_high_wide END AS l_high_wide) FROM y"""
_phase = "CASE WHEN period <= 40 THEN 'observed' WHEN period <= 46 THEN 'forecast' ELSE 'long run' END AS phase"
_pops = ", ".join(s.POPULATIONS)


def _long(t):
    return " UNION ALL ".join(
        f"SELECT entity, name, grp, period, {_phase}, '{n}' AS scenario, l_{n} AS level, {_pops}, "
        f"{'CASE WHEN period <= 46 THEN per_capita END' if n == 'central' else 'NULL::DOUBLE'} AS current_per_capita, l_{n} * pop_central / 1000 AS total FROM {t}" for n in _names)


CTES["scen"] = _long("swide")
CTES["swide0"] = f"""SELECT b.*, {', '.join(_level(n, 'g_low' if s.SIDE.get(n) == 'low' else 'g_high' if s.SIDE.get(n) == 'high' else 'g_central') for n in _names)}
  FROM (SELECT * REPLACE (pop_low AS pop_low_calibrated, pop_high AS pop_high_calibrated) FROM sbase) b LEFT JOIN sfactors f ON f.entity = b.entity AND f.period = least(b.period, 46)"""
LEVELS = "level " + " ".join(s.POPULATIONS) + " total"
register("b16_growth_zones", lambda a, b: s.growth_zones(inputs.suppliers(a, b).select("entity", F.col("grp").alias("region")), long_run_series(a, b), ZONES),
         "SELECT entity, grp AS region, zone, zone_level FROM zoned")
register("b17_scenario_factors", lambda a, b: s.long_factors(dated_bands(a, b)),
         " UNION ALL ".join(f"SELECT entity, period, '{n}' AS scenario, {n} AS factor FROM sfactors" for n in _names), "factor", 6)
register("s1_long_run_growth", lambda a, b: s.long_run_growth(long_run_series(a, b), END, LAST), "SELECT * FROM lrgrowth", "g_central g_low g_high", 6)
register("s2_scenarios", lambda a, b: _full(a, b)[0], "SELECT * FROM scen", LEVELS, 4)
register("s2_scenarios_without_bands", lambda a, b: _build(a, b)[0], _long("swide0"), LEVELS, 4)
register("s3_fact_sheet", lambda a, b: s.fact_sheet(scenario_sheet(a, b), bands(a, b), 5),
         """WITH f AS (SELECT entity, name, zone, zone_level, 'past errors (' || CASE WHEN known THEN grp ELSE 'all' END || ')' AS bounds_source, coalesce(grp = 'EUROPE', false) AS widened, un AS population_known,
              cal AS population_calibrated FROM swide WHERE period = 47)
            SELECT f.*, low_pct, high_pct, error_median, error_median_crisis, downturn_pct, downturn_crisis_pct, downturn_calm_pct, crisis_pct, depth_median FROM f
            LEFT JOIN (SELECT * FROM bands WHERE horizon = 5) b USING (entity)""",
         "low_pct high_pct error_median error_median_crisis downturn_pct downturn_crisis_pct downturn_calm_pct crisis_pct depth_median")
CTES["figures"] = f"""
WITH k AS (SELECT entity, period, {', '.join(f"max(level) FILTER (scenario = '{n}') AS {n}" for n in ('central', 'low', 'high', 'low_wide', 'high_wide'))}, {', '.join(f"max({q}) AS {q}" for q in s.POPULATIONS)}
  FROM scen WHERE entity = 'E3' AND period IN (46, 55, 60) GROUP BY 1, 2),
f AS ({' UNION ALL '.join(f"SELECT entity || ' ' || period || ' {n}' AS figure, {e} AS value FROM k" for n, e in [(f'{n}_pct', f'100 * {n} / central') for n in ('low', 'high', 'low_wide', 'high_wide')] + [('central', 'central')] + [(q, q) for q in s.POPULATIONS])})
SELECT * FROM f WHERE value IS NOT NULL"""


def _changed(spark, sf):
    now = s.key_figures(scenarios(spark, sf), "E3", (46, 55, 60)).withColumn("value", F.round("value", 3))
    published = now.withColumn("value", F.when(F.col("figure").like("%60%"), F.col("value") + 1).otherwise(F.col("value"))).where("figure NOT LIKE '% 55 pop%'")
    return s.changed_figures(published, now)


register("x_changed_figures", _changed,
         """WITH n AS (SELECT figure, round(value, 3) AS value FROM figures), p AS (SELECT figure, CASE WHEN figure LIKE '%60%' THEN value + 1 ELSE value END AS value FROM n WHERE figure NOT LIKE '% 55 pop%')
            SELECT figure, p.value AS published, n.value AS current FROM n JOIN p USING (figure) WHERE p.value IS DISTINCT FROM n.value""", "published current", 3)
