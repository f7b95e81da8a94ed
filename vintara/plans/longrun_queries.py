"""Queries of the long horizon and of the population bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.functions import expr
from vintara.operators import longrun as l, population as p
from vintara.plans import inputs
from vintara.plans.calibration_queries import group_history
from vintara.plans.evaluation_queries import evaluation
from vintara.plans.inputs import REGIONS, memo
from vintara.plans.oracle import CTES
from vintara.plans.registry import register

H_MAX, WINDOW, FIRST, EXTRAPOLATED = 12, 6, 28, 20
REVISIONS, CURRENT, SIZE = (24, 27, 30, 33, 36), 44, 22.0


@memo
def long_errors(spark, sf):
    return l.extended_errors(evaluation(spark, sf), 5, H_MAX, FIRST, WINDOW)


@memo
def long_bands(spark, sf):
    return l.smooth_bands(l.quantiles_by_group(l.cases_for_bands(long_errors(spark, sf)), REGIONS), 8, EXTRAPOLATED)


def past_revisions(spark, sf):
    """A10: projections of past revisions, flat at the mean of the last periods they knew."""
    pop = inputs.panel(spark, sf).where("NOT is_aggregate").select("entity", "period", "population")
    revs = F.explode(F.array(*[F.lit(r) for r in REVISIONS])).alias("revision")
    base = pop.select("*", revs).where(F.col("period").between(F.col("revision") - 3, F.col("revision"))).groupBy("revision", "entity").agg(
        F.sum("population").alias("s"), F.count(F.lit(1)).alias("n"))
    return base.select("revision", "entity", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("k"), (F.col("s") / F.col("n")).alias("m")).select(
        "revision", "entity", (F.col("revision") + F.col("k")).alias("period"), (F.col("m") * (1 + F.col("k") * F.lit(0.002))).alias("population"))


def current_population(spark, sf):
    """Current revision: estimates before it, then a flat median with growing bounds."""
    pop = inputs.panel(spark, sf).where(f"NOT is_aggregate AND period <= {CURRENT}").select("entity", "nk", "period", "population")
    h = F.explode(F.when(F.col("period") == CURRENT, F.sequence(F.lit(0), F.lit(20))).otherwise(F.array(F.lit(0)))).alias("h")
    width = F.col("h") * (F.lit(0.010) + (F.col("nk") % 5) * F.lit(0.004))
    rows = pop.select("*", h)
    known = F.col("period") + F.col("h") >= CURRENT
    return rows.select("entity", (F.col("period") + F.col("h")).alias("period"), F.col("population").alias("median"),
                       F.when(known, F.col("population") * (1 - width)).alias("low"), F.when(known, F.col("population") * (1 + width * F.lit(1.1))).alias("high"))


@memo
def population_rows(spark, sf):
    errors = p.projection_errors(past_revisions(spark, sf), current_population(spark, sf), CURRENT, SIZE)
    grouped = p.with_group(errors, inputs.suppliers(spark, sf).select("entity", "grp"), group_history(spark, sf))
    return p.standardised_deviations(grouped, p.current_bounds(current_population(spark, sf), CURRENT))


@memo
def population_calibration(spark, sf):
    return p.multipliers(population_rows(spark, sf), 4, EXTRAPOLATED)


@memo
def population_bounds(spark, sf):
    return p.calibrated_bounds(current_population(spark, sf), population_calibration(spark, sf), CURRENT, SIZE)


CTES["lreal"] = "SELECT DISTINCT entity, period, realised_own AS g FROM ev WHERE realised_own IS NOT NULL"
CTES["ldrift"] = """SELECT entity, v::INTEGER AS edition_period, 100 * (exp(avg(ln(1 + g / 100))) - 1) AS drift_pct FROM lreal, range(20, 70) t(v)
WHERE period BETWEEN v - 7 AND v - 2 GROUP BY 1, 2 HAVING count(*) >= 4.8"""
CTES["lerr"] = """
WITH f AS (SELECT entity, edition, edition_period, max(grp) AS grp, list(value ORDER BY horizon) AS pth FROM ev WHERE edition_period >= 28 AND horizon BETWEEN 0 AND 5 AND value IS NOT NULL
  GROUP BY 1, 2, 3 HAVING count(*) = 6),
s AS (SELECT f.*, drift_pct, h::INTEGER AS horizon, CASE WHEN h <= 5 THEN pth[h + 1] ELSE drift_pct END AS f0, CASE WHEN h <= 5 THEN pth[h + 1] ELSE list_median(pth[4:6]) END AS f1, drift_pct AS f2
  FROM f JOIN ldrift USING (entity, edition_period), range(0, 13) t(h)),
j AS (SELECT s.*, r.g FROM s LEFT JOIN lreal r ON r.entity = s.entity AND r.period = edition_period + horizon),
c AS (SELECT *, bool_or(g IS NULL) OVER w AS stop, sum(ln(1 + f0 / 100) - ln(1 + g / 100)) OVER w AS s0, sum(ln(1 + f1 / 100) - ln(1 + g / 100)) OVER w AS s1,
  sum(ln(1 + f2 / 100) - ln(1 + g / 100)) OVER w AS s2 FROM j WINDOW w AS (PARTITION BY entity, edition ORDER BY horizon ROWS UNBOUNDED PRECEDING))
SELECT entity, grp, edition, edition_period, horizon, drift_pct, 100 * (exp(s0) - 1) AS error_forecast_then_drift, 100 * (exp(s1) - 1) AS error_forecast_extended,
  100 * (exp(s2) - 1) AS error_drift FROM c WHERE NOT stop"""
CTES["lquant"] = """
WITH k AS (SELECT * FROM lerr WHERE round(drift_pct, 9) >= 0), m AS (SELECT 'all' AS member, * FROM k UNION ALL SELECT grp, * FROM k WHERE grp IS NOT NULL)
SELECT member, horizon, count(*) AS cases, count(DISTINCT edition_period) AS edition_periods, quantile_cont(error_forecast_then_drift, 0.1) AS p10,
  median(error_forecast_then_drift) AS p50, quantile_cont(error_forecast_then_drift, 0.9) AS p90 FROM m GROUP BY 1, 2"""


def _fit(points, keys, lo, n):
    return f"""SELECT {keys}, arg_min(ic, (sse, b)) AS ic, arg_min(sl, (sse, b)) AS sl, arg_min(b, (sse, b)) AS b FROM (SELECT {keys}, b, regr_intercept(y, x) AS ic, regr_slope(y, x) AS sl,
  round(regr_syy(y, x) - coalesce(pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0), 0), 12) AS sse
  FROM (SELECT {keys}, y, b, pow(horizon + 1.0::DOUBLE, b) AS x FROM {points}, (SELECT round({lo} + i * 0.01::DOUBLE, 2) AS b FROM range(0, {n}) t(i))) GROUP BY ALL) GROUP BY ALL"""


CTES["lusable"] = "SELECT * FROM lquant WHERE horizon >= 1 AND edition_periods >= 8 QUALIFY count(*) OVER (PARTITION BY member) >= 3"
CTES["lpoints"] = "SELECT member, horizon, 'p10' AS q, ln(1 + p10 / 100) AS y FROM lusable UNION ALL SELECT member, horizon, 'p90', ln(1 + p90 / 100) FROM lusable"
CTES["llaw"] = _fit("lpoints", "member, q", "0.2::DOUBLE", 181)
CTES["lbands"] = """
WITH f AS (SELECT member, max(horizon) AS last_fitted FROM lusable GROUP BY 1)
SELECT a.member, h::INTEGER AS horizon, last_fitted, 100 * (exp(a.ic + a.sl * pow(h + 1.0::DOUBLE, a.b)) - 1) AS p10_smooth, 100 * (exp(b.ic + b.sl * pow(h + 1.0::DOUBLE, b.b)) - 1) AS p90_smooth,
  q.cases, q.edition_periods, q.p10, q.p50, q.p90
FROM llaw a JOIN llaw b ON a.member = b.member AND a.q = 'p10' AND b.q = 'p90' JOIN f ON f.member = a.member, range(1, 21) t(h) LEFT JOIN lquant q ON q.member = a.member AND q.horizon = h"""
ERR = "drift_pct error_forecast_then_drift error_forecast_extended error_drift"
register("l1_realised_growth", lambda s, d: l.realised_growth(evaluation(s, d)), "SELECT entity, period, g AS growth FROM lreal", "growth", 6)
register("l2_drifts", lambda s, d: l.drifts(l.realised_growth(evaluation(s, d)), WINDOW), "SELECT * FROM ldrift", "drift_pct")
register("l3_l4_l5_extended_errors", lambda s, d: l.extended_errors(evaluation(s, d), 5, H_MAX, FIRST, WINDOW), "SELECT * FROM lerr", ERR)
register("l6_cases_for_bands", lambda s, d: l.cases_for_bands(long_errors(s, d)).groupBy("horizon").agg(F.count(F.lit(1)).alias("n")),
         "SELECT horizon, count(*) AS n FROM lerr WHERE round(drift_pct, 9) >= 0 GROUP BY 1")
_ext = ("forecast_then_drift", "forecast_extended", "drift")
_l7 = " ".join(f"p10_{n} p50_{n} p90_{n} median_abs_{n} p80_abs_{n}" for n in _ext) + " closer_forecast_then_drift closer_forecast_extended"
register("l7_extension_summary", lambda s, d: l.extension_summary(long_errors(s, d)),
         "SELECT horizon, count(*) AS cases, count(DISTINCT edition_period) AS edition_periods, " +
         ", ".join(f"avg((abs(error_{n}) < abs(error_drift))::INT) AS closer_{n}" for n in _ext[:2]) + ", " +
         ", ".join(f"quantile_cont(error_{n}, 0.1) AS p10_{n}, median(error_{n}) AS p50_{n}, quantile_cont(error_{n}, 0.9) AS p90_{n}, median(abs(error_{n})) AS median_abs_{n}, "
                   f"quantile_cont(abs(error_{n}), 0.8) AS p80_abs_{n}" for n in _ext) + " FROM lerr GROUP BY 1", _l7)
register("l8_quantiles_by_group", lambda s, d: l.quantiles_by_group(l.cases_for_bands(long_errors(s, d)), REGIONS), "SELECT * FROM lquant", "p10 p50 p90")


def _laws(spark, sf):
    from vintara.functions import fixed

    q = l.quantiles_by_group(l.cases_for_bands(long_errors(spark, sf)), REGIONS)
    points = q.where("horizon >= 1 AND edition_periods >= 8").select("member", "horizon", F.lit("p10").alias("q"), F.log1p(F.col("p10") / 100).alias("y"))
    return l.fit_power_law(points, ["member", "q"], "horizon", "y", fixed.BAND_EXPONENTS)


register("l9_power_law", _laws, "SELECT member, q, ic AS intercept, sl AS slope, b AS exponent FROM llaw WHERE q = 'p10'", "intercept slope exponent", 4)
register("l10_smooth_bands", lambda s, d: long_bands.build(s, d), "SELECT * FROM lbands", "p10_smooth p90_smooth p10 p50 p90", 3)
register("l11_widening", lambda s, d: l.widening(long_bands(s, d), 5),
         """SELECT a.member, a.horizon, (1 + b.p90_smooth / 100) / (1 + a.p90_smooth / 100) AS low_factor, (1 + b.p10_smooth / 100) / (1 + a.p10_smooth / 100) AS high_factor
            FROM lbands a JOIN lbands b ON a.member = b.member AND b.horizon = 5 WHERE a.horizon >= 5""", "low_factor high_factor")
register("b19_fitted_horizon", lambda s, d: l.fitted_horizon(long_bands(s, d), "ASIA", 8), "SELECT max(horizon) AS fitted_horizon FROM lbands WHERE member = 'ASIA' AND edition_periods >= 8")


def _log_bounds(spark, sf):
    return long_bands(spark, sf).select("member", "horizon", (-F.log1p(F.col("p90_smooth") / 100)).alias("log_low"), (-F.log1p(F.col("p10_smooth") / 100)).alias("log_high"))


register("b18_widen", lambda s, d: l.widen(_log_bounds(s, d), ["member"], F.lit(8)),
         """WITH x AS (SELECT member, horizon, -ln(1 + p90_smooth / 100) AS a, -ln(1 + p10_smooth / 100) AS b FROM lbands),
            y AS (SELECT *, max((a + b) / 2) FILTER (horizon = 8) OVER (PARTITION BY member) AS mid8, greatest((b - a) / 2, 1.2815515655446008 * (0.021 / (2 * 0.974113877059309)) * horizon) AS w FROM x)
            SELECT member, horizon, CASE WHEN horizon > 8 THEN mid8 ELSE (a + b) / 2 END - w AS log_low, CASE WHEN horizon > 8 THEN mid8 ELSE (a + b) / 2 END + w AS log_high FROM y""",
         "log_low log_high")

CTES["popast"] = """
WITH b AS (SELECT r AS revision, entity, sum(population) / count(*) AS m FROM panel, (VALUES (24), (27), (30), (33), (36)) t(r) WHERE NOT is_aggregate AND period BETWEEN r - 3 AND r GROUP BY 1, 2)
SELECT revision, entity, (revision + k)::INTEGER AS period, m * (1 + k * 0.002::DOUBLE) AS population FROM b, range(0, 23) x(k)"""
CTES["pocur"] = """
WITH r AS (SELECT entity, nk, period, population, h FROM panel, range(0, 21) t(h) WHERE NOT is_aggregate AND period <= 44 AND (h = 0 OR period = 44)),
w AS (SELECT *, h * (0.010::DOUBLE + (nk % 5) * 0.004::DOUBLE) AS w FROM r)
SELECT entity, (period + h)::INTEGER AS period, population AS median, CASE WHEN period + h >= 44 THEN population * (1 - w) END AS low, CASE WHEN period + h >= 44 THEN population * (1 + w * 1.1::DOUBLE) END AS high FROM w"""
CTES["poerr"] = """
SELECT r.revision, r.entity, r.period, r.period - r.revision AS horizon, CASE WHEN b.population > 22 THEN 'large' ELSE 'small' END AS size, 100 * (r.population / c.median - 1) AS error_pct
FROM popast r JOIN pocur c ON c.entity = r.entity AND c.period = r.period LEFT JOIN popast b ON b.revision = r.revision AND b.entity = r.entity AND b.period = r.revision
WHERE r.period > r.revision AND c.period < 44 AND r.population > 0 AND c.median > 0"""
CTES["pobnd"] = """
WITH b AS (SELECT entity, period - 44 AS horizon, 100 * (low / median - 1) AS low_pct, 100 * (high / median - 1) AS high_pct FROM pocur WHERE period >= 44 AND low > 0 AND median > 0),
w AS (SELECT *, round(ln(1 + high_pct / 100) - ln(1 + low_pct / 100), 12) AS width FROM b)
SELECT entity, horizon, low_pct, high_pct, ['narrow', 'middle', 'wide'][least(2, floor(3 * (rank() OVER (PARTITION BY horizon ORDER BY width) + (count(*) OVER (PARTITION BY horizon, width) - 1) / 2.0::DOUBLE - 0.5)
  / count(*) OVER (PARTITION BY horizon)))::INTEGER + 1] AS third FROM w"""
CTES["poz"] = """
WITH m AS (SELECT e.*, coalesce(h.grp, s.grp) AS grp, low_pct, high_pct, third, ln(1 + low_pct / 100) AS lo, ln(1 + high_pct / 100) AS hi, -ln(1 + error_pct / 100) AS rho
  FROM poerr e JOIN pobnd b ON b.entity = e.entity AND b.horizon = e.horizon LEFT JOIN suppliers s ON s.entity = e.entity LEFT JOIN group_history h ON h.entity = e.entity AND h.fiscal = e.revision WHERE e.horizon >= 1),
z AS (SELECT * EXCLUDE (lo, hi, rho), CASE WHEN rho >= 0 THEN rho / hi ELSE rho / -lo END AS z FROM m WHERE lo < 0 AND hi > 0)
SELECT *, z >= -1 AND z <= 1 AS inside FROM z"""
CTES["poobs"] = """SELECT size, third, horizon, count(*) AS cases, count(DISTINCT revision) AS revisions, avg(inside::INT) AS share_inside, quantile_cont(z, 0.9) AS k_high_observed,
  -quantile_cont(z, 0.1) AS k_low_observed FROM poz GROUP BY 1, 2, 3"""
CTES["popoints"] = """SELECT size, third, horizon, 'low' AS side, k_low_observed AS y FROM poobs WHERE revisions >= 4 UNION ALL SELECT size, third, horizon, 'high', k_high_observed FROM poobs WHERE revisions >= 4"""
CTES["polaw"] = _fit("popoints", "size, third, side", "-3.0::DOUBLE", 291)
CTES["posmooth"] = """
SELECT a.size, a.third, h::INTEGER AS horizon, f.last_fitted, greatest(1.0::DOUBLE, a.ic + a.sl * pow(h + 1.0::DOUBLE, a.b)) AS k_low, greatest(1.0::DOUBLE, b.ic + b.sl * pow(h + 1.0::DOUBLE, b.b)) AS k_high
FROM polaw a JOIN polaw b ON a.size = b.size AND a.third = b.third AND a.side = 'low' AND b.side = 'high'
JOIN (SELECT size, third, max(horizon) AS last_fitted FROM popoints GROUP BY 1, 2) f ON f.size = a.size AND f.third = a.third, range(1, 21) t(h)"""
CTES["pocal"] = """
WITH c AS (SELECT size, third, horizon, avg((z >= -k_low AND z <= k_high)::INT) AS share_inside_calibrated FROM poz JOIN posmooth USING (size, third, horizon) GROUP BY 1, 2, 3)
SELECT * FROM posmooth LEFT JOIN poobs USING (size, third, horizon) LEFT JOIN c USING (size, third, horizon)"""
CTES["pobounds"] = """
SELECT c.entity, c.period, CASE WHEN b.median > 22 THEN 'large' ELSE 'small' END AS size, t.third, c.low / c.median AS low_ratio, c.high / c.median AS high_ratio,
  exp(k_low * ln(c.low / c.median)) AS low_calibrated, exp(k_high * ln(c.high / c.median)) AS high_calibrated
FROM pocur c JOIN pocur b ON b.entity = c.entity AND b.period = 44 JOIN pobnd t ON t.entity = c.entity AND t.horizon = c.period - 44
JOIN posmooth k ON k.size = CASE WHEN b.median > 22 THEN 'large' ELSE 'small' END AND k.third = t.third AND k.horizon = t.horizon WHERE c.period > 44"""
register("p1_b12_projection_errors", lambda s, d: p.projection_errors(past_revisions(s, d), current_population(s, d), CURRENT, SIZE), "SELECT * FROM poerr", "error_pct", 6)
register("p3_p4_current_bounds", lambda s, d: p.current_bounds(current_population(s, d), CURRENT), "SELECT * FROM pobnd", "low_pct high_pct", 6)
register("p2_p5_b21_standardised_deviations", lambda s, d: population_rows.build(s, d), "SELECT * FROM poz", "error_pct low_pct high_pct z", 6)
CTES["podev"] = """WITH m AS (SELECT 'all' AS member, * FROM poz UNION ALL SELECT grp, * FROM poz WHERE grp IS NOT NULL UNION ALL SELECT size, * FROM poz),
            x AS (SELECT member, horizon, count(*) AS cases, count(DISTINCT revision) AS revisions, avg(inside::INT) AS share_inside, quantile_cont(error_pct, 0.1) AS p10, median(error_pct) AS p50,
              quantile_cont(error_pct, 0.9) AS p90, median(abs(error_pct)) AS median_abs, median(low_pct) AS median_low, median(high_pct) AS median_high FROM m GROUP BY 1, 2)
            SELECT *, (1 / (1 + p90 / 100) - 1) * 100 AS outcome_low_pct, (1 / (1 + p10 / 100) - 1) * 100 AS outcome_high_pct FROM x"""
register("p6_deviation_summary", lambda s, d: p.deviation_summary(population_rows(s, d), REGIONS), "SELECT * FROM podev",
         "share_inside p10 p50 p90 median_abs median_low median_high outcome_low_pct outcome_high_pct", 6)
register("p7_p8_multipliers", lambda s, d: p.multipliers(population_rows(s, d), 4, EXTRAPOLATED), "SELECT * FROM pocal",
         "k_low k_high share_inside k_high_observed k_low_observed share_inside_calibrated", 3)
register("p9_b20_calibrated_bounds", lambda s, d: p.calibrated_bounds(current_population(s, d), population_calibration(s, d), CURRENT, SIZE), "SELECT * FROM pobounds",
         "low_ratio high_ratio low_calibrated high_calibrated", 4)
register("b12_size_class", lambda s, d: inputs.panel(s, d).select("entity", "period", expr.size_class("population", SIZE).alias("size")),
         "SELECT entity, period, CASE WHEN population > 22 THEN 'large' ELSE 'small' END AS size FROM panel")
