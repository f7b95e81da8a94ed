"""Queries of the joint trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.functions import expr
from vintara.operators import calibration as c, draws as w, population as p, scenarios as sc
from vintara.plans import inputs
from vintara.plans.calibration_queries import DRAWS, EDITION, levels_at_edition, predictions
from vintara.plans.inputs import REGIONS, memo
from vintara.plans.longrun_queries import population_rows
from vintara.plans.oracle import CTES
from vintara.plans.registry import register
from vintara.plans.scenario_queries import LAST, dated_bands, scenarios

MIN_ENTITIES, BOOTSTRAP = 8, 200
PERIODS = (46, 55, 60)


@memo
def editions(spark, sf):
    return w.eligible_editions(levels_at_edition(spark, sf), 5, MIN_ENTITIES)


def usable_bands(spark, sf):
    known = scenarios(spark, sf).where("scenario = 'central'").select("entity").distinct()
    return dated_bands(spark, sf).join(known, "entity", "left_semi")


@memo
def ratios(spark, sf):
    return w.ratios_to_horizon(levels_at_edition(spark, sf), usable_bands(spark, sf), editions(spark, sf), 5)


@memo
def trajectories(spark, sf):
    return w.draw_trajectories(ratios(spark, sf), scenarios(spark, sf), EDITION, 5, LAST)


def past_positions(spark, sf):
    return population_rows(spark, sf).where("horizon = 5").select("revision", "entity", "size", "z")


@memo
def populations(spark, sf):
    past = past_positions(spark, sf)
    levels = w.population_levels(past, inputs.suppliers(spark, sf).select("entity"))
    return w.population_draws(levels, w.assign_revisions(editions(spark, sf), past), scenarios(spark, sf), (EDITION, LAST))


@memo
def drawn(spark, sf):
    return w.per_capita_draws(trajectories(spark, sf), populations(spark, sf), scenarios(spark, sf))


def membership(spark, sf):
    """Overlapping aggregates: everything, each region, and one small set."""
    s = inputs.suppliers(spark, sf)
    names = F.filter(F.array(F.lit("all"), F.col("grp"), F.when(F.col("nk") < 6, "first nations")), lambda a: a.isNotNull())
    return s.select("entity", F.explode(names).alias("aggregate"))


CTES["jeds"] = "SELECT edition, count(DISTINCT entity) AS entities FROM levels_pit WHERE horizon = 5 AND level_error_own IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity) >= 8"
CTES["jplaced"] = """
WITH x AS (SELECT p.*, CASE WHEN a.n IS NOT NULL THEN a.cell WHEN b.n IS NOT NULL THEN b.cell ELSE 'all' END AS cell FROM past p
  LEFT JOIN pstats a ON a.horizon = p.horizon AND a.regime = '' AND a.cell = 'cell|' || cls || '|' || grp LEFT JOIN pstats b ON b.horizon = p.horizon AND b.regime = '' AND b.cell = 'class|' || cls)
SELECT horizon, cell, level_error_own, entity, edition, grp, cls::INTEGER AS cls, (rank() OVER (PARTITION BY horizon, cell ORDER BY level_error_own) + (count(*) OVER (PARTITION BY horizon, cell, level_error_own) - 1) / 2.0::DOUBLE - 0.5)
  / count(*) OVER (PARTITION BY horizon, cell) AS u FROM x"""
CTES["jpos"] = """
WITH e AS (SELECT DISTINCT entity, grp FROM bands SEMI JOIN (SELECT entity FROM scen WHERE scenario = 'central') USING (entity)),
g AS (SELECT e.*, edition, h::INTEGER AS horizon FROM e, jeds, range(0, 6) t(h)), k AS (SELECT horizon, edition, entity, avg(u) AS u FROM jplaced GROUP BY 1, 2, 3),
r AS (SELECT g.*, k.u FROM g LEFT JOIN k USING (horizon, edition, entity)), mg AS (SELECT horizon, edition, grp, median(u) AS ug FROM r GROUP BY 1, 2, 3), me AS (SELECT horizon, edition, median(u) AS ue FROM r GROUP BY 1, 2)
SELECT r.horizon, r.edition, r.entity, r.grp, coalesce(r.u, ug, ue, 0.5) AS u FROM r LEFT JOIN mg USING (horizon, edition, grp) LEFT JOIN me ON me.horizon = r.horizon AND me.edition = r.edition"""
CTES["jlev"] = """SELECT *, (k - 0.5::DOUBLE) / n AS level_q FROM (SELECT *, (row_number() OVER (PARTITION BY horizon, entity ORDER BY round(u, 12), edition))::INTEGER AS k,
  count(*) OVER (PARTITION BY horizon, entity) AS n FROM jpos)"""
CTES["jrat"] = """
WITH m AS (SELECT horizon, 'cell|' || cls || '|' || grp AS cell, level_error_own AS e FROM jplaced WHERE grp IS NOT NULL UNION ALL SELECT horizon, 'class|' || cls, level_error_own FROM jplaced
  UNION ALL SELECT horizon, 'all', level_error_own FROM jplaced), l AS (SELECT horizon, cell, list_sort(list(e)) AS es, count(*) AS c FROM m GROUP BY 1, 2),
b AS (SELECT entity, horizon, CASE based_on WHEN 'cell' THEN 'cell|' || cls || '|' || grp WHEN 'class' THEN 'class|' || cls ELSE 'all' END AS cell FROM bands),
q AS (SELECT j.edition, j.entity, j.horizon, es, (c - 1) * level_q AS pos FROM jlev j JOIN b USING (entity, horizon) JOIN l ON l.horizon = j.horizon AND l.cell = b.cell)
SELECT edition AS draw, entity, horizon, 1 / (1 + (es[floor(pos)::INT + 1] + (es[ceil(pos)::INT + 1] - es[floor(pos)::INT + 1]) * (pos - floor(pos))) / 100) AS ratio FROM q"""
CTES["jband"] = """SELECT entity, period, max(level) FILTER (scenario = 'central') AS central, ln(max(level) FILTER (scenario = 'low') / max(level) FILTER (scenario = 'central')) AS l,
  ln(max(level) FILTER (scenario = 'high') / max(level) FILTER (scenario = 'central')) AS h FROM scen WHERE period BETWEEN 41 AND 60 GROUP BY 1, 2"""
CTES["jtraj"] = """
WITH z AS (SELECT draw, entity, ratio, (ln(ratio) - (l + h) / 2) / CASE WHEN (h - l) / 2 > 1e-9 THEN (h - l) / 2 END AS z FROM jrat JOIN jband USING (entity) WHERE horizon = 5 AND period = 46)
SELECT draw, entity, period, ratio * central AS level FROM jrat JOIN jband USING (entity) WHERE period = horizon + 41 AND central IS NOT NULL
UNION ALL SELECT draw, entity, period, coalesce(exp((l + h) / 2 + z * (h - l) / 2), ratio) * central FROM z JOIN jband USING (entity) WHERE period > 46 AND central IS NOT NULL"""
CTES["jplev"] = """
WITH p AS (SELECT revision, entity, size, z FROM poz WHERE horizon = 5), u AS (SELECT entity, revision, avg(u) AS u FROM (SELECT entity, revision,
    (rank() OVER (PARTITION BY size ORDER BY z) + (count(*) OVER (PARTITION BY size, z) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY size) AS u FROM p) GROUP BY 1, 2),
g AS (SELECT s.entity, r.revision, u.u FROM suppliers s CROSS JOIN (SELECT DISTINCT revision FROM p) r LEFT JOIN u ON u.entity = s.entity AND u.revision = r.revision),
m AS (SELECT revision, median(u) AS um FROM g GROUP BY 1), f AS (SELECT entity, g.revision, coalesce(u, um, 0.5) AS u FROM g JOIN m USING (revision))
SELECT *, (k - 0.5::DOUBLE) / n AS level_q FROM (SELECT *, (row_number() OVER (PARTITION BY entity ORDER BY round(u, 12), revision))::INTEGER AS k, count(*) OVER (PARTITION BY entity) AS n FROM f)"""
CTES["jassign"] = """
WITH r AS (SELECT list_sort(list(DISTINCT revision)) AS rs FROM poz WHERE horizon = 5), o AS (SELECT edition, row_number() OVER (ORDER BY substring(edition, 2)::INT * 2 + (edition LIKE 'F%')::INT) - 1 AS i, count(*) OVER () AS n FROM jeds)
SELECT edition AS draw, rs[floor(i * len(rs) / n)::INT + 1] AS revision FROM o, r"""
# Levels are (k - 1/2) / 5: their standard normal quantiles, as fixed values.
CTES["jpop"] = """
WITH q AS (SELECT * FROM (VALUES (1, -1.2815515655446008::DOUBLE), (2, -0.5244005127080409::DOUBLE), (3, 0.0::DOUBLE), (4, 0.5244005127080407::DOUBLE), (5, 1.2815515655446008::DOUBLE)) t(k, x)),
p AS (SELECT draw, l.entity, l.revision, x / 1.2815515655446008 AS z FROM jplev l JOIN q USING (k) JOIN jassign a ON a.revision = l.revision)
SELECT draw, p.entity, period, pop_central * exp(CASE WHEN z >= 0 THEN z * ln(pop_high_calibrated / pop_central) ELSE -z * ln(pop_low_calibrated / pop_central) END) AS population, revision
FROM p JOIN scen s ON s.entity = p.entity AND scenario = 'central' AND period BETWEEN 41 AND 60 WHERE pop_central IS NOT NULL"""
CTES["jdrawn"] = """SELECT draw, t.entity, t.period, population, revision, level * pop_central / 1000 AS total, level * pop_central / population AS level
FROM jtraj t JOIN jpop p USING (draw, entity, period) JOIN (SELECT entity, period, pop_central FROM scen WHERE scenario = 'central') s USING (entity, period)"""
register("j1_past_cells", lambda s, d: w.past_cells(levels_at_edition(s, d), 5)[0].select("horizon", "cell", "level_error_own", "entity", "edition", "grp", "cls", "u"),
         "SELECT * FROM jplaced", "level_error_own u", 6)
register("j2_eligible_editions", lambda s, d: w.eligible_editions(levels_at_edition(s, d), 5, MIN_ENTITIES), "SELECT * FROM jeds")
register("j3_j4_positions_and_levels", lambda s, d: w.quantile_levels(
    w.positions(w.past_cells(levels_at_edition(s, d), 5)[0], editions(s, d), usable_bands(s, d).groupBy("entity").agg(F.min("grp").alias("grp")), 5), ["horizon", "entity"], "edition"),
    "SELECT * FROM jlev", "u level_q", 6)
register("j5_ratios_to_horizon", lambda s, d: ratios.build(s, d), "SELECT * FROM jrat", "ratio", 6)
register("j6_j7_trajectories", lambda s, d: trajectories.build(s, d), "SELECT * FROM jtraj", "level", 3)
register("j7_scenario_slice", lambda s, d: w.scenario_slice(scenarios(s, d), "central", PERIODS),
         "SELECT entity, max(level) FILTER (period = 46) AS p46, max(level) FILTER (period = 55) AS p55, max(level) FILTER (period = 60) AS p60 FROM scen WHERE scenario = 'central' GROUP BY 1", "p46 p55 p60")
register("j8_population_levels", lambda s, d: w.population_levels(past_positions(s, d), inputs.suppliers(s, d).select("entity")), "SELECT * FROM jplev", "u level_q", 6)
register("j9_assign_revisions", lambda s, d: w.assign_revisions(editions(s, d), past_positions(s, d)), "SELECT * FROM jassign")
register("j10_b28_population_draws", lambda s, d: populations.build(s, d), "SELECT * FROM jpop", "population", 5)
register("j11_per_capita_draws", lambda s, d: drawn.build(s, d), "SELECT * FROM jdrawn", "population total level", 3)
register("j12_outside_shares", lambda s, d: w.outside_shares(drawn(s, d), scenarios(s, d), PERIODS),
         """WITH b AS (SELECT entity, period, max(level) FILTER (scenario = 'low') AS lo, max(level) FILTER (scenario = 'high') AS hi, max(pop_low_calibrated) FILTER (scenario = 'central') AS pl,
              max(pop_high_calibrated) FILTER (scenario = 'central') AS ph FROM scen WHERE period IN (46, 55, 60) GROUP BY 1, 2)
            SELECT entity, period, avg(coalesce(level < lo, false)::INT) AS below, avg(coalesce(level > hi, false)::INT) AS above, avg(coalesce(population < pl * (1 - 1e-9), false)::INT) AS population_below,
            avg(coalesce(population > ph * (1 + 1e-9), false)::INT) AS population_above FROM jdrawn JOIN b USING (entity, period) GROUP BY 1, 2""", "below above population_below population_above")


@memo
def control(spark, sf):
    return w.aggregate_control(drawn(spark, sf), scenarios(spark, sf), membership(spark, sf), PERIODS, BOOTSTRAP)


CTES["jcontrol"] = f"""WITH m AS (SELECT entity, 'all' AS aggregate FROM suppliers UNION ALL SELECT entity, grp FROM suppliers WHERE grp IS NOT NULL UNION ALL SELECT entity, 'first nations' FROM suppliers WHERE nk < 6),
             t AS (SELECT aggregate, period, draw, sum(total) AS t FROM jdrawn JOIN m USING (entity) WHERE period IN (46, 55, 60) GROUP BY 1, 2, 3),
             b AS (SELECT aggregate, period, count(DISTINCT entity) AS entities, sum(total) FILTER (scenario = 'central') AS c, sum(total) FILTER (scenario = 'low') AS l, sum(total) FILTER (scenario = 'high') AS h
               FROM scen JOIN m USING (entity) WHERE period IN (46, 55, 60) GROUP BY 1, 2),
             r AS (SELECT t.aggregate, t.period, draw, substring(draw, 2)::INT AS ep, 100 * t / c AS rel, entities, c, l, h FROM t JOIN b USING (aggregate, period)),
             k AS (SELECT ep, row_number() OVER (ORDER BY ep) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ep FROM r)),
             s AS (SELECT d, ('0x' || substring(md5('vintara-q-' || d || '-' || x), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT n FROM k), range(0, {BOOTSTRAP}) a(d), range(0, 100) b(x) WHERE x < n),
             v AS (SELECT aggregate, period, d, quantile_cont(rel, 0.1) AS p10, quantile_cont(rel, 0.9) AS p90 FROM s JOIN k USING (i) JOIN r USING (ep) GROUP BY 1, 2, 3),
             ci AS (SELECT aggregate, period, quantile_cont(p10, 0.025) AS p10_ci_low, quantile_cont(p10, 0.975) AS p10_ci_high, quantile_cont(p90, 0.025) AS p90_ci_low, quantile_cont(p90, 0.975) AS p90_ci_high FROM v GROUP BY 1, 2)
             SELECT * FROM (SELECT aggregate, period, max(entities) AS entities, count(*) AS draws, quantile_cont(rel, 0.1) AS p10, median(rel) AS p50, quantile_cont(rel, 0.9) AS p90, 100 * max(l) / max(c) AS sum_of_lows,
               100 * max(h) / max(c) AS sum_of_highs FROM r GROUP BY 1, 2) JOIN ci USING (aggregate, period)"""
register("j12_j13_aggregate_control", lambda s, d: control.build(s, d), "SELECT * FROM jcontrol",
         "p10 p50 p90 sum_of_lows sum_of_highs p10_ci_low p10_ci_high p90_ci_low p90_ci_high", 3)
register("b28_inverse_normal", lambda s, d: w.population_levels(past_positions(s, d), inputs.suppliers(s, d).select("entity")).groupBy("k", "level_q").agg(F.count(F.lit(1)).alias("n")).withColumn(
    "z", expr.inverse_normal("level_q")),
    """SELECT k, level_q, count(*) AS n, (CASE k WHEN 1 THEN -1.2815515655446008 WHEN 2 THEN -0.5244005127080409 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5244005127080407 ELSE 1.2815515655446008 END)::DOUBLE AS z
       FROM jplev GROUP BY 1, 2""", "level_q z", 6)


def figures(s, d):
    """The four families of key figures: an entity's bands and populations, aggregates, real-time scores, population bounds."""
    parts = [sc.key_figures(scenarios(s, d), "E3", PERIODS), sc.aggregate_figures(control(s, d), ("all", "EUROPE"), PERIODS),
             sc.score_figures(c.band_scores(predictions(s, d), DRAWS)), sc.population_figures(p.deviation_summary(population_rows(s, d), REGIONS), (1, 5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _figures_sql(table: str, name: str, figures: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {name} || ' {n}' AS figure, ({e})::DOUBLE AS value FROM {table}" for n, e in figures.items())


CTES["allfigures"] = "SELECT * FROM figures UNION ALL " + " UNION ALL ".join(f"SELECT * FROM ({x}) WHERE value IS NOT NULL" for x in (
    _figures_sql("jcontrol WHERE aggregate IN ('all', 'EUROPE')", "aggregate || ' ' || period", {c_: c_ for c_ in ("p10", "p10_ci_low", "p10_ci_high", "p90", "sum_of_lows", "sum_of_highs")}),
    _figures_sql("bandscores WHERE retained", "'real time'", {"coverage": "coverage_pct", "coverage_low": "coverage_pct_ci_low", "coverage_high": "coverage_pct_ci_high", "score": "score", "weighted_score": "weighted_score"}),
    _figures_sql("podev WHERE member = 'all' AND horizon IN (1, 5)", "'population ' || horizon", {"share_inside": "100 * share_inside"})))
register("x_key_figures", figures, "SELECT * FROM allfigures", "value", 3)
