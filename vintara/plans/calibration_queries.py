"""Queries of the bands and of the real-time calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.functions import expr
from vintara.operators import bands as b, calibration as c, evaluation as e, vintages as v
from vintara.plans import inputs
from vintara.plans.evaluation_queries import SPLIT, levels, panel_references, real_vintages
from vintara.plans.inputs import REGIONS, memo
from vintara.plans.oracle import CTES
from vintara.plans.registry import register

RT_HORIZON, RT_FIRST = 3, 31
EDITION = 41  # the edition whose projections reach the end of the report
DRAWS = 200


@memo
def world(spark, sf):
    """World growth series, shifted so that falls are the exception."""
    return inputs.panel(spark, sf).where("entity = 'G001' AND growth IS NOT NULL").select(
        "period", (F.col("growth") + 2.0).alias("value"))


def group_history(spark, sf):
    """A group per entity and fiscal period, known for some periods only."""
    regions = F.array(*[F.lit(r) for r in REGIONS])
    return inputs.panel(spark, sf).where("NOT is_aggregate AND population % 4 = 0").select(
        "entity", F.col("period").alias("fiscal"),
        F.get(regions, (F.col("nk") + F.col("population").cast("int")) % 5).alias("grp"))


@memo
def levels_at_edition(spark, sf):
    """Evaluated, chained and grouped in one plan, which lies by entity throughout: neither the evaluation nor the levels are written for it."""
    chained = e.level_errors(v.evaluate(real_vintages(spark, sf), panel_references(spark, sf)))
    return b.groups_at_edition(chained, group_history(spark, sf))


def entities(spark, sf):
    return inputs.suppliers(spark, sf).select("entity", "name", "grp")


@memo
def bands(spark, sf):
    return b.projection_bands(levels_at_edition(spark, sf), v.current_cumulative_projection(real_vintages(spark, sf), EDITION, 5),
                              entities(spark, sf), world(spark, sf), 5)


@memo
def predictions(spark, sf):
    return c.realtime_predictions(levels_at_edition(spark, sf), RT_HORIZON, RT_FIRST, world(spark, sf))


CTES["world"] = "SELECT period, growth + 2.0::DOUBLE AS value FROM panel WHERE entity = 'G001' AND growth IS NOT NULL"
CTES["group_history"] = """
SELECT entity, period AS fiscal, ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'][(nk + population::INTEGER) % 5 + 1] AS grp
FROM panel WHERE NOT is_aggregate AND population::INTEGER % 4 = 0"""
CTES["levels_pit"] = """
SELECT l.* REPLACE (coalesce(h.grp, l.grp) AS grp) FROM levels l LEFT JOIN group_history h
ON h.entity = l.entity AND h.fiscal = l.edition_period + (l.season = 'F')::INTEGER"""
CTES["current_growth"] = """
WITH c AS (SELECT * FROM real_vintages WHERE edition_period = 41 AND season = 'F')
SELECT a.entity, a.horizon, (product(1 + b.value / 100) - 1) * 100 AS g FROM c a JOIN c b ON a.entity = b.entity AND b.horizon BETWEEN 0 AND a.horizon
WHERE a.horizon BETWEEN 0 AND 5 GROUP BY 1, 2 HAVING count(DISTINCT b.horizon) = a.horizon + 1"""
_mem = """SELECT {k}, '{r}' AS regime, 'cell|' || cls || '|' || grp AS cell, level_error_own AS e, worst_realised AS w FROM {t} WHERE {f}
  UNION ALL SELECT {k}, '{r}', 'class|' || cls, level_error_own, worst_realised FROM {t} WHERE {f}
  UNION ALL SELECT {k}, '{r}', 'group|' || grp, level_error_own, worst_realised FROM {t} WHERE {f}
  UNION ALL SELECT {k}, '{r}', 'all', level_error_own, worst_realised FROM {t} WHERE {f}"""


def _stats(k, t):
    mem = " UNION ALL ".join(_mem.format(k=k, r=r, t=t, f=f) for r, f in (("", "true"), ("crisis", "crisis"), ("calm", "NOT crisis")))
    return f"""SELECT {k}, regime, cell, count(*) AS n, avg(coalesce(w < 0, false)::INT) AS freq, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.9) AS hi,
      median(e) AS med, median(w) FILTER (w < 0) AS depth FROM ({mem}) WHERE cell IS NOT NULL GROUP BY 1, 2, 3
      HAVING count(*) >= 100 OR cell NOT LIKE 'cell|%'"""


CTES["past"] = """
WITH p AS (SELECT * FROM levels_pit WHERE horizon BETWEEN 0 AND 5 AND level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL),
q AS (SELECT horizon, quantile_cont(projected_growth_pct, [0.2, 0.4, 0.6, 0.8]) AS edges FROM p GROUP BY 1)
SELECT p.*, edges, len(list_filter(edges, lambda x: round(x, 9) <= round(projected_growth_pct, 9))) + 1 AS cls,
  EXISTS (SELECT 1 FROM world w WHERE w.value < 0 AND w.period > p.edition_period AND w.period <= p.edition_period + p.horizon) AS crisis
FROM p JOIN q USING (horizon)"""
CTES["pstats"] = _stats("horizon", "past")
CTES["pis"] = """
SELECT h::INTEGER AS horizon, avg(EXISTS (SELECT 1 FROM world r WHERE r.value < 0 AND r.period BETWEEN a.period AND a.period + h - 1)::INT) AS pi
FROM range(0, 6) t(h), world a WHERE a.period + h - 1 <= (SELECT max(period) FROM world) GROUP BY 1"""
CTES["bands"] = """
WITH q AS (SELECT DISTINCT horizon, edges FROM past),
r AS (SELECT s.entity, s.name, s.grp, q.horizon, g.g AS projected_growth_pct,
    CASE WHEN g.g IS NOT NULL THEN (len(list_filter(edges, lambda x: round(x, 9) <= round(g.g, 9))) + 1)::INTEGER END AS cls
  FROM suppliers s CROSS JOIN q LEFT JOIN current_growth g ON g.entity = s.entity AND g.horizon = q.horizon),
j AS (SELECT r.*, pi, a.n n1, b.n n2, d.n n3, CASE WHEN a.n IS NOT NULL THEN 'cell' WHEN b.n IS NOT NULL THEN 'class' ELSE 'all' END AS based_on,
    CASE WHEN a.n IS NOT NULL THEN a.n WHEN b.n IS NOT NULL THEN b.n ELSE d.n END AS cases,
    CASE WHEN a.n IS NOT NULL THEN a.lo WHEN b.n IS NOT NULL THEN b.lo ELSE d.lo END AS lo,
    CASE WHEN a.n IS NOT NULL THEN a.med WHEN b.n IS NOT NULL THEN b.med ELSE d.med END AS med,
    CASE WHEN a.n IS NOT NULL THEN a.hi WHEN b.n IS NOT NULL THEN b.hi ELSE d.hi END AS hi,
    CASE WHEN a.n IS NOT NULL THEN a.depth WHEN b.n IS NOT NULL THEN b.depth ELSE d.depth END AS depth,
    CASE WHEN e.n >= 100 THEN e.lo ELSE d.lo END AS glo, CASE WHEN e.n >= 100 THEN e.hi ELSE d.hi END AS ghi,
    coalesce(a.freq, b.freq, d.freq) AS f0, coalesce(ca.freq, cb.freq, cd.freq) AS fc, coalesce(na.freq, nb.freq, nd.freq) AS fn,
    CASE WHEN ca.n IS NOT NULL THEN ca.med WHEN cb.n IS NOT NULL THEN cb.med ELSE cd.med END AS cmed
  FROM r JOIN pis USING (horizon)
  LEFT JOIN pstats a ON a.horizon = r.horizon AND a.regime = '' AND a.cell = 'cell|' || cls || '|' || grp
  LEFT JOIN pstats b ON b.horizon = r.horizon AND b.regime = '' AND b.cell = 'class|' || cls
  LEFT JOIN pstats d ON d.horizon = r.horizon AND d.regime = '' AND d.cell = 'all'
  LEFT JOIN pstats e ON e.horizon = r.horizon AND e.regime = '' AND e.cell = 'group|' || grp
  LEFT JOIN pstats ca ON ca.horizon = r.horizon AND ca.regime = 'crisis' AND ca.cell = 'cell|' || cls || '|' || grp
  LEFT JOIN pstats cb ON cb.horizon = r.horizon AND cb.regime = 'crisis' AND cb.cell = 'class|' || cls
  LEFT JOIN pstats cd ON cd.horizon = r.horizon AND cd.regime = 'crisis' AND cd.cell = 'all'
  LEFT JOIN pstats na ON na.horizon = r.horizon AND na.regime = 'calm' AND na.cell = 'cell|' || cls || '|' || grp
  LEFT JOIN pstats nb ON nb.horizon = r.horizon AND nb.regime = 'calm' AND nb.cell = 'class|' || cls
  LEFT JOIN pstats nd ON nd.horizon = r.horizon AND nd.regime = 'calm' AND nd.cell = 'all')
SELECT entity, name, grp, horizon, projected_growth_pct, cls, based_on, cases, lo AS error_p10, med AS error_median, hi AS error_p90,
  (1 / (1 + hi / 100) - 1) * 100 AS low_pct, (1 / (1 + lo / 100) - 1) * 100 AS high_pct, (1 / (1 + ghi / 100) - 1) * 100 AS low_pct_group,
  (1 / (1 + glo / 100) - 1) * 100 AS high_pct_group, (pi * coalesce(fc, f0) + (1 - pi) * coalesce(fn, f0)) * 100 AS downturn_pct,
  coalesce(fc, f0) * 100 AS downturn_crisis_pct, coalesce(fn, f0) * 100 AS downturn_calm_pct, pi * 100 AS crisis_pct,
  cmed AS error_median_crisis, depth AS depth_median FROM j"""

register("c10_groups_at_edition", lambda s, d: b.groups_at_edition(levels(s, d), group_history(s, d)).groupBy("grp", "horizon").agg(
    F.count(F.lit(1)).alias("n"), F.avg("level_error_own").alias("mean_error")),
    "SELECT grp, horizon, count(*) AS n, avg(level_error_own) AS mean_error FROM levels_pit GROUP BY 1, 2", "mean_error")
register("f24_recession_periods", lambda s, d: b.recession_periods(world(s, d), 40), "SELECT period FROM world WHERE value < 0 AND period <= 40")
register("f25_crisis_probability",
         lambda s, d: b.crisis_probabilities(world(s, d).select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("horizon")).distinct(), world(s, d), F.col("horizon")),
         "SELECT horizon, pi FROM pis", "pi", 6)
register("c9_periods_in_crisis", lambda s, d: b.in_crisis(levels(s, d).where("horizon >= 1"), world(s, d), F.col("horizon")).groupBy(
    "edition_period", "horizon").agg(F.bool_or("crisis").alias("crisis"), F.count(F.lit(1)).alias("n")),
    """SELECT edition_period, horizon, bool_or(EXISTS (SELECT 1 FROM world w WHERE w.value < 0 AND w.period BETWEEN edition_period + 1 AND edition_period + horizon)) AS crisis,
       count(*) AS n FROM levels WHERE horizon >= 1 GROUP BY 1, 2""")


def _statistics(spark, sf):
    from vintara.operators.evaluation import quantile_edges

    past = levels_at_edition(spark, sf).where("level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL")
    edges = quantile_edges(past, ["horizon"], "projected_growth_pct")
    rows = b.in_crisis(b.classify(past, edges, ["horizon"]), world(spark, sf), F.col("horizon"))
    stats = b.cell_statistics(rows, ["horizon"], regimes=True)
    return stats.where("n >= 100 OR cell NOT RLIKE '^([a-z]+:)?cell'").select(
        "horizon", "cell", "n", "frequency", "lo", "hi", "median", "depth")


register("f17_f18_f20_f26_cell_statistics", _statistics,
         """SELECT horizon, CASE WHEN regime = '' THEN cell ELSE regime || ':' || cell END AS cell, n, freq AS frequency, lo, hi, med AS median, depth FROM pstats""",
         "frequency lo hi median depth")
BANDS = ("projected_growth_pct error_p10 error_median error_p90 low_pct high_pct low_pct_group high_pct_group downturn_pct "
         "downturn_crisis_pct downturn_calm_pct crisis_pct error_median_crisis depth_median")
register("f21_f27_f32_projection_bands", lambda s, d: b.projection_bands(
    levels_at_edition(s, d), v.current_cumulative_projection(real_vintages(s, d), EDITION, 5), entities(s, d), world(s, d), 5),
    "SELECT * FROM bands", BANDS)
register("f22_b25_retrospective_calibration",
         lambda s, d: b.retrospective_calibration(levels_at_edition(s, d), RT_HORIZON, SPLIT, "AFRICA"),
         """WITH r AS (SELECT * FROM levels_pit WHERE horizon = 3 AND level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL),
            l AS (SELECT *, weight IS NOT NULL AND row_number() OVER (PARTITION BY edition ORDER BY weight DESC NULLS LAST, entity) <= 20 AS large FROM r),
            q AS (SELECT quantile_cont(projected_growth_pct, [0.2, 0.4, 0.6, 0.8]) AS edges FROM l WHERE edition_period <= 34),
            k AS (SELECT l.*, len(list_filter(edges, lambda x: round(x, 9) <= round(projected_growth_pct, 9))) + 1 AS cls FROM l, q),
            tr AS (SELECT *, level_error_own AS e FROM k WHERE edition_period <= 34), te AS (SELECT *, level_error_own AS e FROM k WHERE edition_period > 34),
            s2 AS (SELECT cls, grp, quantile_cont(e, 0.1) lo, quantile_cont(e, 0.9) hi FROM tr WHERE grp IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100),
            s1 AS (SELECT cls, quantile_cont(e, 0.1) lo, quantile_cont(e, 0.9) hi FROM tr GROUP BY 1),
            sg AS (SELECT grp, quantile_cont(e, 0.1) lo, quantile_cont(e, 0.9) hi FROM tr WHERE grp IS NOT NULL GROUP BY 1),
            so AS (SELECT entity, quantile_cont(e, 0.1) lo, quantile_cont(e, 0.9) hi FROM tr GROUP BY 1),
            m AS (SELECT 'class x group' AS method, te.*, coalesce(s2.lo, s1.lo) AS lo, coalesce(s2.hi, s1.hi) AS hi FROM te LEFT JOIN s2 USING (cls, grp) LEFT JOIN s1 USING (cls)
              UNION ALL SELECT 'class', te.*, lo, hi FROM te LEFT JOIN s1 USING (cls) UNION ALL SELECT 'group', te.*, lo, hi FROM te LEFT JOIN sg USING (grp)
              UNION ALL SELECT 'own history', te.*, lo, hi FROM te LEFT JOIN so USING (entity)),
            x AS (SELECT *, (e BETWEEN lo AND hi)::INT AS inside FROM m WHERE lo IS NOT NULL AND hi IS NOT NULL),
            o AS (SELECT method, count(*) AS cases, avg(inside) * 100 AS coverage_pct, avg(inside) FILTER (large) * 100 AS coverage_large_pct,
              avg(inside) FILTER (grp = 'AFRICA') * 100 AS coverage_poorest_pct,
              sum(inside * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) * 100 AS coverage_weighted_pct, median(hi - lo) AS median_width FROM x GROUP BY 1)
            SELECT *, CASE WHEN coverage_pct > 85 THEN 'cautious' WHEN coverage_pct < 75 THEN 'too narrow' ELSE 'right' END AS verdict FROM o""",
         "coverage_pct coverage_large_pct coverage_poorest_pct coverage_weighted_pct median_width")
register("e17_band_facts", lambda s, d: b.band_facts(bands(s, d), 5),
         """SELECT corr(projected_growth_pct, high_pct) AS growth_bound_link, min(downturn_pct) AS lowest_downturn, max(downturn_pct) AS highest_downturn
            FROM bands WHERE horizon = 5 AND projected_growth_pct IS NOT NULL""", "growth_bound_link lowest_downturn highest_downturn")

CTES["rt_cases"] = """
SELECT * FROM levels_pit WHERE horizon = 3 AND level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL AND worst_realised IS NOT NULL AND worst_projected IS NOT NULL"""
CTES["rt_train"] = """
WITH k AS (SELECT unnest(range(31, 60))::INTEGER AS v), t AS (SELECT k.v, c.* FROM k JOIN rt_cases c ON c.edition_period <= k.v - 5 WHERE k.v <= (SELECT max(edition_period) FROM rt_cases)),
g AS (SELECT v FROM t GROUP BY 1 HAVING count(*) >= 100),
q AS (SELECT v, quantile_cont(projected_growth_pct, [0.2, 0.4, 0.6, 0.8]) AS edges FROM t SEMI JOIN g USING (v) GROUP BY 1)
SELECT t.*, edges, len(list_filter(edges, lambda x: round(x, 9) <= round(projected_growth_pct, 9))) + 1 AS cls,
  EXISTS (SELECT 1 FROM world w WHERE w.value < 0 AND w.period > t.edition_period AND w.period <= t.edition_period + 3 AND w.period <= t.v - 2) AS crisis
FROM t JOIN q USING (v)"""
CTES["rt_stats"] = _stats("v", "rt_train")
CTES["rt_own"] = """SELECT v, entity, count(*) AS n, avg((worst_realised < 0)::INT) AS freq, quantile_cont(level_error_own, 0.1) AS lo, quantile_cont(level_error_own, 0.9) AS hi
FROM rt_train GROUP BY 1, 2 HAVING count(*) >= 8"""
CTES["rt_pi"] = """
SELECT v, avg(EXISTS (SELECT 1 FROM world r WHERE r.value < 0 AND r.period BETWEEN a.period AND a.period + 2)::INT) AS pi
FROM (SELECT DISTINCT v FROM rt_train) k JOIN world a ON a.period + 2 <= k.v - 2 GROUP BY 1"""
CTES["rt_test"] = """
SELECT c.*, q.v, (len(list_filter(edges, lambda x: round(x, 9) <= round(projected_growth_pct, 9))) + 1)::INTEGER AS cls, level_error_own AS error, (worst_realised < 0)::INT::DOUBLE AS down
FROM rt_cases c JOIN (SELECT DISTINCT v, edges FROM rt_train) q ON q.v = c.edition_period"""
CTES["rt_long"] = """
WITH s AS (SELECT v, cell, n, freq, lo, hi FROM rt_stats WHERE regime = ''),
x AS (SELECT t.*, 'cell|' || cls || '|' || grp AS c1, 'class|' || cls AS c2, 'group|' || grp AS c3 FROM rt_test t),
y AS (SELECT x.*, CASE WHEN a.n IS NOT NULL THEN c1 WHEN b.n IS NOT NULL THEN c2 ELSE 'all' END AS k1, CASE WHEN b.n IS NOT NULL THEN c2 ELSE 'all' END AS k2,
    CASE WHEN g.n IS NOT NULL THEN c3 ELSE 'all' END AS k3,
    coalesce(ca.freq, cb.freq, cd.freq) AS fc, coalesce(na.freq, nb.freq, nd.freq) AS fn, coalesce(a.freq, b.freq, d.freq) AS f0
  FROM x LEFT JOIN s a ON a.v = x.v AND a.cell = c1 LEFT JOIN s b ON b.v = x.v AND b.cell = c2 LEFT JOIN s g ON g.v = x.v AND g.cell = c3
  LEFT JOIN s d ON d.v = x.v AND d.cell = 'all'
  LEFT JOIN rt_stats ca ON ca.v = x.v AND ca.regime = 'crisis' AND ca.cell = c1 LEFT JOIN rt_stats cb ON cb.v = x.v AND cb.regime = 'crisis' AND cb.cell = c2
  LEFT JOIN rt_stats cd ON cd.v = x.v AND cd.regime = 'crisis' AND cd.cell = 'all'
  LEFT JOIN rt_stats na ON na.v = x.v AND na.regime = 'calm' AND na.cell = c1 LEFT JOIN rt_stats nb ON nb.v = x.v AND nb.regime = 'calm' AND nb.cell = c2
  LEFT JOIN rt_stats nd ON nd.v = x.v AND nd.regime = 'calm' AND nd.cell = 'all'),
m AS (SELECT y.*, 'class x group' AS method, k1 AS cell FROM y UNION ALL SELECT y.*, 'class', k2 FROM y UNION ALL SELECT y.*, 'group', k3 FROM y UNION ALL SELECT y.*, 'all', 'all' FROM y),
z AS (SELECT m.*, s.lo, s.hi, s.freq AS p FROM m JOIN s USING (v, cell)
  UNION ALL SELECT y.*, 'own history', 'own|' || y.entity, o.lo, o.hi, o.freq FROM y JOIN rt_own o ON o.v = y.v AND o.entity = y.entity
  UNION ALL SELECT y.*, 'announced path', NULL, NULL, NULL, (worst_projected < 0)::INT::DOUBLE FROM y
  UNION ALL SELECT y.*, 'class x group, crises apart', NULL, NULL, NULL, pi * coalesce(fc, f0) + (1 - pi) * coalesce(fn, f0) FROM y JOIN rt_pi USING (v))
SELECT entity, edition, grp, v, period, weight, cls, error, down, method, cell, lo, hi, p FROM z"""
CTES["rt_samples"] = """
SELECT v, 'cell|' || cls || '|' || grp AS cell, level_error_own AS x FROM rt_train WHERE grp IS NOT NULL UNION ALL SELECT v, 'class|' || cls, level_error_own FROM rt_train
UNION ALL SELECT v, 'group|' || grp, level_error_own FROM rt_train WHERE grp IS NOT NULL UNION ALL SELECT v, 'all', level_error_own FROM rt_train
UNION ALL SELECT v, 'own|' || entity, level_error_own FROM rt_train"""
CTES["rt_disp"] = """
SELECT v, cell, count(*) AS n, 2 * sum((2 * i - n - 1) * x) / pow(max(n), 2) AS disp FROM (SELECT v, cell, x, row_number() OVER (PARTITION BY v, cell ORDER BY x) AS i,
  count(*) OVER (PARTITION BY v, cell) AS n FROM rt_samples) GROUP BY 1, 2"""
CTES["preds"] = """
WITH q AS (SELECT DISTINCT v, cell, error FROM rt_long WHERE cell IS NOT NULL),
a AS (SELECT q.v, q.cell, q.error, avg(abs(s.x - q.error)) AS d FROM q JOIN rt_samples s ON s.v = q.v AND s.cell = q.cell GROUP BY 1, 2, 3),
r AS (SELECT a.v, a.cell, a.error, d - disp / 2 AS crps FROM a JOIN rt_disp USING (v, cell))
SELECT l.entity, l.edition, grp, l.v, period, weight, cls, l.error, down, method, lo, hi, crps, p, (l.error BETWEEN lo AND hi)::INT::DOUBLE AS covered,
  CASE WHEN lo IS NOT NULL THEN hi - lo + 10 * greatest(lo - l.error, 0) + 10 * greatest(l.error - hi, 0) END AS score, pow(p - down, 2) AS brier
FROM rt_long l LEFT JOIN r ON r.v = l.v AND r.cell = l.cell AND r.error = l.error"""
register("c8_expanding_training", lambda s, d: c.training_sizes(
    levels_at_edition(s, d).where("horizon = 3 AND level_error_own IS NOT NULL"), 3, RT_FIRST, 43),
    """SELECT v::INTEGER AS v, count(*) AS n, max(edition_period) AS latest FROM range(31, 44) k(v) JOIN levels_pit ON horizon = 3 AND level_error_own IS NOT NULL
       AND edition_period <= v - 5 GROUP BY 1""")
register("h1_h2_realtime_predictions", lambda s, d: c.realtime_predictions(levels_at_edition(s, d), RT_HORIZON, RT_FIRST, world(s, d)),
         "SELECT * FROM preds", "weight error lo hi crps p score brier", 6)


def on(fn):
    return lambda s, d: fn(predictions(s, d))


CTES["common"] = """
SELECT *, max(score) FILTER (method = 'class x group') OVER w - score AS gap, max(covered) FILTER (method = 'class x group') OVER w AS covered_retained
FROM preds WHERE method IN ('class x group', 'class', 'group', 'all', 'own history')
WINDOW w AS (PARTITION BY entity, edition) QUALIFY count(*) OVER w = 5"""


def _boot(rows, key, sums, stats, out):
    """The block bootstrap with the same hash of (draw, slot)."""
    s = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    d = ", ".join(f"sum({n} * times) AS {n}" for n in sums)
    st = ", ".join(f"{e} AS {n}" for n, e in stats.items())
    ci = ", ".join(f"quantile_cont({n}, 0.025) AS {n}_ci_low, quantile_cont({n}, 0.975) AS {n}_ci_high" for n in stats)
    return f"""WITH bt AS (SELECT {key}, period, {s} FROM {rows} GROUP BY 1, 2),
bi AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS b FROM bt),
pk AS (SELECT b, draw, ('0x' || substring(md5('vintara-' || draw || '-' || slot), 1, 8))::BIGINT % b AS i, count(*) AS times
  FROM (SELECT DISTINCT b FROM bi), range(0, {DRAWS}) dd(draw), range(0, 100) ss(slot) WHERE slot < b GROUP BY 1, 2, 3),
dr AS (SELECT {key}, draw, {d} FROM bi JOIN pk USING (b, i) GROUP BY 1, 2),
vs AS (SELECT {key}, {st} FROM dr), cis AS (SELECT {key}, {ci} FROM vs GROUP BY 1),
pt AS (SELECT {key}, {st} FROM (SELECT {key}, {s} FROM {rows} GROUP BY 1)) {out}"""


_W = "coalesce(weight, 0)"
_band_sums = {"s_n": "count(*)", "s_cov": "sum(covered)", "s_score": "sum(score)", "s_crps": "sum(crps)", "s_gap": "sum(gap)", "s_w": f"sum({_W})",
              "s_wscore": f"sum({_W} * score)", "s_wgap": f"sum({_W} * gap)"}
_band_stats = {"coverage_pct": "s_cov / s_n * 100", "score": "s_score / s_n", "crps": "s_crps / s_n", "gap": "s_gap / s_n",
               "weighted_score": "s_wscore / s_w", "weighted_gap": "s_wgap / s_w"}


def _ci(names):
    return " ".join(f"{n} {n}_ci_low {n}_ci_high" for n in names)


CTES["bandscores"] = _boot("common", "method", _band_sums, _band_stats, """
SELECT *, method = 'class x group' AS retained FROM (SELECT method, count(*) AS cases, min(v) AS first_edition, max(v) AS last_edition, median(hi - lo) AS median_width
  FROM common GROUP BY 1) JOIN pt USING (method) JOIN cis USING (method)""")
register("h3_h4_band_scores", on(lambda p: c.band_scores(p, DRAWS)), "SELECT * FROM bandscores", "median_width " + _ci(_band_stats), 3)
_SUB = {"every case": "true", "without two entities": "entity NOT IN ('E1', 'E2')", "early editions": "v <= 36", "late editions": "v > 36",
        "one group": "grp = 'ASIA'", "other groups": "grp <> 'ASIA'"}
CTES["subs"] = " UNION ALL ".join(f"SELECT *, '{n}' AS subsample FROM common WHERE method = 'group' AND {p}" for n, p in _SUB.items())
_gap_stats = {"gap": "s_gap / s_n", "weighted_gap": "s_wgap / s_w"}
register("h5_gap_by_subsample", on(lambda p: c.gap_by_subsample(p, {n: F.expr(q) for n, q in _SUB.items()}, draws=DRAWS)),
         _boot("subs", "subsample", {k: _band_sums[k] for k in ("s_n", "s_gap", "s_w", "s_wgap")}, _gap_stats, """
SELECT * FROM (SELECT subsample, count(*) AS cases, avg(covered_retained) * 100 AS coverage_retained_pct, avg(covered) * 100 AS coverage_pct FROM subs GROUP BY 1
  HAVING count(*) >= 100 AND sum(coalesce(weight, 0)) > 0) JOIN pt USING (subsample) JOIN cis USING (subsample)"""),
         "coverage_retained_pct coverage_pct " + _ci(_gap_stats), 3)
register("h6_coverage_by_cell", on(c.coverage_by_cell),
         """SELECT cls, grp, count(*) AS cases, avg(covered) * 100 AS coverage_pct, median(hi - lo) AS median_width FROM preds
            WHERE method = 'class x group' AND grp IS NOT NULL GROUP BY 1, 2""", "coverage_pct median_width")
register("h6_coverage_by_edition", on(c.coverage_by_edition),
         """SELECT v, count(*) AS cases, avg(covered) * 100 AS coverage_pct, avg((error > hi)::INT) * 100 AS too_high_pct, avg((error < lo)::INT) * 100 AS too_low_pct
            FROM preds WHERE method = 'class x group' GROUP BY 1""", "coverage_pct too_high_pct too_low_pct")
CTES["commond"] = """
SELECT *, max(brier) FILTER (method = 'all') OVER w AS brier_base, max(brier) FILTER (method = 'class x group') OVER w AS brier_cells
FROM preds WINDOW w AS (PARTITION BY entity, edition) QUALIFY count(*) OVER w = 7"""
_down_stats = {"brier": "s_b / s_n", "skill": "1 - s_b / s_base", "gain": "(s_cells - s_b) / s_n"}
register("h7_downturn_scores", on(lambda p: c.downturn_scores(p, DRAWS)),
         _boot("commond", "method", {"s_n": "count(*)", "s_b": "sum(brier)", "s_base": "sum(brier_base)", "s_cells": "sum(brier_cells)"}, _down_stats, """
SELECT * FROM (SELECT method, count(*) AS cases, avg(p) AS mean_probability, avg(down) AS observed FROM commond GROUP BY 1) JOIN pt USING (method) JOIN cis USING (method)"""),
         "mean_probability observed " + _ci(_down_stats), 4)
register("h8_reliability", on(c.reliability),
         """SELECT method, greatest(len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[], lambda e: e < p)) - 1, 0)::INTEGER AS bin, count(*) AS cases,
            avg(p) AS mean_probability, avg(down) AS observed FROM preds WHERE method IN ('class x group', 'class x group, crises apart') GROUP BY 1, 2""",
         "mean_probability observed")
register("b13_b14_scores", lambda s, d: levels(s, d).where("level_error_own IS NOT NULL").select(
    "entity", "edition", "horizon", expr.interval_score(F.lit(-20.0), F.lit(20.0), "level_error_own").alias("score"),
    expr.covered(F.lit(-20.0), F.lit(20.0), "level_error_own").alias("inside"), expr.inverted_bound("level_error_own").alias("bound")),
    """SELECT entity, edition, horizon, 40 + 10 * greatest(-20 - level_error_own, 0) + 10 * greatest(level_error_own - 20, 0) AS score,
       (level_error_own BETWEEN -20 AND 20)::INT::DOUBLE AS inside, (1 / (1 + level_error_own / 100) - 1) * 100 AS bound FROM levels WHERE level_error_own IS NOT NULL""", "score bound")
register("c15_c16_common_cases", on(lambda p: c.common_cases(p).withColumn("gap", c.of_method(c.RETAINED, "score") - F.col("score")).select(
    "entity", "edition", "method", "gap")), "SELECT entity, edition, method, gap FROM common", "gap")
register("c17_cascading_lookup", on(lambda p: p.where(F.col("method") == c.RETAINED).select("entity", "edition", "lo", "hi", "p")),
         "SELECT entity, edition, lo, hi, p FROM preds WHERE method = 'class x group'", "lo hi p")
