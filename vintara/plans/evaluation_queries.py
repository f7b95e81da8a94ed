"""Queries of the vintage base, the evaluation and its syntheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.operators import evaluation as e, vintages as v
from vintara.plans import inputs
from vintara.plans.inputs import REGIONS, memo
from vintara.plans.registry import register

SHOCKS = (32, 37)
SPLIT = 34


def panel_references(spark, sf):
    return inputs.panel(spark, sf).where("NOT is_aggregate").select(
        "entity", "period", "grp", F.lit(False).alias("is_forecast"), F.col("other_growth").alias("growth"), "nominal")


def real_vintages(spark, sf):
    return v.drop_aggregates(inputs.vintages(spark, sf))


@memo
def evaluation(spark, sf):
    return v.evaluate(real_vintages(spark, sf), panel_references(spark, sf))


@memo
def levels(spark, sf):
    return e.level_errors(evaluation(spark, sf))


def on_ev(fn):
    return lambda s, d: fn(evaluation(s, d))


def on_levels(fn):
    return lambda s, d: fn(levels(s, d))


GROUPS = "('AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST')"
WMEAN = "sum({x} * weight) FILTER (weight > 0 AND {x} IS NOT NULL) / sum(weight) FILTER (weight > 0 AND {x} IS NOT NULL)"

register("t6_vintages", lambda s, d: inputs.vintages.build(s, d), "SELECT * FROM vintages", "value", 6)
register("f1_own_reference", lambda s, d: v.own_reference(real_vintages(s, d)), "SELECT * FROM own_ref", "realised_own", 6)
register("f2_f3_panel_references", lambda s, d: v.panel_references(panel_references(s, d)),
         "SELECT entity, period, other_growth AS realised_other, nominal AS weight FROM panel WHERE NOT is_aggregate",
         "realised_other weight", 6)
register("f3_current_groups", lambda s, d: v.current_groups(panel_references(s, d)),
         "SELECT DISTINCT entity, grp FROM panel WHERE grp IS NOT NULL")
register("g1_naive_forecast", lambda s, d: v.naive_forecast(v.own_reference(real_vintages(s, d))), "SELECT * FROM naive", "naive")
register("f4_evaluation", lambda s, d: v.evaluate(real_vintages(s, d), panel_references(s, d)), "SELECT * FROM ev",
         "value realised_own realised_other weight naive error_own error_other error_naive", 6)
register("f31_drop_aggregates_by_panel",
         lambda s, d: v.drop_aggregates(inputs.vintages(s, d), inputs.panel(s, d)).groupBy("edition", "horizon").agg(
             F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities")),
         "SELECT edition, horizon, count(*) AS n, count(DISTINCT entity) AS entities FROM vintages "
         "WHERE entity IN (SELECT entity FROM panel WHERE NOT is_aggregate) GROUP BY 1, 2")
register("f31_drop_aggregates_by_code",
         lambda s, d: real_vintages(s, d).groupBy("edition", "horizon").agg(
             F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities")),
         "SELECT edition, horizon, count(*) AS n, count(DISTINCT entity) AS entities FROM real_vintages GROUP BY 1, 2")
register("f10_world_evaluation",
         lambda s, d: v.evaluate_world(inputs.vintages(s, d)).select("edition", "period", "horizon", "value", "realised_own", "error_own"),
         """WITH w AS (SELECT * FROM vintages WHERE entity = 'G001'),
            r AS (SELECT period, arg_min(value, edition_period) AS realised_own FROM w WHERE horizon = -1 AND season = 'F' GROUP BY 1)
            SELECT edition, w.period, horizon, value, realised_own, value - realised_own AS error_own
            FROM w LEFT JOIN r USING (period) WHERE is_projection""", "value realised_own error_own")
register("f16_current_projection", lambda s, d: v.current_cumulative_projection(real_vintages(s, d), 46, 5),
         """WITH c AS (SELECT * FROM real_vintages WHERE edition_period = 46 AND season = 'F')
            SELECT a.entity, a.horizon, (product(1 + b.value / 100) - 1) * 100 AS projected_growth_pct
            FROM c a JOIN c b ON a.entity = b.entity AND b.horizon BETWEEN 0 AND a.horizon WHERE a.horizon BETWEEN 0 AND 5
            GROUP BY 1, 2 HAVING count(DISTINCT b.horizon) = a.horizon + 1""", "projected_growth_pct")

STACKED = """SELECT *, 'own' AS reference, error_own AS error FROM ev WHERE error_own IS NOT NULL
  UNION ALL SELECT *, 'other', error_other FROM ev WHERE error_other IS NOT NULL"""
CI = """WITH s AS (%s), m AS (SELECT reference, horizon, avg(error) AS m FROM s GROUP BY 1, 2),
  c AS (SELECT s.reference, s.horizon, period, sum(error - m) AS d, count(*) AS k FROM s JOIN m USING (reference, horizon) GROUP BY 1, 2, 3),
  se AS (SELECT reference, horizon, count(*) AS clusters, sqrt(count(*) / (count(*) - 1.0::DOUBLE) * sum(d * d)) / sum(k) AS se FROM c GROUP BY 1, 2)
  SELECT reference, horizon, clusters, CASE WHEN clusters >= 2 THEN m - 1.96 * se END AS ci_low,
    CASE WHEN clusters >= 2 THEN m + 1.96 * se END AS ci_high FROM se JOIN m USING (reference, horizon)""" % STACKED
register("f6_clustered_interval", on_ev(lambda t: e.clustered_interval(e.stacked_errors(t), ["reference", "horizon"], "error", "period")),
         CI, "ci_low ci_high")
BIAS = f"""SELECT reference, horizon, n, mean_error, mae, weighted_error, mean_without_shocks, median_error, median_abs, clusters, ci_low, ci_high
  FROM (SELECT reference, horizon, count(*) AS n, avg(error) AS mean_error, avg(abs(error)) AS mae, {WMEAN.format(x='error')} AS weighted_error,
    avg(error) FILTER (period NOT IN (32, 37)) AS mean_without_shocks, median(error) AS median_error, median(abs(error)) AS median_abs
  FROM ({STACKED}) GROUP BY 1, 2) JOIN ({CI}) USING (reference, horizon)"""
register("f7_bias_by_horizon", on_ev(lambda t: e.bias_by_horizon(t, SHOCKS)), BIAS,
         "mean_error mae weighted_error mean_without_shocks median_error median_abs ci_low ci_high")
register("f8_bias_by_season", on_ev(e.bias_by_season),
         f"""SELECT horizon, season, count(*) AS n, avg(error_own) AS mean_error, avg(abs(error_own)) AS mae,
             {WMEAN.format(x='error_own')} AS weighted_error, median(error_own) AS median_error
             FROM ev WHERE error_own IS NOT NULL GROUP BY 1, 2""", "mean_error mae weighted_error median_error")
register("f9_versus_naive", on_ev(e.versus_naive),
         """SELECT horizon, count(*) AS n, avg(abs(error_own)) AS mae_model, avg(abs(error_naive)) AS mae_naive,
            avg(abs(error_own)) / avg(abs(error_naive)) AS mae_ratio, avg((abs(error_own) < abs(error_naive))::INT) * 100 AS share_model_closer,
            median(abs(error_own)) AS median_model, median(abs(error_naive)) AS median_naive
            FROM ev WHERE error_own IS NOT NULL AND error_naive IS NOT NULL GROUP BY 1""",
         "mae_model mae_naive mae_ratio share_model_closer median_model median_naive")
register("f11_bias_by_group", on_ev(lambda t: e.bias_by_group(t, REGIONS)),
         f"""SELECT horizon, grp, count(*) AS n, avg(error_own) AS mean_error, median(error_own) AS median_error,
             median(abs(error_own)) AS median_abs FROM ev WHERE error_own IS NOT NULL AND grp IN {GROUPS} GROUP BY 1, 2""",
         "mean_error median_error median_abs")
register("f12_level_errors", on_ev(e.level_errors), "SELECT * FROM levels",
         "weight projected_growth_pct worst_projected worst_realised level_error_own level_error_other", 6)
register("f13_level_summary", on_levels(e.level_summary),
         f"""WITH s AS (SELECT horizon, weight, 'own' AS reference, level_error_own AS e FROM levels UNION ALL
               SELECT horizon, weight, 'other', level_error_other FROM levels)
             SELECT reference, horizon, count(*) AS n, avg(e) AS mean_error, {WMEAN.format(x='e')} AS weighted_error,
               avg((e > 5)::INT) * 100 AS share_above_5, avg((e < -5)::INT) * 100 AS share_below_5, median(e) AS median_error,
               quantile_cont(e, 0.1) AS p10, quantile_cont(e, 0.25) AS p25, quantile_cont(e, 0.75) AS p75, quantile_cont(e, 0.9) AS p90
             FROM s WHERE e IS NOT NULL GROUP BY 1, 2""",
         "mean_error weighted_error share_above_5 share_below_5 median_error p10 p25 p75 p90")
register("f14_level_summary_by_group", on_levels(lambda t: e.level_summary_by_group(t, REGIONS)),
         f"""SELECT horizon, grp, count(*) AS n, avg(level_error_own) AS mean_error, median(level_error_own) AS median_error,
             quantile_cont(level_error_own, 0.1) AS p10, quantile_cont(level_error_own, 0.9) AS p90
             FROM levels WHERE level_error_own IS NOT NULL AND grp IN {GROUPS} GROUP BY 1, 2""", "mean_error median_error p10 p90")
register("f23_efficiency", on_ev(e.efficiency),
         """WITH r AS (SELECT * FROM ev WHERE value IS NOT NULL AND realised_own IS NOT NULL),
            q AS (SELECT horizon, quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b, quantile_cont(realised_own, 0.01) c,
              quantile_cont(realised_own, 0.99) d FROM r GROUP BY 1)
            SELECT horizon, count(*) AS n, regr_slope(realised_own, value) AS slope, regr_intercept(realised_own, value) AS intercept
            FROM r JOIN q USING (horizon) WHERE value BETWEEN a AND b AND realised_own BETWEEN c AND d GROUP BY 1 HAVING count(*) >= 10""",
         "slope intercept", 6)
register("f23_bias_by_quintile", on_ev(e.bias_by_forecast_quintile),
         """WITH r AS (SELECT * FROM ev WHERE value IS NOT NULL AND realised_own IS NOT NULL),
            q AS (SELECT horizon, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM r GROUP BY 1),
            b AS (SELECT r.*, greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0)::INTEGER + 1 AS quintile FROM r JOIN q USING (horizon))
            SELECT horizon, quintile, count(*) AS n, median(value) AS median_forecast, median(value - realised_own) AS median_bias
            FROM b GROUP BY 1, 2""", "median_forecast median_bias")
CLASSED = """q AS (SELECT horizon, quantile_cont(projected_growth_pct, [0.2, 0.4, 0.6, 0.8]) AS edges FROM r GROUP BY 1),
  b AS (SELECT r.*, len(list_filter(edges, lambda x: round(x, 9) <= round(projected_growth_pct, 9)))::INTEGER + 1 AS cls FROM r JOIN q USING (horizon))"""
register("f15_growth_classes",
         on_levels(lambda t: _classed(t.where("level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL"))),
         f"""WITH r AS (SELECT * FROM levels WHERE level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL), {CLASSED}
             SELECT horizon, cls, count(*) AS n, min(projected_growth_pct) AS lowest, max(projected_growth_pct) AS highest FROM b GROUP BY 1, 2""",
         "lowest highest")


def _classed(rows):
    from vintara.functions import expr

    edges = e.quantile_edges(rows, ["horizon"], "projected_growth_pct")
    return rows.join(F.broadcast(edges), "horizon").withColumn(
        "cls", expr.digitize("projected_growth_pct", F.col("edges"))).groupBy("horizon", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.min("projected_growth_pct").alias("lowest"), F.max("projected_growth_pct").alias("highest"))


register("f28_level_by_growth", on_levels(lambda t: e.level_summary_by_growth(t, SPLIT)),
         f"""WITH r AS (SELECT * FROM levels WHERE level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL), {CLASSED}
             SELECT horizon, cls, count(*) AS n, avg((worst_realised < 0)::INT) * 100 AS downturn_pct,
               avg((worst_realised < 0)::INT) FILTER (edition_period <= 34) * 100 AS downturn_before_pct,
               avg((worst_realised < 0)::INT) FILTER (edition_period > 34) * 100 AS downturn_after_pct,
               median(projected_growth_pct) AS median_growth, median(level_error_own) AS median_error,
               quantile_cont(level_error_own, 0.1) AS p10, quantile_cont(level_error_own, 0.9) AS p90 FROM b GROUP BY 1, 2""",
         "downturn_pct downturn_before_pct downturn_after_pct median_growth median_error p10 p90")
register("f29_downturns_by_horizon", on_ev(e.downturns_by_horizon),
         """SELECT horizon, count(*) AS n, avg((value < 0)::INT) * 100 AS announced_pct, avg((realised_own < 0)::INT) * 100 AS occurred_pct,
            count(*) FILTER (realised_own < 0) AS occurred,
            count(*) FILTER (value < 0 AND realised_own < 0) * 100.0::DOUBLE / nullif(count(*) FILTER (realised_own < 0), 0) AS occurred_announced_pct,
            count(*) FILTER (value < 0 AND realised_own < 0) * 100.0::DOUBLE / nullif(count(*) FILTER (value < 0), 0) AS announced_occurred_pct
            FROM ev WHERE value IS NOT NULL AND realised_own IS NOT NULL GROUP BY 1""",
         "announced_pct occurred_pct occurred_announced_pct announced_occurred_pct")
LARGE = """l AS (SELECT *, weight IS NOT NULL AND row_number() OVER (PARTITION BY horizon, edition ORDER BY weight DESC NULLS LAST, entity) <= 20 AS large FROM r)"""
register("f19_large_flag", on_levels(lambda t: e.flag_large(t).select("horizon", "edition", "entity", "large")),
         f"WITH r AS (SELECT * FROM levels), {LARGE} SELECT horizon, edition, entity, large FROM l")
register("f30_downturn_risk", on_levels(lambda t: e.downturn_risk(t, REGIONS, SHOCKS, SPLIT)),
         f"""WITH r AS (SELECT * FROM levels WHERE horizon >= 1 AND worst_projected IS NOT NULL AND worst_realised IS NOT NULL), {LARGE},
             x AS (SELECT *, (edition_period + 1 <= 32 AND period >= 32) OR (edition_period + 1 <= 37 AND period >= 37) AS shocked FROM l),
             m AS (SELECT *, 'all' AS member FROM x UNION ALL SELECT *, 'large' FROM x WHERE large UNION ALL SELECT *, grp FROM x WHERE grp IN {GROUPS})
             SELECT horizon, member, count(*) AS n, avg((worst_projected < 0)::INT) * 100 AS announced_pct, avg((worst_realised < 0)::INT) * 100 AS occurred_pct,
               sum((worst_realised < 0)::INT * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) * 100 AS occurred_weighted_pct,
               avg((worst_realised < 0)::INT) FILTER (NOT shocked) * 100 AS occurred_without_shocks_pct,
               avg((worst_realised < 0)::INT) FILTER (edition_period <= 34) * 100 AS occurred_before_pct,
               avg((worst_realised < 0)::INT) FILTER (edition_period > 34) * 100 AS occurred_after_pct,
               median(worst_realised) FILTER (worst_realised < 0) AS median_depth FROM m GROUP BY 1, 2""",
         "announced_pct occurred_pct occurred_weighted_pct occurred_without_shocks_pct occurred_before_pct occurred_after_pct median_depth")
register("b26_means_dominated", on_ev(lambda t: e.means_dominated(e.bias_by_horizon(t, SHOCKS))),
         f"SELECT coalesce(bool_or(mae / nullif(median_abs, 0) > 10), false) AS dominated FROM ({BIAS})")
register("b24_bias_verdict", on_ev(lambda t: e.bias_verdict(e.bias_by_horizon(t, SHOCKS))),
         f"""SELECT reference, coalesce(bool_or(abs(mean_error) >= 0.5) FILTER (horizon = 0), false) AS notable_now,
             bool_and(mean_error > 0) FILTER (horizon >= 1) AS always_high, bool_and(mean_error < 0) FILTER (horizon >= 1) AS always_low
             FROM ({BIAS}) GROUP BY 1""")
register("f33_error_feed", on_ev(e.error_feed),
         f"""SELECT horizon, avg(error_own) AS mean_error, avg(abs(error_own)) AS mae, {WMEAN.format(x='error_own')} AS weighted_error
             FROM ev WHERE error_own IS NOT NULL GROUP BY 1""", "mean_error mae weighted_error")
register("f33_error_series", on_ev(e.error_series),
         """WITH m AS (SELECT period, median(error_own) AS median_error FROM ev WHERE horizon >= 1 AND error_own IS NOT NULL
            AND period < (SELECT max(period) FROM ev) GROUP BY 1) SELECT *, row_number() OVER (ORDER BY median_error DESC, period) <= 3 AS labelled FROM m""", "median_error")
register("f33_worst_periods", on_ev(lambda t: e.error_series(t).where("labelled").drop("labelled")),
         """SELECT period, median(error_own) AS median_error FROM ev WHERE horizon >= 1 AND error_own IS NOT NULL
            AND period < (SELECT max(period) FROM ev) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""", "median_error")
register("e9_biggest_misses", on_ev(e.biggest_misses),
         """SELECT entity, edition, period, horizon, error_own, CASE WHEN error_own > 0 THEN 'too high' ELSE 'too low' END AS side
            FROM ev WHERE abs(error_own) > 10 AND horizon = 1""", "error_own")
register("e9_biggest_misses_all_horizons", on_ev(lambda t: e.biggest_misses(t, horizon=None)),
         """SELECT entity, edition, period, horizon, error_own, CASE WHEN error_own > 0 THEN 'too high' ELSE 'too low' END AS side
            FROM ev WHERE abs(error_own) > 10""", "error_own")
register("e10_describe_errors", on_ev(e.describe_errors),
         f"""SELECT reference, count(*) AS n, avg(error) AS mean, stddev_samp(error) AS sd, min(error) AS lowest, max(error) AS highest,
             quantile_cont(error, 0.25) AS p25, quantile_cont(error, 0.5) AS p50, quantile_cont(error, 0.75) AS p75 FROM ({STACKED}) WHERE horizon = 1 GROUP BY 1""",
         "mean sd lowest highest p25 p50 p75")
register("e10_error_histogram", on_ev(e.error_histogram),
         """WITH r AS (SELECT error_own FROM ev WHERE error_own IS NOT NULL AND horizon = 1), m AS (SELECT min(error_own) lo, max(error_own) hi FROM r)
            SELECT least(floor((error_own - lo) / (hi - lo) * 50), 49)::INTEGER AS bin, count(*) AS n FROM r, m GROUP BY 1""")
register("e13_extreme_groups", on_ev(lambda t: e.extreme_groups(e.bias_by_group(t, REGIONS), "median_error")),
         f"""SELECT horizon, arg_min(grp, m) AS lowest, arg_max(grp, m) AS highest, count(*) AS groups
             FROM (SELECT horizon, grp, median(error_own) AS m FROM ev WHERE error_own IS NOT NULL AND grp IN {GROUPS} GROUP BY 1, 2)
             GROUP BY 1 HAVING count(*) >= 2""")
