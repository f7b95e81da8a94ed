"""Queries of revisions, archives and the shock study."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintara.functions import expr
from vintara.operators import archive as a, evaluation as e, revisions as r, shock as k, summary as sm
from vintara.plans import inputs
from vintara.plans.evaluation_queries import BIAS, SHOCKS, evaluation, real_vintages
from vintara.plans.inputs import REGIONS, memo
from vintara.plans.oracle import CTES
from vintara.plans.registry import register

EDITIONS = (44, 45, 46)
OLD, NEW = "S46", "F46"
SHOCK = 32
CODES = ("G001", "G111", "G112", "G113", "G114", "G115")


@memo
def revisions(spark, sf):
    weights = inputs.panel(spark, sf).where("NOT is_aggregate").select("entity", "period", F.col("nominal").alias("weight"))
    return r.successive_revisions(real_vintages(spark, sf)).join(weights, ["entity", "period"], "left")


@memo
def edition_archive(spark, sf):
    """T1 of every archived edition: revised history, and levels projected two periods ahead."""
    p = inputs.panel(spark, sf).where("NOT is_aggregate AND period >= 38")
    editions = F.explode(F.array(*[F.struct(F.lit(f"{s}{v}").alias("edition"), F.lit(v).alias("ep"), F.lit(i).alias("i"))
                                   for v in EDITIONS for i, s in enumerate("SF")])).alias("e")
    rows = p.select("entity", "nk", "period", "nominal", "volume", "other", editions).select("*", "e.*").where("period < ep")
    drift = 1 + ((F.col("nk") * 7 + F.col("ep") * 2 + F.col("i")) % 13 - 6) / 100.0
    step = 1 + ((F.col("nk") + F.col("ep") + F.col("i")) % 5) * F.lit(0.02)
    ahead = F.explode(F.when(F.col("period") == F.col("ep") - 1, F.array(*[F.lit(j) for j in range(4)])).otherwise(F.array(F.lit(0)))).alias("j")
    rows = rows.select("*", ahead).select("*", F.explode(F.array(
        F.struct(F.lit("NGDP").alias("indicator"), (F.col("nominal") * drift * (1 + F.col("j") * (step - 1) * 1.5)).alias("value")),
        F.struct(F.lit("NGDP_R").alias("indicator"), (F.col("volume") * (1 + F.col("j") * (step - 1))).alias("value")),
        F.struct(F.lit("NGDPD").alias("indicator"), (F.col("other") * drift * (1 + F.col("j") * (step - 1) * 1.2)).alias("value")),
    )).alias("x"))
    return rows.select("edition", "entity", "x.indicator", (F.col("period") + F.col("j")).alias("period"), "x.value")


def metadata(spark, sf):
    """Method metadata per edition, all text."""
    s = inputs.suppliers(spark, sf)
    ed = F.explode(F.array(*[F.struct(F.lit(n).alias("edition"), F.lit(i).alias("i")) for i, n in enumerate((OLD, NEW))])).alias("e")
    m = (F.col("nk") + F.col("i")) % 4
    return s.select("entity", "nk", ed).select("entity", "nk", "e.*").where("NOT (i = 0 AND nk % 9 = 0)").select(
        "edition", "entity",
        F.when(m == 0, " SNA 1993").when(m == 1, "SNA 2008 ").when(m == 2, "Not applicable").alias("methodology"),
        F.when(F.col("nk") % 6 == 0, F.lit("Not applicable")).otherwise((F.lit(2000) + F.col("nk") + F.when(F.col("nk") % 5 == 0, F.col("i")).otherwise(0)).cast("string")).alias("base_year"))


@memo
def changes(spark, sf):
    return r.edition_changes(r.level_revisions(edition_archive(spark, sf), OLD, NEW, 44, 47, 44), r.method_changes(metadata(spark, sf), OLD, NEW),
                             inputs.suppliers(spark, sf).select("entity", "name", "grp"))


CTES["revs"] = """
WITH o AS (SELECT *, edition_period * 2 + (season = 'F')::INT AS ord FROM real_vintages WHERE horizon >= -1),
f AS (SELECT *, ord - lag(ord) OVER w = 1 AS follows, lag(value) OVER w AS pv FROM o WINDOW w AS (PARTITION BY entity, period ORDER BY ord)),
g AS (SELECT *, CASE WHEN follows THEN value - pv END AS revision FROM f)
SELECT g.* EXCLUDE (ord, follows, pv), CASE WHEN follows THEN lag(revision) OVER (PARTITION BY g.entity, g.period ORDER BY ord) END AS previous_revision, p.nominal AS weight
FROM g LEFT JOIN panel p ON p.entity = g.entity AND p.period = g.period"""
CTES["revsum"] = """
WITH x AS (SELECT * FROM revs WHERE revision IS NOT NULL),
b AS (SELECT horizon, season, count(*) AS n, avg(revision) AS mean_revision, sum(revision * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) AS weighted_revision,
    avg(revision) FILTER (period NOT IN (32, 37)) AS mean_without_shocks, avg((revision < 0)::INT) FILTER (revision <> 0) * 100 AS down_pct,
    avg((sign(revision) = sign(previous_revision))::INT) FILTER (revision <> 0 AND previous_revision <> 0) * 100 AS same,
    median(revision) AS median_revision, median(abs(revision)) AS median_abs FROM x GROUP BY 1, 2),
c AS (SELECT * FROM x WHERE previous_revision IS NOT NULL),
q AS (SELECT horizon, season, quantile_cont(revision, 0.01) a, quantile_cont(revision, 0.99) b, quantile_cont(previous_revision, 0.01) c, quantile_cont(previous_revision, 0.99) d FROM c GROUP BY 1, 2),
t AS (SELECT horizon, season, count(*) AS k, stddev_samp(previous_revision) AS sd, regr_slope(revision, previous_revision) AS slope, corr(revision, previous_revision) AS correlation
  FROM c JOIN q USING (horizon, season) WHERE revision BETWEEN a AND b AND previous_revision BETWEEN q.c AND d GROUP BY 1, 2)
SELECT b.* EXCLUDE (same), (CASE season WHEN 'S' THEN 'spring' ELSE 'autumn' END) || (CASE WHEN horizon < 0 THEN ', re-estimate' ELSE ', horizon ' || horizon END) AS step,
  CASE WHEN k >= 10 AND sd > 0 THEN slope END AS slope, CASE WHEN k >= 10 AND sd > 0 THEN correlation END AS correlation, CASE WHEN k >= 10 AND sd > 0 THEN same END AS same_sign_pct
FROM b LEFT JOIN t USING (horizon, season)"""
CTES["edition_archive"] = """
WITH e AS (SELECT s || v AS edition, v AS ep, (s = 'F')::INT AS i FROM (VALUES ('S'), ('F')) a(s), (VALUES (44), (45), (46)) b(v)),
r AS (SELECT p.entity, nk, period, nominal, volume, other, e.*, 1 + ((nk * 7 + ep * 2 + i) % 13 - 6) / 100.0::DOUBLE AS drift, 1 + ((nk + ep + i) % 5) * 0.02::DOUBLE AS step
  FROM panel p JOIN e ON p.period < ep WHERE NOT is_aggregate AND p.period >= 38),
j AS (SELECT r.*, j FROM r, range(0, 4) t(j) WHERE j = 0 OR period = ep - 1)
SELECT edition, entity, 'NGDP' AS indicator, (period + j)::INTEGER AS period, nominal * drift * (1 + j * (step - 1) * 1.5::DOUBLE) AS value FROM j
UNION ALL SELECT edition, entity, 'NGDP_R', (period + j)::INTEGER, volume * (1 + j * (step - 1)) FROM j
UNION ALL SELECT edition, entity, 'NGDPD', (period + j)::INTEGER, other * drift * (1 + j * (step - 1) * 1.2::DOUBLE) FROM j"""
CTES["edlevels"] = "SELECT edition, entity, " + ", ".join(
    f"avg(value) FILTER (indicator = '{i}' AND period = {q}) AS {i}_{q}" for i in ("NGDP", "NGDP_R", "NGDPD") for q in (44, 47)) + \
    " FROM edition_archive WHERE edition IN ('S46', 'F46') GROUP BY 1, 2"
CTES["levrev"] = """
WITH x AS (SELECT o.entity, (n.NGDP_R_47 / n.NGDP_R_44 / (o.NGDP_R_47 / o.NGDP_R_44) - 1) * 100 AS real_growth_pct, (n.NGDPD_47 / n.NGDPD_44 / (o.NGDPD_47 / o.NGDPD_44) - 1) * 100 AS usd_growth_pct,
  (n.NGDPD_47 / o.NGDPD_47 - 1) * 100 AS usd_target_pct, (n.NGDPD_44 / o.NGDPD_44 - 1) * 100 AS usd_history_pct, ((n.NGDP_44 / n.NGDP_R_44) / (o.NGDP_44 / o.NGDP_R_44) - 1) * 100 AS deflator_history_pct
  FROM edlevels o JOIN edlevels n ON n.entity = o.entity AND n.edition = 'F46' WHERE o.edition = 'S46')
SELECT *, coalesce(abs(deflator_history_pct) > 5, false) AS deflator_flag, coalesce(abs(usd_history_pct) > 5, false) AS history_flag FROM x
WHERE coalesce(real_growth_pct, usd_growth_pct, usd_history_pct, deflator_history_pct) IS NOT NULL"""
CTES["metadata"] = """
SELECT edition, entity, CASE (nk + i) % 4 WHEN 0 THEN ' SNA 1993' WHEN 1 THEN 'SNA 2008 ' WHEN 2 THEN 'Not applicable' END AS methodology,
  CASE WHEN nk % 6 = 0 THEN 'Not applicable' ELSE (2000 + nk + CASE WHEN nk % 5 = 0 THEN i ELSE 0 END)::VARCHAR END AS base_year
FROM suppliers, (VALUES ('S46', 0), ('F46', 1)) e(edition, i) WHERE NOT (i = 0 AND nk % 9 = 0)"""
CTES["methods"] = """
WITH m AS (SELECT edition, entity, nullif(trim(methodology), 'Not applicable') AS m, nullif(trim(base_year), 'Not applicable') AS b FROM metadata),
x AS (SELECT entity, max(m) FILTER (edition = 'S46') AS standard_old, max(m) FILTER (edition = 'F46') AS standard_new, max(b) FILTER (edition = 'S46') AS base_year_old,
  max(b) FILTER (edition = 'F46') AS base_year_new FROM m GROUP BY 1)
SELECT *, standard_old <> standard_new AS standard_changed, base_year_old <> base_year_new AS base_year_changed FROM x"""
CTES["changes"] = "SELECT * FROM levrev FULL JOIN methods USING (entity) LEFT JOIN (SELECT entity, name, grp FROM suppliers) s USING (entity)"

register("g2_c19_successive_revisions", lambda s, d: r.successive_revisions(real_vintages(s, d)), "SELECT * EXCLUDE (weight) FROM revs", "value revision previous_revision", 6)
REV = "mean_revision weighted_revision mean_without_shocks down_pct median_revision median_abs slope correlation same_sign_pct"
register("g3_b10_revision_summary", lambda s, d: r.revision_summary(revisions(s, d), SHOCKS), "SELECT * FROM revsum", REV)
register("e15_revision_facts", lambda s, d: r.revision_facts(
    r.revision_summary(revisions(s, d), SHOCKS),
    e.bias_by_horizon(evaluation(s, d), SHOCKS).where("reference = 'own'").agg(F.max_by("mean_error", "horizon"))),
    f"""SELECT sum(mean_revision) AS total_revision, max(abs(mean_revision)) FILTER (horizon >= 2) AS largest_far_revision, min(correlation) AS lowest_correlation,
        max(correlation) AS highest_correlation, (SELECT arg_max(mean_error, horizon) FROM ({BIAS}) WHERE reference = 'own') AS last_bias FROM revsum""",
    "total_revision largest_far_revision lowest_correlation highest_correlation last_bias")
register("a5_edition_levels", lambda s, d: r.edition_levels(edition_archive(s, d), [OLD, NEW], [44, 47]), "SELECT * FROM edlevels",
         " ".join(f"{i}_{q}" for i in ("NGDP", "NGDP_R", "NGDPD") for q in (44, 47)))
LEV = "real_growth_pct usd_growth_pct usd_target_pct usd_history_pct deflator_history_pct"
register("g4_b22_level_revisions", lambda s, d: r.level_revisions(edition_archive(s, d), OLD, NEW, 44, 47, 44), "SELECT * FROM levrev", LEV)
register("g5_a6_b23_method_changes", lambda s, d: r.method_changes(metadata(s, d), OLD, NEW), "SELECT * FROM methods")
register("c13_c14_edition_changes", lambda s, d: changes.build(s, d), "SELECT * FROM changes", LEV)
register("e16_revision_size_facts", lambda s, d: r.revision_size_facts(changes(s, d)),
         """SELECT count(real_growth_pct) AS real_known, count(*) FILTER (abs(real_growth_pct) > 2) AS real_notable, count(usd_growth_pct) AS usd_known,
            count(*) FILTER (abs(usd_growth_pct) > 5) AS usd_notable, count(*) FILTER (standard_changed) AS standard_changed, count(*) FILTER (base_year_changed) AS base_year_changed,
            median(abs(real_growth_pct)) AS median_real, median(abs(usd_growth_pct)) AS median_usd FROM changes""", "median_real median_usd")
register("e14_flagged_entities", lambda s, d: sm.flagged_entities(
    changes(s, d).join(inputs.panel(s, d).where("period = 44").select("entity", "nominal"), "entity", "left"), "history_flag", "nominal"),
    """SELECT entity, nominal, greatest((SELECT count(*) FROM changes WHERE history_flag) - 8, 0) AS others FROM changes
       LEFT JOIN (SELECT entity, nominal FROM panel WHERE period = 44) USING (entity) WHERE history_flag ORDER BY nominal DESC NULLS LAST, entity LIMIT 8""", "nominal", 6)


# ---------------------------------------------------------------- archive of revised data

@memo
def event_archive(spark, sf):
    """T9 from the event stream: a key's last value of a day is that day's version."""
    kinds = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    return inputs.table(spark, sf, "events").groupBy(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"), F.array_position(kinds, F.col("event_type")).cast("int").alias("period"),
        F.date_diff(F.to_date("ts"), F.lit("2023-12-31").cast("date")).alias("version"),
    ).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def _members(spark, sf):
    grp = F.get(F.array(*[F.lit(x) for x in REGIONS]), F.expr("cast(substring(entity, 2) AS int) % 6"))
    return a.revisions_since_publication(event_archive(spark, sf), step=1, first_period=2).withColumns({
        "grp": grp, "weight": F.expr("cast(substring(entity, 2) AS int) % 10") + F.lit(0.0)})


@memo
def publication_revisions(spark, sf):
    return _members(spark, sf)


@memo
def growth_archive(spark, sf):
    return inputs.vintages(spark, sf).where("horizon < 0").select(
        "entity", "period", expr.edition_order("edition_period", "season").alias("version"), "value")


CTES["event_archive"] = """
SELECT 'U' || user_id AS entity, list_position(['click','error','purchase','signup','view'], event_type)::INTEGER AS period,
  date_diff('day', DATE '2023-12-31', ts::DATE)::INTEGER AS version, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events GROUP BY 1, 2, 3"""
CTES["pubrev"] = """
WITH h AS (SELECT * FROM event_archive WHERE value IS NOT NULL AND period >= 2), f AS (SELECT entity, period, min(version) AS first_version, arg_min(value, version) AS first_value FROM h GROUP BY 1, 2),
l AS (SELECT max(version) AS last FROM event_archive),
t AS (SELECT f.*, first_version + k AS target, k::VARCHAR AS delay FROM f, (VALUES (1), (2), (5), (10)) d(k), l WHERE first_version + k <= last
  UNION ALL SELECT f.*, last, 'latest' FROM f, l)
SELECT t.entity, t.period, first_version, first_value, h.value, delay FROM t ASOF JOIN h ON t.entity = h.entity AND t.period = h.period AND t.target >= h.version"""
CTES["pubgrp"] = """SELECT *, CASE WHEN substring(entity, 2)::INT % 6 < 5 THEN ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'][substring(entity, 2)::INT % 6 + 1] END AS grp,
  (substring(entity, 2)::INT % 10)::DOUBLE AS weight FROM pubrev"""
CTES["pubmem"] = "SELECT *, 'all' AS member FROM pubgrp UNION ALL SELECT *, grp FROM pubgrp WHERE grp IS NOT NULL"
register("t9_a3_event_archive", lambda s, d: event_archive.build(s, d), "SELECT * FROM event_archive")
register("a4_archive_versions", lambda s, d: event_archive(s, d).select("version").distinct().orderBy("version"), "SELECT DISTINCT version FROM event_archive")
register("g6_publication_revisions", lambda s, d: a.revisions_since_publication(event_archive(s, d), step=1, first_period=2), "SELECT * FROM pubrev")


def _as_of(spark, sf):
    archive = event_archive(spark, sf)
    first = archive.groupBy("entity", "period").agg(F.min("version").alias("first_version"))
    asked = first.select("entity", "period", "first_version", (F.col("first_version") + 5).alias("target"))
    return a.as_of_join(asked, archive, ["entity", "period"], "target", "version", "value", width=7)


register("c7_as_of_join", _as_of,
         """WITH f AS (SELECT entity, period, min(version) AS first_version, min(version) + 5 AS target FROM event_archive GROUP BY 1, 2)
            SELECT f.*, h.value FROM f ASOF JOIN event_archive h ON f.entity = h.entity AND f.period = h.period AND f.target >= h.version""")
register("g7_growth_revision_summary", lambda s, d: a.growth_revision_summary(publication_revisions(s, d), REGIONS),
         """SELECT delay, member, count(*) AS n, avg(value - first_value) AS mean_revision, avg(abs(value - first_value)) AS mean_abs, avg((abs(value - first_value) > 1)::INT) * 100 AS above_threshold_pct,
            sum(abs(value - first_value) * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) AS weighted_abs, median(value - first_value) AS median_revision,
            median(abs(value - first_value)) AS median_abs FROM pubmem GROUP BY 1, 2""", "mean_revision mean_abs above_threshold_pct weighted_abs median_revision median_abs", 8)
register("g8_level_revision_summary", lambda s, d: a.level_revision_summary(publication_revisions(s, d), REGIONS),
         """WITH x AS (SELECT delay, member, (value / first_value - 1) * 100 AS r FROM pubmem WHERE first_value > 0)
            SELECT delay, member, count(*) AS n, avg((abs(r) > 5)::INT) * 100 AS above_5_pct, avg((abs(r) > 10)::INT) * 100 AS above_threshold_pct, median(r) AS median_revision,
            median(abs(r)) AS median_abs, quantile_cont(abs(r), 0.9) AS p90_abs FROM x GROUP BY 1, 2""", "above_5_pct above_threshold_pct median_revision median_abs p90_abs")


def _event_weights(spark, sf):
    return inputs.table(spark, sf, "events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity")).agg(F.count(F.lit(1)).alias("weight"))


register("g9_largest_revisions", lambda s, d: a.largest_revisions(publication_revisions(s, d), _event_weights(s, d)),
         """WITH w AS (SELECT 'U' || user_id AS entity, count(*) AS weight FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
            x AS (SELECT entity, period, first_version, first_value, value, (value / first_value - 1) * 100 AS revision_pct FROM pubrev SEMI JOIN w USING (entity) WHERE delay = 'latest' AND first_value > 0)
            SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY entity ORDER BY abs(revision_pct) DESC, period) = 1 ORDER BY abs(revision_pct) DESC, entity LIMIT 15""", "revision_pct")
register("g10_realtime_value", lambda s, d: a.realtime_value(growth_archive(s, d), F.col("period") * 2 + 2),
         """SELECT entity, period, arg_max(value, edition_period * 2 + (season = 'F')::INT) AS realised_realtime FROM vintages WHERE horizon < 0 AND edition_period * 2 + (season = 'F')::INT <= period * 2 + 2 GROUP BY 1, 2""",
         "realised_realtime", 6)
register("g11_c6_bias_by_reference", lambda s, d: a.bias_by_reference(evaluation(s, d), a.realtime_value(growth_archive(s, d), F.col("period") * 2 + 2)),
         """WITH t AS (SELECT entity, period, arg_max(value, edition_period * 2 + (season = 'F')::INT) AS rt FROM vintages WHERE horizon < 0 AND edition_period * 2 + (season = 'F')::INT <= period * 2 + 2 GROUP BY 1, 2),
            x AS (SELECT horizon, weight, value - realised_own AS a, value - rt AS b, value - realised_other AS c FROM ev JOIN t USING (entity, period) WHERE realised_own IS NOT NULL AND rt IS NOT NULL AND realised_other IS NOT NULL)
            SELECT horizon, count(*) AS n, avg(a) AS mean_own, avg(b) AS mean_realtime, avg(c) AS mean_other, sum(a * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) AS weighted_own,
            sum(b * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) AS weighted_realtime, sum(c * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0) AS weighted_other,
            median(a) AS median_own, median(b) AS median_realtime, median(c) AS median_other FROM x GROUP BY 1""",
         "mean_own mean_realtime mean_other weighted_own weighted_realtime weighted_other median_own median_realtime median_other")


# ---------------------------------------------------------------- shock study

def current_estimates(spark, sf):
    return inputs.panel(spark, sf).where("growth IS NOT NULL").select("entity", "period", F.col("growth").alias("value"))


def shock_weights(spark, sf):
    return inputs.panel(spark, sf).where(f"NOT is_aggregate AND period = {SHOCK - 1}").select("entity", F.col("nominal").alias("weight"))


@memo
def activity(spark, sf):
    """Shipments counted by supplier; the first source knows its entities under other codes."""
    p = inputs.panel(spark, sf).where("NOT is_aggregate")
    return p.select("entity", "period", F.col("population").alias("activity"), F.when(F.col("nk") % 2 == 1, "survey").otherwise("carriers").alias("source"))


@memo
def activity_table(spark, sf):
    return k.activity_and_output(activity(spark, sf), inputs.vintages(spark, sf), current_estimates(spark, sf), SHOCK)


CTES["allref"] = "SELECT entity, period, arg_min(value, edition_period) AS realised_own FROM vintages WHERE horizon = -1 AND season = 'F' GROUP BY 1, 2"
_around = ["S31", "F31", "S32", "F32", "S33", "F33"]
_codes = "('G001', 'G111', 'G112', 'G113', 'G114', 'G115')"
register("g12_b11_growth_by_edition", lambda s, d: k.growth_by_edition(inputs.vintages(s, d), current_estimates(s, d), CODES, SHOCK),
         f"""WITH g AS (SELECT DISTINCT entity, p::INTEGER AS period FROM vintages, range(32, 37) t(p) WHERE entity IN {_codes}),
             v AS (SELECT entity, period, {', '.join(f"max(value) FILTER (edition = '{x}') AS {x}" for x in _around)} FROM vintages WHERE edition IN {tuple(_around)} GROUP BY 1, 2)
             SELECT g.*, v.* EXCLUDE (entity, period), realised_own, p.growth AS current_estimate FROM g LEFT JOIN v USING (entity, period) LEFT JOIN allref USING (entity, period)
             LEFT JOIN panel p ON p.entity = g.entity AND p.period = g.period""", " ".join([*_around, "realised_own", "current_estimate"]))
register("g13_announced_downturns", lambda s, d: k.announced_downturns(real_vintages(s, d), shock_weights(s, d), SHOCK),
         """WITH x AS (SELECT v.edition, v.value, o.realised_own AS r, p.nominal AS w FROM real_vintages v LEFT JOIN own_ref o ON o.entity = v.entity AND o.period = 32
              LEFT JOIN panel p ON p.entity = v.entity AND p.period = 31 WHERE v.period = 32 AND v.edition IN ('S31', 'F31', 'S32', 'F32'))
            SELECT edition, count(*) AS entities, count(*) FILTER (value < 0) AS announced, sum((value < 0)::INT * w) / sum(w) * 100 AS announced_weight_pct, count(*) FILTER (r < 0) AS occurred,
            sum((r < 0)::INT * w) FILTER (r IS NOT NULL) / sum(w) FILTER (r IS NOT NULL) * 100 AS occurred_weight_pct,
            count(*) FILTER (value < 0 AND r < 0) / nullif(count(*) FILTER (r < 0), 0)::DOUBLE * 100 AS hit_pct FROM x GROUP BY 1""", "announced_weight_pct occurred_weight_pct hit_pct")
register("g14_rebound_errors", lambda s, d: k.rebound_errors(real_vintages(s, d), shock_weights(s, d), SHOCK),
         f"""WITH x AS (SELECT v.edition, v.value - o.realised_own AS e, p.nominal AS w FROM real_vintages v JOIN own_ref o ON o.entity = v.entity AND o.period = 33
              LEFT JOIN panel p ON p.entity = v.entity AND p.period = 31 WHERE v.period = 33 AND v.edition IN {tuple(_around)})
            SELECT edition, count(*) AS entities, sum(e * w) FILTER (w > 0) / sum(w) FILTER (w > 0) AS weighted_error, avg((e < 0)::INT) * 100 AS underestimated_pct, median(e) AS median_error
            FROM x WHERE e IS NOT NULL GROUP BY 1""", "weighted_error underestimated_pct median_error")
register("g15_levels_by_edition", lambda s, d: k.levels_by_edition(inputs.vintages(s, d), current_estimates(s, d), CODES, SHOCK),
         f"""WITH s AS (SELECT entity, period, edition AS source, value AS g FROM vintages WHERE edition IN ('F31', 'S32', 'F32', 'S33') UNION ALL
               SELECT entity, period, 'own reference', realised_own FROM allref UNION ALL SELECT entity, period, 'current', growth FROM panel WHERE growth IS NOT NULL),
             k AS (SELECT * FROM s WHERE entity IN {_codes} AND period BETWEEN 31 AND 36),
             l AS (SELECT *, CASE WHEN row_number() OVER w = period - 30 THEN 100 * product(1 + g / 100) OVER w END AS level FROM k WINDOW w AS (PARTITION BY entity, source ORDER BY period)),
             a AS (SELECT entity, source, {', '.join(f"max(level) FILTER (period = {32 + j}) AS level_{j}" for j in (0, 1, 2, 4))} FROM l GROUP BY 1, 2)
             SELECT g.entity, g.source, a.* EXCLUDE (entity, source) FROM (SELECT DISTINCT entity, source FROM (SELECT entity FROM vintages WHERE entity IN {_codes}),
               (SELECT unnest(['F31', 'S32', 'F32', 'S33', 'own reference', 'current']) AS source)) g LEFT JOIN a USING (entity, source)""", "level_0 level_1 level_2 level_4")
CTES["act"] = """
WITH p AS (SELECT entity, CASE WHEN nk % 2 = 1 THEN 'survey' ELSE 'carriers' END AS source, period, population AS a, growth AS g FROM panel WHERE NOT is_aggregate),
x AS (SELECT entity, min(source) AS source, max(a) FILTER (period = 30) AS activity_base, ln(max(a) FILTER (period = 30) / max(a) FILTER (period = 27)) AS activity_before,
  ln(max(a) FILTER (period = 33) / max(a) FILTER (period = 30)) AS activity_1, ln(max(a) FILTER (period = 36) / max(a) FILTER (period = 30)) AS activity_4,
  CASE WHEN count(g) FILTER (period BETWEEN 28 AND 30) = 3 THEN sum(ln(1 + g / 100)) FILTER (period BETWEEN 28 AND 30) END AS output_before,
  CASE WHEN count(g) FILTER (period BETWEEN 31 AND 33) = 3 THEN sum(ln(1 + g / 100)) FILTER (period BETWEEN 31 AND 33) END AS output_1,
  CASE WHEN count(g) FILTER (period BETWEEN 31 AND 36) = 6 THEN sum(ln(1 + g / 100)) FILTER (period BETWEEN 31 AND 36) END AS output_4 FROM p GROUP BY 1),
j AS (SELECT entity, CASE WHEN count(value) FILTER (period BETWEEN 31 AND 33) = 3 THEN sum(ln(1 + value / 100)) FILTER (period BETWEEN 31 AND 33) END AS projected_1,
  CASE WHEN count(value) FILTER (period BETWEEN 31 AND 36) = 6 THEN sum(ln(1 + value / 100)) FILTER (period BETWEEN 31 AND 36) END AS projected_4 FROM vintages WHERE edition = 'F31' GROUP BY 1)
SELECT x.*, projected_1, projected_4, output_1 - projected_1 AS surprise_1, output_4 - projected_4 AS surprise_4 FROM x LEFT JOIN j USING (entity)"""
register("g16_g17_activity_and_output", lambda s, d: activity_table.build(s, d), "SELECT * FROM act",
         "activity_before activity_1 activity_4 output_before output_1 output_4 projected_1 projected_4 surprise_1 surprise_4", 6)
register("g18_activity_regressions", lambda s, d: k.activity_regressions(activity_table(s, d), "survey"),
         """WITH r AS (SELECT 'before' AS span, activity_before AS y, output_before AS x FROM act WHERE source = 'survey' UNION ALL SELECT '1', activity_1, output_1 FROM act WHERE source = 'survey'
              UNION ALL SELECT '4', activity_4, output_4 FROM act WHERE source = 'survey'),
            f AS (SELECT span, count(*) AS entities, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
            SELECT span, entities, slope, slope - 1.96 * sqrt((syy - slope * sxy) / (entities - 2) / sxx) AS ci_low, slope + 1.96 * sqrt((syy - slope * sxy) / (entities - 2) / sxx) AS ci_high, r2 FROM f WHERE entities >= 5""",
         "slope ci_low ci_high r2")
register("g19_activity_summary", lambda s, d: k.activity_summary(activity_table(s, d), shock_weights(s, d)),
         """WITH w AS (SELECT entity, nominal AS w FROM panel WHERE period = 31 AND NOT is_aggregate),
            x AS (SELECT source AS member, 1 AS delay, activity_base AS b, activity_before AS ab, w, activity_1 AS a, output_1 AS o, projected_1 AS p FROM act JOIN w USING (entity)
              UNION ALL SELECT source, 4, activity_base, activity_before, w, activity_4, output_4, projected_4 FROM act JOIN w USING (entity)),
            t AS (SELECT member, delay, count(*) AS entities, ln(sum(b) / sum(b * exp(-ab))) / 3 AS tr, ln(sum(b * exp(a)) / sum(b)) AS a, ln(sum(w * exp(o)) / sum(w)) AS o, ln(sum(w * exp(p)) / sum(w)) AS p
              FROM x WHERE ab IS NOT NULL AND a IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, a - tr * (delay + 2) AS gap FROM t)
            SELECT member, delay, entities, a * 100 AS activity_growth, tr * 100 AS activity_trend, gap * 100 AS activity_gap, o * 100 AS output_growth, p * 100 AS output_projected, (o - p) * 100 AS output_gap,
              1.0::DOUBLE * (o - p) * 100 AS implied_gap_0, 1.5::DOUBLE * (o - p) * 100 AS implied_gap_1, CASE WHEN gap < 0 THEN (o - p) / gap * 100 END AS explained_pct_0,
              CASE WHEN gap < 0 THEN 1.5::DOUBLE * (o - p) / gap * 100 END AS explained_pct_1 FROM u""",
         "activity_growth activity_trend activity_gap output_growth output_projected output_gap implied_gap_0 implied_gap_1 explained_pct_0 explained_pct_1", 3)


def _stacked(spark, sf):
    p = inputs.panel(spark, sf).where("NOT is_aggregate")
    first = p.where("grp = 'EUROPE'").groupBy(F.lit("EU").alias("geo"), "period").agg(F.sum("population").alias("value"))
    second = p.where("grp <> 'EUROPE'").select("entity", "period", F.col("population").alias("value"))
    return k.stack_activity(first, second, {"EU": "Europe"}, "survey", "carriers")


register("g20_stack_activity", _stacked,
         """SELECT 'Europe' AS entity, period, sum(population) AS activity, 'survey' AS source FROM panel WHERE NOT is_aggregate AND grp = 'EUROPE' GROUP BY period
            UNION ALL SELECT entity, period, population, 'carriers' FROM panel WHERE NOT is_aggregate AND grp <> 'EUROPE'""")
