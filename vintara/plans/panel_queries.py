"""Queries of the panel and summary operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from vintara.functions import expr
from vintara.operators import panel as p, reports as r, summary as s
from vintara.plans import inputs
from vintara.plans.inputs import CUT, END, START, memo
from vintara.plans.oracle import CTES
from vintara.plans.registry import register
from vintara.session import shared_folder


@memo
def report(spark, sf):
    return p.report_panel(inputs.observed_source(spark, sf), inputs.forecast_source(spark, sf), CUT)


@memo
def summary(spark, sf):
    return s.common_panel_ranks(s.entity_summary(report(spark, sf), START, CUT, END))


def on_report(fn):
    return lambda a, b: fn(report(a, b))


def on_summary(fn):
    return lambda a, b: fn(summary(a, b))


CTES["unified"] = """
WITH o AS (SELECT entity, name, period, 'observed' AS data_type, false AS is_forecast, is_aggregate, grp, nominal_raw / 1e9 AS nominal, growth,
    ppp_raw / 1e9 AS ppp, per_capita, volume_raw / 1e9 AS volume, ppp_volume_raw / 1e9 AS ppp_volume, population_raw / 1e6 AS population FROM observed),
names AS (SELECT entity, arg_min(name, period) AS name, arg_min(is_aggregate, period) AS agg, arg_min(grp, period) AS grp FROM o GROUP BY 1),
f AS (SELECT entity, name, period, 'forecast' AS data_type, is_forecast, is_aggregate, NULL::VARCHAR AS grp, nominal, growth, ppp, per_capita,
    NULL::DOUBLE AS volume, NULL::DOUBLE AS ppp_volume, population FROM forecast),
u AS (SELECT * FROM o UNION ALL SELECT * FROM f WHERE is_forecast),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY is_forecast DESC) = 1)
SELECT d.entity, coalesce(n.name, d.name) AS name, d.period, d.data_type, d.is_forecast, coalesce(n.agg, d.is_aggregate) AS is_aggregate, n.grp,
  d.nominal, d.growth, d.ppp, d.per_capita, d.volume, d.ppp_volume, d.population,
  f.nominal AS other_nominal, f.ppp AS other_ppp, f.per_capita AS other_per_capita, f.population AS other_population,
  CASE WHEN NOT d.is_forecast THEN (f.nominal - d.nominal) / nullif(d.nominal, 0) * 100 END AS source_gap_pct
FROM d LEFT JOIN names n USING (entity) LEFT JOIN f ON f.entity = d.entity AND f.period = d.period"""
CTES["spliced"] = """
WITH b AS (SELECT entity, nominal / nullif(other_nominal, 0) AS fn, ppp / nullif(other_ppp, 0) AS fp, per_capita / nullif(other_per_capita, 0) AS fc,
  population / nullif(other_population, 0) AS fo FROM unified WHERE period = 40),
c AS (SELECT entity, CASE WHEN fn > 0 THEN fn END AS fn, CASE WHEN fp > 0 THEN fp END AS fp, CASE WHEN fc > 0 THEN fc END AS fc, CASE WHEN fo > 0 THEN fo END AS fo FROM b)
SELECT u.* REPLACE (CASE WHEN is_forecast THEN nominal * coalesce(fn, 1) ELSE nominal END AS nominal, CASE WHEN is_forecast THEN ppp * coalesce(fp, 1) ELSE ppp END AS ppp,
  CASE WHEN is_forecast THEN per_capita * coalesce(fc, 1) ELSE per_capita END AS per_capita,
  CASE WHEN is_forecast THEN population * coalesce(fo, 1) ELSE population END AS population),
  fn AS factor_nominal, fp AS factor_ppp, fc AS factor_per_capita, fo AS factor_population
FROM unified u LEFT JOIN c USING (entity)"""
CTES["chained"] = """
WITH f AS (SELECT entity, period, bool_or(growth IS NULL OR period <> coalesce(prev, 40) + 1) OVER w AS broken, product(1 + growth / 100) OVER w AS cumul
    FROM (SELECT entity, period, growth, lag(period) OVER (PARTITION BY entity ORDER BY period) AS prev FROM spliced WHERE is_forecast AND period > 40)
    WINDOW w AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
b AS (SELECT entity, volume AS bv, ppp_volume AS bp FROM spliced WHERE period = 40)
SELECT s.* REPLACE (CASE WHEN NOT f.broken AND bv IS NOT NULL THEN bv * cumul ELSE volume END AS volume,
  CASE WHEN NOT f.broken AND bp IS NOT NULL THEN bp * cumul ELSE ppp_volume END AS ppp_volume)
FROM spliced s LEFT JOIN f ON f.entity = s.entity AND f.period = s.period LEFT JOIN b ON b.entity = s.entity"""
CTES["report"] = """
SELECT *, CASE WHEN population > 0 THEN volume / population * 1000 END AS volume_per_capita,
  CASE WHEN population > 0 THEN ppp_volume / population * 1000 END AS ppp_volume_per_capita FROM chained"""


def _at(c, d, p):
    return f"avg({c}) FILTER (period = {p}) AS {c}_{d}"


def _cagr(c, a, b, n):
    return f"CASE WHEN {c}_{a} > 0 AND {c}_{b} > 0 THEN (pow({c}_{b} / {c}_{a}, 1.0::DOUBLE / {n}) - 1) * 100 END"


_dates = {"start": 20, "mid": 30, "end": 40, "fcst": 46}
_wanted = {"nominal": "start mid end fcst", "volume": "start end fcst", "ppp_volume": "start end fcst", "population": "start end fcst",
           "volume_per_capita": "start end fcst", "ppp_volume_per_capita": "end fcst"}
_levels = [f"{c}_{d}" for c, ds in _wanted.items() for d in ds.split()]
_growths = [f"cagr_{c}_{k}" for c in ("nominal", "volume", "population", "volume_per_capita") for k in ("hist", "fcst")]


def _esum(source: str, dates: dict[str, int]) -> str:
    hist, fcst = dates["end"] - dates["start"], dates["fcst"] - dates["end"]
    return f"""
WITH l AS (SELECT entity, arg_min(name, period) AS name, arg_min(grp, period) AS grp,
  {', '.join(_at(c, d, dates[d]) for c, ds in _wanted.items() for d in ds.split())}
  FROM {source} WHERE NOT is_aggregate GROUP BY 1 HAVING count(nominal) > 0)
SELECT *, {', '.join(_cagr(c, 'start', 'end', hist) + f' AS cagr_{c}_hist, ' + _cagr(c, 'end', 'fcst', fcst) + f' AS cagr_{c}_fcst' for c in ('nominal', 'volume', 'population', 'volume_per_capita'))},
  nominal_fcst - nominal_end AS nominal_change, {_cagr('nominal', 'start', 'end', hist)} - {_cagr('volume', 'start', 'end', hist)} AS nominal_volume_gap FROM l"""


CTES["esum"] = _esum("report", _dates)
CTES["ranked"] = """
WITH m AS (SELECT *, nominal_end IS NOT NULL AND nominal_fcst IS NOT NULL AND ((ppp_volume_end IS NOT NULL AND ppp_volume_fcst IS NOT NULL)
    OR (SELECT count(ppp_volume_end) = 0 OR count(ppp_volume_fcst) = 0 FROM esum)) AS in_panel FROM esum),
r AS (SELECT *, CASE WHEN in_panel THEN rank() OVER (ORDER BY CASE WHEN in_panel THEN nominal_end END DESC NULLS LAST) END AS rank_end,
  CASE WHEN in_panel THEN rank() OVER (ORDER BY CASE WHEN in_panel THEN nominal_fcst END DESC NULLS LAST) END AS rank_fcst,
  CASE WHEN in_panel AND ppp_volume_end IS NOT NULL THEN rank() OVER (ORDER BY CASE WHEN in_panel THEN ppp_volume_end END DESC NULLS LAST) END AS rank_ppp_end,
  CASE WHEN in_panel AND ppp_volume_fcst IS NOT NULL THEN rank() OVER (ORDER BY CASE WHEN in_panel THEN ppp_volume_fcst END DESC NULLS LAST) END AS rank_ppp_fcst FROM m)
SELECT *, rank_end - rank_fcst AS rank_change, rank_end - rank_ppp_end AS rank_gap_bases FROM r"""
CTES["toptable"] = "SELECT entity, name, nominal_start, nominal_end, nominal_fcst, cagr_nominal_hist, cagr_nominal_fcst, rank_end, rank_fcst, rank_change FROM ranked ORDER BY nominal_end DESC NULLS LAST, entity LIMIT 10"
CTES["voltable"] = "SELECT entity, nominal_end, volume_end, cagr_nominal_hist, cagr_volume_hist, nominal_volume_gap FROM ranked WHERE cagr_nominal_hist IS NOT NULL AND cagr_volume_hist IS NOT NULL ORDER BY nominal_end DESC NULLS LAST, entity LIMIT 10"
CTES["ppptable"] = "SELECT entity, rank_ppp_end, nominal_end, ppp_volume_end, rank_end, rank_gap_bases FROM ranked WHERE rank_ppp_end IS NOT NULL ORDER BY rank_ppp_end, entity LIMIT 15"

register("t3_panel", lambda a, b: inputs.whole_panel.build(a, b), "SELECT * FROM whole_panel")
register("b1_harmonise_units", lambda a, b: p.harmonise_observed(inputs.observed_source(a, b)),
         """SELECT entity, name, period, 'observed' AS data_type, false AS is_forecast, is_aggregate, grp, nominal_raw / 1e9 AS nominal, growth,
            ppp_raw / 1e9 AS ppp, per_capita, volume_raw / 1e9 AS volume, ppp_volume_raw / 1e9 AS ppp_volume, population_raw / 1e6 AS population FROM observed""")
register("b3_cagr", lambda a, b: inputs.panel(a, b).groupBy("entity").agg(
    F.max(F.when(F.col("period") == START, F.col("nominal"))).alias("first"), F.max(F.when(F.col("period") == END, F.col("nominal"))).alias("last")).select(
    "entity", expr.cagr("first", "last", END - START).alias("cagr_pct"), expr.cagr("first", "last", 0).alias("no_span")),
    "SELECT entity, (pow(max(nominal) FILTER (period = 46) / max(nominal) FILTER (period = 20), 1.0::DOUBLE / 26) - 1) * 100 AS cagr_pct, NULL::DOUBLE AS no_span FROM panel GROUP BY 1",
    "cagr_pct")
register("b4_per_capita", lambda a, b: inputs.panel(a, b).select("entity", "period", expr.per_capita("volume", "population").alias("per_capita")),
         "SELECT entity, period, CASE WHEN population > 0 THEN volume / population * 1000 END AS per_capita FROM panel", "per_capita")
register("b5_e7_comparable_sources", on_report(lambda t: s.comparable_sources(t, CUT)),
         """SELECT count(*) AS comparable, count(*) FILTER (abs(source_gap_pct) > 5) AS diverging, median(abs(source_gap_pct)) AS median_gap
            FROM report WHERE period = 40 AND NOT is_aggregate AND source_gap_pct IS NOT NULL""", "median_gap")
register("d1_unify", lambda a, b: p.unify(inputs.observed_source(a, b), inputs.forecast_source(a, b)), "SELECT * FROM unified")
register("d2_splice", lambda a, b: p.splice(p.unify(inputs.observed_source(a, b), inputs.forecast_source(a, b)), CUT), "SELECT * FROM spliced")
register("d3_chain_volumes", lambda a, b: p.chain_volumes(p.splice(p.unify(inputs.observed_source(a, b), inputs.forecast_source(a, b)), CUT), CUT).select(
    "entity", "period", "is_forecast", "growth", "volume", "ppp_volume"),
    "SELECT entity, period, is_forecast, growth, volume, ppp_volume FROM chained", "growth volume ppp_volume")
register("d4_report_panel", lambda a, b: p.report_panel(inputs.observed_source(a, b), inputs.forecast_source(a, b), CUT), "SELECT * FROM report",
         "volume ppp_volume volume_per_capita ppp_volume_per_capita")
register("d5_pivot_indicators", lambda a, b: p.pivot_indicators(inputs.indicators(a, b), ("nominal", "volume", "population")),
         "SELECT entity, period, nominal, volume, population FROM panel", "nominal volume population", 6)
register("d6_last_well_covered", lambda a, b: p.last_well_covered(inputs.panel(a, b), "nominal"),
         """WITH c AS (SELECT period, count(DISTINCT entity) AS n FROM panel WHERE NOT is_aggregate GROUP BY 1)
            SELECT max(period) AS last_period FROM c WHERE n > (SELECT max(n) FROM c) / 2""")
register("d7_latest_levels", lambda a, b: p.latest_levels(inputs.panel(a, b)),
         "SELECT entity, arg_max(nominal, period) AS weight FROM panel GROUP BY 1", "weight", 6)


def _incomplete(a, b):
    """The observed source with some entities missing in its last periods, as after a late publication."""
    late = (F.col("period") == CUT) & F.expr("cast(substring(entity, 2) AS int) % 7 = 0")
    late2 = (F.col("period") == CUT - 1) & F.expr("cast(substring(entity, 2) AS int) % 11 = 0")
    return inputs.observed_source(a, b).where(~(late | late2) | F.col("is_aggregate"))


CTES["incomplete"] = """SELECT * FROM observed WHERE is_aggregate OR NOT (period = 40 AND substring(entity, 2)::INT % 7 = 0
  OR period = 39 AND substring(entity, 2)::INT % 11 = 0)"""
CTES["candidates"] = """
WITH k AS (SELECT unnest([40, 39, 38, 37, 36])::INTEGER AS cut),
pth AS (SELECT cut, entity, arg_max(nominal, period) AS fn, count(growth) = max(period) - cut AS chain, max(period) AS last FROM k JOIN forecast ON period > cut GROUP BY 1, 2)
SELECT k.cut, o.entity FROM k JOIN incomplete o ON o.period = k.cut JOIN pth p ON p.cut = k.cut AND p.entity = o.entity
WHERE NOT o.is_aggregate AND nominal_raw IS NOT NULL AND ppp_volume_raw IS NOT NULL AND fn IS NOT NULL AND chain AND last = (SELECT max(period) FROM forecast)"""
CANDIDATES = r.candidate_periods(START, CUT)


def _at_cut(text: str, cut: int, source: str) -> str:
    """An expression of the report for another cut, over the source of that cut."""
    return re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {source}_{cut}", re.sub(r"(= |> |prev, )40\b", rf"\g<1>{cut}", text))


for _k in CANDIDATES:
    CTES[f"observed_{_k}"] = f"SELECT * FROM incomplete WHERE period <= {_k}"
    CTES[f"forecast_{_k}"] = f"SELECT * REPLACE (period > {_k} AS is_forecast) FROM forecast"
    CTES[f"unified_{_k}"] = re.sub(r"FROM (observed|forecast)\b", rf"FROM \1_{_k}", CTES["unified"])
    CTES[f"spliced_{_k}"] = _at_cut(CTES["spliced"], _k, "unified")
    CTES[f"chained_{_k}"] = _at_cut(CTES["chained"], _k, "spliced")
    CTES[f"report_{_k}"] = _at_cut(CTES["report"], _k, "chained")
    CTES[f"esum_{_k}"] = _esum(f"report_{_k}", _dates | {"end": _k})
    CTES[f"ranked_{_k}"] = _at_cut(CTES["ranked"], _k, "esum")
CTES["ranks_by_cut"] = " UNION ALL BY NAME ".join(f"SELECT {_k} AS cut, * FROM ranked_{_k}" for _k in CANDIDATES)


@memo
def candidate_ranks(spark, sf):
    return r.ranked_reports(p.report_panels(_incomplete(spark, sf), inputs.forecast_source(spark, sf), CANDIDATES), START, END)


def _two_reports(a, b):
    """Both reports written, then read back: who has which rank in which, and who lost one."""
    path = f"{shared_folder(a)}/reports-{uuid.uuid4().hex}"
    names = list(r.two_reports(_incomplete(a, b), inputs.forecast_source(a, b), p.latest_levels(inputs.panel(a, b).where("NOT is_aggregate")), START, CUT, END, path))
    lost = r.read_reports(a, path, names, "unranked").withColumn("unranked", F.lit(True))
    kept = r.read_reports(a, path, names, "summary").join(lost, ["report", "entity"], "left")
    return kept.select("report", "cut", "entity", "nominal_end", "ppp_volume_fcst", "cagr_volume_hist", "rank_end", "rank_change", "rank_gap_bases", F.coalesce("unranked", F.lit(False)).alias("unranked"))


register("d9_candidate_panels", lambda a, b: r.ranked_candidates(candidate_ranks(a, b)), "SELECT * FROM candidates")
CTES["losses"] = """
WITH c AS (SELECT cut, entity FROM ranks_by_cut WHERE rank_end IS NOT NULL),
w AS (SELECT c.entity, coalesce(arg_max(nominal, period), 0) AS w FROM (SELECT DISTINCT entity FROM c) c LEFT JOIN panel p USING (entity) GROUP BY 1)
SELECT k.cut, count(c.entity) AS entities, coalesce(sum(CASE WHEN c.entity IS NULL THEN w ELSE 0 END) / sum(w) * 100, 0) AS lost_pct
FROM (SELECT DISTINCT cut FROM c) k CROSS JOIN w LEFT JOIN c ON c.cut = k.cut AND c.entity = w.entity GROUP BY 1"""
register("d9_two_reports", _two_reports, """
WITH kept AS (SELECT coalesce((SELECT max(cut) FROM losses WHERE lost_pct < 0.1), (SELECT arg_max(cut, entities * 1000 + cut) FROM losses)) AS ref),
n AS (SELECT 'reference' AS report, ref AS cut FROM kept UNION ALL SELECT 'recent', 40 FROM kept WHERE ref <> 40)
SELECT report, cut, entity, nominal_end, ppp_volume_fcst, cagr_volume_hist, rank_end, rank_change, rank_gap_bases,
  rank_end IS NULL AND entity IN (SELECT x.entity FROM ranks_by_cut x, kept WHERE x.cut = ref AND x.rank_end IS NOT NULL) AS unranked FROM ranks_by_cut JOIN n USING (cut)""",
         "nominal_end ppp_volume_fcst cagr_volume_hist", 6)
register("d8_reference_period", lambda a, b: p.reference_period(
    r.ranked_candidates(candidate_ranks(a, b)), p.latest_levels(inputs.panel(a, b).where("NOT is_aggregate"))),
    """WITH w AS (SELECT c.entity, coalesce(arg_max(nominal, period), 0) AS w FROM (SELECT DISTINCT entity FROM candidates) c LEFT JOIN panel p USING (entity) GROUP BY 1),
       l AS (SELECT k.cut, count(c.entity) AS entities, coalesce(sum(CASE WHEN c.entity IS NULL THEN w ELSE 0 END) / sum(w) * 100, 0) AS lost_pct
         FROM (SELECT DISTINCT cut FROM candidates) k CROSS JOIN w LEFT JOIN candidates c ON c.cut = k.cut AND c.entity = w.entity GROUP BY 1)
       SELECT cut, entities, lost_pct, cut = coalesce((SELECT max(cut) FROM l WHERE lost_pct < 0.1), (SELECT arg_max(cut, entities * 1000 + cut) FROM l)) AS retained FROM l""",
    "lost_pct")
register("d10_structuring_periods", on_report(p.structuring_periods),
         'SELECT min(period) AS start, max(period) FILTER (NOT is_forecast) AS boundary, max(period) AS "end" FROM report')
register("d11_junction_steps", on_report(lambda t: p.junction_steps(t, CUT)),
         """SELECT a.entity, a.source_gap_pct, (b.nominal / a.nominal - 1) * 100 AS shown_growth_pct, (b.other_nominal / a.nominal - 1) * 100 AS juxtaposed_growth_pct
            FROM report a LEFT JOIN report b ON a.entity = b.entity AND b.period = 41 WHERE a.period = 40 AND NOT a.is_aggregate AND a.source_gap_pct IS NOT NULL
            ORDER BY abs(a.source_gap_pct) DESC, a.entity LIMIT 15""", "source_gap_pct shown_growth_pct juxtaposed_growth_pct")
SUM = " ".join([*_levels, *_growths, "nominal_change", "nominal_volume_gap"])
register("e1_entity_summary", on_report(lambda t: s.entity_summary(t, START, CUT, END)), "SELECT * FROM esum", SUM, 5)
register("e2_common_panel_rank", lambda a, b: s.common_panel_ranks(s.entity_summary(
    p.report_panel(inputs.observed_source(a, b), inputs.forecast_source(a, b), CUT), START, CUT, END)), "SELECT * FROM ranked", SUM, 5)
register("e4_top_levels", on_summary(lambda t: s.top(t, "nominal_end", 20).select("entity", "nominal_end")),
         "SELECT entity, nominal_end FROM ranked ORDER BY nominal_end DESC NULLS LAST, entity LIMIT 20", "nominal_end", 5)
register("e5_extreme_gaps", on_summary(lambda t: s.top(t, "nominal_volume_gap", 5).unionByName(s.top(t, "nominal_volume_gap", 5, ascending=True)).select("entity", "nominal_volume_gap")),
         """SELECT * FROM (SELECT entity, nominal_volume_gap FROM ranked ORDER BY nominal_volume_gap DESC NULLS LAST, entity LIMIT 5)
            UNION ALL SELECT * FROM (SELECT entity, nominal_volume_gap FROM ranked ORDER BY nominal_volume_gap ASC NULLS LAST, entity LIMIT 5)""", "nominal_volume_gap")
register("e6_last_rows", on_report(lambda t: s.last_rows(t).select("entity", "period", "is_forecast", "nominal", "growth")),
         "SELECT entity, period, is_forecast, nominal, growth FROM report QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) <= 10", "nominal growth", 5)
register("e8_growth_heat_map", lambda a, b: s.growth_heat_map(report(a, b), s.top(summary(a, b), "nominal_end", 10), 31, END),
         "SELECT entity, " + ", ".join(f"max(growth) FILTER (period = {q}) AS p{q}" for q in range(31, 47)) +
         " FROM report WHERE entity IN (SELECT entity FROM toptable) GROUP BY 1", " ".join(f"p{q}" for q in range(31, 47)))
register("e11_find_entity", on_report(lambda t: s.find_entity(t, "supplier#000000003").select("entity", "name", "period", "nominal")),
         "SELECT entity, name, period, nominal FROM report WHERE upper(name) = 'SUPPLIER#000000003' OR entity = 'SUPPLIER#000000003'", "nominal", 5)
register("e12_top_table", on_summary(s.top_table), "SELECT * FROM toptable", "nominal_start nominal_end nominal_fcst cagr_nominal_hist cagr_nominal_fcst", 5)
register("e12_volume_table", on_summary(s.volume_table), "SELECT * FROM voltable", "nominal_end volume_end cagr_nominal_hist cagr_volume_hist nominal_volume_gap", 5)
register("e12_ppp_table", on_summary(s.ppp_table), "SELECT * FROM ppptable", "nominal_end ppp_volume_end", 5)
register("e12_summary_facts", on_summary(s.summary_facts),
         """SELECT count(*) FILTER (nominal_volume_gap < 0) AS negative_gaps, count(nominal_volume_gap) AS known_gaps, arg_min(entity, rank_ppp_end) AS first_ppp,
            (SELECT arg_min(entity, nominal_volume_gap) FROM voltable) AS largest_negative_gap,
            (SELECT entity FROM ppptable WHERE rank_gap_bases IS NOT NULL ORDER BY rank_gap_bases DESC, rank_ppp_end LIMIT 1) AS climber FROM ranked""")
