"""The derived tables of ``inputs`` as DuckDB common table expressions, for the oracle."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["suppliers"] = """
SELECT 'E' || s_suppkey AS entity, s_name AS name, r_name AS grp, s_nationkey AS nk
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""

CTES["calendar"] = """
SELECT ((year(min(l_shipdate)) - 1990) * 4 + quarter(min(l_shipdate)) - 1)::INTEGER AS first_period, ((year(max(l_shipdate)) - 1990) * 4 + quarter(max(l_shipdate)) - 1)::INTEGER AS last_period,
  ((year(max(l_shipdate)) - 1990) * 4 + quarter(max(l_shipdate)) - 1 - (max(l_shipdate)::DATE < date_trunc('quarter', max(l_shipdate))::DATE + INTERVAL 3 MONTH - INTERVAL 1 DAY)::INTEGER)::INTEGER AS last_whole
FROM lineitem"""

CTES["cells"] = """
SELECT 'E' || l_suppkey AS entity, ((year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1)::INTEGER AS period,
  sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
  sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS net,
  sum(l_quantity::BIGINT)::BIGINT AS qty, count(*) AS pop
FROM lineitem GROUP BY 1, 2"""

CTES["every"] = """
WITH base AS (SELECT c.*, s.name, s.grp, s.nk FROM cells c LEFT JOIN suppliers s USING (entity))
SELECT entity, name, grp, nk, false AS is_aggregate, period, cents, net, qty, pop FROM base
UNION ALL SELECT 'G001', 'World', NULL, 0, true, period, sum(cents)::BIGINT, sum(net)::BIGINT, sum(qty)::BIGINT, sum(pop)::BIGINT
FROM base GROUP BY period
UNION ALL SELECT 'G11' || list_position(['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'], grp), grp, NULL, 0, true, period,
  sum(cents)::BIGINT, sum(net)::BIGINT, sum(qty)::BIGINT, sum(pop)::BIGINT FROM base WHERE grp IS NOT NULL GROUP BY grp, period"""

CTES["whole_panel"] = """
SELECT entity, name, grp, nk, is_aggregate, period, period > last_whole AS is_open, cents / 100000.0::DOUBLE AS nominal, net / 10000000.0::DOUBLE AS other,
  qty::DOUBLE AS volume, qty * (1.0::DOUBLE + nk * 0.02::DOUBLE) AS ppp_volume,
  cents / 100000.0::DOUBLE * (1.0::DOUBLE + nk * 0.02::DOUBLE) AS ppp, pop::DOUBLE AS population,
  CASE WHEN period <= last_whole AND lag(period) OVER w = period - 1 THEN (qty::DOUBLE / nullif(lag(qty) OVER w, 0) - 1) * 100 END AS growth,
  CASE WHEN period <= last_whole AND lag(period) OVER w = period - 1 THEN (net::DOUBLE / nullif(lag(net) OVER w, 0) - 1) * 100 END AS other_growth
FROM every, calendar WINDOW w AS (PARTITION BY entity ORDER BY period)"""

CTES["panel"] = "SELECT * EXCLUDE (is_open) FROM whole_panel WHERE NOT is_open"

CTES["observed"] = """
SELECT entity, name, period, is_aggregate, grp, nominal * 1e9 AS nominal_raw, ppp * 1e9 AS ppp_raw, volume * 1e9 AS volume_raw,
  ppp_volume * 1e9 AS ppp_volume_raw, population * 1e6 AS population_raw, nominal / nullif(population, 0) AS per_capita, growth
FROM panel WHERE period <= 40"""

CTES["forecast"] = """
SELECT entity, entity AS name, period, period > 40 AS is_forecast, is_aggregate, other AS nominal,
  other * (1.0::DOUBLE + nk * 0.02::DOUBLE) AS ppp, other / nullif(population, 0) AS per_capita,
  population * 1.1::DOUBLE AS population, other_growth AS growth FROM panel"""

CTES["vintages"] = """
WITH g AS (SELECT entity, name, period, growth,
  CASE WHEN lag(period, 3) OVER w = period - 3 THEN
    (lag(growth, 3) OVER w + lag(growth, 2) OVER w + lag(growth, 1) OVER w + growth) / 4 END AS mean4
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)),
shape AS (SELECT * FROM (VALUES
  ('F',1,0,0.9,0.0),('F',1,1,0.75,0.0),('F',1,2,0.6,0.0),('F',1,3,0.5,0.0),('F',1,4,0.4,0.0),('F',1,5,0.3,0.0),
  ('S',2,0,0.9,0.0),('S',2,1,0.75,0.0),('S',2,2,0.6,0.0),('S',2,3,0.5,0.0),('S',2,4,0.4,0.0),('S',2,5,0.3,0.0),
  ('F',1,-1,0.0,1.0),('S',1,-1,0.0,0.9),('F',2,-2,0.0,1.0),('S',2,-2,0.0,1.0)) t(season, shift, horizon, km, kg)),
r AS (SELECT entity, name, season, (period + shift)::INTEGER AS edition_period, horizon::INTEGER AS horizon,
  CASE WHEN horizon >= 0 THEN mean4 * km::DOUBLE ELSE growth * kg::DOUBLE END AS value FROM g CROSS JOIN shape)
SELECT entity, name, (edition_period + horizon)::INTEGER AS period, season || edition_period AS edition, season,
  edition_period, horizon, value, horizon >= 0 AS is_projection
FROM r WHERE value IS NOT NULL AND edition_period BETWEEN (SELECT first_period + 4 FROM calendar) AND (SELECT last_whole FROM calendar)"""

CTES["real_vintages"] = "SELECT * FROM vintages WHERE NOT regexp_matches(entity, '^G[0-9]')"

CTES["own_ref"] = """
SELECT entity, period, arg_min(value, edition_period) AS realised_own FROM real_vintages
WHERE horizon = -1 AND season = 'F' GROUP BY 1, 2"""

CTES["naive"] = """
WITH grid AS (SELECT entity, t FROM (SELECT DISTINCT entity FROM own_ref), range(20, 60) x(t)),
m AS (SELECT g.entity, g.t::INTEGER AS t, avg(o.realised_own) AS naive, count(o.realised_own) AS n
  FROM grid g JOIN own_ref o ON o.entity = g.entity AND o.period BETWEEN g.t - 3 AND g.t
  WHERE g.t <= (SELECT max(period) FROM own_ref) GROUP BY 1, 2)
SELECT entity, (t + 2)::INTEGER AS edition_period, naive FROM m WHERE n >= 3"""

CTES["ev"] = """
SELECT v.entity, v.name, g.grp, v.period, v.edition, v.season, v.edition_period, v.horizon, v.value, o.realised_own,
  p.growth AS realised_other, p.nominal AS weight, n.naive, v.value - o.realised_own AS error_own,
  v.value - p.growth AS error_other, n.naive - o.realised_own AS error_naive
FROM real_vintages v LEFT JOIN own_ref o ON v.entity = o.entity AND v.period = o.period
LEFT JOIN (SELECT entity, period, other_growth AS growth, nominal FROM panel) p ON v.entity = p.entity AND v.period = p.period
LEFT JOIN (SELECT DISTINCT entity, grp FROM panel WHERE grp IS NOT NULL) g ON v.entity = g.entity
LEFT JOIN naive n ON v.entity = n.entity AND v.edition_period = n.edition_period
WHERE v.is_projection"""

CTES["levels"] = """
WITH d AS (SELECT *, row_number() OVER w - 1 <> horizon AS skip, CASE WHEN value > -100 THEN ln(1 + value / 100) END AS p,
    CASE WHEN value > -100 AND realised_own > -100 THEN ln(1 + value / 100) - ln(1 + realised_own / 100) END AS own,
    CASE WHEN value > -100 AND realised_other > -100 THEN ln(1 + value / 100) - ln(1 + realised_other / 100) END AS oth
  FROM ev WINDOW w AS (PARTITION BY entity, edition ORDER BY horizon)),
b AS (SELECT *, bool_or(skip OR p IS NULL) OVER w AS bp, bool_or(skip OR own IS NULL) OVER w AS bo, bool_or(skip OR oth IS NULL) OVER w AS bt,
    sum(p) OVER w AS cp, sum(own) OVER w AS co, sum(oth) OVER w AS ct,
    min(CASE WHEN horizon >= 1 THEN value END) OVER w AS wp, min(CASE WHEN horizon >= 1 THEN realised_own END) OVER w AS wr
  FROM d WINDOW w AS (PARTITION BY entity, edition ORDER BY horizon ROWS UNBOUNDED PRECEDING))
SELECT entity, name, grp, edition, season, edition_period, period, horizon, weight,
  CASE WHEN NOT bp THEN (exp(cp) - 1) * 100 END AS projected_growth_pct,
  CASE WHEN NOT bp AND horizon >= 1 THEN wp END AS worst_projected, CASE WHEN NOT bo AND horizon >= 1 THEN wr END AS worst_realised,
  CASE WHEN NOT bo THEN (exp(co) - 1) * 100 END AS level_error_own, CASE WHEN NOT bt THEN (exp(ct) - 1) * 100 END AS level_error_other
FROM b"""


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every table expression it uses, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str, owner: str | None) -> None:
        for name in CTES:
            if name != owner and name not in ordered and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
                visit(CTES[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(body, None)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in ordered)
    return f"WITH {ctes}\nSELECT * FROM ({body.strip()})"
