"""Queries of the sources and sinks: documents are made of the given tables and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vintara.functions import expr, fixed
from vintara.operators import vintages as v
from vintara.plans import inputs
from vintara.plans.evaluation_queries import real_vintages
from vintara.plans.longrun_queries import past_revisions, current_population
from vintara.plans.panel_queries import report, summary
from vintara.plans.registry import register
from vintara.plans.revision_queries import edition_archive, metadata
from vintara.plans.scenario_queries import long_run_series, population_variants
from vintara.session import shared_folder
from vintara.sources import archives as ar, documents as d, tables as t


def real_entities(s, f):
    return inputs.suppliers(s, f).select("entity")


def pages(s, f):
    """One page per entity, with a null value and a record without code in each."""
    p = inputs.panel(s, f).groupBy("entity", "name").agg(F.collect_list(F.struct("period", "nominal")).alias("x"))
    record = lambda e, n, per, val: F.struct(e.alias("countryiso3code"), F.struct(n.alias("value")).alias("country"), per.cast("string").alias("date"), val.alias("value"))
    null = F.lit(None).cast("double")
    records = F.concat(F.transform("x", lambda r: record(F.col("entity"), F.col("name"), r["period"], r["nominal"])),
                       F.array(record(F.col("entity"), F.col("name"), F.lit(1), null), record(F.lit(""), F.col("name"), F.lit(2), F.lit(1.0))))
    header = F.to_json(F.struct(F.lit(1).alias("page"), F.lit("2024-01-01").alias("lastupdated")))
    return p.select(F.concat(F.lit("["), header, F.lit(","), F.to_json(records), F.lit("]")).alias("body"))


def nested(s, f):
    """One nested document per entity; some values are not numbers."""
    p = inputs.panel(s, f)
    text = lambda c: F.when(F.col("period") % 9 == 0, "no data").otherwise(F.col(c).cast("string"))
    maps = p.groupBy("entity").agg(*[F.map_from_entries(F.collect_list(F.struct(F.col("period").cast("string"), text(c)))).alias(c) for c in ("nominal", "volume")])
    values = F.create_map(*[x for c in ("nominal", "volume") for x in (F.lit(c), F.create_map(F.col("entity"), F.col(c)))])
    return maps.select(F.to_json(F.struct(values.alias("values"), F.create_map(
        F.col("entity"), F.struct(F.concat(F.lit("own "), F.col("entity")).alias("label"))).alias("countries"))).alias("body"))


def series_documents(s, f):
    """One index-keyed document per entity: reversed periods, text values, nulls."""
    p = inputs.panel(s, f).where("growth IS NOT NULL").groupBy("entity", "name").agg(F.sort_array(F.collect_list(F.struct("period", "growth", "nominal")), asc=False).alias("x"))
    obs = lambda c: F.map_from_entries(F.transform("x", lambda r, i: F.struct(
        i.cast("string"), F.array(F.when(r["period"] % 7 != 0, r[c].cast("string"))))))
    dims = F.struct(
        F.array(F.struct(F.array(F.struct(F.col("entity").alias("id"), F.col("name").alias("name"))).alias("values")),
                F.struct(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(i).alias("name")) for i in ("GROWTH", "LEVEL")]).alias("values"))).alias("series"),
        F.array(F.struct(F.transform("x", lambda r: F.struct((r["period"] + 2000).cast("string").alias("id"))).alias("values"))).alias("observation"))
    data = F.array(F.struct(F.create_map(
        F.lit("0:0:0"), F.struct(obs("growth").alias("observations")), F.lit("0:1:0"), F.struct(obs("nominal").alias("observations"))).alias("series")))
    body = F.struct(F.struct(dims.alias("dimensions")).alias("structure"), data.alias("dataSets"))
    return p.select(F.to_json(body).alias("body"))


def cubes(s, f):
    """One cube (unit x geo x time) per region; cells of incomplete periods are absent."""
    p = inputs.panel(s, f).where("is_aggregate AND entity <> 'G001'").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("period", "volume"))).alias("x"))
    n = F.size("x")
    index = F.map_from_entries(F.transform("x", lambda r, i: F.struct(r["period"].cast("string"), i)))
    cells = F.filter(F.transform("x", lambda r, i: F.struct((n * 2 + n + i).cast("string").alias("key"), r["volume"].alias("value"))), lambda e: F.col("name").isNotNull() & (e["value"] % 5 != 0))
    category = lambda m: F.struct(F.struct(m.alias("index")).alias("category"))
    dims = F.create_map(
        F.lit("unit"), category(F.create_map(F.lit("A"), F.lit(0), F.lit("PAS"), F.lit(1))),
        F.lit("geo"), category(F.create_map(F.lit("other"), F.lit(0), F.col("name"), F.lit(1))), F.lit("time"), category(index))
    body = F.struct(F.array(*[F.lit(x) for x in ("unit", "geo", "time")]).alias("id"), F.array(F.lit(2), F.lit(2), n).alias("size"),
                    dims.alias("dimension"), F.map_from_entries(cells).alias("value"))
    return p.select(F.to_json(body).alias("body"))


def concept_pages(s, f):
    p = inputs.panel(s, f).groupBy("entity").agg(F.collect_list(F.struct("period", "volume")).alias("x"))
    var = lambda c, i: F.struct(F.lit(c).alias("concept"), i.alias("id"))
    data = F.transform("x", lambda r: F.struct(
        F.array(var("Time", F.concat(F.lit("YR"), r["period"].cast("string"))), var("Country", F.col("entity")), var("Series", F.lit("V"))).alias("variable"),
        F.when(r["period"] % 4 != 0, r["volume"]).alias("value")))
    return p.select(F.to_json(F.struct(F.struct(data.alias("data")).alias("source"))).alias("body"))


register("a13_indicator_pages", lambda s, f: d.indicator_pages(pages(s, f), "body", "nominal", real_entities(s, f)),
         "SELECT entity, name, period, 'nominal' AS indicator, nominal AS value, is_aggregate FROM panel", "value", 5)
register("a14_nested_values", lambda s, f: d.nested_values(nested(s, f), "body", 41, real_entities(s, f), inputs.suppliers(s, f).where("nk % 2 = 0").select("entity", F.col("name").alias("label"))),
         """WITH x AS (SELECT p.entity, p.period, p.is_aggregate, CASE WHEN s.nk % 2 = 0 THEN s.name ELSE 'own ' || p.entity END AS name, p.nominal, p.volume FROM panel p LEFT JOIN suppliers s USING (entity) WHERE period % 9 <> 0)
            SELECT entity, name, period, 'nominal' AS indicator, nominal AS value, period >= 41 AS is_forecast, is_aggregate FROM x UNION ALL SELECT entity, name, period, 'volume', volume, period >= 41, is_aggregate FROM x""", "value", 5)
register("a15_indexed_series", lambda s, f: d.indexed_series(series_documents(s, f), "body"),
         """SELECT entity, name, 'GROWTH' AS indicator, period + 2000 AS period, growth AS value FROM panel WHERE growth IS NOT NULL AND period % 7 <> 0
            UNION ALL SELECT entity, name, 'LEVEL', period + 2000, nominal FROM panel WHERE growth IS NOT NULL AND period % 7 <> 0""", "value", 5)
register("a16_cube", lambda s, f: d.cube(cubes(s, f), "body"),
         "SELECT name AS geo, period, volume AS value FROM panel WHERE is_aggregate AND entity <> 'G001' AND volume::BIGINT % 5 <> 0")
register("a17_concept_records", lambda s, f: d.concept_records(concept_pages(s, f), "body"), "SELECT entity, period, volume AS value FROM panel WHERE period % 4 <> 0")

# A2: the vintage base spread over one column per edition, then read back.
EDITION_NAMES = [f"{x}{p}" for p in range(24, 47) for x in "SF"]


def wide_sheet(s, f):
    rows = inputs.vintages(s, f)
    sheet = rows.groupBy("name", "entity", "period").agg(*[
        F.coalesce(F.max(F.when(F.col("edition") == e, F.col("value"))).cast("string"), F.lit(".")).alias(f"{e}growth") for e in EDITION_NAMES if e not in ("S46", "F46")])
    return sheet


def _sheet(s, f):
    extra = inputs.vintages(s, f).where("edition IN ('F45', 'S46', 'F46')").select(F.upper("name").alias("name"), "entity", "period", "edition", "value")
    return v.wide_to_long(wide_sheet(s, f), "growth", extra)


register("a2_b7_wide_sheet_to_long", _sheet, "SELECT * FROM vintages", "value", 6)
register("a8_long_run_series", lambda s, f: t.long_run_series(long_run_series(s, f).select(
    F.col("zone").alias("REF_AREA"), F.col("scenario").alias("SCENARIO"), F.col("period").cast("string").alias("TIME_PERIOD"), F.when(F.col("period") != 50, F.col("value")).alias("OBS_VALUE"))),
    "SELECT * FROM lrseries WHERE period <> 50", "value")


def wpp(s, f):
    names = {"central": "Medium", "low": "Lower 80 PI", "high": "Upper 80 PI"}
    rows = population_variants(s, f).select(F.col("entity").alias("ISO3_code"), expr.lookup(names, "variant").alias("Variant"), F.col("period").alias("Time"), (F.col("population") * 1000).alias("PopTotal"))
    return rows.unionByName(rows.where("Variant = 'Medium'").withColumn("Variant", F.lit("High")))


register("a9_population_variants", lambda s, f: t.population_variants(wpp(s, f)), "SELECT * FROM unvar", "population")
register("a10_population_revision", lambda s, f: t.population_revision(past_revisions(s, f).select(
    F.concat_ws("-", "revision", "entity").alias("LocID"), F.explode(F.array(F.lit("Medium"), F.lit("Low"))).alias("Variant"), F.col("period").alias("Time"), F.col("population").alias("PopTotal"))),
    "SELECT revision || '-' || entity AS \"LocID\", period, population FROM popast", "population")


def _current(s, f):
    rows = current_population(s, f)
    raw = rows.select(F.col("entity").alias("ISO3_code"), F.col("entity").alias("LocID"), F.lit("Country/Area").alias("LocTypeName"), F.col("period").alias("Time"), F.explode(F.array(
        F.struct(F.lit("Medium").alias("Variant"), F.col("median").alias("PopTotal")), F.struct(F.lit("Lower 80 PI").alias("Variant"), F.col("low").alias("PopTotal")),
        F.struct(F.lit("Upper 80 PI").alias("Variant"), F.col("high").alias("PopTotal")), F.struct(F.lit("High").alias("Variant"), F.col("high").alias("PopTotal")))).alias("x")).select("*", "x.*")
    return t.current_revision(raw.unionByName(raw.withColumn("LocTypeName", F.lit("Region"))))


register("a11_current_revision", _current, 'SELECT entity, entity AS "LocID", period, median, low, high FROM pocur', "median low high")


def _history(s, f):
    p = inputs.panel(s, f).where("NOT is_aggregate")
    code = F.concat(F.lit("N"), F.lpad(F.col("nk").cast("string"), 2, "0"))
    wide = p.withColumn("qty", F.col("volume").cast("bigint")).groupBy(code.alias("entity")).agg(*[
        F.max(F.when(F.col("period") == q, F.col("qty"))).alias(f"q{q}") for q in (20, 30, 40)])
    cls = lambda q: F.when(F.col(q) % 4 == 0, "L").when(F.col(q) % 4 == 1, "LM*").when(F.col(q) % 4 == 2, " UM ").otherwise("..")
    return t.group_history(wide.select("entity", cls("q20").alias("FY89"), cls("q30").alias("FY99"), cls("q40").alias("FY04")))


register("a12_group_history", _history,
         """WITH x AS (SELECT 'N' || lpad(nk::VARCHAR, 2, '0') AS entity, period, max(volume::BIGINT) AS q FROM panel WHERE NOT is_aggregate AND period IN (20, 30, 40) GROUP BY 1, 2)
            SELECT entity, CASE period WHEN 20 THEN 1989 WHEN 30 THEN 1999 ELSE 2004 END AS fiscal, CASE q % 4 WHEN 0 THEN 'LIC' WHEN 1 THEN 'LMC' ELSE 'UMC' END AS grp FROM x WHERE q % 4 < 3""")


def _dimension(s, f):
    return inputs.panel(s, f).select("entity", F.when(F.col("is_aggregate"), "NA").otherwise(F.col("grp")).alias("region"), F.when(F.col("nk") % 4 != 0, F.col("grp")).alias("grp")).distinct()


register("a26_entity_dimension", lambda s, f: t.entity_dimension(_dimension(s, f)), "SELECT entity, CASE WHEN nk % 4 <> 0 THEN grp ELSE 'INX' END AS grp FROM suppliers")
register("a27_entity_regions", lambda s, f: t.entity_regions(_dimension(s, f)), "SELECT entity, grp AS region FROM suppliers")
register("a25_world_growth", lambda s, f: t.world_growth(inputs.panel(s, f).where("entity = 'G001'").select("period", F.col("growth").alias("value"))),
         "SELECT period, growth AS value FROM panel WHERE entity = 'G001' AND growth IS NOT NULL", "value")
register("a24_method_metadata", lambda s, f: t.method_metadata(metadata(s, f), "entity", ["methodology", "base_year"]),
         """SELECT entity, methodology, base_year FROM metadata
            QUALIFY row_number() OVER (PARTITION BY entity ORDER BY (methodology IS NULL)::INT + (base_year IS NULL)::INT, methodology NULLS FIRST, base_year NULLS FIRST) = 1""")
register("a28_report_inputs", lambda s, f: t.report_inputs(report(s, f), summary(s, f))[2],
         'SELECT min(period) AS start, max(period) FILTER (NOT is_forecast) AS boundary, max(period) AS "end" FROM report')


def _scan(s, f):
    """A1: the vintage base written as CSV and scanned back with two columns."""
    path = f"{shared_folder(s)}/scan-{uuid.uuid4().hex}"
    inputs.vintages(s, f).select(*[x.name for x in t.SCHEMAS["vintages"].fields]).write.option("header", "true").csv(path)
    return t.scan(s, path, "vintages", ["edition", "value"], "csv").groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


register("a1_scan_columns", _scan, "SELECT edition, count(*) AS n, sum(value) AS total FROM vintages GROUP BY 1", "total")


def _archived(s, f):
    """Two appends; the second must not rewrite what the first archived."""
    path = f"{shared_folder(s)}/archive-{uuid.uuid4().hex}"
    rows = edition_archive(s, f)
    ar.archive_once(rows.where("edition IN ('S44', 'F44', 'S45')"), path, "edition")
    ar.archive_once(rows.withColumn("value", F.when(F.col("edition") == "S45", -1.0).otherwise(F.col("value"))), path, "edition")
    return ar.read_archive(s, path, "entity string, indicator string, period int, value double, edition string", "NGDP", {"edition": ["F44", "S45", "F46"]})


register("a3_a18_archive_once", _archived, "SELECT entity, indicator, period, value, edition FROM edition_archive WHERE indicator = 'NGDP' AND edition IN ('F44', 'S45', 'F46')", "value", 9)


def _index(s, f):
    """The index that two appends left, the second with nothing new for the editions of the first."""
    path = f"{shared_folder(s)}/archive-{uuid.uuid4().hex}"
    rows = edition_archive(s, f)
    ar.archive_once(rows.where("edition IN ('S44', 'F44')"), path, "edition")
    ar.archive_once(rows, path, "edition")
    return ar.Folder(s, path).index(ar.ARCHIVE_INDEX).withColumnRenamed("partition", "edition")


def _metadata(s, f):
    """Method metadata archived edition by edition, like the data, and never rewritten."""
    path = f"{shared_folder(s)}/metadata-{uuid.uuid4().hex}"
    rows = t.method_metadata(metadata(s, f), "entity", ["methodology", "base_year"])
    ar.archive_once(rows.withColumn("edition", F.lit("F45")), path, "edition")
    ar.archive_once(rows.withColumn("methodology", F.lit("other")).withColumn("edition", F.explode(F.array(F.lit("F45"), F.lit("S46")))), path, "edition")
    return ar.read_archive(s, path, "entity string, methodology string, base_year string, edition string")


register("a18_metadata_archive", _metadata,
         """WITH m AS (SELECT entity, methodology, base_year FROM metadata
              QUALIFY row_number() OVER (PARTITION BY entity ORDER BY (methodology IS NULL)::INT + (base_year IS NULL)::INT, methodology NULLS FIRST, base_year NULLS FIRST) = 1)
            SELECT entity, methodology, base_year, 'F45' AS edition FROM m UNION ALL SELECT entity, 'other', base_year, 'S46' FROM m""")
register("a18_archive_index", _index,
         'SELECT edition, count(*) AS "values", count(DISTINCT entity) AS entities, count(DISTINCT indicator) AS indicators, min(period) AS first_period, max(period) AS last_period FROM edition_archive GROUP BY 1')
register("a7_latest_edition", lambda s, f: ar.latest_edition(edition_archive(s, f), "NGDP_R"),
         "SELECT entity, period, value FROM edition_archive WHERE indicator = 'NGDP_R' AND edition = 'F46'", "value")


def _complement(s, f):
    """Two updates of a written complement; the result is what is read back after the second."""
    path = f"{shared_folder(s)}/complement-{uuid.uuid4().hex}"
    rows = real_vintages(s, f).select(F.lit("growth").alias("indicator"), "entity", "period", "value", "edition")
    main = rows.where("substring(edition, 2) < '44'").select("indicator", "edition").distinct()
    first = main.where("edition <> 'S43'")  # the main source has S43 only by the second update
    ar.update_complement(rows.where("edition IN ('S43', 'S44', 'F44', 'S45')").withColumn("value", F.col("value") - 1000.0), first, path)
    ar.update_complement(rows.where("edition IN ('F43', 'F44', 'S45', 'F45')"), main, path)
    return ar.read_complement(s, path, "indicator string, entity string, period int, value double, edition string")


register("a19_c12_complement", _complement,
         """SELECT 'growth' AS indicator, edition, entity, period, value - 1000 AS value FROM real_vintages WHERE edition = 'S44'
            UNION ALL SELECT 'growth', edition, entity, period, value FROM real_vintages WHERE edition IN ('F44', 'S45', 'F45')""", "value")


def _named(s, f):
    """Flows of the archived editions, one quarter of orders each, and the current flow."""
    quarters = inputs.table(s, f, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).where("q IN (2, 4)").distinct()
    flows = quarters.select(F.concat(F.lit("WEO_"), F.col("y").cast("string"), F.when(F.col("q") == 2, "_APR").otherwise("_OCT"), F.lit("_VINTAGE")).alias("flow"))
    current = quarters.agg(F.lit("WEO").alias("flow"))
    # The current flow reaches five years past its edition, the one after the last archived.
    last = quarters.agg(F.max(F.struct("y", "q")).alias("l")).select(F.col("l.y") + F.when(F.col("l.q") == 4, 1).otherwise(0) + 5).scalar()
    return ar.edition_names(flows.unionByName(current), last)


register("a20_edition_names", _named,
         """SELECT DISTINCT 'WEO_' || year(o_orderdate) || CASE quarter(o_orderdate) WHEN 2 THEN '_APR' ELSE '_OCT' END || '_VINTAGE' AS flow,
              CASE quarter(o_orderdate) WHEN 2 THEN 'S' ELSE 'F' END || year(o_orderdate) AS edition FROM orders WHERE quarter(o_orderdate) IN (2, 4)
            UNION ALL SELECT 'WEO', CASE max(year(o_orderdate) * 10 + quarter(o_orderdate)) % 10 WHEN 4 THEN 'S' || (max(year(o_orderdate) * 10 + quarter(o_orderdate)) // 10 + 1)
              ELSE 'F' || (max(year(o_orderdate) * 10 + quarter(o_orderdate)) // 10) END FROM orders WHERE quarter(o_orderdate) IN (2, 4)""")
MEASURES = ("nominal", "volume", "ppp_volume", "growth", "population", "volume_per_capita")


def _written(s, f):
    path = f"{shared_folder(s)}/report-{uuid.uuid4().hex}"
    written = ar.write_report({"unified": report(s, f), "summary": ar.stamped(summary(s, f), 20, 40, 46)}, path, "20_40_46")
    back = s.read.parquet(written["summary"])
    return back.select("entity", "nominal_20", "nominal_40", "nominal_46", "cagr_nominal_20_40", "cagr_nominal_40_46", F.col("rank_40").alias("rank_end"))


register("a21_write_report", _written,
         """SELECT entity, nominal_start AS nominal_20, nominal_end AS nominal_40, nominal_fcst AS nominal_46, cagr_nominal_hist AS cagr_nominal_20_40, cagr_nominal_fcst AS cagr_nominal_40_46, rank_end FROM ranked""",
         "nominal_20 nominal_40 nominal_46 cagr_nominal_20_40 cagr_nominal_40_46", 5)
register("a22_provenance", lambda s, f: ar.provenance(inputs.observed_source(s, f), inputs.forecast_source(s, f), report(s, f), summary(s, f), MEASURES),
         "SELECT count(*) AS unified_rows, count(DISTINCT entity) AS unified_entities, count(DISTINCT entity) FILTER (is_aggregate) AS excluded_aggregates, min(period) AS first_period, max(period) AS last_period, " +
         ", ".join(f"count({m}) AS known_{m}" for m in MEASURES) + """, (SELECT count(*) FROM observed) AS observed_rows, (SELECT count(*) FROM forecast) AS forecast_rows,
         (SELECT count(*) FROM ranked) AS summary_entities, (SELECT count(rank_end) FROM ranked) AS ranked_entities FROM report""")
register("b2_recode", lambda s, f: inputs.suppliers(s, f).select("entity", expr.recode(F.when(F.col("nk") % 2 == 0, "KOS").when(F.col("nk") % 3 == 0, "WBG").otherwise(F.col("entity")), fixed.CODE_RECODES).alias("code")),
         "SELECT entity, CASE WHEN nk % 2 = 0 THEN 'XKX' WHEN nk % 3 = 0 THEN 'PSE' ELSE entity END AS code FROM suppliers")
register("b9_edition_order", lambda s, f: inputs.vintages(s, f).groupBy("edition").agg(F.max(expr.edition_order("edition_period", "season")).alias("place")),
         "SELECT edition, max(edition_period * 2 + (season = 'F')::INT) AS place FROM vintages GROUP BY 1")
