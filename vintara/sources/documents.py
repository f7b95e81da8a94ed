"""Statistical JSON documents to rows, with ``from_json`` and ``explode`` only.

Each function takes a table with one document (or page) per row in a text column and
returns long rows; many small documents spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vintara.functions import expr, fixed


def _number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def indicator_pages(pages: DataFrame, body: str, indicator: str, entities: DataFrame) -> DataFrame:
    """Pages ``[header, [record, ...]]`` to records; null values and codes are dropped, and
    an entity missing from the list of real entities is an aggregate."""
    record = "array<struct<countryiso3code:string,country:struct<value:string>,date:string,value:double>>"
    rows = pages.select(F.explode(F.from_json(F.get(F.from_json(body, "array<string>"), 1), record)).alias("r")).select(
        F.col("r.countryiso3code").alias("entity"), F.col("r.country.value").alias("name"),
        F.col("r.date").try_cast("int").alias("period"), F.lit(indicator).alias("indicator"), F.col("r.value").alias("value"))
    rows = rows.where("entity <> '' AND period IS NOT NULL AND value IS NOT NULL")
    real = entities.select("entity", F.lit(True).alias("_real")).distinct()
    return rows.join(real, "entity", "left").select(
        "entity", "name", "period", "indicator", "value", F.col("_real").isNull().alias("is_aggregate"))


def nested_values(documents: DataFrame, body: str, forecast_start: int, entities: DataFrame,
                  labels: DataFrame | None = None, recodes: Mapping[str, str] = fixed.CODE_RECODES) -> DataFrame:
    """``{"values": {indicator: {entity: {period: value}}}}`` to rows; what is not a number is skipped.

    ``entities`` (entity) lists the real ones; ``labels`` (entity, label) names entities and
    groups, before the document's own labels.
    """
    schema = "struct<values:map<string,map<string,map<string,string>>>,countries:map<string,struct<label:string>>>"
    parsed = documents.select(F.from_json(body, schema).alias("d"))
    rows = (
        parsed.select("d.countries", F.explode("d.values").alias("indicator", "_e"))
        .select("countries", "indicator", F.explode("_e").alias("code", "_p"))
        .select("countries", "indicator", "code", F.explode("_p").alias("_period", "_text"))
        .select("indicator", "code", F.col("_period").try_cast("int").alias("period"), _number(F.col("_text")).alias("value"),
                F.try_element_at("countries", F.col("code"))["label"].alias("_own"))
        .where("period IS NOT NULL AND value IS NOT NULL")
    )
    real = entities.select(F.col("entity").alias("code"), F.lit(True).alias("_real")).distinct()
    rows = rows.join(real, "code", "left")
    if labels is not None:
        rows = rows.join(labels.select(F.col("entity").alias("code"), "label"), "code", "left")
    else:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    return rows.select(
        expr.recode("code", recodes).alias("entity"), F.coalesce("label", "_own", "code").alias("name"), "period", "indicator", "value",
        (F.col("period") >= forecast_start).alias("is_forecast"), F.col("_real").isNull().alias("is_aggregate"))


_SERIES = (
    "struct<structure:struct<dimensions:struct<series:array<struct<values:array<struct<id:string,name:string>>>>,"
    "observation:array<struct<values:array<struct<id:string>>>>>>,"
    "dataSets:array<struct<series:map<string,struct<observations:map<string,array<string>>>>>>>"
)


def indexed_series(documents: DataFrame, body: str) -> DataFrame:
    """Series keyed ``i:j:k`` and observations keyed by position, both resolved to identifiers.

    Positions are not ordered and values are text: everything goes through the identifiers.
    """
    parsed = documents.select(F.from_json(body, _SERIES).alias("d"))
    dims = F.col("d.structure.dimensions")
    rows = parsed.select(
        dims["series"].alias("_s"), F.get(dims["observation"], 0)["values"].alias("_t"),
        F.explode(F.get(F.col("d.dataSets"), 0)["series"]).alias("_key", "_series"),
    ).select("_s", "_t", F.split("_key", ":").alias("_k"), F.explode("_series.observations").alias("_pos", "_obs"))
    at = lambda dim: F.get(F.get("_s", dim)["values"], F.get("_k", dim).cast("int"))
    return rows.select(
        at(0)["id"].alias("entity"), F.coalesce(at(0)["name"], at(0)["id"]).alias("name"), at(1)["id"].alias("indicator"),
        F.substring(F.get("_t", F.col("_pos").cast("int"))["id"], 1, 4).try_cast("int").alias("period"),
        _number(F.get("_obs", 0)).alias("value"),
    ).where("value IS NOT NULL AND period IS NOT NULL")


def cube(documents: DataFrame, body: str) -> DataFrame:
    """Cube with a linear cell index, last dimension fastest: (geo, period, value)."""
    schema = ("struct<id:array<string>,size:array<int>,dimension:map<string,struct<category:struct<index:map<string,int>>>>,"
              "value:map<string,double>>")
    parsed = documents.select(F.from_json(body, schema).alias("d"))

    def stride(name: str) -> Column:
        at = F.array_position("d.id", name).cast("int")
        return F.aggregate(F.slice("d.size", at + 1, F.size("d.size")), F.lit(1), lambda acc, x: acc * x)

    def size(name: str) -> Column:
        return F.get("d.size", F.array_position("d.id", name).cast("int") - 1)

    def codes(name: str) -> Column:
        entries = F.map_entries(F.try_element_at("d.dimension", F.lit(name))["category"]["index"])
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["value"], e["key"])))

    cells = parsed.select(
        *[f(n).alias(f"_{n}_{k}") for n in ("geo", "time") for k, f in (("stride", stride), ("size", size), ("codes", codes))],
        F.explode("d.value").alias("_index", "value"))

    def code(name: str) -> Column:
        place = F.pmod(F.floor(F.col("_index").cast("bigint") / F.col(f"_{name}_stride")), F.col(f"_{name}_size")).cast("int")
        return F.try_element_at(f"_{name}_codes", place)

    return cells.select(code("geo").alias("geo"), code("time").try_cast("int").alias("period"), "value").where("value IS NOT NULL")


def concept_records(pages: DataFrame, body: str) -> DataFrame:
    """Records whose fields are looked up by concept name; null values are dropped."""
    schema = "struct<source:struct<data:array<struct<variable:array<struct<concept:string,id:string>>,value:double>>>>"
    rows = pages.select(F.explode(F.from_json(body, schema)["source"]["data"]).alias("r")).where("r.value IS NOT NULL")
    fields = F.map_from_entries(F.transform("r.variable", lambda v: F.struct(v["concept"], v["id"])))
    return rows.select(
        F.try_element_at(fields, F.lit("Country")).alias("entity"),
        F.substring(F.try_element_at(fields, F.lit("Time")), 3, 10).try_cast("int").alias("period"), F.col("r.value").alias("value"))
