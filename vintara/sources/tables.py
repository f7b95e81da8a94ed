"""Landed tables of the engine: schemas, scans and small reshapings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from vintara.functions import expr, fixed


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (item.split(":") for item in spec.split())])


# One fixed schema per table; a missing value is NULL.
SCHEMAS: dict[str, T.StructType] = {
    "observed_long": _struct("entity:s name:s period:i indicator:s value:d is_aggregate:b"),
    "forecast_long": _struct("entity:s name:s period:i indicator:s value:d is_aggregate:b is_forecast:b"),
    "vintages": _struct("entity:s name:s period:i edition:s season:s edition_period:i horizon:i value:d is_projection:b"),
    "evaluation": _struct(
        "entity:s name:s grp:s period:i edition:s season:s edition_period:i horizon:i value:d realised_own:d realised_other:d "
        "weight:d naive:d error_own:d error_other:d error_naive:d"),
    "archive": _struct("version:i entity:s period:i value:d"),
    "edition_archive": _struct("edition:s entity:s indicator:s period:i value:d"),
    "group_history": _struct("entity:s fiscal:i grp:s"),
    "world": _struct("period:i value:d"),
    "long_run": _struct("zone:s scenario:s period:i value:d"),
}


def scan(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """A1: read a table with its fixed schema; only the wanted columns are read.

    CSV files are read by header; NaN becomes NULL on the way in.
    """
    schema = SCHEMAS[table]
    reader = spark.read.schema(schema)
    df = reader.option("header", "true").option("nanValue", "NaN").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    fixed_nan = {f.name: expr.finite(f.name) for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    df = df.withColumns(fixed_nan) if fixed_nan else df
    return df.select(*columns) if columns else df


def long_run_series(raw: DataFrame) -> DataFrame:
    """Long-run source to zone, scenario, period, value; incomplete rows are dropped."""
    return raw.select(
        F.col("REF_AREA").alias("zone"), F.col("SCENARIO").alias("scenario"), F.col("TIME_PERIOD").cast("int").alias("period"),
        F.col("OBS_VALUE").cast("double").alias("value")).na.drop()


VARIANTS = {"Medium": "central", "Lower 80 PI": "low", "Upper 80 PI": "high"}


def population_variants(raw: DataFrame, variants: Mapping[str, str] = VARIANTS) -> DataFrame:
    """Population by entity, period and variant, in millions."""
    return raw.where(F.col("Variant").isin(list(variants)) & F.col("ISO3_code").isNotNull()).select(
        F.col("ISO3_code").alias("entity"), F.col("Time").cast("int").alias("period"),
        expr.lookup(variants, "Variant").alias("variant"), (F.col("PopTotal") / 1000).alias("population"))


def population_revision(raw: DataFrame) -> DataFrame:
    """A10: central variant of a past revision."""
    return raw.where(F.col("Variant") == "Medium").select(
        "LocID", F.col("Time").cast("int").alias("period"), F.col("PopTotal").alias("population"))


def current_revision(raw: DataFrame) -> DataFrame:
    """Entities only, the three variants as columns by conditional aggregation."""
    rows = raw.where((F.col("LocTypeName") == "Country/Area") & F.col("ISO3_code").isNotNull() & F.col("Variant").isin(list(VARIANTS)))
    names = {"Medium": "median", "Lower 80 PI": "low", "Upper 80 PI": "high"}
    return rows.groupBy(F.col("ISO3_code").alias("entity"), "LocID", F.col("Time").cast("int").alias("period")).agg(
        *[F.avg(F.when(F.col("Variant") == v, F.col("PopTotal"))).alias(n) for v, n in names.items()])


def group_history(wide: DataFrame, code: str = "entity", groups: Mapping[str, str] = fixed.GROUP_CODES) -> DataFrame:
    """One column per fiscal year (FY89, FY04, ...) to rows; a star marks a provisional class."""
    years = [c for c in wide.columns if c.startswith("FY")]
    rows = wide.where(F.length(code) == 3).select(code, F.explode(F.array(*[
        F.struct(F.lit(int(c[2:])).alias("y"), F.col(c).cast("string").alias("v")) for c in years])).alias("e"))
    label = expr.lookup(groups, F.regexp_replace(F.trim("e.v"), r"\*+$", ""))
    return rows.select(
        F.col(code).alias("entity"), (F.when(F.col("e.y") >= 50, 1900).otherwise(2000) + F.col("e.y")).alias("fiscal"), label.alias("grp"),
    ).where("grp IS NOT NULL")


def entity_dimension(raw: DataFrame) -> DataFrame:
    """Real entities with their group; aggregates have region NA, unclassified ones group INX."""
    return raw.where(F.col("region").isNotNull() & (F.col("region") != "NA")).select("entity", F.coalesce("grp", F.lit("INX")).alias("grp"))


def entity_regions(raw: DataFrame) -> DataFrame:
    """Region of every real entity, for fallbacks."""
    return raw.where(F.col("region").isNotNull() & (F.col("region") != "NA")).select("entity", "region")


def world_growth(raw: DataFrame) -> DataFrame:
    """One world value per period."""
    return raw.where(F.col("value").isNotNull()).groupBy(F.col("period").cast("int").alias("period")).agg(F.max("value").alias("value"))


def method_metadata(raw: DataFrame, code: str, attributes: Sequence[str]) -> DataFrame:
    """One row of every entity, all text; a missing column is an error.

    Landed rows have no order, so the fullest row is taken, and of equally full ones the least.
    """
    missing = [c for c in (code, *attributes) if c not in raw.columns]
    if missing:
        raise ValueError(f"metadata columns missing: {', '.join(missing)}")
    missing_values = sum((F.col(c).isNull().cast("int") for c in attributes), F.lit(0))
    kept = F.min(F.struct(missing_values.alias("_missing"), *[F.col(c).cast("string").alias(c) for c in attributes])).alias("_m")
    return raw.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("entity")).agg(kept).select("entity", *[f"_m.{c}" for c in attributes])


def report_inputs(unified: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unified panel, summary, and the periods derived from the panel."""
    from vintara.operators.panel import structuring_periods

    return unified, summary, structuring_periods(unified)
