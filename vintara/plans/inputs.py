"""Tables of the engine derived from the given star schema.

Entity = supplier, period = quarter index (1990 Q1 = 0), observed source = gross revenue and
quantity by ship date, second source = discounted revenue. Amounts are summed as integer
cents, so every engine sees the same numbers. Codes starting with ``G`` are aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from vintara.session import materialize

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
START, CUT, END = 20, 40, 46  # the periods of the report that the queries publish: first, last observed, last projected
BEFORE_EDITIONS = 4  # periods that the first edition has behind it
DAMPING = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3)
_MEMO: dict[tuple, DataFrame] = {}
_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per session, not once per query."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def memo(build):
    """Materialise a derived table once per session and scale: several operators read it."""

    def cached(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf.rstrip("/"), build.__name__)
        if key not in _MEMO:
            _MEMO[key] = materialize(build(spark, sf), build.__name__)
        return _MEMO[key]

    cached.__name__ = build.__name__
    cached.build = build
    return cached


def period_of(ts: str):
    return ((F.year(ts) - 1990) * 4 + F.quarter(ts) - 1).cast("int")


@memo
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """One row from the facts: first period, last period, and the last whole one (the last, if its last day is there)."""
    dates = table(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    ends = F.to_date("last") == F.date_sub(F.add_months(F.trunc("last", "quarter"), 3), 1)
    return dates.select(period_of("first").alias("first_period"), period_of("last").alias("last_period"),
                        (period_of("last") - F.when(ends, 0).otherwise(1)).alias("last_whole"))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Entity dimension: code, name, group (region of the nation) and nation key."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    s = table(spark, sf, "supplier")
    return s.join(places, s.s_nationkey == places.n_nationkey, "left").select(
        F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("entity"),
        F.col("s_name").alias("name"), F.col("r_name").alias("grp"), F.col("s_nationkey").alias("nk"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by supplier and quarter: rows are combined before the only shuffle, on integer keys."""
    return (
        table(spark, sf, "lineitem")
        .select(
            "l_suppkey", period_of("l_shipdate").alias("period"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
            F.col("l_quantity").cast("bigint").alias("qty"),
        )
        .groupBy("l_suppkey", "period")
        .agg(
            F.sum("cents").alias("cents"),
            F.sum(F.col("cents") * (100 - F.col("disc"))).alias("net"),
            F.sum("qty").alias("qty"),
            F.count(F.lit(1)).alias("pop"),
        )
        .withColumn("entity", F.concat(F.lit("E"), F.col("l_suppkey").cast("string")))
        .drop("l_suppkey")
    )


@memo
def whole_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Entity panel with the world (G001) and region (G11x) aggregates; rows of a quarter that is still open are flagged and have no growth.

    Every cell is sent to the totals it belongs to and added up in one aggregation, combined
    before the shuffle: the facts are scanned once, and no total is summed by one task.
    """
    base = cells(spark, sf).join(suppliers(spark, sf), "entity", "left")
    text, region = F.lit(None).cast("string"), F.array_position(F.array(*[F.lit(r) for r in REGIONS]), F.col("grp"))

    def total(entity, name, grp, nk, aggregate):
        return F.struct(entity.alias("entity"), name.alias("name"), grp.alias("grp"), nk.alias("nk"), F.lit(aggregate).alias("is_aggregate"))

    totals = F.array(
        total(F.col("entity"), F.col("name"), F.col("grp"), F.col("nk"), False),
        total(F.lit("G001"), F.lit("World"), text, F.lit(0), True),
        F.when(F.col("grp").isNotNull(), total(F.concat(F.lit("G11"), region.cast("string")), F.col("grp"), text, F.lit(0), True)),
    )
    rows = base.select("period", "cents", "net", "qty", "pop", F.explode(totals).alias("t")).where("t IS NOT NULL")
    every = rows.select("t.*", "period", "cents", "net", "qty", "pop").groupBy(
        "entity", "name", "grp", "nk", "is_aggregate", "period").agg(*[F.sum(c).alias(c) for c in ("cents", "net", "qty", "pop")])
    w = Window.partitionBy("entity").orderBy("period")
    is_open = F.col("period") > calendar(spark, sf).select("last_whole").scalar()
    follows = ~F.col("is_open") & (F.lag("period").over(w) == F.col("period") - 1)

    def growth(c: str):
        return F.when(follows, (F.try_divide(F.col(c) * F.lit(1.0), F.lag(c).over(w)) - 1) * 100)

    return every.withColumn("is_open", is_open).select(
        "entity", "name", "grp", "nk", "is_aggregate", "period", "is_open",
        (F.col("cents") / F.lit(100000.0)).alias("nominal"),
        (F.col("net") / F.lit(10000000.0)).alias("other"),
        F.col("qty").cast("double").alias("volume"),
        (F.col("qty") * (F.lit(1.0) + F.col("nk") * F.lit(0.02))).alias("ppp_volume"),
        (F.col("cents") / F.lit(100000.0) * (F.lit(1.0) + F.col("nk") * F.lit(0.02))).alias("ppp"),
        F.col("pop").cast("double").alias("population"),
        growth("qty").alias("growth"), growth("net").alias("other_growth"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole periods of the panel."""
    return whole_panel(spark, sf).where("NOT is_open").drop("is_open")


def observed_source(spark: SparkSession, sf: str) -> DataFrame:
    """T3, observed side, in the raw units of its source."""
    return panel(spark, sf).select(
        "entity", "name", "period", "is_aggregate", F.col("grp"),
        (F.col("nominal") * 1e9).alias("nominal_raw"), (F.col("ppp") * 1e9).alias("ppp_raw"),
        (F.col("volume") * 1e9).alias("volume_raw"), (F.col("ppp_volume") * 1e9).alias("ppp_volume_raw"),
        (F.col("population") * 1e6).alias("population_raw"),
        F.try_divide(F.col("nominal"), F.col("population")).alias("per_capita"), F.col("growth"),
    ).where(F.col("period") <= CUT)


def forecast_source(spark: SparkSession, sf: str) -> DataFrame:
    """T3, forecast side: another name, another level, its own growth, rows after the cut flagged."""
    return panel(spark, sf).select(
        "entity", F.col("entity").alias("name"), "period", (F.col("period") > CUT).alias("is_forecast"),
        "is_aggregate", F.col("other").alias("nominal"),
        (F.col("other") * (F.lit(1.0) + F.col("nk") * F.lit(0.02))).alias("ppp"),
        F.try_divide(F.col("other"), F.col("population")).alias("per_capita"),
        (F.col("population") * F.lit(1.1)).alias("population"), F.col("other_growth").alias("growth"),
    )


@memo
def vintages(spark: SparkSession, sf: str) -> DataFrame:
    """T6. Each period, a spring edition (knows v-2) and an autumn edition (knows v-1).

    One lag window per entity, then one explode: no join.
    """
    w = Window.partitionBy("entity").orderBy("period")
    g = panel(spark, sf).select("entity", "name", "period", "growth")
    lags = [F.lag("growth", k).over(w) for k in (3, 2, 1)]
    dense = F.lag("period", 3).over(w) == F.col("period") - 3
    known = g.withColumn("mean4", F.when(dense, (lags[0] + lags[1] + lags[2] + F.col("growth")) / 4))

    def row(season: str, lag: int, horizon: int, value):
        return F.struct(F.lit(season).alias("season"), (F.col("period") + lag).alias("edition_period"),
                        F.lit(horizon).alias("horizon"), value.alias("value"))

    rows = [row(s, k, h, F.col("mean4") * F.lit(DAMPING[h])) for s, k in (("F", 1), ("S", 2)) for h in range(6)]
    rows += [row("F", 1, -1, F.col("growth")), row("S", 1, -1, F.col("growth") * F.lit(0.9)),
             row("F", 2, -2, F.col("growth")), row("S", 2, -2, F.col("growth"))]
    out = known.select("entity", "name", F.explode(F.array(*rows)).alias("r")).select(
        "entity", "name", "r.*").where("value IS NOT NULL")
    known_periods = calendar(spark, sf)
    first, last = known_periods.select(F.col("first_period") + BEFORE_EDITIONS).scalar(), known_periods.select("last_whole").scalar()
    return out.where(F.col("edition_period").between(first, last)).select(
        "entity", "name", (F.col("edition_period") + F.col("horizon")).alias("period"),
        F.concat("season", F.col("edition_period").cast("string")).alias("edition"),
        "season", "edition_period", "horizon", "value", (F.col("horizon") >= 0).alias("is_projection"))


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Long indicator rows of the observed source."""
    return panel(spark, sf).select("entity", "name", "period", "is_aggregate", F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value")) for c in ("nominal", "volume", "population")
    ])).alias("i")).select("entity", "name", "period", "is_aggregate", "i.indicator", "i.value")
