"""Vintage base and evaluation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vintara.functions import expr, fixed
from vintara.session import spread

VINTAGE_COLUMNS = ["entity", "name", "period", "edition", "season", "edition_period", "horizon", "value", "is_projection"]


def derive_edition_columns(long: DataFrame) -> DataFrame:
    """Season, edition period, horizon and projection flag from the edition name."""
    return (
        long.withColumn("season", F.substring("edition", 1, 1))
        .withColumn("edition_period", F.expr("try_cast(substring(edition, 2) AS int)"))
        .where(F.col("edition_period").isNotNull())
        .withColumn("horizon", F.col("period") - F.col("edition_period"))
        .withColumn("is_projection", F.col("horizon") >= 0)
    )


def wide_to_long(
    wide: DataFrame,
    indicator: str = "",
    complement: DataFrame | None = None,
    identifiers: Sequence[str] = ("name", "entity", "period"),
) -> DataFrame:
    """A2: one text column per edition becomes one row per value; ``.`` and blanks are missing.

    Editions of ``complement`` (name, entity, period, edition, value) are added only when
    the wide sheet does not have them; the sheet's name of an entity wins over its own.
    """
    editions = [c for c in wide.columns if c not in identifiers]
    long = wide.select(
        *identifiers,
        F.explode(F.array(*[
            F.struct(F.lit(c.replace(indicator, "")).alias("edition"), F.col(c).cast("string").alias("text"))
            for c in editions
        ])).alias("e"),
    ).select(*identifiers, "e.edition", F.expr("try_cast(e.text AS double)").alias("value"))
    if complement is not None:
        known = [c.replace(indicator, "") for c in editions]
        names = wide.groupBy("entity").agg(F.min_by("name", "period").alias("sheet_name"))
        extra = (
            complement.where(~F.col("edition").isin(known))
            .join(names, "entity", "left")
            .select(F.coalesce("sheet_name", "name").alias("name"), "entity", "period", "edition",
                    F.col("value").cast("double").alias("value"))
        )
        long = long.unionByName(extra)
    return (
        derive_edition_columns(long.where(F.col("value").isNotNull() & ~F.isnan("value")))
        .withColumn("entity", expr.recode("entity"))
        .select(*VINTAGE_COLUMNS)
    )


def drop_aggregates(df: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """Keep the entities the panel knows as non-aggregates, else reject aggregate codes."""
    if panel is None:
        return df.where(~expr.aggregate_code("entity"))
    real = panel.where(~F.col("is_aggregate")).select("entity").distinct()
    return df.join(real, "entity", "left_semi")


def own_reference(vintages: DataFrame) -> DataFrame:
    """value re-estimated one period later, by the autumn edition when there is any."""
    later = vintages.where(F.col("horizon") == -1)
    autumn = later.where(F.col("season") == "F").limit(1)
    return (
        later.where((F.col("season") == "F") | ~autumn.exists())
        .groupBy("entity", "period")
        .agg(F.min_by("value", "edition_period").alias("realised_own"))
    )


def panel_references(panel: DataFrame) -> DataFrame:
    """F2 and F3 in one pass: observed growth, and the level of the target period as weight."""
    return panel.where(~F.col("is_forecast")).select(
        "entity", "period", F.col("growth").alias("realised_other"), F.col("nominal").alias("weight")
    )


def current_groups(panel: DataFrame) -> DataFrame:
    """group of every entity, from its first period that has one."""
    return panel.where(F.col("grp").isNotNull()).groupBy("entity").agg(F.min_by("grp", "period").alias("grp"))


def naive_forecast(
    reference: DataFrame,
    window: int = fixed.NAIVE_WINDOW,
    lag: int = fixed.NAIVE_LAG,
    minimum: int = fixed.NAIVE_MIN,
) -> DataFrame:
    """G1: mean of the last known re-estimates, the same for every horizon of an edition.

    Each value is sent to the windows it belongs to, so gaps need no dense grid and no sort.
    """
    last = reference.agg(F.max("period")).scalar()
    return (
        reference.where("realised_own IS NOT NULL")
        .select("entity", "realised_own", F.explode(F.sequence(F.col("period"), F.col("period") + window - 1)).alias("t"))
        .where(F.col("t") <= last)
        .groupBy("entity", (F.col("t") + lag).alias("edition_period"))
        .agg(F.avg("realised_own").alias("naive"), F.count("realised_own").alias("_n"))
        .where(F.col("_n") >= minimum)
        .drop("_n")
    )


def by_key(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """One row per entity: a map from ``key`` to ``value``, which the calendar bounds. A NULL key leads to nothing."""
    return rows.where(F.col(key).isNotNull()).groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(key), value))).alias(name))


def evaluate(vintages: DataFrame, panel: DataFrame) -> DataFrame:
    """Projections next to both references, weight, group and naive forecast.

    What an entity is compared to is gathered in maps, so that the projections meet all of it by entity, in one shuffle.
    Several panel rows of a period stay several.
    """
    own = own_reference(vintages)
    references = panel_references(panel).groupBy("entity", "period").agg(F.collect_list(F.struct("realised_other", "weight")).alias("_all"))
    projections = vintages.where("is_projection")
    return (
        spread(projections, "entity", projections.count())
        .join(by_key(own, "period", F.col("realised_own"), "_own"), "entity", "left")
        .withColumn("realised_own", F.try_element_at("_own", F.col("period"))).drop("_own")
        .join(by_key(naive_forecast(own), "edition_period", F.col("naive"), "_naive"), "entity", "left")
        .withColumn("naive", F.try_element_at("_naive", F.col("edition_period"))).drop("_naive")
        .join(current_groups(panel), "entity", "left")
        .join(by_key(references, "period", F.col("_all"), "_references"), "entity", "left")
        .withColumn("_r", F.explode_outer(F.try_element_at("_references", F.col("period"))))
        .withColumns({c: F.col(f"_r.{c}") for c in ("realised_other", "weight")})
        .withColumn("error_own", F.col("value") - F.col("realised_own"))
        .withColumn("error_other", F.col("value") - F.col("realised_other"))
        .withColumn("error_naive", F.col("naive") - F.col("realised_own"))
        .select("entity", "name", "grp", "period", "edition", "season", "edition_period", "horizon", "value",
                "realised_own", "realised_other", "weight", "naive", "error_own", "error_other", "error_naive")
    )


def evaluate_world(vintages: DataFrame, code: str = "G001") -> DataFrame:
    """the world aggregate against its own re-estimate only."""
    world = vintages.where(F.col("entity") == code)
    return (
        world.where("is_projection")
        .join(own_reference(world), ["entity", "period"], "left")
        .withColumn("error_own", F.col("value") - F.col("realised_own"))
        .withColumn("error_other", F.lit(None).cast("double"))
    )


def current_cumulative_projection(vintages: DataFrame, edition_period: int, horizons: int) -> DataFrame:
    """F16, for every horizon at once: growth the latest edition of a period projects up to h.

    The edition is the autumn one when it exists. A missing horizon ends the path.
    """
    editions = vintages.where((F.col("edition_period") == edition_period) & F.col("horizon").between(0, horizons))
    autumn = vintages.where((F.col("edition_period") == edition_period) & (F.col("season") == "F")).limit(1)
    rows = editions.where((F.col("season") == "F") == autumn.exists())
    return (
        rows.groupBy("entity")
        .agg(F.map_from_entries(F.collect_list(F.struct("horizon", "value"))).alias("path"))
        .select("entity", "path", F.explode(F.sequence(F.lit(0), F.lit(horizons))).alias("horizon"))
        .where(F.forall(F.sequence(F.lit(0), F.col("horizon")), lambda h: F.try_element_at("path", h).isNotNull()))
        .select(
            "entity", "horizon",
            ((F.aggregate(
                F.sequence(F.lit(0), F.col("horizon")), F.lit(1.0),
                lambda acc, h: acc * (1 + F.try_element_at("path", h) / 100),
            ) - 1) * 100).alias("projected_growth_pct"),
        )
    )
