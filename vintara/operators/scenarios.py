"""Scenarios per entity and period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.longrun import widen

# The bounds come in three widths (the entity's own, its group's, widened), each with a low and a high side; three paths have no side.
SIDES, WIDTHS, PATHS = ("low", "high"), ("", "_group", "_wide"), ("central", "corrected", "world_crisis")
SIDE = {f"{side}{width}": side for width in WIDTHS for side in SIDES}
SCENARIOS = (*PATHS, *SIDE)
POPULATIONS = ("pop_central", "pop_low", "pop_high", "pop_low_calibrated", "pop_high_calibrated")


def scenario_factors(bands: DataFrame) -> DataFrame:
    """Factor on the projected path by scenario, from the bands at every horizon."""
    q = lambda c: F.try_divide(F.lit(1.0), 1 + c / 100)
    own = {side: 1 + F.col(f"{side}_pct") / 100 for side in SIDES}
    paths = {"central": F.lit(1.0), "corrected": q(F.col("error_median")), "world_crisis": q(F.coalesce("error_median_crisis", "error_median"))}
    bounds = {s: F.coalesce(1 + F.col(f"{side}_pct_group") / 100, own[side]) if s.endswith("_group") else own[side] for s, side in SIDE.items()}
    return bands.select("entity", "period", *[c.alias(s) for s, c in (paths | bounds).items()])


def long_factors(bands: DataFrame) -> DataFrame:
    """B17 in long form: one row per entity, period and scenario."""
    return scenario_factors(bands).select("entity", "period", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.col(s).alias("factor")) for s in SCENARIOS])).alias("f")).select("entity", "period", "f.*")


def growth_zones(entities: DataFrame, series: DataFrame, regions: Mapping[str, str], world: str = fixed.WORLD_ZONE) -> DataFrame:
    """Zone whose growth an entity follows: its own, else its region's, else the world's."""
    zones = series.select(F.col("zone").alias("_z")).distinct()
    own = zones.select(F.col("_z").alias("_own"))
    regional = zones.where(F.col("_z").isin(list(regions.values()))).select(F.col("_z").alias("_reg"))
    rows = entities.withColumn("_region_zone", expr.lookup(regions, "region"))
    return rows.join(own, F.col("entity") == F.col("_own"), "left").join(
        F.broadcast(regional), F.col("_region_zone") == F.col("_reg"), "left").select(
        *entities.columns, F.coalesce("_own", "_reg", F.lit(world)).alias("zone"),
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_reg").isNotNull(), "region").otherwise("world").alias("zone_level"))


def long_run_growth(series: DataFrame, start: int, end: int, central: str = fixed.CENTRAL_LONG_RUN) -> DataFrame:
    """Cumulative growth of every zone from ``start``: central scenario, least and most
    favourable by the whole period. A missing year ends a path."""
    w = Window.partitionBy("zone", "scenario").orderBy("period")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratios = series.where(F.col("period").between(start, end)).select(
        "zone", "scenario", "period",
        F.when(F.lag("period").over(w) == F.col("period") - 1, F.try_divide(F.col("value"), F.lag("value").over(w))).alias("ratio"),
    ).where(F.col("period") > start)
    paths = ratios.withColumns({
        "path": F.when((F.count("ratio").over(run) == F.col("period") - start), F.product("ratio").over(run)),
        "_total": F.product("ratio").over(Window.partitionBy("zone", "scenario")),
    })
    whole = Window.partitionBy("zone")
    picked = paths.withColumns({
        "scenario_low": F.min(F.struct("_total", "scenario")).over(whole)["scenario"],
        "scenario_high": F.max(F.struct(F.col("_total"), F.col("scenario"))).over(whole)["scenario"],
    })
    return picked.groupBy("zone", "period", "scenario_low", "scenario_high").agg(
        F.max(F.when(F.col("scenario") == central, F.col("path"))).alias("g_central"),
        F.max(F.when(F.col("scenario") == F.col("scenario_low"), F.col("path"))).alias("g_low"),
        F.max(F.when(F.col("scenario") == F.col("scenario_high"), F.col("path"))).alias("g_high"))


def population_paths(variants: DataFrame, last_observed: int, horizon: int) -> DataFrame:
    """Growth of the central variant since the forecast horizon and ratios of the others to it."""
    wide = variants.groupBy("entity", "period").agg(*[
        F.avg(F.when(F.col("variant") == v, F.col("population"))).alias(v) for v in ("central", "low", "high")])
    w = Window.partitionBy("entity")
    run = w.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.when(F.col("period") > horizon, F.col("central"))
    seen = F.col("period") <= last_observed
    ratio = lambda c: F.when(seen, 1.0).otherwise(F.coalesce(F.try_divide(F.col(c), F.col("central")), F.lit(1.0)))
    return wide.select(
        "entity", "period",
        F.when(F.count(after).over(run) == F.col("period") - horizon, F.try_divide(
            F.col("central"), F.max(F.when(F.col("period") == horizon, F.col("central"))).over(w))).alias("un_growth"),
        ratio("low").alias("un_low"), ratio("high").alias("un_high"))


def build_scenarios(
    panel: DataFrame, bands: DataFrame, series: DataFrame, variants: DataFrame, regions: Mapping[str, str],
    last_observed: int, horizon: int, end: int, model_horizon: int,
    long_bands: DataFrame | None = None, population_bounds: DataFrame | None = None,
    widened_group: str = "HIC", min_editions: int = fixed.MIN_EDITION_PERIODS,
) -> tuple[DataFrame, DataFrame]:
    """Nine scenarios per entity and period, and a fact sheet per entity.

    Every level is a product of keyed factors (projected path, band at its horizon, long-run
    growth, widening), so the whole table is joins on (entity, period), (zone, period) and
    (group, horizon); nothing is iterated.
    """
    own = Window.partitionBy("entity")
    at_end = lambda c: F.max(F.when(F.col("period") == horizon, F.col(c))).over(own)
    base = panel.where(~F.col("is_aggregate")).select(
        "entity", "name", "grp", "period", "per_capita", F.col("volume_per_capita").alias("hab"), "population",
        at_end("volume_per_capita").alias("hab_end"), at_end("population").alias("pop_end"),
    ).where("hab_end IS NOT NULL AND pop_end IS NOT NULL")
    null = F.lit(None).cast("double")
    future = base.where(F.col("period") == horizon).withColumns({"per_capita": null, "population": null}).withColumn(
        "period", F.explode(F.sequence(F.lit(horizon + 1), F.lit(end))))
    rows = base.unionByName(future).withColumn("_at", F.least("period", F.lit(horizon)))
    factors = scenario_factors(bands).withColumnRenamed("period", "_at")
    rows = rows.join(factors, ["entity", "_at"], "left")
    zoned = growth_zones(rows.select("entity", F.col("grp").alias("region")).distinct(), series, regions)
    rows = rows.join(zoned.select("entity", "zone", "zone_level"), "entity")
    rows = rows.join(long_run_growth(series, horizon, end), ["zone", "period"], "left")
    paths = population_paths(variants, last_observed, horizon)
    rows = rows.join(paths, ["entity", "period"], "left").join(
        variants.select("entity", F.lit(True).alias("_un")).distinct(), "entity", "left")

    later = F.col("period") > horizon
    central_pop = F.when(later, F.col("pop_end") * F.col("un_growth")).otherwise(F.col("population"))
    rows = rows.withColumn("pop_central", central_pop).withColumns({
        f"pop_{s}": F.col("pop_central") * F.coalesce(f"un_{s}", F.lit(1.0)) for s in ("low", "high")})
    if population_bounds is not None:
        bounds = population_bounds.select("entity", "period", F.col("low_calibrated").alias("_bl"), F.col("high_calibrated").alias("_bh"))
        has = population_bounds.select("entity", F.lit(True).alias("_cal")).distinct()
        rows = rows.join(bounds, ["entity", "period"], "left").join(has, "entity", "left")
        ratio = lambda c: F.when(F.col("period") <= last_observed, 1.0).otherwise(F.coalesce(c, F.lit(1.0)))
        rows = rows.withColumns({
            f"pop_{s}_calibrated": F.when(F.col("_cal"), F.col("pop_central") * ratio(F.col(c))).otherwise(F.col(f"pop_{s}"))
            for s, c in (("low", "_bl"), ("high", "_bh"))})
    else:
        rows = rows.withColumns({"pop_low_calibrated": F.col("pop_low"), "pop_high_calibrated": F.col("pop_high"), "_cal": F.lit(None).cast("boolean")})

    if long_bands is not None:
        steps = F.lit(model_horizon) + F.col("period") - horizon
        table = long_bands.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct(
            "horizon", F.struct("p10_smooth", "p90_smooth")))).alias("_law"), F.max("horizon").alias("_last"),
            F.max(F.when(F.col("edition_periods") >= min_editions, F.col("horizon"))).alias("_fitted"))
        everyone = table.where(F.col("member") == fixed.ALL_GROUPS).select("_law").scalar()
        last = table.where(F.col("member") == fixed.ALL_GROUPS).select("_last").scalar()
        rows = rows.join(F.broadcast(table.withColumnRenamed("member", "grp")), "grp", "left").withColumns({
            "_known": F.col("_law").isNotNull(), "_law": F.coalesce("_law", everyone), "_last": F.coalesce("_last", last)})
        at = lambda h, q: 1 + F.try_element_at("_law", h)[q] / 100
        far = F.least(steps, F.col("_last"))
        rows = rows.withColumns({
            "_wlow": at(F.lit(model_horizon), "p90_smooth") / at(far, "p90_smooth"),
            "_whigh": at(F.lit(model_horizon), "p10_smooth") / at(far, "p10_smooth")})
        growth = {s: F.col("g_central") * (F.col(f"_w{SIDE[s]}") if s in SIDE else F.lit(1.0)) for s in SCENARIOS}
    else:
        rows = rows.withColumns({"_known": F.lit(False), "_fitted": F.lit(None).cast("int")})
        growth = {s: F.col({"low": "g_low", "high": "g_high"}.get(SIDE.get(s), "g_central")) for s in SCENARIOS}

    def level(s: str) -> Column:
        factor = F.coalesce(F.col(s), F.lit(1.0))
        now = F.col("hab") * F.when(F.col("period") > last_observed, factor).otherwise(1.0)
        return F.when(later, F.col("hab_end") * factor * growth[s]).otherwise(now)

    wide = rows.withColumns({f"l_{s}": level(s) for s in SCENARIOS})
    widened = F.col("grp") == widened_group if long_bands is not None else F.lit(False)
    if long_bands is not None:
        logs = wide.where(later & widened).select(
            "entity", "period", "_fitted", (F.lit(model_horizon) + F.col("period") - horizon).alias("horizon"), F.col("l_central").alias("_c"),
            F.ln(F.col("l_low") / F.col("l_central")).alias("log_low"), F.ln(F.col("l_high") / F.col("l_central")).alias("log_high"))
        logs = widen(logs, ["entity"], F.coalesce("_fitted", F.lit(10**6))).select(
            "entity", "period", (F.col("_c") * F.exp("log_low")).alias("_xl"), (F.col("_c") * F.exp("log_high")).alias("_xh"))
        wide = wide.join(logs, ["entity", "period"], "left").withColumns({
            "l_low_wide": F.coalesce("_xl", "l_low_wide"), "l_high_wide": F.coalesce("_xh", "l_high_wide")})

    phase = F.when(F.col("period") <= last_observed, "observed").when(~later, "forecast").otherwise("long run")
    long = wide.select(
        "entity", "name", "grp", "period", phase.alias("phase"), *POPULATIONS, "per_capita",
        F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"l_{s}").alias("level")) for s in SCENARIOS])).alias("s"))
    table = long.select(
        "entity", "name", "grp", "period", "phase", "s.scenario", "s.level", *POPULATIONS,
        F.when((F.col("s.scenario") == "central") & ~later, F.col("per_capita")).alias("current_per_capita"),
        (F.col("s.level") * F.col("pop_central") / 1000).alias("total"))
    if long_bands is not None:
        source = F.concat(F.lit("past errors ("), F.when(F.col("_known"), F.col("grp")).otherwise(fixed.ALL_GROUPS), F.lit(")"))
    else:
        source = F.concat(F.lit("long-run scenarios "), F.col("scenario_low"), F.lit(" and "), F.col("scenario_high"))
    sheet = wide.where(F.col("period") == horizon + 1).select(
        "entity", "name", "zone", "zone_level", source.alias("bounds_source"), F.coalesce(widened, F.lit(False)).alias("widened"),
        F.coalesce("_un", F.lit(False)).alias("population_known"), F.coalesce("_cal", F.lit(False)).alias("population_calibrated"))
    return table, sheet


def fact_sheet(sheet: DataFrame, bands: DataFrame, horizon: int) -> DataFrame:
    """S3: fact sheet with the band of the last horizon."""
    columns = ["low_pct", "high_pct", "error_median", "error_median_crisis", "downturn_pct", "downturn_crisis_pct", "downturn_calm_pct", "crisis_pct", "depth_median"]
    return sheet.join(bands.where(F.col("horizon") == horizon).select("entity", *columns), "entity", "left")


def key_figures(scenarios: DataFrame, entity: str, periods: Sequence[int]) -> DataFrame:
    """Key figures: band of an entity in % of its central path, and its populations; missing inputs leave a figure out."""
    rows = scenarios.where((F.col("entity") == entity) & F.col("period").isin(list(periods)))
    wide = rows.groupBy("entity", "period").agg(
        *[F.max(F.when(F.col("scenario") == s, F.col("level"))).alias(s) for s in ("central", "low", "high", "low_wide", "high_wide")],
        *[F.max(F.when(F.col("scenario") == "central", F.col(p))).alias(p) for p in POPULATIONS])
    figures = {f"{s}_pct": 100 * F.try_divide(F.col(s), F.col("central")) for s in ("low", "high", "low_wide", "high_wide")} | {
        "central": F.col("central"), **{p: F.col(p) for p in POPULATIONS}}
    return _figures(wide, [F.col("entity"), F.col("period").cast("string")], figures)


def _figures(rows: DataFrame, name: Sequence[Column], figures: Mapping[str, Column]) -> DataFrame:
    """One row per figure that has a value: its name, the given parts and its own, and its value."""
    return rows.select(F.explode(F.array(*[
        F.struct(F.concat_ws(" ", *name, F.lit(n)).alias("figure"), v.cast("double").alias("value")) for n, v in figures.items()
    ])).alias("f")).select("f.*").where("value IS NOT NULL")


def aggregate_figures(control: DataFrame, aggregates: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Key figures of aggregates: bounds of the joint draws in % of the central path, with their interval, and the sums of the bounds."""
    rows = control.where(F.col("aggregate").isin(list(aggregates)) & F.col("period").isin(list(periods)))
    return _figures(rows, [F.col("aggregate"), F.col("period").cast("string")], {
        c: F.col(c) for c in ("p10", "p10_ci_low", "p10_ci_high", "p90", "sum_of_lows", "sum_of_highs")})


def score_figures(scores: DataFrame) -> DataFrame:
    """Key figures of the real-time test: coverage with its interval and the scores of the method retained."""
    names = {"coverage": "coverage_pct", "coverage_low": "coverage_pct_ci_low", "coverage_high": "coverage_pct_ci_high", "score": "score", "weighted_score": "weighted_score"}
    return _figures(scores.where("retained"), [F.lit("real time")], {n: F.col(c) for n, c in names.items()})


def population_figures(summary: DataFrame, horizons: Sequence[int], member: str = fixed.ALL_GROUPS) -> DataFrame:
    """Key figures of population: share of past projections inside their bounds, in %, by horizon."""
    rows = summary.where((F.col("member") == member) & F.col("horizon").isin(list(horizons)))
    return _figures(rows, [F.lit("population"), F.col("horizon").cast("string")], {"share_inside": 100 * F.col("share_inside")})


def changed_figures(published: DataFrame, current: DataFrame) -> DataFrame:
    """Published against current key figures: those of both that differ; a figure of one side has nothing to differ from."""
    both = published.select("figure", F.col("value").alias("published")).join(
        current.select("figure", F.col("value").alias("current")), "figure")
    return both.where(~F.col("published").eqNullSafe(F.col("current")))
