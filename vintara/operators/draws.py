"""Joint trajectories: the ranks of past editions reorder the bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.bands import classify, memberships, with_cells
from vintara.operators.evaluation import quantile_edges
from vintara.operators.quantiles import grouped_quantiles, quantiles_at, with_ranks
from vintara.session import materialize


def past_cells(levels: DataFrame, horizons: int, min_cell: int = fixed.MIN_CELL) -> tuple[DataFrame, DataFrame]:
    """Past cases with their retained cell and position u in it, and the cells' sizes of every horizon.

    Positions are average ranks attached bucket by bucket: a cell may hold any number of cases, and a value any share of it.
    """
    placed, cells = _placed_cases(levels, horizons, min_cell)
    return _with_positions(placed), cells


def _with_positions(placed: DataFrame) -> DataFrame:
    ranks = with_ranks(placed, ["horizon", "cell"], "level_error_own")
    return ranks.withColumn("u", (F.col("rank_avg") - 0.5) / F.col("n")).drop("rank_min", "rank_avg", "n")


def _placed_cases(levels: DataFrame, horizons: int, min_cell: int) -> tuple[DataFrame, DataFrame]:
    """Past cases with their retained cell, written, and the cells' sizes."""
    past = levels.where(
        F.col("horizon").between(0, horizons) & F.col("level_error_own").isNotNull() & F.col("projected_growth_pct").isNotNull())
    edges = quantile_edges(past, ["horizon"], "projected_growth_pct")
    classed = materialize(classify(past, edges, ["horizon"]), "draw_cases")
    sizes = classed.select("horizon", F.explode(memberships()).alias("cell")).groupBy("horizon", "cell").agg(F.count(F.lit(1)).alias("n0"))
    cells = materialize(sizes, "draw_cells")
    placed = materialize(with_cells(classed, cells, ["horizon"], min_cell).withColumn("cell", F.col("_cell")).drop("_cell", "_q0", "_class", "_group", "_all"), "draw_placed")
    return placed, cells


def eligible_editions(levels: DataFrame, horizon: int, minimum: int = fixed.MIN_ENTITIES_PER_DRAW) -> DataFrame:
    """Editions whose last error is known for enough entities."""
    return levels.where((F.col("horizon") == horizon) & F.col("level_error_own").isNotNull()).groupBy("edition").agg(
        F.count_distinct("entity").alias("entities")).where(F.col("entities") >= minimum)


def positions(placed: DataFrame, editions: DataFrame, entities: DataFrame, horizons: int) -> DataFrame:
    """Position of every entity in every replayed edition and horizon, with its fallbacks:
    median of the group in the edition, median of the edition, one half."""
    listed = editions.agg(F.sort_array(F.collect_list("edition"))).scalar()
    grid = entities.withColumn("_e", listed).select("entity", "grp", F.explode("_e").alias("edition")).withColumn(
        "horizon", F.explode(F.sequence(F.lit(0), F.lit(horizons))))
    known = placed.groupBy("horizon", "edition", "entity").agg(F.avg("u").alias("u"))
    rows = materialize(grid.join(known, ["horizon", "edition", "entity"], "left"), "positions")
    by_group = materialize(grouped_quantiles(rows, ["horizon", "edition", "grp"], {"u": "u"}, {"_ug": ("u", 0.5)}), "group_positions")
    by_edition = grouped_quantiles(rows, ["horizon", "edition"], {"u": "u"}, {"_ue": ("u", 0.5)}, bounded_groups=True)
    return rows.join(by_group, ["horizon", "edition", "grp"], "left").join(
        F.broadcast(by_edition), ["horizon", "edition"], "left").select(
        "horizon", "edition", "entity", "grp", F.coalesce("u", "_ug", "_ue", F.lit(0.5)).alias("u"))


def quantile_levels(rows: DataFrame, keys: Sequence[str], draw: str) -> DataFrame:
    """Level (k - 1/2) / n of every draw by its rank in the entity's own history; ties in name order."""
    w = Window.partitionBy(*keys).orderBy(F.round("u", 12), draw)
    return rows.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).withColumn(
        "level_q", (F.col("k") - 0.5) / F.col("n"))


def ratios_to_horizon(levels: DataFrame, bands: DataFrame, editions: DataFrame, horizons: int, min_cell: int = fixed.MIN_CELL) -> DataFrame:
    """Realised over projected by draw: quantile of the entity's present cell at the draw's level.

    The levels are asked for as a table, once for each cell, and answered by rank selection in one plan, whatever their number.
    """
    placed, cells = _placed_cases(levels.select("entity", "grp", "edition", "horizon", "projected_growth_pct", "level_error_own"), horizons, min_cell)
    entities = bands.groupBy("entity").agg(F.min("grp").alias("grp"))
    levels_q = materialize(quantile_levels(positions(_with_positions(placed), editions, entities, horizons), ["horizon", "entity"], "edition"), "draw_levels")
    now = bands.select("entity", "grp", "horizon", "cls")
    now = with_cells(now, cells, ["horizon"], min_cell).select("entity", "horizon", F.col("_cell").alias("cell"))
    drawn = materialize(levels_q.join(now, ["horizon", "entity"], "left").withColumn("cell", F.coalesce("cell", F.lit("all"))), "draw_asked")
    asked = drawn.select("horizon", "cell", "k", "n").distinct().withColumn("p", (F.col("k") - 0.5) / F.col("n"))
    cases = placed.select("horizon", "cls", "grp", "level_error_own")
    table = materialize(quantiles_at(cases, ["horizon", "cell"], "level_error_own", asked, cases.select("level_error_own"), ("cell", memberships(), ["cls", "grp"])).drop("p"), "draw_quantiles")
    return drawn.join(table, ["horizon", "cell", "k", "n"]).select(
        F.col("edition").alias("draw"), "entity", "horizon", F.try_divide(F.lit(1.0), 1 + F.col("q") / 100).alias("ratio"))


def draw_trajectories(ratios: DataFrame, scenarios: DataFrame, edition_period: int, horizons: int, end: int) -> DataFrame:
    """Level per draw, entity and period; past the horizon a draw keeps its place in the log band.

    The later periods of an entity are one short array, so the join stays one row per draw.
    """
    wide = scenarios.where(F.col("scenario").isin("central", "low", "high") & (F.col("period") >= edition_period) & (F.col("period") <= end)).groupBy(
        "entity", "period").agg(*[F.max(F.when(F.col("scenario") == s, F.col("level"))).alias(s) for s in ("central", "low", "high")])
    low, high = F.ln(F.try_divide("low", "central")), F.ln(F.try_divide("high", "central"))
    placed = wide.select("entity", "period", "central", ((low + high) / 2).alias("m"), ((high - low) / 2).alias("w"))
    last = edition_period + horizons
    band = F.struct("period", "central", "m", "w")
    per_entity = placed.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("period", band))).alias("_b"))
    rows = ratios.withColumn("period", F.col("horizon") + edition_period).join(per_entity, "entity")
    near = rows.select("draw", "entity", "period", (F.col("ratio") * F.try_element_at("_b", F.col("period"))["central"]).alias("level"))
    at_end = F.try_element_at("_b", F.lit(last))
    far = rows.where(F.col("period") == last).withColumn(
        "_z", (F.ln("ratio") - at_end["m"]) / F.when(at_end["w"] > 1e-9, at_end["w"])).select(
        "draw", "entity", "ratio", "_z", "_b", F.explode(F.sequence(F.lit(last + 1), F.lit(end))).alias("period")).withColumn(
        "_x", F.try_element_at("_b", F.col("period"))).select(
        "draw", "entity", "period",
        (F.coalesce(F.exp(F.col("_x.m") + F.col("_z") * F.col("_x.w")), F.col("ratio")) * F.col("_x.central")).alias("level"))
    return near.unionByName(far).where("level IS NOT NULL")


def population_levels(past: DataFrame, entities: DataFrame) -> DataFrame:
    """Level of every past revision in an entity's history, from ranks pooled over the size class."""
    u = with_ranks(past, ["size"], "z", bounded_groups=True).withColumn("u", (F.col("rank_avg") - 0.5) / F.col("n"))
    known = u.groupBy("entity", "revision").agg(F.avg("u").alias("u"))
    listed = past.agg(F.sort_array(F.collect_set("revision"))).scalar()
    grid = materialize(entities.withColumn("_r", listed).select("entity", F.explode("_r").alias("revision")).join(known, ["entity", "revision"], "left"), "population_positions")
    medians = grouped_quantiles(grid, ["revision"], {"u": "u"}, {"_um": ("u", 0.5)}, bounded_groups=True)
    filled = grid.join(F.broadcast(medians), "revision", "left").select(
        "entity", "revision", F.coalesce("u", "_um", F.lit(0.5)).alias("u"))
    return quantile_levels(filled, ["entity"], "revision")


def assign_revisions(editions: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revisions handed to the draws in consecutive blocks of their chronological order."""
    order = Window.orderBy(expr.edition_order(F.substring("edition", 2, 10).cast("int"), F.substring("edition", 1, 1)))
    listed = revisions.agg(F.sort_array(F.collect_set("revision"))).scalar()
    n = editions.agg(F.count(F.lit(1))).scalar()
    ranked = editions.select("edition", (F.row_number().over(order) - 1).alias("_i")).withColumns({"_r": listed, "_n": n})
    block = F.floor(F.col("_i") * F.size("_r") / F.col("_n")).cast("int")
    return ranked.select(F.col("edition").alias("draw"), F.get("_r", block).alias("revision"))


def population_draws(levels: DataFrame, assignment: DataFrame, scenarios: DataFrame, periods: tuple[int, int]) -> DataFrame:
    """Population of every draw at z = inverse normal of its level, in half-widths of its side."""
    placed = levels.select("entity", "revision", (expr.inverse_normal("level_q") / fixed.Z90).alias("z")).join(F.broadcast(assignment), "revision")
    central = scenarios.where((F.col("scenario") == "central") & F.col("period").between(*periods)).select(
        "entity", "period", "pop_central", F.ln(F.col("pop_low_calibrated") / F.col("pop_central")).alias("_l"),
        F.ln(F.col("pop_high_calibrated") / F.col("pop_central")).alias("_h"))
    shift = F.when(F.col("z") >= 0, F.col("z") * F.col("_h")).otherwise(-F.col("z") * F.col("_l"))
    return placed.join(central, "entity").select(
        "draw", "entity", "period", (F.col("pop_central") * F.exp(shift)).alias("population"), "revision").where("population IS NOT NULL")


def per_capita_draws(trajectories: DataFrame, populations: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Level per head with the drawn population; the total of a draw does not move."""
    central = scenarios.where("scenario = 'central'").select("entity", "period", "pop_central")
    rows = trajectories.join(populations, ["draw", "entity", "period"]).join(central, ["entity", "period"])
    total = F.col("level") * F.col("pop_central") / 1000
    return rows.select("draw", "entity", "period", "population", "revision", total.alias("total"),
                       (1000 * total / F.col("population")).alias("level"))


def outside_shares(draws: DataFrame, scenarios: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Share of the draws outside the bands by entity and period, level and population."""
    at = scenarios.where(F.col("period").isin(list(periods))).groupBy("entity", "period").agg(
        F.max(F.when(F.col("scenario") == "low", F.col("level"))).alias("_lo"), F.max(F.when(F.col("scenario") == "high", F.col("level"))).alias("_hi"),
        F.max(F.when(F.col("scenario") == "central", F.col("pop_low_calibrated"))).alias("_pl"),
        F.max(F.when(F.col("scenario") == "central", F.col("pop_high_calibrated"))).alias("_ph"))
    rows = draws.where(F.col("period").isin(list(periods))).join(at, ["entity", "period"])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy("entity", "period").agg(
        share(F.col("level") < F.col("_lo")).alias("below"), share(F.col("level") > F.col("_hi")).alias("above"),
        share(F.col("population") < F.col("_pl") * (1 - 1e-9)).alias("population_below"),
        share(F.col("population") > F.col("_ph") * (1 + 1e-9)).alias("population_above"))


def quantile_interval(
    rows: DataFrame, keys: Sequence[str], value: str, block: str, targets: Mapping[str, float],
    draws: int = fixed.QUANTILE_BOOTSTRAP_DRAWS, seed: str = "vintara-q",
) -> DataFrame:
    """95 % interval of quantiles by resampling edition periods.

    ``rows`` holds one value per draw (as many as editions): a resample counts how often
    each block is drawn, and the percentile takes those counts as frequencies.
    """
    keys = list(keys)
    blocks = rows.select(block).distinct().select(
        block, (F.row_number().over(Window.orderBy(block)) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_b"))
    blocks = materialize(blocks, "edition_blocks")
    slots = blocks.select("_b").distinct().withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    digest = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("_d").cast("string"), F.col("_s").cast("string"))), 1, 8)
    picks = slots.select("_d", F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.col("_b")).alias("_i")).groupBy("_d", "_i").agg(
        F.count(F.lit(1)).alias("_times")).join(blocks.select(block, "_i"), "_i")
    drawn = rows.join(F.broadcast(picks), block)
    values = drawn.groupBy(*keys, "_d").agg(*[F.percentile(value, F.lit(q), F.col("_times")).alias(n) for n, q in targets.items()])
    return values.groupBy(*keys).agg(*[
        F.percentile(n, F.lit(q)).alias(f"{n}_{side}") for n in targets for side, q in (("ci_low", 0.025), ("ci_high", 0.975))])


def aggregate_control(
    draws: DataFrame, scenarios: DataFrame, membership: DataFrame, periods: Sequence[int], bootstrap: int = fixed.QUANTILE_BOOTSTRAP_DRAWS
) -> DataFrame:
    """Totals of overlapping aggregates per draw, in % of their central path, against the sum of the bounds.

    Totals are partial sums by (aggregate, draw, period): the aggregate holding every
    entity is combined before the shuffle.
    """
    keys = ["aggregate", "period"]
    totals = draws.where(F.col("period").isin(list(periods))).join(membership, "entity").groupBy(*keys, "draw").agg(F.sum("total").alias("_t"))
    bounds = scenarios.where(F.col("period").isin(list(periods)) & F.col("scenario").isin("central", "low", "high")).join(membership, "entity").groupBy(*keys).agg(
        F.count_distinct("entity").alias("entities"),
        *[F.sum(F.when(F.col("scenario") == s, F.col("total"))).alias(f"_{s}") for s in ("central", "low", "high")])
    relative = totals.join(bounds, keys).withColumn("relative", F.try_divide(100 * F.col("_t"), F.col("_central"))).withColumn(
        "edition_period", F.substring("draw", 2, 10).cast("int"))
    relative = materialize(relative, "relative_totals")
    point = relative.groupBy(*keys).agg(
        F.max("entities").alias("entities"), F.count(F.lit(1)).alias("draws"), F.percentile("relative", F.lit(0.1)).alias("p10"),
        F.percentile("relative", F.lit(0.5)).alias("p50"), F.percentile("relative", F.lit(0.9)).alias("p90"),
        F.try_divide(100 * F.max("_low"), F.max("_central")).alias("sum_of_lows"), F.try_divide(100 * F.max("_high"), F.max("_central")).alias("sum_of_highs"))
    return point.join(quantile_interval(relative, keys, "relative", "edition_period", {"p10": 0.1, "p90": 0.9}, bootstrap), keys)


def scenario_slice(scenarios: DataFrame, scenario: str, periods: Sequence[int], value: Column | None = None) -> DataFrame:
    """One scenario as entity x period columns, without a pivot pre-scan."""
    value = F.col("level") if value is None else value
    return scenarios.where(F.col("scenario") == scenario).groupBy("entity").agg(
        *[F.max(F.when(F.col("period") == p, value)).alias(f"p{p}") for p in periods])
