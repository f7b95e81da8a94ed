"""Errors and bands beyond the forecast horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.quantiles import summarise

EXTENSIONS = ("forecast_then_drift", "forecast_extended", "drift")


def realised_growth(ev: DataFrame) -> DataFrame:
    """L1: re-estimated growth, one row per entity and period."""
    return ev.where("realised_own IS NOT NULL").groupBy("entity", "period").agg(F.min("realised_own").alias("growth"))


def drifts(realised: DataFrame, window: int = fixed.DRIFT_WINDOW, share: float = fixed.DRIFT_SHARE) -> DataFrame:
    """L2: mean growth (of logarithms) of the periods v-window-1 .. v-2, with enough of them.

    Each value is sent to the editions whose window it belongs to: a partial aggregate, no
    dense grid.
    """
    return (
        realised.select("entity", F.log1p(F.col("growth") / 100).alias("_g"),
                        F.explode(F.sequence(F.col("period") + 2, F.col("period") + window + 1)).alias("edition_period"))
        .groupBy("entity", "edition_period")
        .agg(F.avg("_g").alias("_m"), F.count("_g").alias("_n"))
        .where(F.col("_n") >= share * window)
        .select("entity", "edition_period", (100 * F.expm1("_m")).alias("drift_pct"))
    )


def _median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def extended_errors(ev: DataFrame, last_model: int = 5, h_max: int = fixed.LONG_HORIZON, first_edition: int = 1999,
                    window: int = fixed.DRIFT_WINDOW, share: float = fixed.DRIFT_SHARE) -> DataFrame:
    """Level error of three extensions of every complete trajectory, until the first
    period without an outcome.

    A trajectory and an entity's outcomes are two short arrays; the join is by entity and
    edition period, and one window per trajectory chains the three errors together.
    """
    real = realised_growth(ev)
    paths = (
        ev.where((F.col("edition_period") >= first_edition) & F.col("horizon").between(0, last_model) & F.col("value").isNotNull())
        .groupBy("entity", "edition", "edition_period")
        .agg(F.sort_array(F.collect_list(F.struct("horizon", "value"))).alias("_path"), F.max("grp").alias("grp"))
        .where(F.size("_path") == last_model + 1)
    )
    history = real.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("period", "growth"))).alias("_real"))
    rows = paths.join(drifts(real, window, share), ["entity", "edition_period"]).join(history, "entity")
    steps = rows.select(
        "entity", "grp", "edition", "edition_period", "drift_pct", "_path", F.explode(F.sequence(F.lit(0), F.lit(h_max))).alias("horizon"), "_real",
    ).withColumn("_r", F.try_element_at("_real", F.col("edition_period") + F.col("horizon")))
    at = lambda h: F.get("_path", h)["value"]
    late = _median3(at(F.lit(last_model - 2)), at(F.lit(last_model - 1)), at(F.lit(last_model)))
    inside = F.col("horizon") <= last_model
    steps = steps.select(
        "entity", "grp", "edition", "edition_period", "horizon", "drift_pct", "_r",
        F.when(inside, at(F.col("horizon"))).otherwise(F.col("drift_pct")).alias("_f0"),
        F.when(inside, at(F.col("horizon"))).otherwise(late).alias("_f1"), F.col("drift_pct").alias("_f2"))
    run = Window.partitionBy("entity", "edition").orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = lambda c: F.log1p(F.col(c) / 100) - F.log1p(F.col("_r") / 100)
    chained = steps.withColumns({
        "_stop": F.max(F.col("_r").isNull()).over(run),
        **{f"error_{n}": 100 * F.expm1(F.sum(gap(f"_f{i}")).over(run)) for i, n in enumerate(EXTENSIONS)},
    })
    return chained.where(~F.col("_stop")).select(
        "entity", "grp", "edition", "edition_period", "horizon", "drift_pct", *[f"error_{n}" for n in EXTENSIONS])


def cases_for_bands(errors: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Only trajectories whose drift reaches the minimum enter the bands.

    A level that comes back to its start has a drift of zero up to the rounding of the
    logarithms, whose sum depends on the order of rows: the comparison ignores that noise.
    """
    return errors.where(F.round("drift_pct", 9) >= minimum)


def extension_summary(errors: DataFrame) -> DataFrame:
    """Robust size of the errors by horizon, and how often the forecast beats the drift."""
    measures, targets = {}, {}
    for n in EXTENSIONS:
        measures |= {n: f"error_{n}", f"abs_{n}": F.abs(f"error_{n}")}
        targets |= {f"p10_{n}": (n, 0.1), f"p50_{n}": (n, 0.5), f"p90_{n}": (n, 0.9),
                    f"median_abs_{n}": (f"abs_{n}", 0.5), f"p80_abs_{n}": (f"abs_{n}", 0.8)}
    closer = [F.avg((F.abs(f"error_{n}") < F.abs("error_drift")).cast("double")).alias(f"closer_{n}") for n in EXTENSIONS[:2]]
    return summarise(
        errors, ["horizon"], [F.count(F.lit(1)).alias("cases"), F.count_distinct("edition_period").alias("edition_periods"), *closer],
        measures, targets)


def quantiles_by_group(errors: DataFrame, groups: Sequence[str], extension: str = EXTENSIONS[0]) -> DataFrame:
    """Quantiles by group and horizon, and over all groups."""
    member = F.filter(F.array(F.lit(fixed.ALL_GROUPS), F.when(F.col("grp").isin(list(groups)), F.col("grp"))), lambda g: g.isNotNull())
    rows = errors.withColumn("member", F.explode(member))
    return summarise(
        rows, ["member", "horizon"], [F.count(F.lit(1)).alias("cases"), F.count_distinct("edition_period").alias("edition_periods")],
        {"e": f"error_{extension}"}, {"p10": ("e", 0.1), "p50": ("e", 0.5), "p90": ("e", 0.9)})


def exponent_grid(bounds: tuple[float, float, float]) -> Column:
    """The exponents tried by a fit, smallest first."""
    low, high, step = bounds
    n = round((high - low) / step)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.lit(low) + i * step, 2))


def fit_power_law(points: DataFrame, keys: Sequence[str], horizon: str, y: str, grid: tuple[float, float, float]) -> DataFrame:
    """y = a + b (h+1)^c, the exponent from a grid, the rest by least squares.

    All groups and exponents are fitted by one grouped regression; the smallest sum of
    squares wins, the smallest exponent among equals.
    """
    keys = list(keys)
    rows = points.select(*keys, F.col(horizon).alias("_h"), F.col(y).alias("_y"), F.explode(exponent_grid(grid)).alias("exponent")).withColumn(
        "_x", F.pow(F.col("_h") + 1.0, F.col("exponent")))
    fits = rows.groupBy(*keys, "exponent").agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_sxy("_y", "_x").alias("_sxy"), F.regr_syy("_y", "_x").alias("_syy"))
    sse = F.round(F.col("_syy") - F.coalesce(F.try_divide(F.pow(F.col("_sxy"), 2), F.col("_sxx")), F.lit(0.0)), 12)
    return fits.groupBy(*keys).agg(F.min_by(F.struct("intercept", "slope", "exponent"), F.struct(sse, "exponent")).alias("_f")).select(*keys, "_f.*")


def smooth_bands(quantiles: DataFrame, min_editions: int = fixed.MIN_EDITION_PERIODS, h_max: int = fixed.EXTRAPOLATION_HORIZON) -> DataFrame:
    """Smoothed 10th and 90th percentiles to ``h_max``, next to the observed ones.

    Fitted on horizons from 1 with enough edition periods; a group needs three of them.
    """
    usable = quantiles.where((F.col("horizon") >= 1) & (F.col("edition_periods") >= min_editions)).withColumn(
        "_points", F.count(F.lit(1)).over(Window.partitionBy("member"))).where("_points >= 3")
    points = usable.select("member", "horizon", F.explode(F.array(
        F.struct(F.lit("p10").alias("q"), F.log1p(F.col("p10") / 100).alias("y")),
        F.struct(F.lit("p90").alias("q"), F.log1p(F.col("p90") / 100).alias("y")))).alias("_p")).select("member", "horizon", "_p.*")
    laws = fit_power_law(points, ["member", "q"], "horizon", "y", fixed.BAND_EXPONENTS)
    last = usable.groupBy("member").agg(F.max("horizon").alias("last_fitted"))
    law = F.struct("intercept", "slope", "exponent")
    wide = laws.groupBy("member").agg(*[F.max(F.when(F.col("q") == q, law)).alias(f"_{q}") for q in ("p10", "p90")])
    value = lambda q: 100 * F.expm1(F.col(f"_{q}.intercept") + F.col(f"_{q}.slope") * F.pow(F.col("horizon") + 1.0, F.col(f"_{q}.exponent")))
    smooth = wide.join(last, "member").select("*", F.explode(F.sequence(F.lit(1), F.lit(h_max))).alias("horizon")).select(
        "member", "horizon", "last_fitted", value("p10").alias("p10_smooth"), value("p90").alias("p90_smooth"))
    return smooth.join(quantiles, ["member", "horizon"], "left")


def widening(bands: DataFrame, start: int) -> DataFrame:
    """Factors on the low and high bounds from horizon ``start`` to every later one, by group."""
    base = bands.where(F.col("horizon") == start).select("member", F.col("p10_smooth").alias("_a"), F.col("p90_smooth").alias("_b"))
    return bands.where(F.col("horizon") >= start).join(base, "member").select(
        "member", "horizon", ((1 + F.col("_b") / 100) / (1 + F.col("p90_smooth") / 100)).alias("low_factor"),
        ((1 + F.col("_a") / 100) / (1 + F.col("p10_smooth") / 100)).alias("high_factor"))


def fitted_horizon(bands: DataFrame, group: str, min_editions: int = fixed.MIN_EDITION_PERIODS) -> DataFrame:
    """Last horizon of a group with enough edition periods."""
    return bands.where((F.col("member") == group) & (F.col("edition_periods") >= min_editions)).agg(F.max("horizon").alias("fitted_horizon"))


def widen(bounds: DataFrame, keys: Sequence[str], fitted: Column, sd: float = fixed.ANNUAL_SD_FLOOR) -> DataFrame:
    """Log bounds with a frozen middle past the fitted horizon and a floored half-width."""
    run = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle, half = (F.col("log_low") + F.col("log_high")) / 2, (F.col("log_high") - F.col("log_low")) / 2
    last = F.max_by(middle, F.when(F.col("horizon") <= fitted, F.col("horizon"))).over(run)
    frozen = F.when(F.col("horizon") > fitted, F.coalesce(last, middle)).otherwise(middle)
    floor = F.greatest(half, F.lit(fixed.Z90 * sd) * F.col("horizon"))
    return bounds.withColumns({"_m": F.coalesce(frozen, middle), "_w": floor}).withColumns({
        "log_low": F.col("_m") - F.col("_w"), "log_high": F.col("_m") + F.col("_w")}).drop("_m", "_w")
