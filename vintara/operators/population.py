"""Errors of past population projections and calibrated bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.longrun import fit_power_law
from vintara.operators.quantiles import summarise, with_ranks

THIRDS = ("narrow", "middle", "wide")


def projection_errors(revisions: DataFrame, current: DataFrame, current_revision: int, threshold: float = fixed.SIZE_THRESHOLD) -> DataFrame:
    """Projected over estimated - 1 for the targets after each revision; size class of its own base.

    The base of a revision is read off the same rows by a window, not by a second scan.
    """
    estimated = current.where((F.col("period") < current_revision) & (F.col("median") > 0)).select("entity", "period", "median")
    own = Window.partitionBy("revision", "entity")
    rows = revisions.withColumn("_base", F.max(F.when(F.col("period") == F.col("revision"), F.col("population"))).over(own))
    return rows.where((F.col("period") > F.col("revision")) & (F.col("population") > 0)).join(estimated, ["entity", "period"]).select(
        "revision", "entity", "period", (F.col("period") - F.col("revision")).alias("horizon"),
        expr.size_class(F.coalesce("_base", F.lit(0.0)), threshold).alias("size"),
        (100 * (F.col("population") / F.col("median") - 1)).alias("error_pct"))


def with_group(errors: DataFrame, groups: DataFrame, history: DataFrame) -> DataFrame:
    """Group of the revision's own period, the current one by default."""
    known = history.groupBy("entity", F.col("fiscal").alias("revision")).agg(F.min("grp").alias("_then"))
    return errors.join(groups, "entity", "left").join(known, ["entity", "revision"], "left").withColumn(
        "grp", F.coalesce("_then", "grp")).drop("_then")


def width_third(rows: DataFrame, keys: Sequence[str], width: str) -> DataFrame:
    """Third of a width by average rank, so ties share one; horizons may hold every entity."""
    keys = list(keys)
    third = F.least(F.lit(2), F.floor(3 * (F.col("rank_avg") - 0.5) / F.col("n"))).cast("int")
    labels = F.array(*[F.lit(t) for t in THIRDS])
    return with_ranks(rows, keys, width, bounded_groups=True).withColumn("third", F.get(labels, third)).drop("rank_min", "rank_avg", "n")


def current_bounds(current: DataFrame, revision: int) -> DataFrame:
    """Current 80 % bounds in % of the median, with the third of their log width per horizon."""
    rows = current.where((F.col("period") >= revision) & (F.col("low") > 0) & (F.col("median") > 0) & F.col("high").isNotNull()).select(
        "entity", (F.col("period") - revision).alias("horizon"), (100 * (F.col("low") / F.col("median") - 1)).alias("low_pct"),
        (100 * (F.col("high") / F.col("median") - 1)).alias("high_pct"))
    rows = rows.withColumn("width", F.round(F.log1p(F.col("high_pct") / 100) - F.log1p(F.col("low_pct") / 100), 12))
    return width_third(rows, ["horizon"], "width").drop("width")


def standardised_deviations(errors: DataFrame, bounds: DataFrame) -> DataFrame:
    """Log outcome over projection in half-widths of its side; degenerate bounds are left out."""
    low, high = F.log1p(F.col("low_pct") / 100), F.log1p(F.col("high_pct") / 100)
    rho = -F.log1p(F.col("error_pct") / 100)
    return errors.where("horizon >= 1").join(bounds, ["entity", "horizon"]).where((low < 0) & (high > 0)).withColumn(
        "z", F.when(rho >= 0, rho / high).otherwise(rho / -low)).withColumn("inside", (F.col("z") >= -1) & (F.col("z") <= 1))


def deviation_summary(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Errors by horizon for all, by group and by size class."""
    member = F.filter(F.array(F.lit(fixed.ALL_GROUPS), F.when(F.col("grp").isin(list(groups)), F.col("grp")), F.col("size")), lambda g: g.isNotNull())
    return summarise(
        rows.withColumn("member", F.explode(member)), ["member", "horizon"],
        [F.count(F.lit(1)).alias("cases"), F.count_distinct("revision").alias("revisions"), F.avg(F.col("inside").cast("double")).alias("share_inside")],
        {"e": "error_pct", "a": F.abs("error_pct"), "l": "low_pct", "h": "high_pct"},
        {"p10": ("e", 0.1), "p50": ("e", 0.5), "p90": ("e", 0.9), "median_abs": ("a", 0.5), "median_low": ("l", 0.5), "median_high": ("h", 0.5)},
    ).withColumns({"outcome_low_pct": expr.inverted_bound("p90"), "outcome_high_pct": expr.inverted_bound("p10")})


def multipliers(rows: DataFrame, min_revisions: int = fixed.MIN_REVISIONS, h_max: int = fixed.EXTRAPOLATION_HORIZON) -> DataFrame:
    """Multipliers of the bounds by size, third and horizon, smoothed, at least 1; coverage before and after."""
    keys = ["size", "third"]
    observed = summarise(
        rows, [*keys, "horizon"],
        [F.count(F.lit(1)).alias("cases"), F.count_distinct("revision").alias("revisions"), F.avg(F.col("inside").cast("double")).alias("share_inside")],
        {"z": "z"}, {"_z10": ("z", 0.1), "k_high_observed": ("z", 0.9)},
    ).withColumn("k_low_observed", -F.col("_z10")).drop("_z10")
    usable = observed.where(F.col("revisions") >= min_revisions)
    points = usable.select(*keys, "horizon", F.explode(F.array(
        F.struct(F.lit("low").alias("side"), F.col("k_low_observed").alias("k")), F.struct(F.lit("high").alias("side"), F.col("k_high_observed").alias("k"))
    )).alias("_p")).select(*keys, "horizon", "_p.*")
    laws = fit_power_law(points, [*keys, "side"], "horizon", "k", fixed.MULTIPLIER_EXPONENTS)
    law = F.struct("intercept", "slope", "exponent")
    wide = laws.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, law)).alias(f"_{s}") for s in ("low", "high")])
    value = lambda s: F.greatest(F.lit(1.0), F.col(f"_{s}.intercept") + F.col(f"_{s}.slope") * F.pow(F.col("horizon") + 1.0, F.col(f"_{s}.exponent")))
    last = usable.groupBy(*keys).agg(F.max("horizon").alias("last_fitted"))
    smooth = wide.join(last, keys).select("*", F.explode(F.sequence(F.lit(1), F.lit(h_max))).alias("horizon")).select(
        *keys, "horizon", "last_fitted", value("low").alias("k_low"), value("high").alias("k_high"))
    calibrated = rows.join(F.broadcast(smooth.select(*keys, "horizon", "k_low", "k_high")), [*keys, "horizon"]).groupBy(*keys, "horizon").agg(
        F.avg(((F.col("z") >= -F.col("k_low")) & (F.col("z") <= F.col("k_high"))).cast("double")).alias("share_inside_calibrated"))
    return smooth.join(observed, [*keys, "horizon"], "left").join(calibrated, [*keys, "horizon"], "left")


def calibrated_bounds(current: DataFrame, calibration: DataFrame, revision: int, threshold: float = fixed.SIZE_THRESHOLD) -> DataFrame:
    """Bounds of every entity and period as ratios to the median, published and calibrated."""
    own = Window.partitionBy("entity")
    rows = current.withColumn("_base", F.max(F.when(F.col("period") == revision, F.col("median"))).over(own))
    rows = rows.where(F.col("period") > revision).dropna(subset=["median", "low", "high"]).select(
        "entity", "period", "median", "low", "high", (F.col("period") - revision).alias("horizon"),
        expr.size_class(F.coalesce("_base", F.lit(0.0)), threshold).alias("size"))
    thirds = current_bounds(current, revision).select("entity", "horizon", "third")
    k = calibration.select("size", "third", "horizon", "k_low", "k_high")
    joined = rows.join(thirds, ["entity", "horizon"]).join(F.broadcast(k), ["size", "third", "horizon"])
    low, high = F.try_divide("low", "median"), F.try_divide("high", "median")
    return joined.select(
        "entity", "period", "size", "third", low.alias("low_ratio"), high.alias("high_ratio"),
        expr.calibrated_ratio(low, "k_low").alias("low_calibrated"), expr.calibrated_ratio(high, "k_high").alias("high_calibrated"))


