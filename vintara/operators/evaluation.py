"""Syntheses of the evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.quantiles import grouped_quantiles, not_null, summarise
from vintara.session import materialize


def stacked_errors(ev: DataFrame) -> DataFrame:
    """Both references as rows; a projection counts for the references it has."""
    return ev.select(
        "*",
        F.explode(F.array(
            F.struct(F.lit("own").alias("reference"), F.col("error_own").alias("error")),
            F.struct(F.lit("other").alias("reference"), F.col("error_other").alias("error")),
        )).alias("_r"),
    ).select("*", "_r.*").drop("_r").where("error IS NOT NULL")


def clustered_interval(rows: DataFrame, keys: Sequence[str], error: str, cluster: str) -> DataFrame:
    """mean and 95 % interval robust to the common shock of a period; NULL below two clusters.

    Errors are summed by cluster first; the windows below run on those sums only.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, cluster).agg(F.sum(error).alias("_s"), F.count(error).alias("_k"))
    whole = Window.partitionBy(*keys)
    centred = sums.withColumn("_mean", F.sum("_s").over(whole) / F.sum("_k").over(whole))
    spread = centred.groupBy(*keys).agg(
        F.max("_mean").alias("_mean"), F.sum("_k").alias("_n"), F.count(cluster).alias("clusters"),
        F.sum(F.pow(F.col("_s") - F.col("_k") * F.col("_mean"), 2)).alias("_ss"),
    )
    se = F.when(
        F.col("clusters") >= 2,
        F.sqrt(F.col("clusters") / (F.col("clusters") - 1.0) * F.col("_ss")) / F.col("_n"),
    )
    return spread.select(*keys, "clusters", (F.col("_mean") - 1.96 * se).alias("ci_low"), (F.col("_mean") + 1.96 * se).alias("ci_high"))


def bias_by_horizon(ev: DataFrame, shock_periods: Sequence[int]) -> DataFrame:
    """bias and dispersion by reference and horizon."""
    rows = stacked_errors(ev)
    keys = ["reference", "horizon"]
    table = summarise(
        rows, keys,
        [
            F.count("error").alias("n"), F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mae"),
            expr.weighted_mean("error", "weight").alias("weighted_error"),
            F.avg(F.when(~F.col("period").isin(list(shock_periods)), F.col("error"))).alias("mean_without_shocks"),
        ],
        {"e": "error", "a": F.abs("error")}, {"median_error": ("e", 0.5), "median_abs": ("a", 0.5)},
    )
    return table.join(clustered_interval(rows, keys, "error", "period"), keys)


def bias_by_season(ev: DataFrame) -> DataFrame:
    """F8: bias by horizon and season, spring before autumn."""
    rows = ev.where("error_own IS NOT NULL")
    return summarise(
        rows, ["horizon", "season"],
        [F.count("error_own").alias("n"), F.avg("error_own").alias("mean_error"),
         F.avg(F.abs("error_own")).alias("mae"), expr.weighted_mean("error_own", "weight").alias("weighted_error")],
        {"e": "error_own"}, {"median_error": ("e", 0.5)},
    ).orderBy("horizon", F.when(F.col("season") == "S", 0).otherwise(1))


def versus_naive(ev: DataFrame) -> DataFrame:
    """model against the naive forecast on the same projections."""
    a, b = F.abs("error_own"), F.abs("error_naive")
    rows = ev.where("error_own IS NOT NULL AND error_naive IS NOT NULL")
    return summarise(
        rows, ["horizon"],
        [F.count(F.lit(1)).alias("n"), F.avg(a).alias("mae_model"), F.avg(b).alias("mae_naive"),
         F.try_divide(F.avg(a), F.avg(b)).alias("mae_ratio"), expr.share_pct(a < b).alias("share_model_closer")],
        {"a": a, "b": b}, {"median_model": ("a", 0.5), "median_naive": ("b", 0.5)},
    )


def bias_by_group(ev: DataFrame, groups: Sequence[str]) -> DataFrame:
    """bias by horizon and listed group."""
    rows = ev.where(F.col("error_own").isNotNull() & F.col("grp").isin(list(groups)))
    return summarise(
        rows, ["horizon", "grp"], [F.count("error_own").alias("n"), F.avg("error_own").alias("mean_error")],
        {"e": "error_own", "a": F.abs("error_own")}, {"median_error": ("e", 0.5), "median_abs": ("a", 0.5)},
    )


def _log_growth(c: str) -> Column:
    return F.when(F.col(c) == -100, F.lit(float("-inf"))).otherwise(expr.log_ratio(c))


def level_errors(ev: DataFrame) -> DataFrame:
    """Error on the level reached by chaining growth, per entity, edition and horizon.

    A missing rate or a skipped horizon breaks the chain for all later horizons. One window
    per (entity, edition) serves every column.
    """
    w = Window.partitionBy("entity", "edition").orderBy("horizon")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = ev.where("horizon >= 0").select(
        "*", (F.row_number().over(w) - 1 != F.col("horizon")).alias("_skip"),
        _log_growth("value").alias("_p"),
        (_log_growth("value") - _log_growth("realised_own")).alias("_own"),
        (_log_growth("value") - _log_growth("realised_other")).alias("_other"),
    )

    def broken(c: str) -> Column:
        return F.max(F.coalesce(F.col(c).isNull() | F.col("_skip"), F.lit(True))).over(run)

    def chained(c: str) -> Column:
        return F.when(~broken(c), (F.exp(F.sum(c).over(run)) - 1) * 100)

    def worst(c: str, chain: str) -> Column:
        later = F.min(F.when(F.col("horizon") >= 1, F.col(c))).over(run)
        return F.when(~broken(chain) & (F.col("horizon") >= 1), later)

    return d.select(
        "entity", "name", "grp", "edition", "season", "edition_period", "period", "horizon", "weight",
        chained("_p").alias("projected_growth_pct"),
        worst("value", "_p").alias("worst_projected"), worst("realised_own", "_own").alias("worst_realised"),
        chained("_own").alias("level_error_own"), chained("_other").alias("level_error_other"),
    )


def level_summary(levels: DataFrame) -> DataFrame:
    """distribution of level errors by reference and horizon."""
    rows = levels.select("horizon", "weight", F.explode(F.array(
        F.struct(F.lit("own").alias("reference"), F.col("level_error_own").alias("e")),
        F.struct(F.lit("other").alias("reference"), F.col("level_error_other").alias("e")),
    )).alias("_r")).select("horizon", "weight", "_r.*").where("e IS NOT NULL")
    return summarise(
        rows, ["reference", "horizon"],
        [F.count("e").alias("n"), F.avg("e").alias("mean_error"), expr.weighted_mean("e", "weight").alias("weighted_error"),
         expr.share_pct(F.col("e") > 5).alias("share_above_5"), expr.share_pct(F.col("e") < -5).alias("share_below_5")],
        {"e": "e"},
        {"median_error": ("e", 0.5), "p10": ("e", 0.1), "p25": ("e", 0.25), "p75": ("e", 0.75), "p90": ("e", 0.9)},
    )


def level_summary_by_group(levels: DataFrame, groups: Sequence[str]) -> DataFrame:
    """the same by horizon and listed group, own reference."""
    rows = levels.where(F.col("level_error_own").isNotNull() & F.col("grp").isin(list(groups)))
    return summarise(
        rows, ["horizon", "grp"], [F.count("level_error_own").alias("n"), F.avg("level_error_own").alias("mean_error")],
        {"e": "level_error_own"}, {"median_error": ("e", 0.5), "p10": ("e", 0.1), "p90": ("e", 0.9)},
    )


def trimmed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows inside the 1-99 % range of every listed column, range taken group by group."""
    low, high = fixed.TRIM_QUANTILES
    targets = {f"_{c}_{side}": (c, q) for c in columns for side, q in (("lo", low), ("hi", high))}
    limits = grouped_quantiles(rows, keys, {c: c for c in columns}, targets, bounded_groups=True)
    kept = rows.join(F.broadcast(limits), list(keys))
    for c in columns:
        kept = kept.where(F.col(c).between(F.col(f"_{c}_lo"), F.col(f"_{c}_hi")))
    return kept.drop(*targets)


def efficiency(ev: DataFrame, minimum: int = 10) -> DataFrame:
    """realised = a + b * forecast by horizon on trimmed rows."""
    rows = ev.where("value IS NOT NULL AND realised_own IS NOT NULL")
    return trimmed(rows, ["horizon"], ["value", "realised_own"]).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("realised_own", "value").alias("slope"),
        F.regr_intercept("realised_own", "value").alias("intercept"),
    ).where(F.col("n") >= minimum)


def bias_by_forecast_quintile(ev: DataFrame, classes: int = 5) -> DataFrame:
    """median forecast and median bias by right-closed quantile bin of the forecast (untrimmed)."""
    rows = ev.where("value IS NOT NULL AND realised_own IS NOT NULL")
    targets = {f"q{i}": ("v", i / classes) for i in range(classes + 1)}
    edges = grouped_quantiles(rows, ["horizon"], {"v": "value"}, targets, bounded_groups=True).select(
        "horizon", F.array_distinct(F.array(*targets)).alias("_edges"))
    binned = rows.join(F.broadcast(edges), "horizon").withColumn(
        "quintile", expr.right_closed_bin("value", F.col("_edges")) + 1)
    return summarise(
        binned, ["horizon", "quintile"], [F.count(F.lit(1)).alias("n")],
        {"v": "value", "b": F.col("value") - F.col("realised_own")},
        {"median_forecast": ("v", 0.5), "median_bias": ("b", 0.5)},
    )


def quantile_edges(rows: DataFrame, keys: Sequence[str], value: str, classes: int = fixed.GROWTH_CLASSES) -> DataFrame:
    """inner class edges of every group as one array, written, as what is classed by them is read more than once."""
    targets = {f"_e{i}": ("v", i / classes) for i in range(1, classes)}
    return materialize(grouped_quantiles(rows, keys, {"v": value}, targets, bounded_groups=True).select(
        *keys, F.array(*targets).alias("edges")), "edges")


def level_summary_by_growth(levels: DataFrame, cut: int) -> DataFrame:
    """level error and downturn share by horizon and projected-growth class, before and after a cut."""
    rows = levels.where("level_error_own IS NOT NULL AND projected_growth_pct IS NOT NULL")
    edges = quantile_edges(rows, ["horizon"], "projected_growth_pct")
    classed = rows.join(F.broadcast(edges), "horizon").withColumn("cls", expr.digitize("projected_growth_pct", F.col("edges")))
    down = F.col("worst_realised") < 0
    early = F.col("edition_period") <= cut
    return summarise(
        classed, ["horizon", "cls"],
        [F.count(F.lit(1)).alias("n"), expr.share_pct(down).alias("downturn_pct"),
         expr.share_pct(F.when(early, down)).alias("downturn_before_pct"),
         expr.share_pct(F.when(~early, down)).alias("downturn_after_pct")],
        {"g": "projected_growth_pct", "e": "level_error_own"},
        {"median_growth": ("g", 0.5), "median_error": ("e", 0.5), "p10": ("e", 0.1), "p90": ("e", 0.9)},
    )


def downturns_by_horizon(ev: DataFrame) -> DataFrame:
    """downturns announced and occurred, and how often one went with the other."""
    rows = ev.where("value IS NOT NULL AND realised_own IS NOT NULL")
    said, came = F.col("value") < 0, F.col("realised_own") < 0
    return rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), expr.share_pct(said).alias("announced_pct"), expr.share_pct(came).alias("occurred_pct"),
        F.count_if(came).alias("occurred"),
        (F.try_divide(F.count_if(said & came), F.count_if(came)) * 100).alias("occurred_announced_pct"),
        (F.try_divide(F.count_if(said & came), F.count_if(said)) * 100).alias("announced_occurred_pct"),
    )


def flag_large(rows: DataFrame, top: int = fixed.LARGE_ENTITIES) -> DataFrame:
    """the ``top`` weights of every horizon and edition.

    The ranked filter is cut in every task before the shuffle; only ``top`` rows per
    horizon and edition (both from the calendar) are joined back.
    """
    w = Window.partitionBy("horizon", "edition").orderBy(F.desc("weight"), "entity")
    leaders = rows.where("weight IS NOT NULL").select("horizon", "edition", "entity", "weight").withColumn(
        "_r", F.row_number().over(w)).where(F.col("_r") <= top).select(
        "horizon", "edition", "entity", F.lit(True).alias("_large"))
    return rows.join(F.broadcast(leaders), ["horizon", "edition", "entity"], "left").withColumn(
        "large", F.coalesce("_large", F.lit(False))).drop("_large")


def downturn_risk(levels: DataFrame, groups: Sequence[str], shock_periods: Sequence[int], cut: int) -> DataFrame:
    """at least one downturn over the h periods after an edition, by overlapping groups."""
    rows = flag_large(levels.where("horizon >= 1 AND worst_projected IS NOT NULL AND worst_realised IS NOT NULL"))
    shocked = F.lit(False)
    for p in shock_periods:
        shocked = shocked | ((F.col("edition_period") + 1 <= p) & (F.col("period") >= p))
    member = F.filter(
        F.array(F.lit("all"), F.when(F.col("large"), "large"), F.when(F.col("grp").isin(list(groups)), F.col("grp"))),
        lambda g: g.isNotNull(),
    )
    rows = rows.select("*", shocked.alias("shocked"), F.explode(member).alias("member"))
    down, early = F.col("worst_realised") < 0, F.col("edition_period") <= cut
    return summarise(
        rows, ["horizon", "member"],
        [F.count(F.lit(1)).alias("n"), expr.share_pct(F.col("worst_projected") < 0).alias("announced_pct"),
         expr.share_pct(down).alias("occurred_pct"),
         (expr.weighted_mean(down.cast("double"), "weight") * 100).alias("occurred_weighted_pct"),
         expr.share_pct(F.when(~F.col("shocked"), down)).alias("occurred_without_shocks_pct"),
         expr.share_pct(F.when(early, down)).alias("occurred_before_pct"),
         expr.share_pct(F.when(~early, down)).alias("occurred_after_pct")],
        {"w": F.when(down, F.col("worst_realised"))}, {"median_depth": ("w", 0.5)},
    )


def means_dominated(bias: DataFrame, ratio: float = fixed.OUTLIER_RATIO) -> DataFrame:
    """True when some horizon's mean absolute error dwarfs its median."""
    return bias.agg(F.coalesce(F.bool_or(F.try_divide(F.col("mae"), F.col("median_abs")) > ratio), F.lit(False)).alias("dominated"))


def error_feed(ev: DataFrame) -> DataFrame:
    """mean, mean absolute and weighted error by horizon."""
    return ev.where("error_own IS NOT NULL").groupBy("horizon").agg(
        F.avg("error_own").alias("mean_error"), F.avg(F.abs("error_own")).alias("mae"),
        expr.weighted_mean("error_own", "weight").alias("weighted_error"))


def error_series(ev: DataFrame, labelled: int = 3) -> DataFrame:
    """median error of every target period beyond horizon 0, the last one left out; the largest are marked for labels."""
    last = ev.agg(F.max("period")).scalar()
    rows = ev.where((F.col("horizon") >= 1) & F.col("error_own").isNotNull() & (F.col("period") < last))
    series = grouped_quantiles(rows, ["period"], {"e": "error_own"}, {"median_error": ("e", 0.5)})
    # One row per period of the calendar: ranked in one task.
    return series.withColumn("labelled", F.row_number().over(Window.orderBy(F.desc("median_error"), "period")) <= labelled)


def at_horizon(ev: DataFrame, horizon: int | None) -> DataFrame:
    """Rows of one horizon, or all of them."""
    return ev if horizon is None else ev.where(F.col("horizon") == horizon)


def biggest_misses(ev: DataFrame, threshold: float = 10.0, horizon: int | None = 1) -> DataFrame:
    """All errors over the threshold, one year ahead unless told otherwise, tagged by sign."""
    return at_horizon(ev, horizon).where(F.abs("error_own") > threshold).select(
        "entity", "edition", "period", "horizon", "error_own",
        F.when(F.col("error_own") > 0, "too high").otherwise("too low").alias("side"))


def describe_errors(ev: DataFrame, horizon: int | None = 1) -> DataFrame:
    """Count, mean, spread, extremes and quartiles by reference."""
    rows = stacked_errors(at_horizon(ev, horizon))
    return summarise(
        rows, ["reference"],
        [F.count("error").alias("n"), F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"),
         F.min("error").alias("lowest"), F.max("error").alias("highest")],
        {"e": "error"}, {"p25": ("e", 0.25), "p50": ("e", 0.5), "p75": ("e", 0.75)},
    )


def error_histogram(ev: DataFrame, bins: int = 50, horizon: int | None = 1) -> DataFrame:
    """Equal-width histogram of the own-reference errors over their range; equal errors share the first bin."""
    rows = at_horizon(ev, horizon).where("error_own IS NOT NULL")
    ends = rows.agg(F.struct(F.min("error_own").alias("lo"), F.max("error_own").alias("hi"))).scalar()
    ranged = rows.select("error_own", ends.alias("ends")).select("error_own", "ends.*")
    place = F.coalesce(F.try_divide(F.col("error_own") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    bucket = F.least(F.floor(place * bins), F.lit(bins - 1))
    return ranged.groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bias_verdict(bias: DataFrame, notable: float = 0.5) -> DataFrame:
    """Is the bias notable at horizon 0, and of one sign beyond it?"""
    beyond = F.col("horizon") >= 1
    return bias.groupBy("reference").agg(
        F.coalesce(F.bool_or(F.when(F.col("horizon") == 0, F.abs("mean_error") >= notable)), F.lit(False)).alias("notable_now"),
        F.bool_and(F.when(beyond, F.col("mean_error") > 0)).alias("always_high"),
        F.bool_and(F.when(beyond, F.col("mean_error") < 0)).alias("always_low"),
    )


def extreme_groups(table: DataFrame, value: str) -> DataFrame:
    """Lowest and highest group of a measure by horizon, when there are at least two."""
    return not_null(table, ["grp", value]).groupBy("horizon").agg(
        F.min_by("grp", value).alias("lowest"), F.max_by("grp", value).alias("highest"), F.count_distinct("grp").alias("groups"),
    ).where("groups >= 2")
