"""Forecast revisions and changes between editions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.evaluation import trimmed
from vintara.operators.quantiles import summarise


def successive_revisions(vintages: DataFrame) -> DataFrame:
    """Value minus the previous edition's for the same target, consecutive editions only."""
    w = Window.partitionBy("entity", "period").orderBy("_order")
    rows = vintages.where("horizon >= -1").withColumn("_order", expr.edition_order("edition_period", "season"))
    follows = F.col("_order") - F.lag("_order").over(w) == 1
    revised = rows.withColumns({
        "_follows": follows, "revision": F.when(follows, F.col("value") - F.lag("value").over(w))})
    return revised.withColumn(
        "previous_revision", F.when(F.col("_follows"), F.lag("revision").over(w))).drop("_order", "_follows")


def revision_summary(revisions: DataFrame, shock_periods: Sequence[int], minimum: int = 10) -> DataFrame:
    """Direction and persistence of revisions by step, farthest step first."""
    keys = ["horizon", "season"]
    rows = revisions.where("revision IS NOT NULL")
    r, p = F.col("revision"), F.col("previous_revision")
    same = F.when((r != 0) & (p != 0), (F.signum(r) == F.signum(p)).cast("double"))
    base = summarise(
        rows, keys,
        [F.count(r).alias("n"), F.avg(r).alias("mean_revision"), expr.weighted_mean("revision", "weight").alias("weighted_revision"),
         F.avg(F.when(~F.col("period").isin(list(shock_periods)), r)).alias("mean_without_shocks"),
         (F.avg(F.when(r != 0, (r < 0).cast("double"))) * 100).alias("down_pct"), (F.avg(same) * 100).alias("_same")],
        {"r": "revision", "a": F.abs("revision")}, {"median_revision": ("r", 0.5), "median_abs": ("a", 0.5)},
    )
    pairs = trimmed(rows.where("previous_revision IS NOT NULL"), keys, ["revision", "previous_revision"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_pairs"), F.stddev_samp(p).alias("_sd"),
        F.regr_slope(r, p).alias("_slope"), F.corr(r, p).alias("_corr"))
    good = (F.col("_pairs") >= minimum) & (F.col("_sd") > 0)
    table = base.join(pairs, keys, "left").withColumns({
        "step": expr.step_label("horizon", "season"), "slope": F.when(good, F.col("_slope")),
        "correlation": F.when(good, F.col("_corr")), "same_sign_pct": F.when(good, F.col("_same")),
    }).drop("_pairs", "_sd", "_slope", "_corr", "_same")
    return table.orderBy(-F.col("horizon") * 2 + (F.col("season") == "F").cast("int"))


def edition_levels(archive: DataFrame, editions: Sequence[str], periods: Sequence[int],
                   indicators: Sequence[str] = ("NGDP", "NGDP_R", "NGDPD")) -> DataFrame:
    """A5: the wanted levels of archived editions, one row per edition and entity, no pivot."""
    rows = archive.where(F.col("edition").isin(list(editions)) & F.col("indicator").isin(list(indicators)) & F.col("period").isin(list(periods)))
    return rows.withColumn("entity", expr.recode("entity")).groupBy("edition", "entity").agg(*[
        F.avg(F.when((F.col("indicator") == i) & (F.col("period") == p), F.col("value"))).alias(f"{i}_{p}")
        for i in indicators for p in sorted(set(periods))])


def level_revisions(archive: DataFrame, old: str, new: str, base: int, target: int, control: int,
                    threshold: float = fixed.HISTORY_REVISION_THRESHOLD) -> DataFrame:
    """What a new edition changes for the entities of both, in %, with two flags.

    Both editions are read in one scan and set side by side by one aggregation.
    """
    wide = edition_levels(archive, [old, new], [base, target, control])
    columns = [c for c in wide.columns if c not in ("edition", "entity")]
    sides = wide.groupBy("entity").agg(
        F.count_if(F.col("edition") == old).alias("_o"), F.count_if(F.col("edition") == new).alias("_n"),
        *[F.max(F.when(F.col("edition") == e, F.col(c))).alias(f"{k}_{c}") for k, e in (("o", old), ("n", new)) for c in columns])

    def change(after: Column, before: Column) -> Column:
        return expr.finite((F.try_divide(after, before) - 1) * 100)

    def growth(k: str, i: str) -> Column:
        return F.try_divide(F.col(f"{k}_{i}_{target}"), F.col(f"{k}_{i}_{base}"))

    def deflator(k: str) -> Column:
        return F.try_divide(F.col(f"{k}_NGDP_{control}"), F.col(f"{k}_NGDP_R_{control}"))

    table = sides.where("_o > 0 AND _n > 0").select(
        "entity",
        change(growth("n", "NGDP_R"), growth("o", "NGDP_R")).alias("real_growth_pct"),
        change(growth("n", "NGDPD"), growth("o", "NGDPD")).alias("usd_growth_pct"),
        change(F.col(f"n_NGDPD_{target}"), F.col(f"o_NGDPD_{target}")).alias("usd_target_pct"),
        change(F.col(f"n_NGDPD_{control}"), F.col(f"o_NGDPD_{control}")).alias("usd_history_pct"),
        change(deflator("n"), deflator("o")).alias("deflator_history_pct"),
    ).withColumns({
        "deflator_flag": F.coalesce(F.abs("deflator_history_pct") > threshold, F.lit(False)),
        "history_flag": F.coalesce(F.abs("usd_history_pct") > threshold, F.lit(False)),
    })
    return table.where(F.coalesce("real_growth_pct", "usd_growth_pct", "usd_history_pct", "deflator_history_pct").isNotNull())


def method_changes(metadata: DataFrame, old: str, new: str) -> DataFrame:
    """Standard and base year in two editions; a change is NULL when either is unknown."""
    m = metadata.where(F.col("edition").isin(old, new)).withColumn("entity", expr.recode("entity"))

    def side(edition: str, c: str) -> Column:
        return F.max(F.when(F.col("edition") == edition, expr.known_text(c)))

    return m.groupBy("entity").agg(
        side(old, "methodology").alias("standard_old"), side(new, "methodology").alias("standard_new"),
        side(old, "base_year").alias("base_year_old"), side(new, "base_year").alias("base_year_new"),
    ).withColumns({
        "standard_changed": F.col("standard_old") != F.col("standard_new"),
        "base_year_changed": F.col("base_year_old") != F.col("base_year_new"),
    })


def edition_changes(levels: DataFrame, methods: DataFrame, names: DataFrame) -> DataFrame:
    """Level revisions and method changes side by side (full join), named where known."""
    return levels.join(methods, "entity", "full").join(names, "entity", "left")


def revision_size_facts(changes: DataFrame, volume: float = fixed.VOLUME_REVISION_THRESHOLD, usd: float = 5.0) -> DataFrame:
    """How many entities the edition revised notably (strict thresholds), and medians."""
    rows = changes.withColumn("_all", F.lit("all"))
    return summarise(
        rows, ["_all"],
        [F.count("real_growth_pct").alias("real_known"), F.count_if(F.abs("real_growth_pct") > volume).alias("real_notable"),
         F.count("usd_growth_pct").alias("usd_known"), F.count_if(F.abs("usd_growth_pct") > usd).alias("usd_notable"),
         F.count_if(F.col("standard_changed")).alias("standard_changed"), F.count_if(F.col("base_year_changed")).alias("base_year_changed")],
        {"r": F.abs("real_growth_pct"), "u": F.abs("usd_growth_pct")}, {"median_real": ("r", 0.5), "median_usd": ("u", 0.5)},
    ).drop("_all")


def revision_facts(summary: DataFrame, last_bias: DataFrame) -> DataFrame:
    """Mean revisions end to end against the bias at the last horizon, and range of correlations."""
    return summary.agg(
        F.sum("mean_revision").alias("total_revision"),
        F.max(F.when(F.col("horizon") >= 2, F.abs("mean_revision"))).alias("largest_far_revision"),
        F.min("correlation").alias("lowest_correlation"), F.max("correlation").alias("highest_correlation"),
    ).withColumn("last_bias", last_bias.scalar())
