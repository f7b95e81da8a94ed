"""Editions around a shock, level index and activity against output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.quantiles import summarise
from vintara.operators.vintages import own_reference


def growth_by_edition(vintages: DataFrame, current: DataFrame, codes: Sequence[str], shock: int) -> DataFrame:
    """Growth of the shock period and the next ones by edition, next to both outcomes."""
    last = shock + max(fixed.SHOCK_LEVEL_OFFSETS)
    editions = expr.editions_around(shock)
    mine = vintages.where(F.col("entity").isin(list(codes)))
    span = F.col("period").between(shock, last)
    wide = mine.where(span & F.col("edition").isin(editions)).groupBy("entity", "period").agg(
        *[F.max(F.when(F.col("edition") == e, F.col("value"))).alias(e) for e in editions])
    grid = mine.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(shock), F.lit(last))).alias("period"))
    return (
        grid.join(wide, ["entity", "period"], "left")
        .join(own_reference(mine).where(span), ["entity", "period"], "left")
        .join(current.where(span).select("entity", "period", F.col("value").alias("current_estimate")), ["entity", "period"], "left")
    )


def _with_outcome(vintages: DataFrame, weights: DataFrame, target: int, editions: Sequence[str]) -> DataFrame:
    rows = vintages.where((F.col("period") == target) & F.col("edition").isin(list(editions)))
    real = own_reference(vintages).where(F.col("period") == target).select("entity", "realised_own")
    return rows.select("entity", "edition", "value").join(real, "entity", "left").join(weights, "entity", "left")


def announced_downturns(vintages: DataFrame, weights: DataFrame, shock: int) -> DataFrame:
    """Downturns announced by each edition for the shock period against those that occurred."""
    rows = _with_outcome(vintages, weights, shock, expr.editions_around(shock)[:4])
    said, came = F.col("value") < 0, F.col("realised_own") < 0
    rows = rows.withColumns({"_said": said.cast("double"), "_came": came.cast("double")})
    return rows.groupBy("edition").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(said).alias("announced"),
        (expr.weighted_mean("_said", "weight") * 100).alias("announced_weight_pct"),
        F.count_if(came).alias("occurred"), (expr.weighted_mean("_came", "weight") * 100).alias("occurred_weight_pct"),
        (F.try_divide(F.count_if(said & came), F.count_if(came)) * 100).alias("hit_pct"))


def rebound_errors(vintages: DataFrame, weights: DataFrame, shock: int) -> DataFrame:
    """Error of each edition on the growth of the period after the shock."""
    rows = _with_outcome(vintages, weights, shock + 1, expr.editions_around(shock)).withColumn(
        "error", F.col("value") - F.col("realised_own")).where("error IS NOT NULL")
    return summarise(
        rows, ["edition"],
        [F.count("error").alias("entities"), expr.weighted_mean("error", "weight").alias("weighted_error"),
         expr.share_pct(F.col("error") < 0).alias("underestimated_pct")],
        {"e": "error"}, {"median_error": ("e", 0.5)})


def levels_by_edition(vintages: DataFrame, current: DataFrame, codes: Sequence[str], shock: int) -> DataFrame:
    """Level index, 100 two periods before the shock, by edition and realised.

    A missing period empties what follows: the running product is kept while rows are dense.
    """
    first, last = shock - 1, shock + max(fixed.SHOCK_LEVEL_OFFSETS)
    editions = expr.editions_around(shock)[1:5]
    mine = vintages.where(F.col("entity").isin(list(codes)))
    columns = ["entity", "period", "source", "growth"]
    stacked = (
        mine.where(F.col("edition").isin(editions)).select("entity", "period", F.col("edition").alias("source"), F.col("value").alias("growth"))
        .unionByName(own_reference(mine).select("entity", "period", F.lit("own reference").alias("source"), F.col("realised_own").alias("growth")))
        .unionByName(current.where(F.col("entity").isin(list(codes))).select("entity", "period", F.lit("current").alias("source"), F.col("value").alias("growth")))
    ).select(*columns).where(F.col("period").between(first, last) & F.col("growth").isNotNull())
    w = Window.partitionBy("entity", "source").orderBy("period")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = F.row_number().over(w) == F.col("period") - first + 1
    index = stacked.select("*", F.when(dense, 100 * F.product(1 + F.col("growth") / 100).over(run)).alias("level"))
    wide = index.groupBy("entity", "source").agg(*[
        F.max(F.when(F.col("period") == shock + k, F.col("level"))).alias(f"level_{k}") for k in fixed.SHOCK_LEVEL_OFFSETS])
    sources = F.array(*[F.lit(s) for s in [*editions, "own reference", "current"]])
    return mine.select("entity").distinct().select("entity", F.explode(sources).alias("source")).join(wide, ["entity", "source"], "left")


def cumulative_log_growth(rows: Column, period: str, first: int, last: int) -> Column:
    """Log ratio of the levels of two periods from the rates between them, NULL if one is missing."""
    inside = F.col(period).between(first + 1, last) & rows.isNotNull()
    return F.when(F.count_if(inside) == last - first, F.sum(F.when(inside, F.log1p(rows / 100))))


def stack_activity(first: DataFrame, second: DataFrame, codes: Mapping[str, str], first_source: str, second_source: str) -> DataFrame:
    """Two activity sources, the first recoded to the entity codes, tagged and stacked."""
    a = first.withColumn("entity", expr.lookup(codes, "geo")).where("entity IS NOT NULL").select(
        "entity", "period", F.col("value").alias("activity"), F.lit(first_source).alias("source"))
    return a.unionByName(second.select("entity", "period", F.col("value").alias("activity"), F.lit(second_source).alias("source")))


def activity_and_output(activity: DataFrame, vintages: DataFrame, current: DataFrame, shock: int) -> DataFrame:
    """Log growth of activity and output before and after the shock, and the output surprise."""
    base, trend = shock - 2, shock - 2 - fixed.TREND_PERIODS
    edition = f"F{shock - 1}"

    def at(p: int) -> Column:
        return F.max(F.when((F.col("period") == p) & (F.col("activity") > 0), F.col("activity")))

    act = activity.groupBy("entity").agg(
        F.min_by("source", "period").alias("source"), F.max(F.when(F.col("period") == base, F.col("activity"))).alias("activity_base"),
        F.ln(at(base) / at(trend)).alias("activity_before"),
        *[F.ln(at(shock + k) / at(base)).alias(f"activity_{k}") for k in fixed.ACTIVITY_DELAYS])
    real = current.groupBy("entity").agg(
        cumulative_log_growth(F.col("value"), "period", trend, base).alias("output_before"),
        *[cumulative_log_growth(F.col("value"), "period", base, shock + k).alias(f"output_{k}") for k in fixed.ACTIVITY_DELAYS])
    projected = vintages.where(F.col("edition") == edition).groupBy("entity").agg(
        *[cumulative_log_growth(F.col("value"), "period", base, shock + k).alias(f"projected_{k}") for k in fixed.ACTIVITY_DELAYS])
    return act.join(real, "entity", "left").join(projected, "entity", "left").withColumns({
        f"surprise_{k}": F.col(f"output_{k}") - F.col(f"projected_{k}") for k in fixed.ACTIVITY_DELAYS})


def activity_regressions(table: DataFrame, source: str, minimum: int = 5) -> DataFrame:
    """Activity growth on output growth across entities: slope, 95 % interval, R2."""
    spans = ["before", *[str(k) for k in fixed.ACTIVITY_DELAYS]]
    rows = table.where(F.col("source") == source).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("span"), F.col(f"activity_{s}").alias("y"), F.col(f"output_{s}").alias("x")) for s in spans
    ])).alias("r")).select("r.*").where("x IS NOT NULL AND y IS NOT NULL")
    fit = rows.groupBy("span").agg(
        F.count(F.lit(1)).alias("entities"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"),
        F.regr_sxx("y", "x").alias("_sxx"), F.regr_sxy("y", "x").alias("_sxy"), F.regr_syy("y", "x").alias("_syy"))
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    se = F.sqrt(residual / (F.col("entities") - 2) / F.col("_sxx"))
    return fit.where(F.col("entities") >= minimum).select(
        "span", "entities", "slope", (F.col("slope") - 1.96 * se).alias("ci_low"), (F.col("slope") + 1.96 * se).alias("ci_high"), "r2")


def activity_summary(table: DataFrame, output_base: DataFrame) -> DataFrame:
    """Gap of activity to its trend, weighted output gap and the share elasticities explain."""
    rows = table.join(output_base.where("weight IS NOT NULL"), "entity").select(
        F.col("source").alias("member"), "activity_base", "activity_before", "weight",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("delay"), F.col(f"activity_{k}").alias("a"), F.col(f"output_{k}").alias("o"), F.col(f"projected_{k}").alias("p"))
            for k in fixed.ACTIVITY_DELAYS])).alias("r"),
    ).select("*", "r.*").where("activity_before IS NOT NULL AND a IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL")
    base, w = F.col("activity_base"), F.col("weight")
    totals = rows.groupBy("member", "delay").agg(
        F.count(F.lit(1)).alias("entities"),
        (F.ln(F.try_divide(F.sum(base), F.sum(base * F.exp(-F.col("activity_before"))))) / fixed.TREND_PERIODS).alias("_trend"),
        F.ln(F.try_divide(F.sum(base * F.exp("a")), F.sum(base))).alias("_a"),
        F.ln(F.try_divide(F.sum(w * F.exp("o")), F.sum(w))).alias("_o"), F.ln(F.try_divide(F.sum(w * F.exp("p")), F.sum(w))).alias("_p"))
    gap = F.col("_a") - F.col("_trend") * (F.col("delay") + 2)
    surprise = F.col("_o") - F.col("_p")
    return totals.select(
        "member", "delay", "entities", (F.col("_a") * 100).alias("activity_growth"), (F.col("_trend") * 100).alias("activity_trend"),
        (gap * 100).alias("activity_gap"), (F.col("_o") * 100).alias("output_growth"), (F.col("_p") * 100).alias("output_projected"),
        (surprise * 100).alias("output_gap"),
        *[(e * surprise * 100).alias(f"implied_gap_{i}") for i, e in enumerate(fixed.ELASTICITIES)],
        *[F.when(gap < 0, e * surprise / gap * 100).alias(f"explained_pct_{i}") for i, e in enumerate(fixed.ELASTICITIES)])
