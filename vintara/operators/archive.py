"""Revisions of the realised data itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr, fixed
from vintara.operators.quantiles import summarise


#: Width of a time bucket of the as-of join, in steps of the versions.
BUCKET = 16


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, time: str, value: str, width: int) -> DataFrame:
    """Last ``value`` of ``right`` known at or before ``left.at``, by key.

    Both sides are ordered together inside time buckets of ``width``; what a bucket does not
    know is carried from the buckets before it. No row meets more than one other, and a hot
    key is spread over its buckets.
    """
    keys = list(keys)
    extra = [c for c in left.columns if c not in (*keys, at)]
    asked = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in extra] or [F.lit(0).alias("_none")]).alias("_row"),
                        F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    told = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both = asked.unionByName(told).withColumn("_bucket", F.floor(F.col("_t") / width))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(inner))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    carried = both.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end")).select(
        *keys, "_bucket", F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return local.where("_side = 1").join(carried, [*keys, "_bucket"]).select(
        *keys, F.col("_t").alias(at), *[F.col(f"_row.{c}").alias(c) for c in extra], F.coalesce("_seen", "_carry").alias(value))


def revisions_since_publication(
    archive: DataFrame, delays: Sequence[int] = fixed.REVISION_DELAYS, step: int = 100, first_period: int | None = None
) -> DataFrame:
    """First publication of every key, its value ``delay`` later, and the latest one.

    Every delay asks for the value as of a version; all are answered by one as-of join, so a key may have any number of versions. A delay
    that reaches past the last version is left out.
    """
    bounds = archive.agg(F.min("version").alias("lo"), F.max("version").alias("hi"))
    start = F.floor(bounds.select("lo").scalar() / step) - 1 if first_period is None else F.lit(first_period)
    known = archive.where(F.col("value").isNotNull())
    first = known.groupBy("entity", "period").agg(F.min("version").alias("first_version"), F.min_by("value", "version").alias("first_value"))
    asked = first.withColumns({"_start": start, "_last": bounds.select("hi").scalar()}).where(F.col("period") >= F.col("_start")).withColumn(
        "_k", F.explode(F.array(*[F.lit(k) for k in delays], F.lit(None).cast("int"))))
    target = F.coalesce(F.col("first_version") + step * F.col("_k"), F.col("_last")).cast(archive.schema["version"].dataType)
    asked = asked.withColumn("target", target).where(F.col("target") <= F.col("_last")).select(
        "entity", "period", "target", "first_version", "first_value", F.coalesce(F.col("_k").cast("string"), F.lit("latest")).alias("delay"))
    return as_of_join(asked, known, ["entity", "period"], "target", "version", "value", BUCKET * step).select(
        "entity", "period", "first_version", "first_value", "value", "delay")


def _with_members(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All rows, and each listed group: a NULL group counts only in the total."""
    member = F.filter(F.array(F.lit("all"), F.when(F.col("grp").isin(list(groups)), F.col("grp"))), lambda g: g.isNotNull())
    return rows.withColumn("member", F.explode(member))


def growth_revision_summary(revisions: DataFrame, groups: Sequence[str], threshold: float = fixed.GROWTH_REVISION_THRESHOLD) -> DataFrame:
    """Revision in points by delay, for all and by group."""
    r = F.col("value") - F.col("first_value")
    rows = _with_members(revisions.withColumn("revision", r), groups)
    a = F.abs("revision")
    return summarise(
        rows.withColumn("_a", a), ["delay", "member"],
        [F.count(F.lit(1)).alias("n"), F.avg("revision").alias("mean_revision"), F.avg(a).alias("mean_abs"),
         expr.share_pct(a > threshold).alias("above_threshold_pct"), expr.weighted_mean("_a", "weight").alias("weighted_abs")],
        {"r": "revision", "a": a}, {"median_revision": ("r", 0.5), "median_abs": ("a", 0.5)})


def level_revision_summary(revisions: DataFrame, groups: Sequence[str], threshold: float = fixed.LEVEL_REVISION_THRESHOLD) -> DataFrame:
    """Revision in % of a positive first level by delay, for all and by group."""
    rows = _with_members(
        revisions.where("first_value > 0").withColumn("revision", (F.col("value") / F.col("first_value") - 1) * 100), groups)
    a = F.abs("revision")
    return summarise(
        rows, ["delay", "member"],
        [F.count(F.lit(1)).alias("n"), expr.share_pct(a > 5).alias("above_5_pct"), expr.share_pct(a > threshold).alias("above_threshold_pct")],
        {"r": "revision", "a": a}, {"median_revision": ("r", 0.5), "median_abs": ("a", 0.5), "p90_abs": ("a", 0.9)})


def largest_revisions(revisions: DataFrame, weights: DataFrame, n: int = 15, among: int = fixed.TOP_REVISED_ENTITIES) -> DataFrame:
    """Most revised period of each of the heaviest entities, largest revisions first."""
    leaders = weights.orderBy(F.desc_nulls_last("weight"), "entity").limit(among).select("entity")
    rows = revisions.where("delay = 'latest' AND first_value > 0").join(F.broadcast(leaders), "entity", "left_semi").withColumn(
        "revision_pct", (F.col("value") / F.col("first_value") - 1) * 100)
    columns = ["period", "first_version", "first_value", "value", "revision_pct"]
    worst = rows.groupBy("entity").agg(F.max_by(F.struct(*columns), F.struct(F.abs("revision_pct"), -F.col("period"))).alias("_r"))
    return worst.select("entity", "_r.*").orderBy(F.abs("revision_pct").desc(), "entity").limit(n)


def realtime_value(archive: DataFrame, limit: Column) -> DataFrame:
    """Value of the last version out by ``limit`` (by default of the caller: the end of the next year)."""
    return archive.where((F.col("version") <= limit) & F.col("value").isNotNull()).groupBy("entity", "period").agg(
        F.max_by("value", "version").alias("realised_realtime"))


def bias_by_reference(ev: DataFrame, realtime: DataFrame) -> DataFrame:
    """Bias against three references on the projections that have all of them."""
    references = {"own": "realised_own", "realtime": "realised_realtime", "other": "realised_other"}
    rows = ev.join(realtime, ["entity", "period"]).dropna(subset=list(references.values()))
    errors = {f"e_{n}": F.col("value") - F.col(c) for n, c in references.items()}
    rows = rows.withColumns(errors)
    return summarise(
        rows, ["horizon"],
        [F.count(F.lit(1)).alias("n"), *[F.avg(f"e_{n}").alias(f"mean_{n}") for n in references],
         *[expr.weighted_mean(f"e_{n}", "weight").alias(f"weighted_{n}") for n in references]],
        {n: f"e_{n}" for n in references}, {f"median_{n}": (n, 0.5) for n in references})
