"""Summary per entity, common-panel ranks and published top tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.functions import expr
from vintara.operators.quantiles import grouped_quantiles, with_ranks
from vintara.session import materialize


def reference_periods(start: int, end: Column | int, forecast_end: int) -> dict[str, Column]:
    """The four dates of the summary; the middle is ten periods after the start, or half-way."""
    end = F.lit(end) if isinstance(end, int) else end
    middle = F.when(F.lit(start + 10) < end, F.lit(start + 10)).otherwise(F.lit(start) + F.floor((end - F.lit(start)) / 2))
    return {"start": F.lit(start), "mid": middle, "end": end, "fcst": F.lit(forecast_end)}


def entity_summary(unified: DataFrame, start: int, end: Column | int, forecast_end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Levels at the reference periods and compound growth, one shuffle for all measures.

    With ``keys``, one summary for each of their values, on which ``end`` may depend.
    """
    dates = reference_periods(start, end, forecast_end)
    n_hist, n_fcst = dates["end"] - start, F.lit(forecast_end) - dates["end"]
    wanted = {
        "nominal": ("start", "mid", "end", "fcst"), "volume": ("start", "end", "fcst"), "ppp_volume": ("start", "end", "fcst"),
        "population": ("start", "end", "fcst"), "volume_per_capita": ("start", "end", "fcst"), "ppp_volume_per_capita": ("end", "fcst"),
    }

    def at(c: str, d: str) -> Column:
        return F.avg(F.when(F.col("period") == dates[d], F.col(c))).alias(f"{c}_{d}")

    levels = unified.where(~F.col("is_aggregate")).groupBy(*keys, "entity").agg(
        F.min_by("name", "period").alias("name"), F.min_by("grp", F.when(F.col("grp").isNotNull(), F.col("period"))).alias("grp"),
        F.count("nominal").alias("_known"), *[at(c, d) for c, ds in wanted.items() for d in ds],
    ).where("_known > 0").drop("_known")
    growth = {}
    for c in ("nominal", "volume", "population", "volume_per_capita"):
        growth[f"cagr_{c}_hist"] = expr.cagr(f"{c}_start", f"{c}_end", n_hist)
        growth[f"cagr_{c}_fcst"] = expr.cagr(f"{c}_end", f"{c}_fcst", n_fcst)
    return levels.withColumns(growth).withColumns({
        "nominal_change": F.col("nominal_fcst") - F.col("nominal_end"),
        "nominal_volume_gap": F.col("cagr_nominal_hist") - F.col("cagr_volume_hist"),
    })


RANKED = {"rank_end": "nominal_end", "rank_fcst": "nominal_fcst", "rank_ppp_end": "ppp_volume_end", "rank_ppp_fcst": "ppp_volume_fcst"}


def common_panel_ranks(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks of the entities known at both dates on both bases, and rank changes.

    Without any second base the panel is the nominal one. The four measures are ranked together, from
    bucketed counts (``with_ranks``), not from a single sorted partition. With ``keys`` (few values, such as
    the cuts of reports) every value has its own panel and ranks.
    """
    keys = list(keys)
    summary = materialize(summary, "summary")  # one row per entity, read by every rank
    no_second = summary.groupBy(*keys).agg(
        ((F.count("ppp_volume_end") == 0) | (F.count("ppp_volume_fcst") == 0)).alias("_no_second"))
    nominal = F.col("nominal_end").isNotNull() & F.col("nominal_fcst").isNotNull()
    both = nominal & F.col("ppp_volume_end").isNotNull() & F.col("ppp_volume_fcst").isNotNull()
    told = summary.join(F.broadcast(no_second), keys) if keys else summary.withColumn("_no_second", no_second.scalar())
    marked = told.withColumn("in_panel", F.when(F.col("_no_second"), nominal).otherwise(both)).drop("_no_second")
    long = marked.where("in_panel").select(*keys, "entity", F.explode(F.array(*[
        F.struct(F.lit(rank).alias("measure"), F.col(c).alias("value")) for rank, c in RANKED.items()
    ])).alias("m")).select(*keys, "entity", "m.measure", "m.value").where("value IS NOT NULL")
    ranks = with_ranks(long, [*keys, "measure"], "value", descending=True, bounded_groups=True)
    wide = ranks.groupBy(*keys, "entity").agg(*[
        F.max(F.when(F.col("measure") == rank, F.col("rank_min"))).alias(rank) for rank in RANKED])
    ranked = marked.join(wide, [*keys, "entity"], "left")
    return ranked.withColumns({
        "rank_change": F.col("rank_end") - F.col("rank_fcst"),
        "rank_gap_bases": F.col("rank_end") - F.col("rank_ppp_end"),
    })


def top(summary: DataFrame, column: str, n: int, ascending: bool = False) -> DataFrame:
    """First rows by a column, missing values last; never a full sort."""
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return summary.orderBy(order, "entity").limit(n)


def top_table(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Largest entities with levels, growth and rank move."""
    return top(ranked, "nominal_end", n).select(
        "entity", "name", "nominal_start", "nominal_end", "nominal_fcst", "cagr_nominal_hist", "cagr_nominal_fcst",
        "rank_end", "rank_fcst", "rank_change")


def volume_table(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Largest entities that have both nominal and volume growth."""
    both = ranked.where("cagr_nominal_hist IS NOT NULL AND cagr_volume_hist IS NOT NULL")
    return top(both, "nominal_end", n).select(
        "entity", "nominal_end", "volume_end", "cagr_nominal_hist", "cagr_volume_hist", "nominal_volume_gap")


def ppp_table(ranked: DataFrame, n: int = 15) -> DataFrame:
    """Best ranks on the second base."""
    return top(ranked.where("rank_ppp_end IS NOT NULL"), "rank_ppp_end", n, ascending=True).select(
        "entity", "rank_ppp_end", "nominal_end", "ppp_volume_end", "rank_end", "rank_gap_bases")


def summary_facts(ranked: DataFrame) -> DataFrame:
    """Facts of the published tables in one row each."""
    shown = volume_table(ranked).agg(F.min_by("entity", F.struct("nominal_volume_gap", "entity")).alias("largest_negative_gap"))
    climber = ppp_table(ranked).where("rank_gap_bases IS NOT NULL").agg(
        F.min_by("entity", F.struct(-F.col("rank_gap_bases"), F.col("rank_ppp_end"))).alias("climber"))
    counts = ranked.agg(
        F.count_if(F.col("nominal_volume_gap") < 0).alias("negative_gaps"), F.count("nominal_volume_gap").alias("known_gaps"),
        F.min_by("entity", F.struct("rank_ppp_end", "entity")).alias("first_ppp"),
    )
    return counts.select("*", shown.select("largest_negative_gap").scalar().alias("largest_negative_gap"),
                         climber.select("climber").scalar().alias("climber"))


def last_rows(unified: DataFrame, n: int = 10) -> DataFrame:
    """Last n periods of every entity."""
    w = Window.partitionBy("entity").orderBy(F.desc("period"))
    return unified.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def comparable_sources(unified: DataFrame, period: int, threshold: float = 5.0) -> DataFrame:
    """How far the two sources stand apart at one observed period."""
    rows = unified.where((F.col("period") == period) & ~F.col("is_aggregate") & F.col("source_gap_pct").isNotNull()).withColumn(
        "_all", F.lit("all"))
    plain = rows.groupBy("_all").agg(
        F.count(F.lit(1)).alias("comparable"), F.count_if(F.abs("source_gap_pct") > threshold).alias("diverging"))
    mid = grouped_quantiles(rows, ["_all"], {"g": F.abs("source_gap_pct")}, {"median_gap": ("g", 0.5)}, bounded_groups=True)
    return plain.join(mid, "_all").drop("_all")


def growth_heat_map(unified: DataFrame, leaders: DataFrame, first: int, last: int) -> DataFrame:
    """Growth by period (columns) of the leading entities (rows)."""
    return unified.where(F.col("period").between(first, last)).join(leaders.select("entity"), "entity", "left_semi").groupBy("entity").agg(
        *[F.max(F.when(F.col("period") == p, F.col("growth"))).alias(f"p{p}") for p in range(first, last + 1)])


def find_entity(unified: DataFrame, text: str) -> DataFrame:
    """Rows of an entity by code or by name, whatever the case."""
    return unified.where((F.col("entity") == text.upper()) | (F.upper("name") == text.upper()))


def flagged_entities(table: DataFrame, flag: str, size: str, n: int = 8) -> DataFrame:
    """Largest flagged entities and how many others there are."""
    flagged = table.where(F.col(flag))
    total = flagged.agg(F.count(F.lit(1))).scalar()
    return flagged.orderBy(F.desc_nulls_last(size), "entity").limit(n).select(
        "entity", size, F.greatest(total - n, F.lit(0)).cast("bigint").alias("others"))
