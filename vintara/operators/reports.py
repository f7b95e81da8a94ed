"""Several reports in one job, and the two that are published."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vintara.functions import fixed
from vintara.operators.panel import reference_period, report_panels
from vintara.operators.summary import common_panel_ranks, entity_summary
from vintara.session import materialize
from vintara.sources.archives import Folder

REFERENCE, RECENT = "reference", "recent"


def candidate_periods(start: int, last: int, count: int = fixed.CANDIDATE_PERIODS) -> list[int]:
    """The last ``count`` observed periods after the start."""
    return list(range(max(start + 1, last - count + 1), last + 1))


def ranked_reports(panels: DataFrame, start: int, forecast_end: int) -> DataFrame:
    """Summary and ranks of every report of ``report_panels``, each on its own common panel."""
    return common_panel_ranks(entity_summary(panels, start, F.col("cut"), forecast_end, ["cut"]), ["cut"])


def ranked_candidates(ranked: DataFrame) -> DataFrame:
    """(cut, entity): who has a rank in which report."""
    return ranked.where("rank_end IS NOT NULL").select("cut", "entity")


def two_reports(
    observed: DataFrame, forecast: DataFrame, weights: DataFrame, start: int, last: int, forecast_end: int, path: str,
    count: int = fixed.CANDIDATE_PERIODS, loss_pct: float = fixed.LOST_WEIGHT_PCT,
) -> dict[str, int]:
    """Write the report of the reference period and, where the last observed period differs, a second one of that.

    All candidates are unified, spliced, chained, summarised and ranked with the cut as a key. The reference is the latest whose
    unranked entities weigh less than ``loss_pct`` %. A report is a folder of ``unified``, ``summary``, ``choice`` (every candidate, its ranked
    entities and lost weight) and ``unranked`` (entities that the reference ranks and this report does not). It is moved into place whole; a second report
    left by an earlier run goes when there is none now. Returns the cut of each report written.
    """
    spark = observed.sparkSession
    panels = materialize(report_panels(observed, forecast, candidate_periods(start, last, count)), "candidate_reports")
    ranked = materialize(ranked_reports(panels, start, forecast_end), "candidate_ranks")
    named = ranked_candidates(ranked)
    choice = materialize(reference_period(named, weights, loss_pct), "choice")
    retained = [r.cut for r in choice.where("retained").collect()]  # a row per candidate
    if not retained:
        raise ValueError("no candidate period ranks any entity")
    cuts = {REFERENCE: retained[0]} | ({RECENT: last} if last != retained[0] else {})
    folder = Folder(spark, path)
    for name, cut in cuts.items():
        of = lambda df: df.where(F.col("cut") == cut)  # noqa: E731, B023
        lost = named.where(F.col("cut") == cuts[REFERENCE]).select("entity").join(of(named).select("entity"), "entity", "left_anti")
        staging = f"_staging-{uuid.uuid4().hex}"
        for table, rows in {"unified": of(panels), "summary": of(ranked), "choice": choice, "unranked": lost}.items():
            rows.write.parquet(f"{folder.path}/{staging}/{table}")
        folder.move(staging, name)
    if RECENT not in cuts and folder.exists(RECENT):
        folder.remove(RECENT)
    return cuts


def read_reports(spark, path: str, names: Sequence[str], table: str) -> DataFrame:
    """A table of the written reports, with the report's name as ``report``."""
    each = [spark.read.parquet(f"{path.rstrip('/')}/{n}/{table}").withColumn("report", F.lit(n)) for n in names]
    whole = each[0]
    for more in each[1:]:
        whole = whole.unionByName(more)
    return whole
