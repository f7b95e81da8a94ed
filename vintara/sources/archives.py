"""Archives that are written once, and run outputs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vintara.functions import expr
from vintara.session import materialize


def edition_names(flows: DataFrame, last_period: Column | int, span: int = 5) -> DataFrame:
    """Edition of every flow: archives carry a date, the current flow follows the latest.

    ``flows`` has one ``flow`` column. The current flow must reach ``span`` periods past its
    edition, else the job fails rather than guess.
    """
    pattern = r"^[A-Z]+_(\d{4})_([A-Z]{3})_VINTAGE$"
    year = F.regexp_extract("flow", pattern, 1).try_cast("int")
    spring = F.regexp_extract("flow", pattern, 2).isin("JAN", "FEB", "MAR", "APR", "MAY", "JUN")
    dated = flows.select("flow", year.alias("year"), F.when(spring, "S").otherwise("F").alias("season"))
    archives = dated.where("year IS NOT NULL")
    latest = archives.agg(F.max(F.struct(expr.edition_order("year", "season").alias("o"), "year", "season"))).scalar()
    current = dated.where("year IS NULL").select("flow", latest.alias("_l")).select(
        "flow", F.when(F.col("_l.season") == "F", F.col("_l.year") + 1).otherwise(F.col("_l.year")).alias("year"),
        F.when(F.col("_l.season") == "F", "S").otherwise("F").alias("season"))
    last = F.lit(last_period) if isinstance(last_period, int) else last_period
    checked = current.withColumn("year", F.when(F.col("year") + span == last, F.col("year")).otherwise(
        F.raise_error(F.lit("the current edition cannot be dated")).cast("int")))
    return archives.unionByName(checked).select("flow", F.concat("season", F.col("year").cast("string")).alias("edition"))


class Folder:
    """A folder of the cluster's file system with an index of what is committed in it.

    Rows are written to a staging folder of their own, moved to their place, and listed in the index last, by one small write.
    Only what the index lists exists for readers: a run that dies before leaves nothing but files that no one reads, and can be repeated.
    Names that begin with ``_`` are passed over by readers of the folder itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def move(self, source: str, target: str) -> None:
        """Move into place; an old copy there was never committed."""
        if self.exists(target):
            self.remove(target)
        self._fs.mkdirs(self.at(target).getParent())
        if not self._fs.rename(self.at(source), self.at(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def index(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/_index") if self.exists("_index") else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/_index")


ARCHIVE_INDEX = "partition string, values bigint, entities bigint, indicators bigint, first_period int, last_period int"
COMPLEMENT_INDEX = "edition string, run int, present boolean"


def archived_partitions(spark: SparkSession, path: str) -> list[str]:
    """A4: archived versions in order, from the index."""
    return sorted(r.partition for r in Folder(spark, path).index(ARCHIVE_INDEX).select("partition").distinct().collect())  # versions are a calendar


def archive_once(rows: DataFrame, path: str, partition: str) -> list[str]:
    """Append the partitions that are not archived yet, with their row of the index; what is archived is never rewritten.

    The index counts values, and entities, indicators and periods where the rows have such columns.
    """
    spark = rows.sparkSession
    folder, present = Folder(spark, path), archived_partitions(spark, path)
    staging = f"_staging-{uuid.uuid4().hex}"
    new = rows.where(F.col(partition).isNotNull() & ~F.col(partition).cast("string").isin(present))
    new.write.partitionBy(partition).parquet(f"{folder.path}/{staging}")
    found = [n for n in folder.names(staging) if n.startswith(f"{partition}=")]
    if found:
        staged = spark.read.parquet(f"{folder.path}/{staging}")
        index = materialize(archive_index(staged, partition), "archive_index")
        for name in found:
            folder.move(f"{staging}/{name}", name)
        folder.commit(index.select(F.col(partition).cast("string").alias("partition"), "values", "entities", "indicators", "first_period", "last_period"))
    folder.remove(staging)
    return [p for p in archived_partitions(spark, path) if p not in present]


def read_archive(spark: SparkSession, path: str, schema: str, indicator: str | None = None, partitions: Mapping[str, Sequence] | None = None) -> DataFrame:
    """A3: all committed versions, or some of them; filters reach the partitions and the files."""
    df, committed = spark.read.schema(schema).parquet(path), archived_partitions(spark, path)
    df = df.where(F.col(df.columns[-1]).cast("string").isin(committed))  # the partition column
    for column, values in (partitions or {}).items():
        df = df.where(F.col(column).isin(list(values)))
    return df if indicator is None else df.where(F.col("indicator") == indicator)


def latest_edition(archive: DataFrame, indicator: str) -> DataFrame:
    """One indicator of the latest archived edition, recoded."""
    order = expr.edition_order(F.substring("edition", 2, 10).cast("int"), F.substring("edition", 1, 1))
    last = archive.select("edition").distinct().agg(F.max_by("edition", order)).scalar()
    return archive.where((F.col("indicator") == indicator) & (F.col("edition") == last)).select(
        expr.recode("entity").alias("entity"), "period", "value")


def archive_index(archive: DataFrame, partition: str = "edition") -> DataFrame:
    """Volume of every archived edition."""
    has = lambda c, column, kind: (column if c in archive.columns else F.lit(None)).cast(kind)
    return archive.groupBy(partition).agg(
        F.count(F.lit(1)).alias("values"), *[has(c, F.count_distinct(c), "bigint").alias(n) for c, n in (("entity", "entities"), ("indicator", "indicators"))],
        has("period", F.min("period"), "int").alias("first_period"), has("period", F.max("period"), "int").alias("last_period"))


def complement_editions(existing: DataFrame, served: DataFrame, main_editions: DataFrame, horizons: tuple[int, int] = (-2, 5)) -> DataFrame:
    """Editions the main source lacks: those served now replace their old copy, the rest stay.

    Rows: indicator, edition, entity, period, value. The main source always wins.
    """
    keys = ["indicator", "edition"]
    offset = F.col("period") - F.substring("edition", 2, 10).cast("int")
    fresh = served.where(offset.between(*horizons)).join(main_editions, keys, "left_anti")
    kept = existing.join(main_editions, keys, "left_anti").join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh)


def read_complement(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed copy of every edition. ``schema`` ends in the edition."""
    folder = Folder(spark, path)
    index = folder.index(COMPLEMENT_INDEX)
    if not folder.exists("_index"):
        return spark.createDataFrame([], schema)
    last = index.groupBy("edition").agg(F.max_by(F.struct("run", "present"), "run").alias("l")).where("l.present").select("edition", F.col("l.run").alias("run"))
    rows = spark.read.schema(f"{schema}, run int").parquet(folder.path)
    return rows.join(F.broadcast(last), ["run", "edition"], "left_semi").drop("run")  # a row per edition of the calendar


def update_complement(served: DataFrame, main_editions: DataFrame, path: str, horizons: tuple[int, int] = (-2, 5)) -> int:
    """Bring a written complement up to date; returns the run's number.

    Editions served now are written next to their old copies, as this run's; editions that the main source has since are marked as gone. The index row
    of the run makes both visible at once; the old copies go after that, so that a run that dies changes nothing for readers.
    """
    spark = served.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in served.schema if f.name != "edition") + ", edition string"
    folder = Folder(spark, path)
    run = (folder.index(COMPLEMENT_INDEX).agg(F.max("run")).first()[0] or 0) + 1
    existing = read_complement(spark, path, schema)
    columns = [c.split()[0] for c in schema.split(", ")]
    after = materialize(complement_editions(existing.select(*columns), served.select(*columns), main_editions, horizons), "complement")
    before = existing.select("edition").distinct().withColumn("old", F.lit(True))
    touched = served.select("edition").distinct().withColumn("fresh", F.lit(True))
    states = after.select("edition").distinct().withColumn("present", F.lit(True)).join(before, "edition", "full").join(touched, "edition", "left")
    gone_in_part = existing.join(main_editions, ["indicator", "edition"], "left_semi").select("edition").distinct().withColumn("less", F.lit(True))
    changed = materialize(states.join(gone_in_part, "edition", "left").where("fresh OR less OR present IS NULL OR old IS NULL").select(
        "edition", F.coalesce("present", F.lit(False)).alias("present")), "changed_editions")
    staging = f"_staging-{uuid.uuid4().hex}"
    after.join(F.broadcast(changed.where("present")), "edition", "left_semi").write.partitionBy("edition").parquet(f"{folder.path}/{staging}")
    folder.move(staging, f"run={run}")
    replaced = folder.index(COMPLEMENT_INDEX).where("present").join(changed, "edition", "left_semi").select("run", "edition").collect()  # editions are a calendar
    folder.commit(changed.select("edition", F.lit(run).alias("run"), "present"))
    for old in replaced:
        folder.remove(f"run={old.run}/edition={old.edition}")
    return run


def write_report(tables: Mapping[str, DataFrame], path: str, run: str) -> dict[str, str]:
    """The tables of a report under one run id."""
    written = {}
    for name, df in tables.items():
        written[name] = f"{path.rstrip('/')}/run={run}/{name}"
        df.write.mode("errorifexists").parquet(written[name])
    return written


def stamped(summary: DataFrame, start: int, end: int, forecast_end: int) -> DataFrame:
    """Published names that carry the bounds of the run."""
    dates = {"start": start, "end": end, "fcst": forecast_end}
    spans = {"hist": f"{start}_{end}", "fcst": f"{end}_{forecast_end}"}

    def renamed(c: str) -> str:
        head, _, tail = c.rpartition("_")
        if c.startswith("cagr_") and tail in spans:
            return f"{head}_{spans[tail]}"
        return f"{head}_{dates[tail]}" if head and tail in dates else c

    return summary.toDF(*[renamed(c) for c in summary.columns])


def provenance(observed: DataFrame, forecast: DataFrame, unified: DataFrame, summary: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row of volumes and non-missing counts, each table read once."""
    u = unified.agg(
        F.count(F.lit(1)).alias("unified_rows"), F.count_distinct("entity").alias("unified_entities"),
        F.count_distinct(F.when(F.col("is_aggregate"), F.col("entity"))).alias("excluded_aggregates"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        *[F.count(m).alias(f"known_{m}") for m in measures])
    return u.select(
        "*", observed.agg(F.count(F.lit(1))).scalar().alias("observed_rows"), forecast.agg(F.count(F.lit(1))).scalar().alias("forecast_rows"),
        summary.agg(F.count(F.lit(1))).scalar().alias("summary_entities"), summary.agg(F.count("rank_end")).scalar().alias("ranked_entities"))


def write_provenance(record: DataFrame, path: str, extra: Mapping[str, object] | None = None) -> None:
    """The record as one JSON line, with the run's own notes."""
    record.withColumn("notes", F.lit(json.dumps(dict(extra or {}), sort_keys=True))).write.mode("overwrite").json(path)
