"""Session set-up and materialisation of tables that several operators reuse."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vintara")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Exact percentiles of many small groups: keep hashing instead of sorting the rows.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the session (``spark.checkpoint.dir``).

    Only a local session may fall back on a folder of its own: on a cluster, a table
    written to one machine is lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    cached = _LOCAL_FOLDERS.get(spark.sparkContext.applicationId)
    if cached is None:
        cached = tempfile.mkdtemp(prefix="vintara-", dir="/tmp")
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = cached
    return cached


_LOCAL_FOLDERS: dict[str, str] = {}


ROWS_A_TASK = 200_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``key`` to tasks of bounded size where there are more of them than cores.

    Sorts and windows of wide rows take memory by a task's rows; adaptive execution sizes tasks by compressed bytes, which
    rows that repeat each other have few of. Fewer rows are left to it.
    """
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def materialize(df: DataFrame, name: str, partitions_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, keeps column pruning and filter
    pushdown for the readers, and gives Spark the true size of the table, so that small
    ones are broadcast by the size check of the planner rather than by a hint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partitions_by else spark.read.parquet(path)
