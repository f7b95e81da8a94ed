"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vintara.plans.oracle import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None, doubles: str = "", digits: int = 4) -> None:
    """Add a query; both engines publish the listed double columns rounded alike."""
    columns = doubles.split()

    def published(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns}) if columns else df

    QUERIES[name] = published
    if sql is not None:
        body = sql
        if columns:
            rounded = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in columns)
            body = f"SELECT * REPLACE ({rounded}) FROM ({sql.strip()})"
        ORACLES[name] = with_ctes(body)
