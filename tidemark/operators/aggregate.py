"""Counts over visible, resolved rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.context import QueryError

MAX_FIELDS = 256


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def exists(rows: DataFrame) -> DataFrame:
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def grouped_count(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows by fields; null is the missing group, as no null value exists.  Missing sorts first."""
    if not fields or len(set(fields)) < len(fields) or len(fields) > MAX_FIELDS:
        raise QueryError("group by 1 to 256 different fields")
    return rows.groupBy(*fields).agg(F.count("*").alias("n"))


def within(rows: DataFrame, limit: int, what: str = "results") -> DataFrame:
    """rows, or an error if there are more than ``limit``: results are never cut."""
    if rows.limit(limit + 1).count() > limit:
        raise QueryError(f"more than {limit} {what}")
    return rows


def one_kind(rows: DataFrame, kind: str) -> None:
    """Refuses a column whose values are of several kinds."""
    if rows.select(kind).filter(F.col(kind).isNotNull()).distinct().limit(2).count() > 1:
        raise QueryError("values of several kinds in one group column")


def unique_keys(rows: DataFrame, key: str) -> None:
    """Refuses repeated result keys."""
    if not rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1).isEmpty():
        raise QueryError("a result key occurs twice")


def contributors(resolved: DataFrame) -> DataFrame:
    """Distinct assertions that contribute to resolved slots."""
    ids = F.explode(F.split("contributors", ",").cast("array<long>"))
    return resolved.filter(F.col("contributors") != "").select(ids.alias("assertion_id")).distinct()
