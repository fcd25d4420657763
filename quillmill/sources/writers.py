"""Writers; like Spark's own they fail when the target is there already, unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line and no index column; quotes are doubled inside a field."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sink_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, null fields kept, so that every record has every field."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name a table for SQL; returns the named table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def preview_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows, untruncated."""
    return df.limit(n)
