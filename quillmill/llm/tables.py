"""Reading the given tables and writing intermediate ones to the folder all executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.plans.shipping import ship
from quillmill.plans.storage import new_path


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with workers that know this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shielded(df: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns called like one of ``names`` put under other names, and the way back."""
    away = {c: f"_kept_{i}" for i, c in enumerate(df.columns) if c.lower() in names}
    return df.withColumnsRenamed(away), {b: a for a, b in away.items()}
