"""Readers with declared schemas, so no pass over the files goes into inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.vectorfiles import vector_lines

POSTS_RAW = """
    id long, lang string, created_at string, source string, text string, truncated boolean,
    extended_tweet struct<full_text: string>,
    user struct<id_str: string, name: string, location: string, description: string>,
    retweeted_status struct<text: string, truncated: boolean, extended_tweet: struct<full_text: string>>
"""
MAILS_RAW = (
    "`From` string, `To` array<string>, `Date` string, Subject string, msg_text string, msg_html string"
)
DOMAIN_CATEGORY = "domain_names string, required string"


def scan_json_lines(spark: SparkSession, path: str | list[str], schema: str = POSTS_RAW) -> DataFrame:
    """JSON objects, one per line; ``path`` may be a glob."""
    return spark.read.schema(schema).json(path)


def scan_json_lines_concat(spark: SparkSession, paths: list[str], schemas: list[str] | None = None) -> DataFrame:
    """Several JSON-lines files as one table; with unlike schemas, missing columns are null."""
    if schemas is None:
        return spark.read.json(paths)
    parts = [scan_json_lines(spark, path, schema) for path, schema in zip(paths, schemas, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_json_records(spark: SparkSession, path: str | list[str], schema: str = MAILS_RAW) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_text_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """One document per line; blank lines are left out unless asked for."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "text_data")
    return lines if keep_blank else lines.where(F.length(F.trim("text_data")) > 0)


def scan_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one document."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text_data")


def scan_category_csv(spark: SparkSession, path: str, schema: str = DOMAIN_CATEGORY) -> DataFrame:
    """The labelled domain list, with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_vectors(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Word vectors as (word, vector): Parquet, or text lines ``word x1 x2 ...``.

    A text file may start with its ``count dimension`` line; only a file's first line is taken
    for one. Large files are read in ranges of bytes.
    """
    if form == "parquet":
        return spark.read.parquet(path).select("word", F.col("vector").cast("array<float>"))
    if form != "text":
        raise ValueError(f"unknown form {form!r}: use 'parquet' or 'text'")
    parts = F.split(F.rtrim(F.col("value")), " ")
    return vector_lines(spark, path).select(
        parts[0].alias("word"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vector"),
    )
