"""Predicates, joins and counts of the post and mail tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.joins import lookup_join


def flag_prefix(text: Column, prefix: str = "RT") -> Column:
    """``Y`` when the text starts with the prefix, else ``N`` (also for a missing text)."""
    return F.when(F.substring(text, 1, len(prefix)) == prefix, "Y").otherwise("N")


def pick_full_text(
    is_retweet: Column,
    retweet_truncated: Column,
    retweet_full: Column,
    retweet_text: Column,
    truncated: Column,
    full: Column,
    text: Column,
) -> Column:
    """The text that is not cut off; null when the truncation flag is missing."""
    return (
        F.when((is_retweet == "Y") & retweet_truncated, retweet_full)
        .when((is_retweet == "Y") & ~retweet_truncated, retweet_text)
        .when((is_retweet != "Y") & truncated, full)
        .when((is_retweet != "Y") & ~truncated, text)
    )


def fill_nulls(df: DataFrame, value: str) -> DataFrame:
    """Every null of every column becomes ``value``; other types turn into strings."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) for c in df.columns])


def left_join_category(
    mails: DataFrame, categories: DataFrame, fill: str | None = "na"
) -> DataFrame:
    """Mails with the manual label of their domain.

    A domain that is listed twice multiplies its mails; ``fill`` replaces all nulls after.
    """
    labels = fill_nulls(categories.select("domain_names", "required"), "n")
    joined = lookup_join(mails, labels.withColumnRenamed("domain_names", "domain"), "domain", "left")
    return joined if fill is None else fill_nulls(joined, fill)


def non_null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of non-null values of each column."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns])


def distinct_domains(mails: DataFrame, since: str) -> DataFrame:
    """The domains of all mails since a day."""
    return mails.where(F.col("only_Date") >= since).select(F.col("domain").alias("domain_names")).distinct()


def emails_by_year(mails: DataFrame) -> DataFrame:
    """Mails per year of the ``yyyy-MM-dd`` day column."""
    return (
        mails.where(F.col("only_Date").isNotNull())
        .groupBy(F.substring("only_Date", 1, 4).cast("int").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables on top of each other, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
