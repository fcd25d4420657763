"""Joins from a large table to a keyed lookup table that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_key_salts(counts: DataFrame, key: str, slices: int) -> DataFrame:
    """(key, _salts): into how many slices each key with over 1/slices of all rows is cut.

    There are fewer than ``slices`` such keys, and their salts sum to at most twice as many,
    so the table has a bounded size and leaves no hot key out.
    """
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") * slices / total.scalar()
    return counts.where(F.col(key).isNotNull() & (share > 1)).select(key, F.ceil(share).cast("int").alias("_salts"))


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` to a lookup table on ``key``, reading ``facts`` once.

    Whether the lookup is broadcast goes by its size in bytes, as the session has it; else
    adaptive execution splits the partitions of hot keys, on the side of the facts. A missing
    key matches nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    return facts.join(lookup, key, how)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: list[str],
    counts: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on ``key``, splitting the heaviest keys by plan.

    For joins whose result goes on to a costly step, when the caller has a (key, n) table of
    ``counts``, written out once. Keys with over a partition's share of rows get a salt from
    the ``spread`` columns, and their lookup rows one copy per salt; all other keys meet
    under salt 0. No row is dropped, and duplicates on either side are kept.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    slices = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_key_salts(counts, key, slices))
    slice_of = F.xxhash64(*spread)
    # a missing key matches nothing; spread its rows as well
    salts = F.when(F.col(key).isNull(), F.lit(slices)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_facts = facts.join(heavy, key, "left").withColumn(
        "_salt", F.pmod(slice_of, salts).cast("int")
    ).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_lookup = lookup.join(heavy, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_facts.join(salted_lookup, [key, "_salt"], how).drop("_salt")
