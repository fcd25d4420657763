"""Vocabulary sizes by sketches that are kept and merged later.

A sketch is a column of some kilobytes, whatever it has counted; those of new sources or days are
merged with the ones already written, without reading the texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# base-2 logarithm of a sketch's number of cells
CELLS = 14


def relative_error(cells: int = CELLS) -> float:
    """The standard error of an estimate, in parts of the exact count; also that of a merged sketch."""
    return 1.04 / 2 ** (cells / 2)


def vocab_sketches(bag: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """(keys, sketch): the different terms of each group of a (keys, term) table; null terms do not count."""
    return bag.groupBy(*keys).agg(F.hll_sketch_agg("term", F.lit(cells)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per group of ``keys``, or one for all, of the sketches given; the tables they came from stay unread."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_sizes(sketches: DataFrame) -> DataFrame:
    """The keys and the estimated ``vocab_size`` of each sketch."""
    keys = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keys, F.hll_sketch_estimate("sketch").alias("vocab_size"))
