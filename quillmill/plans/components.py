"""Connected components of a table of links, in Spark rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.storage import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root being the smallest node reachable.

    Large star and small star in turn: every node hangs its larger neighbours, then its
    smaller ones, under the smallest it knows, until only stars are left, which takes a
    number of rounds that is logarithmic in practice. Smallest neighbours are combined
    before the shuffle; the join that hands them back has a row per link and can be split
    by key. Every round is written out before the next. Links of a node to itself and links
    with a null are ignored.
    """
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = cut_lineage(links.where("a != b").select(*up).distinct())
    state = signature(stars)
    while state[0]:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, signature(stars)
        if state == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def signature(links: DataFrame) -> tuple:
    """How many links there are, and a sum of their hashes."""
    spread = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(spread)).first())


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``count`` by the links (a[i], b[i])."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, root):
            return root
        root = new
