"""Dense ids in sort order without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.plans.storage import cut_lineage

ROW_BITS = 33


def with_dense_ids(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order``.

    Range partitions are sorted on their own and numbered within; the offsets come from
    one count per partition, so only that many rows meet in one place. The checkpoint
    keeps the partition borders fixed between the count and the numbering.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is (partition number << 33) + row number in the partition
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", ROW_BITS)).withColumn(
        "_row", F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg((F.max("_row") + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_row") + start).cast("bigint"))
        .drop("_part", "_row", "_place", "_offset")
    )
