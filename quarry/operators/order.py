"""Places in an order, counted over range partitions, so that no group has to fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def places(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 1, of each row in its group's order.

    Rows are spread by ranges of (group, order) and written once; a row's place is its number within its range and
    group plus the rows of the group in earlier ranges. ``order`` should be unique within a group.
    """
    keys = [F.col(group), *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, [group, "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("place"))
