"""Row numbers inside groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise


def range_numbers(df: DataFrame, group: str, order: list[Column], number: str, size: str | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group, and the group's size.

    Rows are dealt to tasks by ranges of (group, order) and numbered inside their range; the counts of the
    ranges before it are added. So a group may span any number of tasks. ``order`` must leave no ties.
    """
    dealt = df.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")  # the range of a row must not change between its two uses
    counts = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part")
    counts = counts.select(
        "_group",
        "_part",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_group")).alias("_size"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part"))
    out = dealt.withColumn("_inside", inside).join(counts, same)
    cols = [F.col(c) for c in df.columns] + [(F.col("_before") + F.col("_inside")).alias(number)]
    return out.select(*cols, *([F.col("_size").alias(size)] if size else []))


def placed(ordered: DataFrame, place: str = "place") -> DataFrame:
    """``ordered`` with the place (from 1) of each row in the order that it has.

    Rows are numbered inside their partition, and the sizes of the partitions before it, one number each, are added.
    """
    rows = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = rows.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part")
    inside = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return out.select(*[F.col(c) for c in ordered.columns], (F.col("_before") + inside + 1).alias(place))
