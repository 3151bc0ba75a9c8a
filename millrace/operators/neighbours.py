"""The row before and the row behind, within groups of any size.

A window over a group is one task's work, and one group may hold a third of all
rows. So rows are laid out by ranges of (group, order); neighbours are looked up
within a range, and across ranges by way of the ranges' first and last rows, of
which a group has no more than there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def with_neighbours(df: DataFrame, group: list[str], order: list[str], value: str, before: str = "before", behind: str = "behind", ranges: int | None = None) -> DataFrame:
    """df with the `value` of the row before and behind each row in its group; null at the group's ends.

    `order` should tell all rows of a group apart; the value breaks ties.
    """
    spark = df.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(dict.fromkeys([*order, value]))
    laid = materialize(df.repartitionByRange(count, *group, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    rank = F.struct(*keys)
    edges = laid.groupBy(*group, "_range").agg(F.min(rank).alias("_low"), F.max(rank).alias("_high"))
    between = Window.partitionBy(*group).orderBy("_range")
    edges = edges.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_range").alias("_r"),
        F.lag(f"_high.{value}").over(between).alias("_near_before"),
        F.lead(f"_low.{value}").over(between).alias("_near_behind"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*keys)
    near = laid.withColumn(before, F.lag(value).over(inside)).withColumn(behind, F.lead(value).over(inside))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return near.join(edges, same, "left").select(*df.columns, F.coalesce(before, "_near_before").alias(before), F.coalesce(behind, "_near_behind").alias(behind))
