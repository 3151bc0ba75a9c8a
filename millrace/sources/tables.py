"""Parquet tables of a directory, and rows given by the caller."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory of Parquet files; the scan is lazy and prunes columns and row groups."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows in memory as a table; the schema is given, never guessed, so that an empty table has one too."""
    return spark.createDataFrame(list(rows), schema)


def write_sorted(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """Writes files that are sorted by key and whose key ranges don't overlap, for point and range reads."""
    count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(count, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
