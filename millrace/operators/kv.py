"""Views of a key-value change log (seq, op, key, value); op is put or delete.

A log row hides all earlier rows of its key. Extra columns are ignored; rows
without key or seq change nothing; of rows with one seq the greater op, then the
greater value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "seq long, op string, key binary, value binary"


def newest(log: DataFrame, key: str = "key", order: tuple[str, ...] = ("seq",), columns: tuple[str, ...] = ("op", "value")) -> DataFrame:
    """The newest row of each key, tombstones included. max(struct) is combined before the shuffle, so a hot key sends one row a task."""
    ranked = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_row")
    kept = log.filter(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    return kept.groupBy(key).agg(ranked).select(key, *[F.col(f"_row.{c}") for c in dict.fromkeys((*order, *columns))])


def latest(log: DataFrame) -> DataFrame:
    """(key, value) of the live keys."""
    return newest(log).filter(F.col("op") != "delete").select("key", "value")


def between(view: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Rows with low <= key <= high; sorted by key. Keys compare as unsigned bytes."""
    return view.filter(F.col(key).between(low, high)).orderBy(key)


def starting(view: DataFrame, prefix, key: str = "key") -> DataFrame:
    return view.filter(F.startswith(F.col(key), F.lit(prefix))).orderBy(key)


def compact(log: DataFrame, keep_tombstones: bool = True) -> DataFrame:
    """The log with one row a key; without tombstones only if nothing older lies elsewhere."""
    rows = newest(log).select("seq", "op", "key", "value")
    return rows if keep_tombstones else rows.filter(F.col("op") != "delete")


def _size(column: str) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0))


def stats(log: DataFrame) -> DataFrame:
    """(op, entries, key_bytes, value_bytes) of a log."""
    return log.groupBy("op").agg(F.count("*").alias("entries"), F.sum(_size("key")).alias("key_bytes"), F.sum(_size("value")).alias("value_bytes"))


#: Files of level 0 that make a compaction due, and the bytes at which its outputs are cut.
LEVEL_FILES, OUTPUT_BYTES = 4, 2 << 20


def merge_level(log: DataFrame, path: str, output_bytes: int = OUTPUT_BYTES) -> DataFrame:
    """Moves the log to the next level: one row a key, tombstones kept, in files sorted by key whose ranges don't overlap.

    Returns (path, entries, bytes, min_key, max_key) of the files. Point and range reads
    touch few of them. Ranges are chosen so that a file gets about `output_bytes`.
    """
    rows = compact(log)
    sized = rows.withColumn("_bytes", F.lit(16) + _size("key") + _size("value"))
    total = sized.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    rows.repartitionByRange(max(1, -(-int(total) // output_bytes)), "key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path).withColumn("path", F.col("_metadata.file_path"))
    return written.groupBy("path").agg(F.count("*").alias("entries"), F.sum(F.lit(16) + _size("key") + _size("value")).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
