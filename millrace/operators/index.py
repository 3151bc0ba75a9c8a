"""Secondary indexes: multi-maps from keys to row ids, as tables (index, seq, key, row_id).

An index is a log like the key-value one: an insert adds a row, a removal is a
tombstone that hides all rows of its key with a smaller seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidInput, InvalidOperation, NotFound
from millrace.limits import check_index_name

KINDS = ("btree", "hash")


def entries(log: DataFrame) -> DataFrame:
    """Rows that no later removal hides. log: (seq, op, key, row_id), op insert or remove."""
    gone = log.filter(F.col("op") == "remove").groupBy("key").agg(F.max("seq").alias("gone"))
    inserted = log.filter(F.col("op") == "insert")
    return inserted.join(gone, "key", "left").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).select("key", "row_id", "seq")


def find(index: DataFrame, key) -> DataFrame:
    """Row ids of one key, oldest first."""
    return index.filter(F.col("key") == F.lit(key)).orderBy("seq", "row_id").select("row_id")


def search(index: DataFrame, low, high) -> DataFrame:
    """(key, row_id) with low <= key <= high, in the order of keys, then of insertion.

    A row an entry and not a list a key: one key may hold a large part of an index.
    """
    return _ordered(index.filter(F.col("key").between(low, high)))


def prefixed(index: DataFrame, prefix) -> DataFrame:
    return _ordered(index.filter(F.startswith(F.col("key"), F.lit(prefix))))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key", "seq", "row_id").select("key", "row_id")


def bounds(index: DataFrame) -> DataFrame:
    return index.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def info(index: DataFrame, name: str, kind: str) -> DataFrame:
    """(name, kind, entry_count, key_count)"""
    return index.agg(F.count("*").alias("entry_count"), F.countDistinct("key").alias("key_count")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "entry_count", "key_count")


def lookup_join(left: DataFrame, index: DataFrame, left_key: str) -> DataFrame:
    """left with the row ids of its key: the many finds of an application as one equi-join."""
    return left.join(index.select(F.col("key").alias("_key"), "row_id"), F.col(left_key) == F.col("_key")).drop("_key")


class Indexes:
    """Named indexes; changes gather on the driver and join the table in batches."""

    BATCH, BATCH_BYTES = 10_000, 4 << 20

    def __init__(self, spark):
        self.spark = spark
        self.kinds: dict[str, str] = {}
        self.tables: dict[str, DataFrame] = {}
        self.pending: dict[str, list[tuple]] = {}
        self.bytes: dict[str, int] = {}
        self.seq = 0
        self.schema = "seq long, op string, key binary, row_id long"

    def create(self, name: str, kind: str = "btree") -> None:
        check_index_name(name)
        kind = kind.lower()
        if kind not in KINDS:
            raise InvalidInput(f"an index is one of {', '.join(KINDS)}")
        if name in self.kinds:
            raise InvalidOperation(f"index {name} is there already")
        self.kinds[name], self.pending[name] = kind, []
        self.tables[name] = self.spark.createDataFrame([], self.schema)

    def drop(self, name: str) -> bool:
        for held in (self.tables, self.pending):
            held.pop(name, None)
        return self.kinds.pop(name, None) is not None

    def _known(self, name: str) -> None:
        if name not in self.kinds:
            raise NotFound(f"unknown index {name}")

    def _add(self, name: str, op: str, key: bytes, row_id: int | None) -> None:
        self._known(name)
        self.seq += 1
        self.pending[name].append((self.seq, op, bytearray(key), row_id))
        self.bytes[name] = self.bytes.get(name, 0) + len(key)
        if len(self.pending[name]) >= self.BATCH or self.bytes[name] >= self.BATCH_BYTES:
            self._flush(name)

    def _flush(self, name: str) -> None:
        from millrace.session import materialize

        if self.pending[name]:
            more = self.spark.createDataFrame(self.pending[name], self.schema)
            self.tables[name] = materialize(self.tables[name].unionByName(more), "index")
            self.pending[name], self.bytes[name] = [], 0

    def insert(self, name: str, key: bytes, row_id: int) -> None:
        self._add(name, "insert", key, row_id)

    def remove(self, name: str, key: bytes) -> bool:
        there = not self.find(name, key).isEmpty()
        if there:
            self._add(name, "remove", key, None)
        return there

    def entries(self, name: str) -> DataFrame:
        self._known(name)
        self._flush(name)
        return entries(self.tables[name])

    def find(self, name: str, key: bytes) -> DataFrame:
        return find(self.entries(name), bytearray(key))

    def range(self, name: str, low: bytes, high: bytes) -> DataFrame:
        return search(self.ordered(name), bytearray(low), bytearray(high))

    def prefix(self, name: str, prefix: bytes) -> DataFrame:
        return prefixed(self.ordered(name), bytearray(prefix))

    def bounds(self, name: str) -> DataFrame:
        return bounds(self.ordered(name))

    def contains(self, name: str, key: bytes) -> bool:
        return not self.find(name, key).isEmpty()

    def clear(self, name: str) -> None:
        self._known(name)
        self.pending[name] = []
        self.tables[name] = self.spark.createDataFrame([], self.schema)

    def ordered(self, name: str) -> DataFrame:
        self._known(name)
        if self.kinds[name] != "btree":
            raise InvalidOperation(f"index {name} has no order")
        return self.entries(name)

    def names(self) -> list[str]:
        return sorted(self.kinds)

    def info(self, name: str) -> DataFrame:
        return info(self.entries(name), name, self.kinds[name])
