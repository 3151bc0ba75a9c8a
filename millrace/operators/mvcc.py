"""Multi-version views and transactions over versions (key, value, txn_id, commit_ts, op).

Versions are stamped when their transaction commits. A snapshot sees, of each key,
the newest version whose stamp isn't after it; a delete hides the key. Isolation is
that of snapshots under every level name, and of two transactions that change the
same key at the same time the first to commit wins.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import ConflictError, InvalidInput, TransactionError
from millrace.operators.kv import newest
from millrace.session import fresh_path
from millrace.sources.versioned import VersionedTable

VERSIONS = "key binary, value binary, txn_id long, commit_ts long, op string"
LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


def as_of(versions: DataFrame, ts, key: str = "key", order: tuple[str, ...] = ("commit_ts",), columns: tuple[str, ...] = ("op", "value")) -> DataFrame:
    """The live rows of a snapshot; the stamp filter reaches the scan."""
    return newest(versions.filter(F.col(order[0]) <= F.lit(ts)), key, order, columns).filter(F.col("op") != "delete").drop("op")


def scan(versions: DataFrame, ts, prefix, key: str = "key") -> DataFrame:
    """(key, value) of a snapshot whose key starts with the prefix, in key order."""
    kept = versions.filter(F.startswith(F.col(key), F.lit(prefix)))
    return as_of(kept, ts, key).select(key, "value").orderBy(key)


def collectable(versions: DataFrame, oldest, key: str = "key", order: tuple[str, ...] = ("commit_ts",)) -> DataFrame:
    """The versions to keep: all after the oldest active snapshot, and of each key the newest that it sees."""
    old = versions.filter(F.col(order[0]) <= F.lit(oldest))
    others = tuple(c for c in versions.columns if c != key)
    kept = newest(old, key, order, others).select(*versions.columns)
    return versions.filter(F.col(order[0]) > F.lit(oldest)).unionByName(kept)


class Transaction:
    def __init__(self, store: Transactions, number: int, snapshot: int, level: str):
        self.store, self.number, self.snapshot, self.level = store, number, snapshot, level
        self.writes: dict[bytes, bytes | None] = {}
        self.open = True

    def _check(self) -> None:
        if not self.open:
            raise TransactionError("the transaction has ended")

    def get(self, key: bytes) -> bytes | None:
        self._check()
        if key in self.writes:
            return self.writes[key]
        rows = as_of(self.store.versions().filter(F.col("key") == F.lit(bytearray(key))), self.snapshot).select("value").head(1)
        return bytes(rows[0][0]) if rows else None

    def put(self, key: bytes, value: bytes) -> None:
        self._check()
        self.writes[bytes(key)] = bytes(value)

    def delete(self, key: bytes) -> None:
        self._check()
        self.writes[bytes(key)] = None

    def scan(self, prefix: bytes = b"") -> DataFrame:
        """(key, value) as the transaction sees it, its own writes included."""
        self._check()
        spark = self.store.spark
        seen = as_of(self.store.versions(), self.snapshot).select("key", "value")
        if self.writes:
            own = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None) for k, v in self.writes.items()], "key binary, value binary, gone boolean")
            seen = seen.join(own.select("key"), "key", "left_anti").unionByName(own.filter("not gone").select("key", "value"))
        return seen.filter(F.startswith(F.col("key"), F.lit(bytearray(prefix)))).orderBy("key")

    def commit(self) -> int | None:
        self._check()
        return self.store._commit(self)

    def rollback(self) -> None:
        self._check()
        self.writes.clear()
        self.store._end(self)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()


class Transactions:
    """A version table in a directory; a commit appends one batch, atomically."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.table = VersionedTable(spark, root or fresh_path(spark, "versions"))
        self.lock = threading.Lock()
        self.next = 1
        head = self.table.head()
        self.clock = head["clock"] if head else 0
        self.active: dict[int, Transaction] = {}
        self.committed: list[tuple[int, frozenset[bytes]]] = []

    def versions(self) -> DataFrame:
        return self.table.read() if self.table.head() else self.spark.createDataFrame([], VERSIONS)

    def begin(self, level: str = "serializable") -> Transaction:
        if level.lower() not in LEVELS:
            raise InvalidInput(f"a level is one of {', '.join(LEVELS)}")
        with self.lock:
            txn = Transaction(self, self.next, self.clock, level.lower())
            self.next += 1
            self.active[txn.number] = txn
            return txn

    def _end(self, txn: Transaction) -> None:
        txn.open = False
        self.active.pop(txn.number, None)
        least = min((t.snapshot for t in self.active.values()), default=self.clock)
        self.committed = [(ts, keys) for ts, keys in self.committed if ts > least]

    def _commit(self, txn: Transaction) -> int | None:
        with self.lock:
            mine = frozenset(txn.writes)
            if any(ts > txn.snapshot and keys & mine for ts, keys in self.committed):
                self._end(txn)
                raise ConflictError("another transaction has changed one of the keys")
            if not mine:
                self._end(txn)
                return None
            ts = self.clock + 1
            rows = [(bytearray(k), None if v is None else bytearray(v), txn.number, ts, "delete" if v is None else "put") for k, v in txn.writes.items()]
            self.table.append(self.spark.createDataFrame(rows, VERSIONS).coalesce(1), self.table.head(), clock=ts)
            self.clock = ts
            self.committed.append((ts, mine))
            self._end(txn)
            return ts

    def gc(self) -> int:
        """Drops versions that no active snapshot can see; returns how many."""
        with self.lock:
            if self.table.head() is None:
                return 0
            oldest = min((t.snapshot for t in self.active.values()), default=self.clock)
            before = self.versions()
            kept = collectable(before, oldest)
            count = before.count()
            folder, onto = self.table.new_folder(), self.table.head()
            kept.write.parquet(folder)
            self.table.commit(folder, onto, folders=[folder], clock=self.clock)
            return count - self.versions().count()
