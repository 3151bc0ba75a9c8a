"""Applying a feed of inserts, updates and deletes (problem 1).

Every change is (key columns, eff, tie, live, payload columns): `eff` is where
it takes effect, `tie` orders changes that take effect at one place, `live` is
True for a put and False for a delete. The last change of a key decides.

Method: a table in an embedded DuckDB per bucket is the state. Changes are
inserted with ON CONFLICT DO UPDATE under the condition that the new change comes
later than the stored one, so repeated and out-of-order changes do no harm.
Tombstones are rows with live = False and stay in the state: a change older than
the delete may still arrive. The same upsert runs first in each map task, as a
combiner, so that a key sends one row per task through the shuffle, however hot
it is; then once per bucket, a hash partition of the keys. The buckets are
written to a new folder of a versioned table, which one rename publishes. A
later feed reads and rewrites only the buckets that it touches. When the state has
outgrown its buckets, the next feed lays all of it out in more of them.

Defined results: a change with a null key, eff or live is no change; an empty
feed gives an empty table; of changes with equal (eff, tie) a put goes before
a delete, then the greatest payload (as bytes or text); columns of the feed that
are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import NotFound
from millrace.functions.text import folded
from millrace.session import discard, fresh_path, materialize, partitions_for, ship
from millrace.sources.versioned import VersionedTable

#: Bytes of Parquet that one bucket gets; its state, some ten times that, then fits a worker's memory. DuckDB may not spill.
BUCKET_BYTES = 16 << 20
#: Keys that a combiner holds before it hands them on.
COMBINER_KEYS = 500_000

#: The record types of the log and the numbers that older writers put in their place.
LOG_TYPES = {"put": "1", "delete": "2", "begintx": "3", "committx": "4", "checkpoint": "5"}

DUCKDB_TYPES = {T.StringType: "VARCHAR", T.BinaryType: "BLOB", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE"}


class _State:
    """The upsert state of one bucket or one combiner."""

    def __init__(self, schema: T.StructType, keys: Sequence[str]):
        import duckdb

        self.names = schema.names
        quoted = [f'"{x}"' for x in self.names]
        key = ", ".join(f'"{x}"' for x in keys)
        rest = [x for x in self.names if x not in keys]
        payload = [f'"{x}"' for x in rest if x not in ("eff", "tie", "live")]
        order = lambda of: "(" + ", ".join(f"{of}{x}" for x in ("eff", "tie", "live")) + ")"
        later = f"{order('excluded.')} > {order('state.')}"
        if payload:
            # a null payload counts as the least
            rank = lambda of: "(" + ", ".join(f"{of}{x} IS NOT NULL, {of}{x}" for x in payload) + ")"
            later += f" OR ({order('excluded.')} = {order('state.')} AND {rank('excluded.')} > {rank('state.')})"
        tail = "".join(f", {x} DESC NULLS LAST" for x in payload)
        columns = ", ".join(f'"{f.name}" {DUCKDB_TYPES[type(f.dataType)]}' for f in schema)
        self.create = f"CREATE OR REPLACE TABLE state ({columns}, PRIMARY KEY ({key}))"
        self.upsert = (
            f"INSERT INTO state SELECT {', '.join(quoted)} FROM batch "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY eff DESC, tie DESC, live DESC{tail}) = 1 "
            f"ON CONFLICT ({key}) DO UPDATE SET " + ", ".join(f'"{x}" = excluded."{x}"' for x in rest) + f" WHERE {later}"
        )
        self.db = duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": False, "memory_limit": "1GB", "temp_directory": ""})
        self.db.execute(self.create)

    def add(self, batch: pa.RecordBatch) -> None:
        table = pa.Table.from_batches([batch])
        self.db.register("batch", table)
        self.db.execute(self.upsert)
        self.db.unregister("batch")

    def keys(self) -> int:
        return self.db.execute("SELECT count(*) FROM state").fetchall()[0][0]  # all rows: an unfinished result would block the connection

    def export(self) -> Iterator[pa.RecordBatch]:
        reader = self.db.sql("SELECT * FROM state").to_arrow_reader(65_536)
        yield from reader


def _upserter(schema: T.StructType, keys: Sequence[str], most: int | None):
    """A mapInArrow function; `most` keys are held at once by a combiner, a bucket holds all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            state = state or _State(schema, keys)
            state.add(batch)
            rows += batch.num_rows
            if most and rows >= most:
                rows = state.keys()
                if rows >= most // 2:
                    yield from state.export()
                    state.db.close()
                    state, rows = None, 0
        if state:
            yield from state.export()
            state.db.close()

    return run


def _whole(changes: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    rows = changes.select(*keys, F.col("eff").cast("long").alias("eff"), F.col("tie").cast("long").alias("tie"), F.col("live").cast("boolean").alias("live"), *payload)
    for c in (*keys, "eff", "live"):
        rows = rows.filter(F.col(c).isNotNull())
    return rows.withColumn("tie", F.coalesce("tie", F.lit(-(2**63))))


def _combined(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At most a row a key and task, of rows that are whole."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_upserter(rows.schema, list(keys), COMBINER_KEYS), rows.schema)


def _settled(combined: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    return combined.repartitionById(count, bucket_of(keys, count)).mapInArrow(_upserter(combined.schema, list(keys), None), combined.schema)


def latest_changes(changes: DataFrame, keys: Sequence[str], payload: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """One row for each key: its last change, tombstones included; laid out by bucket."""
    return _settled(_combined(_whole(changes, keys, payload), keys), keys, buckets or partitions_for(changes, BUCKET_BYTES))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class ChangeFeedTable:
    """A table kept by applying change feeds to it; any order of the feeds gives the same state.

    The number of buckets comes from the first feed (or is given) and is kept with the
    table, which lays itself out anew when feeds and state have outgrown it; every
    commit names the folder and size of each bucket.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], payload: Sequence[str] = (), buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES):
        self.keys, self.payload, self.buckets, self.bucket_bytes = list(keys), list(payload), buckets, bucket_bytes
        self.table = VersionedTable(spark, root)
        self.spark = spark

    def _read(self, places: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*sorted(f"{folder}/bucket={k}" for k, folder in places.items()))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.table.head()["schema"])

    def apply(self, changes: DataFrame, **facts) -> dict:
        """Applies the feed to the current version and publishes the next one, all touched buckets at once; `facts` are published with it."""
        feed = _combined(_whole(changes, self.keys, self.payload), self.keys)
        onto, used = self.table.head(), []
        places: dict[str, str] = dict(onto["places"]) if onto else {}
        sizes: dict[str, int] = dict(onto["sizes"]) if onto else {}
        count = onto["buckets"] if onto else self.buckets or partitions_for(changes, self.bucket_bytes)
        if places:
            feed = materialize(feed, "feed", used)  # once, for its buckets and for the state
            needed = -(-(sum(sizes.values()) + self.table.files.size(used[0])) // self.bucket_bytes)
            if needed > 2 * count:
                count, touched = 1 << int(needed - 1).bit_length(), set(places)
                held, places, sizes = places, {}, {}
            else:
                # at most as many numbers as there are buckets
                held = places
                touched = {str(r[0]) for r in feed.select(bucket_of(self.keys, count)).distinct().collect()} & places.keys()
            if touched:
                feed = feed.unionByName(self._read({k: held[k] for k in touched}).select(*feed.columns))
        folder = self.table.new_folder()
        state = _settled(feed, self.keys, count)
        state.withColumn("bucket", bucket_of(self.keys, count)).write.partitionBy("bucket").parquet(folder)
        for name in self.table.files.names(folder):
            if name.startswith("bucket="):
                k = name.partition("=")[2]
                places[k], sizes[k] = folder, self.table.files.size(f"{folder}/{name}")
        entry = self.table.commit(folder, onto, buckets=count, places=places, sizes=sizes, schema=feed.schema.jsonValue(), **facts)
        discard(self.spark, used)
        return entry

    def state(self) -> DataFrame:
        """The last change of every key, with tombstones."""
        head = self.table.head()
        if head is None:
            raise NotFound(f"nothing has been applied to {self.table.root}")
        return self._read(head["places"]) if head["places"] else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """The live rows."""
        return self.state().filter("live")


def log_kind(*kinds: str, column: str = "entry_type") -> Column:
    """Whether a record is of one of the kinds, however spelled; false for records of no known kind."""
    return F.coalesce(folded(F.col(column)).isin([x for k in kinds for x in (k, LOG_TYPES[k])]), F.lit(False))


def store_changes(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The changes of a log and of sorted files, each where it takes effect.

    A log change of a transaction takes effect at the transaction's commit (at
    the first, should there be several) or never. A sorted file's entry is the last
    change of its key at its place. The commits are joined to the transactional
    changes only; the join is left to adaptive execution, which broadcasts the
    commits if they turn out small and splits hot transactions if not.
    """
    puts = log.filter(F.col("key").isNotNull() & log_kind("put", "delete"))
    live = log_kind("put").alias("live")
    plain = puts.filter(F.col("tx_id").isNull()).select("db_name", "key", F.col("seq").alias("eff"), F.col("seq").alias("tie"), live)
    commits = log.filter(F.col("tx_id").isNotNull() & log_kind("committx")).groupBy("db_name", "tx_id").agg(F.min("seq").alias("eff"))
    within = (
        puts.filter(F.col("tx_id").isNotNull())
        .select("db_name", "tx_id", "key", F.col("seq").alias("tie"), live)
        .join(commits, ["db_name", "tx_id"])
        .select("db_name", "key", "eff", "tie", "live")
    )
    stored = entries.filter(F.col("entry_type").isin(0, 1)).select(
        "db_name", "key", F.col("sequence").alias("eff"), F.lit(2**63 - 1).alias("tie"), F.coalesce(F.col("entry_type") == 0, F.lit(False)).alias("live")
    )
    return plain.unionByName(within).unionByName(stored)


def current_keys(log: DataFrame, entries: DataFrame) -> DataFrame:
    """(db_name, key_hex, seq) of every live key, through a freshly published table."""
    spark = log.sparkSession
    table = ChangeFeedTable(spark, fresh_path(spark, "changefeed"), ["db_name", "key"])
    table.apply(store_changes(log, entries))
    return table.current().select("db_name", F.hex("key").alias("key_hex"), F.col("eff").alias("seq"))
