"""A write-ahead log (seq, op, tx_id, key, value, ...) and its recovery.

op is put, delete, begin, commit or checkpoint. Records without tx_id stand for
themselves; those of a transaction count once it has a commit record. Records
with a checksum that doesn't fit end the replay: what lies behind them is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.errors import NotFound
from millrace.operators.kv import latest
from millrace.session import discard, materialize
from millrace.sources.versioned import VersionedTable

RECORD = ("op", "tx_id", "key", "value")


def checksum(columns: tuple[str, ...] = RECORD) -> Column:
    """CRC-32 of a record. Lengths go before the parts, and null differs from empty."""
    parts = []
    for c in columns:
        text = F.hex(F.col(c).cast("binary") if c in ("key", "value") else F.col(c).cast("string"))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.crc32(F.concat(*parts).cast("binary"))


def sealed(log: DataFrame) -> DataFrame:
    """log with the column crc."""
    return log.withColumn("crc", checksum())


def intact(log: DataFrame, of: str | None = None) -> DataFrame:
    """The records before the first whose checksum doesn't fit, in each log that the column `of` tells apart.

    Damaged places are few, a row a damaged log; they are joined to the records.
    """
    damaged = log.filter(~F.col("crc").eqNullSafe(checksum()))
    if of is None:
        end = damaged.agg(F.min("seq")).first()[0]
        return log if end is None else log.filter(F.col("seq") < F.lit(end))
    ends = damaged.groupBy(F.col(of).alias("_of")).agg(F.min("seq").alias("_end"))
    return log.join(ends, log[of].eqNullSafe(F.col("_of")) & (F.col("seq") >= F.col("_end")), "left_anti")


def committed(log: DataFrame) -> DataFrame:
    """(tx_id) of transactions with a commit record."""
    return log.filter((F.col("op") == "commit") & F.col("tx_id").isNotNull()).select("tx_id").distinct()


def recover(log: DataFrame, markers: bool = False) -> DataFrame:
    """The records that count.

    Without markers: puts and deletes, with the columns `stage` and `place` that give
    the order of their replay: what stands alone, then transactions by tx_id (a number
    or a text), each by seq.
    With markers: all records but those of unfinished transactions, in the order of seq.
    """
    done = committed(log)
    alone = log.filter(F.col("tx_id").isNull())
    within = log.filter(F.col("tx_id").isNotNull()).join(done, "tx_id", "left_semi").select(*log.columns)
    if markers:
        return alone.unionByName(within)
    changes = F.col("op").isin("put", "delete")
    return (
        alone.filter(changes).withColumns({"stage": F.lit(0), "place": F.col("tx_id")})
        .unionByName(within.filter(changes).withColumns({"stage": F.lit(1), "place": F.col("tx_id")}))
    )


def replay(log: DataFrame) -> DataFrame:
    """(key, value) after recovery; the order of replay is one struct, no global sort."""
    ordered = recover(log).select(F.struct("stage", "place", "seq").alias("seq"), "op", "key", "value")
    return latest(ordered)


def stats(log: DataFrame) -> DataFrame:
    """(op, records) of each record type, and of unfinished transactions as op "incomplete"."""
    kinds = log.groupBy("op").agg(F.count("*").alias("records"))
    begun = log.filter(F.col("tx_id").isNotNull()).select("tx_id").distinct()
    open_ = begun.join(committed(log), "tx_id", "left_anti").agg(F.count("*").alias("records")).select(F.lit("incomplete").alias("op"), "records")
    return kinds.unionByName(open_)


def segments(files: DataFrame) -> DataFrame:
    """(segments, total_size, oldest, latest) of log files (path, length), as the binaryFile source lists them."""
    return files.agg(F.count("*").alias("segments"), F.sum("length").alias("total_size"), F.min("path").alias("oldest"), F.max("path").alias("latest"))


def obsolete(files: DataFrame, before: int) -> DataFrame:
    """Segments (path, sequence, ...) that hold only records before `before`: all but the last that starts at or before it."""
    needed = files.filter(F.col("sequence") <= F.lit(before)).agg(F.max("sequence")).first()[0]
    return files.filter(F.lit(False)) if needed is None else files.filter(F.col("sequence") < F.lit(needed))


def record_bytes() -> Column:
    """Bytes of a record with its fixed parts: what a segment's size is reckoned by."""
    return F.lit(32) + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))


class SegmentedLog:
    """A log in segments of bounded size, each a folder named by its first sequence.

    A batch is cut into segments by running sizes: sums of ranges of the sequence come
    first, then those within a range, so that no task sorts the whole batch. Each
    append publishes its segments at once; a cleaned-up segment is taken off the list
    before its files are deleted.
    """

    #: Fixed value: the size at which a segment is full.
    SEGMENT_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, root: str, segment_bytes: int = SEGMENT_BYTES):
        self.spark, self.segment_bytes = spark, segment_bytes
        self.table = VersionedTable(spark, root)

    def segments(self) -> list[dict]:
        """(name, folder, first, last, records, bytes) of the segments, oldest first."""
        head = self.table.head()
        return head["segments"] if head else []

    def append(self, log: DataFrame) -> dict:
        """Adds records (seq, op, tx_id, key, value); a segment is closed by the record that fills it."""
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        used: list[str] = []
        laid = materialize(log.repartitionByRange(count, "seq").withColumns({"_range": F.spark_partition_id(), "_bytes": record_bytes().cast("long")}), "log", used)
        sums = laid.groupBy("_range").agg(F.sum("_bytes").alias("size"))  # as many rows as there are ranges
        before = sums.select("_range", F.coalesce(F.sum("size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        running = F.sum("_bytes").over(Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        cut = laid.join(F.broadcast(before), "_range").withColumn("segment", F.floor((F.col("_before") + F.coalesce(running, F.lit(0))) / self.segment_bytes).cast("int"))
        folder, onto = self.table.new_folder(), self.table.head()
        cut.drop("_range", "_before").write.partitionBy("segment").parquet(folder)
        facts = self.spark.read.parquet(folder).groupBy("segment").agg(F.min("seq"), F.max("seq"), F.count("*"), F.sum("_bytes")).orderBy("segment").collect() if log.columns and self.table.files.names(folder) != ["_SUCCESS"] else []
        new = [{"name": f"wal-{r[1]:016x}.log", "folder": f"{folder}/segment={r[0]}", "first": r[1], "last": r[2], "records": r[3], "bytes": r[4]} for r in facts]  # a row a segment
        discard(self.spark, used)
        return self.table.commit(folder, onto, segments=sorted([*self.segments(), *new], key=lambda x: x["first"]))

    def read(self, from_seq: int | None = None) -> DataFrame:
        """All records, or those from a sequence on: only the segments that reach it are opened. Calling it again starts anew."""
        wanted = [x["folder"] for x in self.segments() if from_seq is None or x["last"] >= from_seq]
        if not wanted:
            return self.spark.createDataFrame([], "seq long, op string, tx_id long, key binary, value binary")
        rows = self.spark.read.parquet(*wanted).drop("_bytes")
        return rows if from_seq is None else rows.filter(F.col("seq") >= F.lit(from_seq))

    def seek(self, name: str) -> DataFrame:
        """The records of a segment and of those behind it."""
        first = next((x["first"] for x in self.segments() if x["name"] == name), None)
        if first is None:
            raise NotFound(f"no segment {name}")
        return self.read(first)

    def cleanup_before(self, seq: int) -> int:
        """Deletes the segments that hold only records before `seq`; returns their number."""
        return self._keep([x for x in self.segments() if x["last"] >= seq])

    def cleanup_all(self) -> int:
        return self._keep([])

    def _keep(self, kept: list[dict]) -> int:
        gone = [x for x in self.segments() if x not in kept]
        if gone:
            head = self.table.head()
            self.table.commit(head["folder"], head, segments=kept)
            for x in gone:
                self.table.files.delete(x["folder"])
        return len(gone)
