"""Consolidating far too many small files (problem 5).

Method: the file manifest is frozen first (the listed files that are too small
for their level, written down once). First-fit decreasing packs them by size into
bins of about the level's target. Each bin is rewritten as one sorted file, and what
went into it is counted and summed on the way. The new files are read back: each must
have the rows and checksum that went into it, and all of them together the distinct
records that the files of the frozen manifest hold, which are counted by a path of
their own. One commit takes the inputs off the manifest and puts the new files on.

The files of one level of one database may be very many, so they are packed in
blocks of `BLOCK_FILES` at most, chosen by a hash of the path: each block wastes
less than one bin, and no task packs a whole hot database. A bin has about the
target size, so a task that rewrites it holds one open file and no group.

A later run takes only files that no commit has replaced yet; the files of earlier
commits stay. With nothing new it commits nothing.

Defined results: a file is listed if its manifest row with the greatest sequence
is an add (repeated rows agree; rows without path or sequence don't count) and
that row gives level and size; negative sizes count as 0; records with a null key
are kept, records and files without database are not; the same record (database, level, key, sequence) in several files comes
out once, with the least (entry_type, value); a level without target has no
small files; a listed file without records adds nothing. A file that is listed again
after it was replaced is a new file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CorruptionError
from millrace.functions.text import folded, plain_path
from millrace.session import fresh_path, materialize, ship
from millrace.sources.versioned import VersionedTable

#: Files that first-fit decreasing packs at once.
BLOCK_FILES = 20_000

RECORD = "db_name string, level int, key binary, sequence long, entry_type int, value binary"
WRITTEN = "bin string, path string, n long, bytes long, total decimal(38,0)"
#: From this mean size on the new files are read by Spark's own reader.
LARGE = 8 << 20


def listed_files(manifest: DataFrame) -> DataFrame:
    """(db_name, path, level, file_size, entry_count) of the files that the manifest lists now."""
    kind = F.regexp_replace(folded(F.col("record_type")), "[^a-z]", "")
    row = F.struct("sequence", kind.alias("kind"), "level", "file_size", "entry_count")
    return (
        manifest.select("db_name", plain_path(F.col("path")).alias("path"), row.alias("row"))
        .filter((F.col("path") != "") & F.col("row.sequence").isNotNull())
        .groupBy("db_name", "path").agg(F.max("row").alias("row"))
        .filter(F.col("row.kind") == "addsstable")
        .select("db_name", "path", "row.level", "row.file_size", "row.entry_count", "row.sequence")
    )


def levels(manifest: DataFrame) -> DataFrame:
    """(level, files, total_size, entries) of what the manifest lists."""
    return listed_files(manifest).groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("total_size"), F.sum("entry_count").alias("entries"))


def small_files(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Listed files below their level's target, with that target."""
    known = listed_files(manifest).filter(F.col("level").isNotNull() & F.col("file_size").isNotNull())
    goal = targets.filter("target_file_size > 0").groupBy("level").agg(F.max("target_file_size").alias("target"))
    return known.join(goal, "level").filter(F.col("file_size") < F.col("target"))


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; a tree over the bins' free space finds the first that fits in log time."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)
    bins = [0] * n
    for i in sorted(range(n), key=lambda j: -sizes[j]):
        need, at = min(max(0, sizes[i]), capacity), 1
        while at < width:
            at = 2 * at if free[2 * at] >= need else 2 * at + 1
        free[at] -= need
        bins[i] = at - width
        at //= 2
        while at:
            free[at] = max(free[2 * at], free[2 * at + 1])
            at //= 2
    return bins


def pack(files: DataFrame, block_files: int = BLOCK_FILES) -> DataFrame:
    """files with the column bin."""
    counts = files.groupBy("db_name", "level").agg(F.count("*").alias("files"))
    blocks = F.ceil(F.col("files") / F.lit(block_files)).cast("int")
    blocked = files.join(counts, ["db_name", "level"]).select(
        "db_name", "level", "path", "file_size", "entry_count", "sequence", "target", F.pmod(F.xxhash64("path"), blocks).cast("int").alias("block")
    )

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("path", "ascending")])  # the same bins whatever the order of arrival
        target = rows.column("target")[0].as_py()
        where = f"{uuid.uuid5(uuid.NAMESPACE_OID, repr([rows.column(c)[0].as_py() for c in ('db_name', 'level', 'block')])).hex[:16]}"
        bins = first_fit_decreasing(rows.column("file_size").to_pylist(), target)
        return rows.append_column("bin", pa.array([f"{where}-{b:06d}" for b in bins], pa.string())).drop_columns(["block"])

    schema = "db_name string, level int, path string, file_size long, entry_count long, sequence long, target long, bin string"
    return blocked.groupBy("db_name", "level", "block").applyInArrow(run, schema)


def _open(root: str):
    from pyarrow import fs

    where = root if "://" in root or not root.startswith("file:") else "file://" + root[5:]
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def _added(hashes) -> Decimal:
    """The exact sum of 64-bit numbers."""
    return Decimal((int((hashes >> 32).sum()) << 32) + int((hashes & 0xFFFFFFFF).sum()))


def _writer(root: str):
    """Rows (RECORD, bin, h) arrive ordered by bin; each bin becomes one file, under a name that no other attempt uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, base = _open(root)
        held, file, stream, name, n, total, done = None, None, None, "", 0, Decimal(0), []

        def close() -> None:
            file.close()
            size = stream.tell()
            stream.close()
            done.append((held, f"{root}/{name}", n, size, total))

        for batch in batches:
            if not batch.num_rows:
                continue
            bins, hashes = batch.column("bin"), batch.column("h").to_numpy()
            rows = pa.Table.from_batches([batch]).drop_columns(["bin", "h"])
            ends = [*(pc.indices_nonzero(pc.not_equal(bins[1:], bins[:-1])).to_numpy() + 1), batch.num_rows]
            start = 0
            for end in map(int, ends):
                this = bins[start].as_py()
                if this != held:
                    if file:
                        close()
                    held, n, total, name = this, 0, Decimal(0), f"{this}-{uuid.uuid4().hex[:12]}.parquet"
                    stream = system.open_output_stream(f"{base}/{name}")
                    file = pq.ParquetWriter(stream, rows.schema, compression="zstd", store_schema=False, use_dictionary=["db_name"], write_statistics=["key", "sequence"])
                file.write_table(rows.slice(start, end - start))
                n += end - start
                total += _added(hashes[start:end])
                start = end
        if file:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], [], [], []]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bin", "path", "n", "bytes", "total"])

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the listed files; many small files cost less here than a Spark split each."""
    import pyarrow.parquet as pq

    types = [("db_name", pa.string()), ("level", pa.int32()), ("key", pa.binary()), ("sequence", pa.int64()), ("entry_type", pa.int32()), ("value", pa.binary())]
    schema = pa.schema([*types, ("bin", pa.string())])
    held, rows = [], 0
    for batch in batches:
        for name, path in zip(batch.column("bin").to_pylist(), batch.column("path").to_pylist(), strict=True):
            system, at = _open(path)
            with system.open_input_file(at) as source:
                for part in pq.ParquetFile(source).iter_batches(65_536, use_threads=False):
                    columns = [part.column(c).cast(t) for c, t in types]
                    held.append(pa.RecordBatch.from_arrays([*columns, pa.repeat(name, part.num_rows)], schema=schema))
                    rows += part.num_rows
                    if rows >= 16_384:  # not a batch for each tiny file
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_files(written: DataFrame) -> DataFrame:
    """The records in the files that `written` (bin, path) names, with the bin."""
    count = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written.select("bin", "path").repartition(count, "path").mapInArrow(_reader, f"{RECORD}, bin string")


def _row_hash():
    return F.xxhash64("db_name", "level", "key", "sequence", "entry_type", "value")


def _key_hash():
    return F.xxhash64("db_name", "level", "key", "sequence")


def _total(column):
    return F.sum(column.cast("decimal(38,0)"))


class Compactor:
    """Rewrites small files under `root`; what is committed there can be read at once, the rest never."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, self.root)
        ship(spark)

    def _new(self, manifest: DataFrame, targets: DataFrame) -> DataFrame:
        """Small files that no commit has replaced."""
        small = small_files(manifest, targets)
        if self.table.head() is None:
            return small
        gone = self.inputs().groupBy("db_name", "path").agg(F.max("sequence").alias("gone"))
        return small.join(gone, ["db_name", "path"], "left").filter(F.col("gone").isNull() | (F.col("sequence") > F.col("gone"))).drop("gone")

    def run(self, manifest: DataFrame, entries: DataFrame, targets: DataFrame, block_files: int = BLOCK_FILES) -> dict | None:
        """Compacts what is new and publishes it; None if there is nothing to do and nothing was ever done."""
        spark, onto = self.spark, self.table.head()
        bins = materialize(pack(materialize(self._new(manifest, targets), "frozen-manifest"), block_files), "bins")
        if onto is not None and bins.isEmpty():
            return onto
        plain = entries.select("db_name", plain_path(F.col("path")).alias("path"), "key", F.col("entry_type").cast("int").alias("entry_type"), "value", "sequence")
        records = (
            plain.join(bins.select("db_name", "path", "level", "bin"), ["db_name", "path"])
            .groupBy("db_name", "level", "key", "sequence")
            .agg(F.min(F.struct("entry_type", "value", "bin")).alias("row"))
            .select("db_name", "level", "key", "sequence", "row.entry_type", "row.value", "row.bin")
        )
        folder = f"{self.table.new_folder()}-files"
        self.table.files.mkdirs(folder)
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = records.select(*[c.split()[0] for c in RECORD.split(", ")], "bin", _row_hash().alias("h")).repartition(count, "bin").sortWithinPartitions("bin", "key", "sequence")
        written = materialize(ordered.mapInArrow(_writer(folder), WRITTEN), "written")
        self._check(written, plain, bins, folder)
        placed = bins.groupBy("bin").agg(F.first("db_name").alias("db_name"), F.first("level").alias("level"), F.count("*").alias("files_in"), F.sum("file_size").alias("bytes_in"), F.first("target").alias("target"), F.max("sequence").alias("sequence"))
        listing, inputs = self.table.new_folder(), self.table.new_folder()
        placed.join(written.drop("total"), "bin", "left").write.parquet(listing)
        bins.select("db_name", "path", "level", "file_size", "entry_count", "sequence", "bin").write.parquet(inputs)
        before = onto or {}
        return self.table.commit(listing, onto, folders=[*before.get("folders", []), listing], places={**before.get("places", {}), f"inputs-{len(before.get('places', {}))}": inputs}, files=folder)

    def _check(self, written: DataFrame, plain: DataFrame, bins: DataFrame, folder: str) -> None:
        """The new files against what went into them, and against the files of the frozen manifest."""
        back = materialize(read_files(written).groupBy("bin").agg(F.count("*").alias("n1"), _total(_row_hash()).alias("total1"), _total(_key_hash()).alias("keys1")), "read-back")
        bad = written.join(back, "bin", "full").filter(~(F.col("n").eqNullSafe(F.col("n1")) & F.col("total").eqNullSafe(F.col("total1")))).select("bin", "n", "n1").limit(5).collect()
        # hashes of keys only, each once: from the entries themselves, by the files and not by the bins they were packed in
        frozen = bins.select("db_name", "path", "level").distinct()
        held = plain.select("db_name", "path", "key", "sequence").join(frozen, ["db_name", "path"]).select(_key_hash().alias("h")).distinct()
        want = held.agg(F.count("*"), _total(F.col("h"))).first()
        got = back.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.sum("keys1")).first()
        if bad or tuple(want) != tuple(got):
            self.table.files.delete(folder)
            raise CorruptionError(f"rewritten files don't hold what their sources do: {bad or (tuple(want), tuple(got))}")

    def bins(self) -> DataFrame:
        """(bin, db_name, level, files_in, bytes_in, target, sequence, path, n, bytes) of all bins; those without records have no file."""
        return self.table.read()

    def files(self) -> DataFrame:
        """The bins that have a file."""
        return self.bins().filter(F.col("path").isNotNull())

    def inputs(self) -> DataFrame:
        """(db_name, path, level, file_size, entry_count, sequence, bin) of the files that commits have replaced."""
        head = self.table.head()
        return self.spark.read.parquet(*head["places"].values())

    def manifest(self, manifest: DataFrame) -> DataFrame:
        """(db_name, level, path, entry_count, file_size, sequence, record_type): the manifest after the commits.

        All records of a commit have one sequence, next to the greatest that it replaced
        in the bin: a record that was listed later than the commit knew stays.
        """
        columns = ["db_name", "level", "path", "entry_count", "file_size", "sequence", "record_type"]
        if self.table.head() is None:
            return manifest.select(*columns)
        gone = self.inputs().select("db_name", "level", "path", "entry_count", "file_size", "sequence", F.lit("RemoveSSTable").alias("record_type"))
        new = self.files().select("db_name", "level", "path", F.col("n").alias("entry_count"), F.col("bytes").alias("file_size"), (F.col("sequence") + 1).alias("sequence"), F.lit("AddSSTable").alias("record_type"))
        taken = gone.select("db_name", "path", F.col("sequence").alias("gone")).groupBy("db_name", "path").agg(F.max("gone").alias("gone"))
        rows = manifest.select(*columns).withColumn("_plain", plain_path(F.col("path")))
        kept = rows.join(taken.withColumnRenamed("path", "_plain"), ["db_name", "_plain"], "left").filter(F.col("gone").isNull() | (F.col("sequence") > F.col("gone"))).select(*columns)
        return kept.unionByName(gone).unionByName(new)

    def records(self) -> DataFrame:
        """The records of all new files; each once, also if runs at different times met it."""
        files = self.files()
        facts = files.agg(F.count("*"), F.coalesce(F.avg("bytes"), F.lit(0.0))).first()
        if facts[0] and facts[1] >= LARGE:
            folders = sorted({x["files"] for x in self.table.commits()})
            rows = self.spark.read.schema(RECORD).parquet(*folders).withColumn("_name", F.element_at(F.split("_metadata.file_path", "/"), -1))
            listed = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"))
            found = rows.join(listed, "_name", "left_semi").drop("_name")
        else:
            found = read_files(files).drop("bin")
        return found if len(self.table.head()["folders"]) == 1 else found.dropDuplicates(["db_name", "level", "key", "sequence"])


def compacted(manifest: DataFrame, entries: DataFrame, targets: DataFrame) -> Compactor:
    """A fresh compaction of what the manifest lists."""
    job = Compactor(manifest.sparkSession, fresh_path(manifest.sparkSession, "compaction"))
    job.run(manifest, entries, targets)
    return job
