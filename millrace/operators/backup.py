"""Snapshots of a directory: copies with checksums, their catalogue, differences and restore.

Files are copied and checked by the executors, a file a row, in pieces of 8 MB; the
catalogue entry is published last, so that a snapshot is there with all its
files or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CorruptionError, NotFound
from millrace.operators.compaction import _open
from millrace.operators.neighbours import with_neighbours
from millrace.session import Files, materialize, ship

FILES = "relative_path string, size long, modified long, checksum long"
PIECE = 8 << 20


def _copier(source: str, target: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(source)
        for batch in batches:
            rows = []
            for path, modified in zip(batch.column("relative_path").to_pylist(), batch.column("modified").to_pylist(), strict=True):
                crc, size = 0, 0
                out = None
                if target:
                    there, root = _open(target)
                    at = f"{root}/{path}"
                    there.create_dir(at.rpartition("/")[0], recursive=True)
                    out = there.open_output_stream(at)
                with system.open_input_stream(f"{base}/{path}") as data:
                    while piece := data.read(PIECE):
                        crc, size = zlib.crc32(piece, crc), size + len(piece)
                        if out:
                            out.write(piece)
                if out:
                    out.close()
                rows.append((path, size, modified, crc))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["relative_path", "size", "modified", "checksum"])

    return run


def changed_files(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Files of `later` that are new or have another checksum."""
    seen = earlier.select(F.col("relative_path").alias("_path"), F.col("checksum").alias("_sum"))
    return later.join(seen, (F.col("relative_path") == F.col("_path")) & F.col("checksum").eqNullSafe(F.col("_sum")), "left_anti")


def chain_breaks(snapshots: DataFrame, group: str | None = None, order: str = "sequence") -> DataFrame:
    """Snapshots that break their chain: the first must be full, an incremental one must name its predecessor."""
    near = with_neighbours(snapshots, [group] if group else [], [order], "id", "_before", "_behind")
    full = F.col("snapshot_type") == "full"
    good = full | F.col("parent_id").eqNullSafe(F.col("_before")) & F.col("_before").isNotNull()
    return near.filter(~F.coalesce(good, F.lit(False))).drop("_before", "_behind")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.files.mkdirs(f"{self.root}/_catalogue")

    def _list(self, source: str, include_log: bool = True) -> DataFrame:
        """Files below a directory, without lock files and dotfiles."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "modificationTime")
        base = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
        start = source.split(":", 1)[-1] if source.startswith("file:") else source
        relative = F.regexp_replace(F.substring(base, len("/" + start.strip("/")) + 2, 4096), "^/+", "")
        rows = found.select(relative.alias("relative_path"), F.unix_millis("modificationTime").alias("modified"))
        name = F.element_at(F.split("relative_path", "/"), -1)
        rows = rows.filter(~name.startswith(".") & (name != "lock") & (name != "LOCK"))
        return rows if include_log else rows.filter(~F.col("relative_path").startswith("wal/"))

    def create(self, source: str, parent: str | None = None, include_log: bool = True) -> dict:
        """A full snapshot, or one of the files changed since its parent."""
        number = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
        listed = self._list(source, include_log)
        folder = f"{self.root}/{number}"
        if parent:
            # read once for their checksums; those that differ from what the parent's chain gives are copied
            hashed = materialize(listed.mapInArrow(_copier(source, None), FILES), "hashed")
            known = self.whole(parent)
            listed = changed_files(hashed, known).select("relative_path", "modified")
            known.select("relative_path").join(hashed.select("relative_path"), "relative_path", "left_anti").write.parquet(f"{folder}/deleted")
        copied = listed.mapInArrow(_copier(source, f"{folder}/files"), FILES)
        copied.write.parquet(f"{folder}/manifest")
        total = self.spark.read.parquet(f"{folder}/manifest").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        meta = {"id": number, "parent_id": parent, "snapshot_type": "incremental" if parent else "full", "source": source, "total_size": total[0], "files": total[1], "sequence": len(self.list()) + 1}
        self.files.publish(json.dumps(meta), f"{self.root}/_catalogue/{number}.json")
        return meta

    def manifest(self, number: str) -> DataFrame:
        self.get(number)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/{number}/manifest")

    def list(self) -> list[dict]:
        return [json.loads(self.files.read(f"{self.root}/_catalogue/{x}")) for x in self.files.names(f"{self.root}/_catalogue") if x.endswith(".json") and not x.startswith(".")]

    def get(self, number: str) -> dict:
        found = [x for x in self.list() if x["id"] == number]
        if not found:
            raise NotFound(f"no snapshot {number}")
        return found[0]

    def delete(self, number: str) -> None:
        self.get(number)
        self.files.delete(f"{self.root}/_catalogue/{number}.json")
        self.files.delete(f"{self.root}/{number}")

    def deleted(self, number: str) -> DataFrame:
        """(relative_path) of files that the parent's chain has and the snapshot has not."""
        if self.get(number)["parent_id"] is None:
            return self.spark.createDataFrame([], "relative_path string")
        return self.spark.read.schema("relative_path string").parquet(f"{self.root}/{number}/deleted")

    def chain(self, number: str) -> list[dict]:
        """The snapshot and those it builds on, the full one first."""
        chain = [self.get(number)]
        while chain[-1]["parent_id"]:
            chain.append(self.get(chain[-1]["parent_id"]))
        return chain[::-1]

    def whole(self, number: str) -> DataFrame:
        """(relative_path, size, modified, checksum, snapshot_id) of all files of a snapshot, and which snapshot of its chain holds each."""
        rows = None
        for place, meta in enumerate(self.chain(number)):
            own = self.manifest(meta["id"]).withColumns({"snapshot_id": F.lit(meta["id"]), "_place": F.lit(place), "_there": F.lit(True)})
            gone = self.deleted(meta["id"]).select("relative_path", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("modified", "long"), ("checksum", "long"))]).withColumns({"snapshot_id": F.lit(meta["id"]), "_place": F.lit(place), "_there": F.lit(False)})
            both = own.unionByName(gone)
            rows = both if rows is None else rows.unionByName(both)
        columns = ["_there", "size", "modified", "checksum", "snapshot_id"]
        last = rows.groupBy("relative_path").agg(F.max(F.struct("_place", *columns)).alias("row"))
        return last.filter("row._there").select("relative_path", *[f"row.{c}" for c in columns[1:]])

    def restore(self, number: str, target: str) -> int:
        """Copies the files that a snapshot stands for, each from the snapshot of its chain that holds it, to the target and checks them; returns their number."""
        wanted = materialize(self.whole(number), "wanted")
        count = 0
        for meta in self.chain(number):
            mine = wanted.filter(F.col("snapshot_id") == meta["id"])
            copied = mine.select("relative_path", "modified").mapInArrow(_copier(f"{self.root}/{meta['id']}/files", target), FILES)
            checked = materialize(copied.alias("c").join(mine.alias("w"), "relative_path", "full").selectExpr("relative_path", "(c.checksum <=> w.checksum) and (c.size <=> w.size) as right"), "checked")
            bad = checked.filter("not right").limit(3).collect()
            if bad:
                raise CorruptionError(f"files don't have their checksums: {[r['relative_path'] for r in bad]}")
            count += checked.count()
        return count
