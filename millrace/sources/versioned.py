"""A directory-backed table whose versions are published atomically.

Data files of a version lie in a folder of their own; a reader sees them only
once the numbered commit file that names the folder has been renamed into place.
Two writers that start from the same version can't both commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace import FORMAT_VERSION
from millrace.errors import ConflictError, CorruptionError, NotFound
from millrace.session import Files


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark, self.root)
        self.files.mkdirs(f"{self.root}/_commits")

    def commits(self) -> list[dict]:
        names = [x for x in self.files.names(f"{self.root}/_commits") if not x.startswith(".") and x.endswith(".json")]
        return [json.loads(self.files.read(f"{self.root}/_commits/{x}")) for x in names]

    def head(self) -> dict | None:
        names = [x for x in self.files.names(f"{self.root}/_commits") if not x.startswith(".") and x.endswith(".json")]
        if not names:
            return None
        entry = json.loads(self.files.read(f"{self.root}/_commits/{names[-1]}"))
        if entry.get("format", 0) > FORMAT_VERSION:
            raise CorruptionError(f"{self.root} has format {entry['format']}, newer than {FORMAT_VERSION}")
        return entry

    def new_folder(self) -> str:
        return f"{self.root}/data-{uuid.uuid4().hex}"

    def commit(self, folder: str, onto: dict | None, **facts) -> dict:
        """Publishes a written folder as the version after `onto`."""
        number = 1 if onto is None else onto["version"] + 1
        entry = {"format": FORMAT_VERSION, "version": number, "folder": folder, **facts}
        if not self.files.publish(json.dumps(entry), f"{self.root}/_commits/{number:012d}.json"):
            raise ConflictError(f"version {number} was committed by another writer")
        return entry

    def replace(self, df: DataFrame, **facts) -> dict:
        """Writes df as the next version and publishes it."""
        onto, folder = self.head(), self.new_folder()
        df.write.parquet(folder)
        return self.commit(folder, onto, **facts)

    def append(self, df: DataFrame, onto: dict | None, **facts) -> dict:
        """Adds a folder to those of the version before; a read gets them all."""
        folder = self.new_folder()
        df.write.parquet(folder)
        return self.commit(folder, onto, folders=[*(onto or {}).get("folders", []), folder], **facts)

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.head() if version is None else next((x for x in self.commits() if x["version"] == version), None)
        if entry is None:
            raise NotFound(f"{self.root} has no such version")
        return self.spark.read.parquet(*entry.get("folders", [entry["folder"]]))

    def vacuum(self) -> int:
        """Deletes data folders that no commit names, such as those of failed writers; no writer may be at work."""
        named = {x for c in self.commits() for x in [c["folder"], *c.get("folders", []), *c.get("places", {}).values()]}
        stale = [x for x in self.files.names(self.root) if x.startswith("data-") and f"{self.root}/{x}" not in named]
        for x in stale:
            self.files.delete(f"{self.root}/{x}")
        return len(stale)
