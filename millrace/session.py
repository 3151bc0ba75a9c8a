"""Sessions, the shared working folder and files on Hadoop file systems."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import InvalidOperation

#: After so long the claim of a writer that hasn't published is taken for that of a dead one.
CLAIM_SECONDS = 60


def local_session(cores: int = 8, app: str = "millrace", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one, but in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get().rsplit("/", 1)[0] if held.isDefined() else None
    if not at:
        if not is_local(spark):
            raise InvalidOperation("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(f"{at}/checkpoints")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors.

    `paths` gets where it lies, for callers that know when it may be discarded.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing will read any more."""
    while paths:
        path = paths.pop()
        Files(spark, path).delete(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context; in local mode too, as their path may differ from the driver's."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-ship-"), "millrace_package.zip")
    with zipfile.ZipFile(target, "w") as package:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                package.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(target)
    context._millrace_shipped = True


def plan_bytes(df: DataFrame) -> int:
    """The size of what df reads: the sum over the leaves of its plan whose size is known. (The estimate for a join is a product, of no use here.)"""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # rows in memory count as endless


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each gets about bytes_each of df, but no fewer than the session's shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-plan_bytes(df) // bytes_each))


class Files:
    """The few calls on a Hadoop file system that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def mkdirs(self, at: str) -> None:
        self._fs.mkdirs(self._path(at))

    def delete(self, at: str) -> bool:
        return self._fs.delete(self._path(at), True)

    def size(self, at: str) -> int:
        """Bytes of all files below a folder."""
        return self._fs.getContentSummary(self._path(at)).getLength() if self.exists(at) else 0

    def names(self, at: str) -> list[str]:
        if not self.exists(at):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(at)))

    def read(self, at: str) -> str:
        stream = self._fs.open(self._path(at))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, at: str) -> bool:
        """Creates the file with its whole text or not at all; False if it is there already.

        The text is written under another name first. Where the file system can tell
        that a rename would overwrite, the rename decides between two writers; where it
        can't (a local one overwrites), an exclusively created claim does.
        """
        parent, _, name = at.rpartition("/")
        if self.exists(at):
            return False
        claim, held = f"{parent}/.{name}.claim", f"{parent}/.{name}.{uuid.uuid4().hex}"
        if not self._claim(claim):
            return False
        stream = self._fs.create(self._path(held), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = not self.exists(at) and self._fs.rename(self._path(held), self._path(at))
        if not done:
            self._fs.delete(self._path(held), False)
        self._fs.delete(self._path(claim), False)
        return done

    def _claim(self, at: str) -> bool:
        """Creates an empty file; False if it is there, unless the writer that made it is long dead."""
        path = self._path(at)
        if self._fs.getScheme() == "file":
            made = self._jvm.java.io.File(path.toUri().getPath()).createNewFile()  # atomic, where the file system's own create is not
        else:
            try:
                self._fs.create(path, False).close()
                made = True
            except Exception:  # noqa: BLE001  a Java error; whether it means that the file is there is asked next
                if not self.exists(at):
                    raise
                made = False
        if made:
            return True
        try:
            age = time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000
        except Exception:  # noqa: BLE001  its writer is done with it
            return False
        if age < CLAIM_SECONDS:
            return False
        self._fs.delete(path, False)
        return self._claim(at)
