"""Processing only new or changed records (problem 4).

Method: each source is cut into partitions by ranges of the sequence, of about
PART_ROWS rows when the view is made; new records mostly fall into the last ones
or into new ones. A partition has a fingerprint: the count of its rows and the sum
of their hashes, and the same of the runs that reach into it, each cut to the
partition. Both are additive, so they come from one map-side aggregation of the scan
and don't depend on order. A refresh compares the fingerprints with those that the last
successful one committed, computes the result again for the partitions that
differ and only for them, writes them by dynamic partition overwrite, which
replaces each partition as a whole, and commits the new fingerprints last. A
refresh that fails before the commit leaves the old fingerprints and a mark: no
result is read until the next refresh has done the same partitions again, so nothing
is skipped and nothing stands twice.

What is to be read: a version (a distinct content of a row but for the listing
time) that no successful run covers that began when the version was readable. The
sequences are cut into blocks about as long as a usual run. A run gives a piece to
the two blocks that it ends in, and a piece to each block with records that it
covers as a whole; these are found by dyadic blocks of blocks (at most two of each
size a run), which the blocks look up, not the records. So a record meets only the
few pieces of its own block, in one equi-join.

Defined results: a run counts by its row with the latest logged_at (at equal
times the greatest status as text); rows without run_id are of no run; a run without
bounds or start covers nothing; records without database or sequence are left out;
repeated rows are one version; contents are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import InvalidOperation
from millrace.functions.text import folded
from millrace.session import Files, fresh_path, materialize
from millrace.sources.versioned import VersionedTable

SOURCES = ("manifest_sstable", "segment_info", "snapshot_meta")
#: Rows that a partition should have when the view is made.
PART_ROWS = 2_000_000
LONG_MAX = 2**63 - 1


def _hash(columns: list, salt: str):
    return F.xxhash64(F.lit(salt), *columns)


def _total(column):
    return F.sum(column.cast("decimal(38,0)"))


def contents(table: DataFrame, listed: str = "listed_at") -> tuple[DataFrame, list[str]]:
    """(db_name, sequence, listed, c0, c1, ...) of the usable rows, whatever the columns are called, and the names of the last ones."""
    content = [c for c in table.columns if c != listed]
    named = [f"c{i}" for i in range(len(content))]
    rows = table.select(F.col("db_name"), F.col("sequence").cast("long").alias("sequence"), F.col(listed).alias("listed"), *[F.col(f"`{c}`").alias(n) for c, n in zip(content, named, strict=True)])
    return rows.filter(F.col("db_name").isNotNull() & F.col("sequence").isNotNull()), named


def successful_runs(runs: DataFrame) -> DataFrame:
    """(run_id, source_table, db_name, from_sequence, to_sequence, started_at) of runs whose last row says success."""
    columns = ["source_table", "db_name", "from_sequence", "to_sequence", "started_at"]
    last = runs.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max(F.struct("logged_at", folded(F.col("status")).alias("state"), *columns)).alias("row"))
    return last.filter("row.state = 'success'").select("run_id", *[f"row.{c}" for c in columns]).dropna(subset=columns)


def dyadic_blocks(low, high):
    """Blocks (level, index) of 2^level sequences that together make up low+1 ... high; at most two a level.

    A block of a level is used at the range's left end if its index is odd there,
    at the right end if it is even; then the level above goes on inside.
    """

    def ends(k):
        shift = lambda x: F.call_function("shiftright", x, k)
        a = shift(low + F.call_function("shiftleft", F.lit(1).cast("long"), k))  # first whole block of the level
        b = shift(high + F.lit(1))  # behind the last whole block
        odd_a, odd_b = a % 2 != 0, b % 2 != 0
        return F.array(
            F.when((a < b) & odd_a, F.struct(k.alias("level"), a.alias("index"))),
            F.when((a < b) & odd_b & ~(odd_a & (a == b - 1)), F.struct(k.alias("level"), (b - 1).alias("index"))),
        )

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), ends)))


def pieces(runs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Runs (db_name, from_sequence, to_sequence, started_at) over blocks of 2^bits sequences.

    First the pieces (db_name, block, low, high, start) of the blocks that runs end in,
    then the dyadic nodes (db_name, level, index, start) of the blocks that lie between.
    """
    one = runs.filter(F.col("to_sequence") > F.col("from_sequence")).groupBy("db_name", "from_sequence", "to_sequence").agg(F.max("started_at").alias("start"))
    first, last = F.shiftright(F.col("from_sequence") + 1, bits), F.shiftright("to_sequence", bits)
    ends = one.select("db_name", F.explode(F.array_distinct(F.array(first, last))).alias("block"), F.col("from_sequence").alias("low"), F.col("to_sequence").alias("high"), "start")
    between = one.filter(last - first > 1).select("db_name", "start", F.explode(dyadic_blocks(first, last - 1)).alias("node"))
    return ends, between.groupBy("db_name", "node.level", "node.index").agg(F.max("start").alias("start"))


def unread(table: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """(db_name, sequence) with a version in `table` that no run in `runs` (successful ones of this source) has read."""
    rows, named = contents(table)
    content = [F.col(c) for c in named]
    newest = (
        rows.select("db_name", "sequence", "listed", _hash(content, "a").alias("h1"), _hash(content[::-1], "b").alias("h2"))
        .groupBy("db_name", "sequence", "h1", "h2").agg(F.min("listed").alias("readable"))
        .groupBy("db_name", "sequence").agg(F.max("readable").alias("readable"))
        .withColumn("block", F.shiftright("sequence", bits))
    )
    ends, nodes = pieces(runs, bits)
    levels = sorted(r[0] for r in nodes.select("level").distinct().collect())  # 62 at most
    all_pieces = ends
    if levels:
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("block", k).alias("index")) for k in levels])).alias("at")
        blocks = newest.select("db_name", "block").distinct().select("db_name", "block", at).select("db_name", "block", "at.level", "at.index")
        whole = blocks.join(nodes, ["db_name", "level", "index"]).groupBy("db_name", "block").agg(F.max("start").alias("start"))
        all_pieces = ends.unionByName(whole.select("db_name", "block", F.lit(-LONG_MAX).alias("low"), F.lit(LONG_MAX).alias("high"), "start"))
    piece = all_pieces.select(F.col("db_name").alias("of"), F.col("block").alias("within"), "low", "high", "start")
    read = (F.col("db_name") == F.col("of")) & (F.col("block") == F.col("within")) & (F.col("low") < F.col("sequence")) & (F.col("sequence") <= F.col("high")) & (F.col("start") >= F.col("readable"))
    return newest.join(piece, read, "left_anti").select("db_name", "sequence")


class IncrementalView:
    """The unread sequences, kept under `root` and brought up to date partition by partition."""

    def __init__(self, spark: SparkSession, root: str, part_rows: int = PART_ROWS):
        self.spark, self.root, self.part_rows = spark, root.rstrip("/"), part_rows
        self.target = f"{self.root}/target"
        self.mark = f"{self.root}/_unfinished"
        self.prints = VersionedTable(spark, f"{self.root}/fingerprints")
        self.files = Files(spark, self.root)

    def _widths(self, tables: dict[str, DataFrame], runs: DataFrame, known: dict[str, list[int]]) -> dict[str, list[int]]:
        """Bits of a partition's and a block's range, for each source with rows; fixed once they are known."""
        new = [s for s in sorted(tables) if s not in known]
        if not new:
            return known
        sizes = None
        for source in new:
            part = contents(tables[source])[0].agg(F.lit(source).alias("source"), F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
            sizes = part if sizes is None else sizes.unionByName(part)
        length = F.expr("percentile_approx(to_sequence - from_sequence, 0.5)")
        usual = runs.filter("to_sequence > from_sequence").groupBy(F.col("source_table").alias("source")).agg(length.alias("usual"))
        found = dict(known)
        for r in sizes.join(usual, "source", "left").collect():  # a row a source
            if r["n"]:
                span = r["high"] - r["low"] + 1
                bits = max(0, min(61, (span * self.part_rows // r["n"]).bit_length()))
                found[r["source"]] = [bits, min(bits, int(r["usual"] or 1023).bit_length())]
        return found

    def _fingerprints(self, tables: dict[str, DataFrame], good: DataFrame, widths: dict[str, list[int]]) -> DataFrame:
        """(source_table, part, n, total, runs, covered) of all partitions with rows."""
        all_rows = all_runs = None
        for source, (bits, _) in sorted(widths.items()):
            rows, named = contents(tables[source])
            row = rows.groupBy(F.shiftright("sequence", bits).alias("part")).agg(F.count("*").alias("n"), _total(_hash([F.col(c) for c in (*named, "listed")], "row")).alias("total")).withColumn("source_table", F.lit(source))
            all_rows = row if all_rows is None else all_rows.unionByName(row)
        if all_rows is None:
            return self.spark.createDataFrame([], "source_table string, part long, n long, total decimal(38,0), runs long, covered decimal(38,0)")
        all_rows = materialize(all_rows, "fingerprints")
        reach = {r[0]: (r[1], r[2]) for r in all_rows.groupBy("source_table").agg(F.min("part"), F.max("part")).collect()}  # a row a source
        for source, (low, high) in sorted(reach.items()):
            bits = widths[source][0]
            first = F.greatest(F.shiftright(F.col("from_sequence") + 1, bits), F.lit(low))
            last = F.least(F.shiftright("to_sequence", bits), F.lit(high))
            mine = good.filter((F.col("source_table") == source) & (F.col("to_sequence") > F.col("from_sequence"))).filter(first <= last)
            cut = mine.select("db_name", "from_sequence", "to_sequence", "started_at", F.explode(F.sequence(first, last)).alias("part"))
            start = F.shiftleft("part", bits)
            inside = [F.col("db_name"), F.greatest("from_sequence", start - 1), F.least("to_sequence", start + F.lit((1 << bits) - 1)), F.col("started_at")]
            run = cut.groupBy("part").agg(F.count("*").alias("runs"), _total(_hash(inside, "run")).alias("covered")).withColumn("source_table", F.lit(source))
            all_runs = run if all_runs is None else all_runs.unionByName(run)
        return materialize(all_rows.join(all_runs, ["source_table", "part"], "left"), "fingerprints") if all_runs is not None else all_rows.withColumns({"runs": F.lit(None).cast("long"), "covered": F.lit(None).cast("decimal(38,0)")})

    def refresh(self, tables: dict[str, DataFrame], runs: DataFrame, before_commit=None) -> dict:
        """Computes the changed partitions; `before_commit` is called between the overwrite and the commit (tests let it fail)."""
        onto = self.prints.head()
        good = materialize(successful_runs(runs), "runs")
        widths = self._widths(tables, good, onto["widths"] if onto else {})
        now = self._fingerprints(tables, good, widths)
        some = ["source_table", "part"]
        changed = now.select(*some)
        if onto is not None:
            facts = ("n", "total", "runs", "covered")
            old = self.prints.read(onto["version"]).select(*some, *[F.col(c).alias(f"{c}0") for c in facts], F.lit(True).alias("there"))
            same = F.col("there") & F.col("n").isNotNull()
            for c in facts:
                same &= F.col(c).eqNullSafe(F.col(f"{c}0"))
            changed = materialize(now.join(old, some, "full").filter(~F.coalesce(same, F.lit(False))).select(*some), "changed")
        counts = {r[0]: r[1] for r in changed.groupBy("source_table").agg(F.count("*")).collect()}  # a row a source
        if counts:
            # a partition whose result is empty must be replaced too: each gets a row without sequence
            whole = changed.select("source_table", F.lit(None).cast("string").alias("db_name"), F.lit(None).cast("long").alias("sequence"), "part")
            for source in sorted(counts.keys() & tables.keys()):
                bits, block = widths[source]
                table, mine = tables[source], good.filter(F.col("source_table") == source)
                if onto is not None:
                    parts = changed.filter(F.col("source_table") == source).select(F.col("part").alias("_part"))
                    table = table.join(parts, F.shiftright(table["sequence"].cast("long"), bits) == F.col("_part"), "left_semi")
                found = unread(table, mine, block)
                whole = whole.unionByName(found.select(F.lit(source).alias("source_table"), "db_name", "sequence", F.shiftright("sequence", bits).alias("part")))
            self.files.publish("", self.mark)
            (
                whole.hint("rebalance", *some)  # a task a partition, more for a large one
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy(*some).parquet(self.target)
            )
        if before_commit:
            before_commit()
        folder = self.prints.new_folder()
        now.write.parquet(folder)
        entry = self.prints.commit(folder, onto, widths=widths, recomputed=sum(counts.values()))
        self.files.delete(self.mark)
        return entry

    def result(self) -> DataFrame:
        if self.files.exists(self.mark):
            raise InvalidOperation(f"a refresh of {self.root} was not finished; refresh again")
        if not self.files.exists(self.target):
            return self.spark.createDataFrame([], "source_table string, db_name string, sequence long")
        schema = "db_name string, sequence long, source_table string, part long"
        return self.spark.read.schema(schema).parquet(self.target).filter(F.col("sequence").isNotNull()).select("source_table", "db_name", "sequence")

    def log(self) -> list[dict]:
        """The commits so far, with the number of partitions that each computed."""
        return self.prints.commits()


def unread_sequences(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    view = IncrementalView(runs.sparkSession, fresh_path(runs.sparkSession, "incremental"))
    view.refresh(tables, runs)
    return view.result()
