"""What changed between consecutive full snapshots (problem 3).

Method: EXCEPT ALL in both directions takes away the rows that are the same in
both snapshots; what remains is joined in full by key and labelled added, removed
or changed.

Every row of a snapshot is put once into the pair in which it is the later side
and once into the pair in which it is the earlier one, so all pairs of all
databases go through one EXCEPT ALL each way, spread by (pair, key) and not by
snapshot: no task gets a whole snapshot.

Defined results: of several rows of a snapshot for one path the one with the
greatest `modified` counts (null is least; at equal times the greater size, then
the greater checksum); rows without path don't count; a snapshot that lists no
file is an empty one, so all files before it are removed; snapshots that the
metadata doesn't know are left out; the first full snapshot of a database has no
cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import folded, plain_path
from millrace.operators.neighbours import with_neighbours
from millrace.session import materialize


def diff_pairs(later: DataFrame, earlier: DataFrame, keys: list[str], values: list[str], changed) -> DataFrame:
    """keys and change_kind of two row sets; `changed` is given the prefixes n_ and o_ on the values.

    Rows of one key that stand several times in one side are compared as a bag;
    callers make keys unique if a key should have one row.
    """
    columns = [*keys, *values]
    later, earlier = later.select(*columns), earlier.select(*columns)
    new = later.exceptAll(earlier).select(*keys, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("n_there"))
    old = earlier.exceptAll(later).select(*keys, *[F.col(v).alias(f"o_{v}") for v in values], F.lit(True).alias("o_there"))
    both = new.join(old, keys, "full")
    kind = F.when(F.col("o_there").isNull(), "added").when(F.col("n_there").isNull(), "removed").when(changed, "changed")
    return both.select(*keys, kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())


def full_snapshots(meta: DataFrame) -> DataFrame:
    """(snapshot_id, next_id, before_id): full snapshots by their newest rows, each with its neighbours among those of its database."""
    newest = (
        meta.select(folded(F.col("id")).alias("snapshot_id"), F.struct("listed_at", "sequence", "db_name", folded(F.col("snapshot_type")).alias("kind")).alias("row"))
        .filter(F.col("snapshot_id").isNotNull())
        .groupBy("snapshot_id")
        .agg(F.max("row").alias("row"))
        .select("snapshot_id", "row.sequence", "row.db_name", "row.kind")
        .filter(F.col("kind") == "full")
    )
    near = with_neighbours(newest, ["db_name"], ["sequence"], "snapshot_id", "before_id", "next_id")
    return near.select("snapshot_id", "next_id", "before_id")


def snapshot_changes(meta: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, relative_path, change_kind) for each full snapshot against the one before it."""
    fulls = materialize(full_snapshots(meta), "fulls")
    listed = (
        files.select(
            folded(F.col("snapshot_id")).alias("snapshot_id"), plain_path(F.col("relative_path")).alias("relative_path"),
            F.struct("modified", "size", "checksum").alias("row"),
        )
        .filter((F.col("relative_path") != "") & F.col("snapshot_id").isNotNull())
        .join(fulls, "snapshot_id")
        .groupBy("snapshot_id", "relative_path", "next_id", "before_id")
        .agg(F.max("row").alias("row"))
        .select("snapshot_id", "relative_path", "next_id", "before_id", "row.size", "row.checksum")
    )
    listed = materialize(listed, "listed")
    later = listed.filter(F.col("before_id").isNotNull())
    earlier = listed.filter(F.col("next_id").isNotNull()).withColumn("snapshot_id", F.col("next_id"))
    differs = ~F.col("n_size").eqNullSafe(F.col("o_size")) | F.coalesce(F.col("n_checksum") != F.col("o_checksum"), F.lit(False))
    return diff_pairs(later, earlier, ["snapshot_id", "relative_path"], ["size", "checksum"], differs)
