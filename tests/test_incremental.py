import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidOperation
from millrace.operators.incremental import IncrementalView, dyadic_blocks, pieces, successful_runs, unread, unread_sequences
from millrace.session import fresh_path

TABLE = "db_name string, sequence long, content string, readable_at string, listed_at long"
RUNS = "run_id long, source_table string, db_name string, from_sequence long, to_sequence long, started_at long, status string, logged_at long"
NAMES = ("manifest_sstable", "segment_info", "snapshot_meta")


def tables(spark, rows):
    frame = spark.createDataFrame([(d, s, c, None, t) for _, d, s, c, t in rows], TABLE).withColumn("_n", F.lit(0)).drop("_n")
    return {n: frame if n == NAMES[0] else frame.limit(0) for n in NAMES}


def brute(rows, runs):
    last = {}
    for r in runs:
        if r[0] not in last or (r[7], r[6] or "") > (last[r[0]][7], last[r[0]][6] or ""):
            last[r[0]] = r
    good = [r for r in last.values() if (r[6] or "").strip().lower() == "success"]
    first = {}
    for _, d, s, c, t in rows:
        if d is not None and s is not None:
            first[d, s, c] = min(t, first.get((d, s, c), t))
    return {
        (NAMES[0], d, s)
        for (d, s, c), t in first.items()
        if not any(r[1] == NAMES[0] and r[2] == d and None not in r[3:6] and r[3] < s <= r[4] and r[5] >= t for r in good)
    }


def random_case(seed):
    rng = random.Random(seed)
    rows = [(0, rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(-3, 60)]), rng.choice("xy"), rng.randrange(100)) for _ in range(300)]
    rows += rng.sample(rows, 60)
    runs = []
    for i in range(25):
        a = rng.randrange(-5, 60)
        row = (i, NAMES[rng.random() < 0.1], rng.choice(["hot", "b"]), a, a + rng.randrange(-1, 25), rng.choice([None, *range(100)]), rng.choice(["success", " SUCCESS", "failed", None]), 1)
        runs += [row, (*row[:6], rng.choice(["success", "failed"]), 2)] if rng.random() < 0.3 else [row]
    return rows, runs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unread_against_brute_force(spark, seed):
    rows, runs = random_case(seed)
    got = {tuple(r) for r in unread_sequences(tables(spark, rows), spark.createDataFrame(runs, RUNS)).collect()}
    assert got == brute(rows, runs)


def test_dyadic_blocks_cover_a_range_once(spark):
    rng = random.Random(1)
    ranges = [(a := rng.randrange(0, 500), a + rng.randrange(0, 700)) for _ in range(60)] + [(-9, 6), (3, 3), (2**40, 2**40 + 12345)]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", dyadic_blocks(F.col("a"), F.col("b")).alias("blocks"))
    for a, b, blocks in df.collect():
        covered = [x for k, i in blocks for x in (range(i << k, (i + 1) << k) if k < 14 else [])] if b - a < 13000 else []
        assert sorted(covered) == list(range(a + 1, b + 1)) and len(blocks) <= 2 * 62


def test_only_changed_partitions_are_computed_again(spark):
    rows, runs = random_case(5)
    view = IncrementalView(spark, fresh_path(spark, "view"), part_rows=40)
    runs = spark.createDataFrame(runs, RUNS)
    first = view.refresh(tables(spark, rows), runs)
    assert view.refresh(tables(spark, rows[::-1]), runs)["recomputed"] == 0 and first["recomputed"] >= 2
    assert first["recomputed"] > 4
    more = [*rows, (0, "b", 59, "new", 500)]
    assert view.refresh(tables(spark, more), runs)["recomputed"] == 1
    assert (NAMES[0], "b", 59) in {tuple(r) for r in view.result().collect()}


def test_a_run_recomputes_the_partitions_it_reaches_into(spark):
    rows = [(0, "a", i, "x", 1) for i in range(256)] + [(0, "b", 300, "x", 1)]
    view = IncrementalView(spark, fresh_path(spark, "view"), part_rows=10)
    early = [(1, NAMES[0], "a", -1, 64, 5, "success", 1)]
    first = view.refresh(tables(spark, rows), spark.createDataFrame(early, RUNS))
    late = [*early, (2, NAMES[0], "a", 64, 90, 5, "success", 1), (3, NAMES[0], "a", 1000, 9000, 5, "success", 1), (4, NAMES[0], "a", 250, 2**62, 0, "failed", 1)]
    again = view.refresh(tables(spark, rows), spark.createDataFrame(late, RUNS))
    assert 10 < first["recomputed"] and again["recomputed"] <= 4
    assert {tuple(r) for r in view.result().collect()} == brute(rows, late)


def test_long_runs_and_short_blocks(spark):
    """Runs over very many blocks are told by nodes over blocks, not by a piece a block."""
    rng = random.Random(8)
    rows = [(0, "hot", rng.randrange(0, 4000), rng.choice("xy"), rng.randrange(100)) for _ in range(500)]
    runs = [(i, NAMES[0], "hot", a := rng.randrange(-10, 4000), a + rng.choice([3, 3, 3, 900, 2**60]), rng.randrange(100), "success", 1) for i in range(40)]
    got = {tuple(r) for r in unread(tables(spark, rows)[NAMES[0]], successful_runs(spark.createDataFrame(runs, RUNS)), 2).collect()}
    assert {(NAMES[0], *r) for r in got} == brute(rows, runs)
    ends, nodes = pieces(successful_runs(spark.createDataFrame(runs, RUNS)), 2)
    assert ends.count() <= 2 * 40 and nodes.count() <= 40 * 2 * 62


def test_a_partition_that_becomes_empty_loses_its_rows(spark):
    view = IncrementalView(spark, fresh_path(spark, "view"), part_rows=1)
    none = spark.createDataFrame([], RUNS)
    view.refresh(tables(spark, [(0, "a", 1, "x", 1), (0, "b", 1, "x", 1)]), none)
    view.refresh(tables(spark, [(0, "b", 1, "x", 1)]), none)
    assert {r.db_name for r in view.result().collect()} == {"b"}


def test_a_failed_run_neither_skips_nor_repeats(spark):
    rows, runs = random_case(7)
    view = IncrementalView(spark, fresh_path(spark, "view"), part_rows=40)
    frame = spark.createDataFrame(runs, RUNS)

    def fail():
        raise RuntimeError("lost")

    view.refresh(tables(spark, rows[:100]), frame)
    with pytest.raises(RuntimeError):
        view.refresh(tables(spark, rows), frame, before_commit=fail)
    assert len(view.log()) == 1
    with pytest.raises(InvalidOperation):  # what an unfinished refresh wrote isn't read
        view.result()
    view.refresh(tables(spark, rows), frame)
    got = [tuple(r) for r in view.result().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, runs)


def test_empty_tables(spark):
    assert unread_sequences(tables(spark, []), spark.createDataFrame([], RUNS)).count() == 0
    assert successful_runs(spark.createDataFrame([], RUNS)).count() == 0
