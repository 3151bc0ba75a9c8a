import os
import random

import pytest

from millrace.errors import CorruptionError
from millrace.operators import compaction
from millrace.operators.compaction import Compactor, first_fit_decreasing
from millrace.session import fresh_path

MANIFEST = "db_name string, level int, path string, entry_count long, file_size long, sequence long, record_type string, bin string"
ENTRIES = "db_name string, path string, key binary, entry_type int, value binary, sequence long, target int"
TARGETS = "level int, target_file_size long"


def frames(spark, manifest, entries, targets=((0, 100), (1, 1000))):
    return (
        spark.createDataFrame([(*m, "clash") for m in manifest], MANIFEST),
        spark.createDataFrame([(*e, 1) for e in entries], ENTRIES),
        spark.createDataFrame(list(targets), TARGETS),
    )


def test_first_fit_decreasing_against_the_plain_way():
    rng = random.Random(2)
    for n in (0, 1, 5, 200):
        sizes = [rng.randrange(0, 100) for _ in range(n)]
        free, want = [], {}
        for i in sorted(range(n), key=lambda j: -sizes[j]):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if b is None:
                free.append(100)
                b = len(free) - 1
            free[b] -= sizes[i]
            want[i] = b
        got = first_fit_decreasing(sizes, 100)
        assert got == [want[i] for i in range(n)]


def test_listed_small_files_come_out_once(spark):
    manifest = [
        ("d", 0, "sst/a", 2, 40, 1, "AddSSTable"), ("d", 0, "sst\\b", 2, 30, 2, "add_sstable"), ("d", 0, "sst/c", 1, 30, 3, "ADDSSTABLE"), ("d", 0, "./sst/c", 1, None, 9, "RemoveSSTable"),
        ("d", 0, "sst/big", 1, 100, 4, "AddSSTable"), ("d", 1, "sst/moved", 1, 50, 6, "AddSSTable"), ("d", 0, "sst/moved", 1, 50, 5, "AddSSTable"), ("d", 0, "sst/unknown", 1, None, 7, "AddSSTable"), ("d", 0, "sst/a", 2, 40, 1, "AddSSTable"), ("d", 0, None, 1, 1, 1, "AddSSTable"), ("d", 7, "sst/none", 1, 1, 1, "AddSSTable"),
    ]
    entries = [
        ("d", "sst/a", b"k", 0, b"1", 1), ("d", "./sst//a", b"k", 0, b"1", 1), ("d", "sst/b", b"k", 0, b"1", 1), ("d", "sst/b", b"k", 1, None, 2), ("d", "sst/a", b"", 0, None, 3),
        ("d", "sst/c", b"c", 0, b"", 1), ("d", "sst/big", b"b", 0, b"", 1), ("d", "sst/moved", b"m", 0, b"", 1), ("d", "sst/unknown", b"u", 0, b"", 1), ("e", "sst/a", b"k", 0, b"", 1), ("d", "sst/none", b"n", 0, b"", 1),
    ]
    job = Compactor(spark, fresh_path(spark, "c"))
    job.run(*frames(spark, manifest, entries))
    got = [(r.db_name, r.level, bytes(r.key), r.sequence) for r in job.records().collect()]
    assert sorted(got) == sorted([("d", 0, b"k", 1), ("d", 0, b"k", 2), ("d", 0, b"", 3), ("d", 1, b"m", 1)])
    assert job.files().count() == 2


def many(n=300):
    rng = random.Random(3)
    manifest = [("hot", 0, f"sst/{i}", 3, rng.randrange(1, 60), i, "AddSSTable") for i in range(n)]
    return manifest, [("hot", f"sst/{i}", f"{i}-{j}".encode(), 0, os.urandom(4), j) for i in range(n) for j in range(3)]


def test_a_hot_database_is_packed_in_blocks_and_stays_near_the_target(spark):
    manifest, entries = many()
    job = Compactor(spark, fresh_path(spark, "c"))
    job.run(*frames(spark, manifest, entries), block_files=100)
    files = job.files().collect()
    total = sum(m[4] for m in manifest)
    assert sum(f.n for f in files) == 900 and all(f.bytes_in <= 100 for f in files)
    assert len(files) <= 1.15 * total / 100 + 4
    assert {bytes(r.key) for r in job.records().collect()} == {e[2] for e in entries}


def test_a_damaged_rewrite_is_not_committed(spark, monkeypatch):
    manifest, entries = many(20)
    real = compaction.read_files
    monkeypatch.setattr(compaction, "read_files", lambda w: real(w).filter("sequence > 0"))
    job = Compactor(spark, fresh_path(spark, "c"))
    with pytest.raises(CorruptionError):
        job.run(*frames(spark, manifest, entries))
    assert job.table.head() is None


def test_records_that_the_rewrite_loses_are_noticed(spark, monkeypatch):
    """Lost between the sources and the writer: only the count of the sources' own records can tell."""
    manifest, entries = many(20)
    real = compaction._writer
    monkeypatch.setattr(compaction, "_writer", lambda root: lambda batches: real(root)(b.slice(1) for b in batches))
    job = Compactor(spark, fresh_path(spark, "c"))
    with pytest.raises(CorruptionError):
        job.run(*frames(spark, manifest, entries))
    assert job.table.head() is None


def test_a_commit_takes_inputs_off_the_manifest_and_a_second_run_does_nothing(spark):
    manifest, entries = many(30)
    manifest.append(("hot", 0, "sst/large", 1, 5000, 99, "AddSSTable"))
    job = Compactor(spark, fresh_path(spark, "c"))
    first = job.run(*frames(spark, manifest, entries))
    rows = frames(spark, manifest, entries)
    assert job.run(*rows)["version"] == first["version"] == 1
    listed = {r.path for r in compaction.listed_files(job.manifest(rows[0])).collect()}
    assert {"sst/large", *[compaction_path(r.path) for r in job.files().collect()]} == listed
    # a later file is compacted alone; what was committed before stays
    manifest.append(("hot", 0, "./sst/new", 1, 7, 200, "AddSSTable"))
    manifest.append(("hot", 0, "sst/0", 3, 9, 201, "AddSSTable"))  # listed again after it was replaced
    entries.append(("hot", "sst/new", b"new", 0, b"", 1))
    assert job.run(*frames(spark, manifest, entries))["version"] == 2
    got = [bytes(r.key) for r in job.records().collect()]
    assert len(got) == len(set(got)) == 91 and b"new" in got
    assert job.run(*frames(spark, manifest, entries))["version"] == 2


def compaction_path(path):
    return "/".join(x for x in path.split("/") if x not in ("", "."))


def test_large_files_are_read_by_spark(spark, monkeypatch):
    monkeypatch.setattr(compaction, "LARGE", 1)
    manifest, entries = many(20)
    job = Compactor(spark, fresh_path(spark, "c"))
    job.run(*frames(spark, manifest, entries))
    assert {bytes(r.key) for r in job.records().collect()} == {e[2] for e in entries}


def test_empty_tables(spark):
    job = Compactor(spark, fresh_path(spark, "c"))
    job.run(*frames(spark, [], []))
    assert job.records().count() == 0
