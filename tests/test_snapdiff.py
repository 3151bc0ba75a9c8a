from millrace.operators.neighbours import with_neighbours
from millrace.operators.snapdiff import snapshot_changes

META = "id string, db_name string, sequence long, snapshot_type string, listed_at long, extra string"
FILES = "snapshot_id string, relative_path string, size long, modified long, checksum long, before_id string"


def changes(spark, meta, files):
    meta = spark.createDataFrame([(*m, None) for m in meta], META)
    files = spark.createDataFrame([(*f, "clash") for f in files], FILES)
    return {tuple(r) for r in snapshot_changes(meta, files).collect()}


def test_kinds_of_changes(spark):
    meta = [("S1", "d", 1, "Full", 0), ("s2", "d", 2, " FULL", 0), ("i", "d", 3, "Incremental", 0), ("s3", "d", 4, "full", 0), ("o", "e", 1, "Full", 0), ("s2", "d", 2, "Full", 1)]
    files = [
        ("s1 ", "a/./b", 1, 5, 10), ("s1", "a\\b", 9, 4, 10), ("s1", "gone", 1, 1, 1), ("s1", "same", 1, 1, 1), ("s1", "null", 1, 1, None), ("s1", None, 1, 1, 1), ("s1", "./", 1, 1, 1),
        ("s2", "a//b", 1, 5, 11), ("s2", "Gone", 1, 1, 1), ("s2", "same", 1, 9, 1), ("s2", "./null", 1, 1, 7), ("i", "never", 1, 1, 1), ("o", "x", 1, 1, 1), ("lost", "x", 1, 1, 1),
    ]
    assert changes(spark, meta, files) == {
        ("s2", "a/b", "changed"), ("s2", "gone", "removed"), ("s2", "Gone", "added"),
        ("s3", "a/b", "removed"), ("s3", "Gone", "removed"), ("s3", "same", "removed"), ("s3", "null", "removed"),
    }


def test_the_last_listing_decides_the_type(spark):
    meta = [("a", "d", 1, "Full", 0), ("b", "d", 2, "Full", 0), ("b", "d", 2, "Incremental", 1)]
    assert changes(spark, meta, [("a", "x", 1, 1, 1)]) == set()


def test_empty_tables(spark):
    assert changes(spark, [], []) == set()


def test_neighbours_across_ranges(spark):
    rows = [("hot", i, f"h{i:03d}") for i in range(200)] + [("cold", 1, "c1"), (None, 1, "n1"), (None, 2, "n2")]
    got = {r.v: (r.before, r.behind) for r in with_neighbours(spark.createDataFrame(rows, "g string, o long, v string").repartition(3), ["g"], ["o"], "v", ranges=7).collect()}
    assert all(got[f"h{i:03d}"] == (f"h{i - 1:03d}" if i else None, f"h{i + 1:03d}" if i < 199 else None) for i in range(200))
    assert got["c1"] == (None, None) and got["n1"] == (None, "n2") and len(got) == 203
