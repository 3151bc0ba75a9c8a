import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from millrace.operators import changefeed
from millrace.operators.changefeed import ChangeFeedTable, current_keys, latest_changes, store_changes
from millrace.session import fresh_path

FEED = "k string, eff long, tie long, live boolean, v string, extra int"
WAL = "db_name string, seq long, entry_type string, tx_id long, key binary, value binary, state string, batch int"
SST = "db_name string, path string, key binary, entry_type int, value binary, sequence long"


def brute(rows):
    best = {}
    for k, eff, tie, live, v, _ in rows:
        if k is None or eff is None or live is None:
            continue
        rank = (eff, -(2**63) if tie is None else tie, live, v is not None, v or "")
        if k not in best or rank > best[k][0]:
            best[k] = (rank, v)
    return {k: (r[0], r[2], v) for k, (r, v) in best.items()}


def noisy(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        k = rng.choice(["hot"] * 5 + [f"k{rng.randrange(40)}", "", None, "ß"])
        rows.append((k, rng.choice([None, *range(30)]), rng.choice([None, 1, 2]), rng.choice([True, False, None]), rng.choice([None, "", "a", "b"]), 1))
    rows += rng.sample(rows, 100)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_the_last_change_of_each_key_stays(spark, seed):
    rows = noisy(seed)
    got = {r.k: (r.eff, r.live, r.v) for r in latest_changes(spark.createDataFrame(rows, FEED).repartition(5), ["k"], ["v"]).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("spread", [4, 12, 1000])
def test_a_combiner_goes_on_when_it_has_had_its_number_of_rows(spread):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("eff", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("live", T.BooleanType())])
    rng = random.Random(spread)
    rows = [(f"k{rng.randrange(spread)}", rng.randrange(500), i, rng.random() < 0.8) for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 7], strict=True)], names=schema.names) for at in range(0, 300, 7)]
    got = [r for b in changefeed._upserter(schema, ["k"], 20)(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
    best = {}
    for k, *rank in rows:
        best[k] = max(best.get(k, rank), rank)
    last = {}
    for k, *rank in got:
        last[k] = max(last.get(k, rank), rank)
    assert last == best and (len(got) == spread if spread < 10 else len(got) <= 300)


def test_feeds_in_any_order_give_one_state(spark):
    rows = noisy(3)
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"], buckets=7)
    parts = [rows[400:], rows[:200], rows[200:400], rows[100:300]]
    for i, part in enumerate(parts):
        assert table.apply(spark.createDataFrame(part, FEED))["version"] == i + 1
    assert {r.k: (r.eff, r.live, r.v) for r in table.state().collect()} == brute(rows)
    assert {r.k for r in table.current().collect()} == {k for k, (_, live, _) in brute(rows).items() if live}


def test_a_feed_rewrites_only_its_buckets(spark):
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"], buckets=8)
    first = table.apply(spark.createDataFrame([(f"k{i}", 1, 0, True, "x", 0) for i in range(100)], FEED))
    second = table.apply(spark.createDataFrame([("k5", 2, 0, False, None, 0)], FEED))
    moved = [b for b, folder in second["places"].items() if folder != first["places"][b]]
    assert len(moved) == 1 and table.current().count() == 99


def test_a_table_that_was_born_small_gets_more_buckets(spark):
    path = fresh_path(spark, "feed")
    spark.range(20_000).selectExpr("concat('k', id) as k", "id % 7 as eff", "0L as tie", "id % 5 > 0 as live", "uuid() as v").write.parquet(path)
    large = spark.read.parquet(path)
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"], buckets=2, bucket_bytes=50_000)
    first = table.apply(spark.createDataFrame([(f"k{i}", 9, 0, True, "x", 0) for i in range(200)], FEED))
    second = table.apply(large)
    assert first["buckets"] == 2 and second["buckets"] >= 8 and len(set(second["places"].values())) == 1
    state = {r.k: (r.eff, r.live) for r in table.state().collect()}
    assert len(state) == 20_000 and all(state[f"k{i}"] == ((9, True) if i < 200 else (i % 7, i % 5 > 0)) for i in range(20_000))
    assert table.apply(spark.createDataFrame([("k0", 10, 0, False, None, 0)], FEED))["buckets"] == second["buckets"] and table.current().count() == 16_039


def test_an_unpublished_write_is_not_seen(spark):
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"])
    table.apply(spark.createDataFrame([("a", 1, 0, True, "x", 0)], FEED))
    spark.createDataFrame([("b", 1, 0, True, "x")], "k string, eff long, tie long, live boolean, v string").write.parquet(table.table.new_folder())  # a writer that died
    assert [r.k for r in table.state().collect()] == ["a"]
    assert table.table.vacuum() == 1


def test_empty_feed(spark):
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"])
    table.apply(spark.createDataFrame([], FEED))
    assert table.current().count() == 0
    table.apply(spark.createDataFrame([("a", 1, 0, True, "x", 0)], FEED))
    assert table.current().count() == 1


def found(spark, log, entries=()):
    log = [(*r, None, 0) for r in log]
    return {(r.db_name, bytes.fromhex(r.key_hex), r.seq) for r in current_keys(spark.createDataFrame(log, WAL), spark.createDataFrame(list(entries), SST)).collect()}


def test_transactions_take_effect_at_their_commit(spark):
    log = [
        ("d", 1, "BeginTx", 7, None, None), ("d", 2, " PUT", 7, b"a", b"1"), ("d", 3, "put", None, b"a", b"2"), ("d", 4, "Delete", 7, b"b", None),
        ("d", 5, "1", 7, b"b", b"3"), ("d", 9, "committx\t", 7, None, None), ("d", 9, "CommitTx", 7, None, None), ("d", 6, "2", None, b"a", None),
        ("d", 10, "Put", 8, b"c", b"x"), ("e", 11, "CommitTx", 8, None, None), ("d", 12, "Noop", None, b"q", b"x"), ("d", 13, None, None, b"q", b"x"), ("d", 14, "put", None, None, b"x"),
    ]
    assert found(spark, log) == {("d", b"a", 9), ("d", b"b", 9)}


def test_sorted_files_and_log_together(spark):
    log = [("d", 5, "put", None, b"a", None), ("d", 6, "delete", None, b"b", None), ("d", 8, "put", 1, b"t", b""), ("d", 9, "delete", 1, b"t", None), ("d", 10, "4", 1, None, None)]
    entries = [("d", "x", b"a", 1, None, 4), ("d", "x", b"b", 0, b"v", 7), ("d", "y", b"b", 0, b"v", 7), ("d", "y", b"t", 1, None, 10), ("d", "y", b"\xff\x00", 0, b"", 1), ("d", "y", b"u", 5, b"", 1)]
    assert found(spark, log, entries) == {("d", b"a", 5), ("d", b"b", 7), ("d", b"\xff\x00", 1)}


def test_empty_tables(spark):
    assert found(spark, []) == set()


def test_the_plan_pushes_filters_and_reads_needed_columns_only(spark, data):
    from millrace.sources.tables import load

    plan = store_changes(load(spark, data, "wal_entry"), load(spark, data, "sstable_entry"))._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(key)" in plan and "written_at" not in plan and "value" not in plan
