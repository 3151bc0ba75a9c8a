"""Keys and values, indexes, transactions, logs, snapshots, streams."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import errors
from millrace.database import Database
from millrace.operators import backup, index, kv, mvcc, wal
from millrace.operators.changefeed import ChangeFeedTable
from millrace.session import Files, fresh_path
from millrace.streaming.changelog import keep_current, read_log, windowed_counts


def test_keys_and_values_against_a_dict(spark):
    db, model, rng = Database(spark, fresh_path(spark, "db")), {}, random.Random(1)
    for step in range(60):
        key = f"k{rng.randrange(8)}".encode()
        if rng.random() < 0.7:
            value = str(step).encode()
            db.put(key, value)
            model[key] = value
        else:
            assert db.delete(key) == (model.pop(key, None) is not None)
        if step % 25 == 24:
            db.sync()
    assert {bytes(r.key): bytes(r.value) for r in db.view().collect()} == model
    db.compact()
    again = Database(spark, db.root)
    assert again.seq == db.seq and {bytes(r.key): bytes(r.value) for r in again.view().collect()} == model
    assert again.get(b"none") is None and again.is_persistent() and not Database(spark).is_persistent()
    assert [bytes(r.key) for r in again.range(b"k2", b"k5").collect()] == sorted(k for k in model if b"k2" <= k <= b"k5")
    assert [bytes(r.key) for r in again.prefix(b"k").collect()] == sorted(model)
    assert again.stats().filter("op = 'put'").first().entries == len(model)


@pytest.mark.parametrize("key", [b"", b"x" * (16 * 1024 * 1024 + 1)])
def test_bad_keys(spark, key):
    with pytest.raises(errors.InvalidInput):
        Database(spark).put(key, b"")


def test_keys_sort_as_unsigned_bytes(spark):
    df = spark.createDataFrame([(i, "put", bytearray([i]), b"") for i in (255, 128, 127, 0)], kv.LOG_SCHEMA)
    assert [r.key[0] for r in kv.between(kv.latest(df), bytearray(b"\x00"), bytearray(b"\xff")).collect()] == [0, 127, 128, 255]


def test_empty_log(spark):
    none = spark.createDataFrame([], kv.LOG_SCHEMA)
    assert kv.latest(none).count() == kv.compact(none).count() == kv.stats(none).count() == 0


def test_indexes(spark):
    db = Database(spark)
    db.indexes.create("names", "BTree")
    db.indexes.create("mails", "hash")
    for bad in ("a/b", "", "x" * 300, ".."):
        with pytest.raises(errors.InvalidInput):
            db.indexes.create(bad)
    with pytest.raises(errors.InvalidOperation):
        db.indexes.create("names")
    with pytest.raises(errors.NotFound):
        db.indexes.insert("nope", b"a", 1)
    for key, row in ((b"b", 2), (b"a", 1), (b"b", 1), (b"c", 3), (b"b", 2)):
        db.indexes.insert("names", key, row)
    assert [r.row_id for r in db.indexes.find("names", b"b").collect()] == [2, 1, 2]
    assert [(bytes(r.key), r.row_id) for r in db.indexes.range("names", b"a", b"b").collect()] == [(b"a", 1), (b"b", 2), (b"b", 1), (b"b", 2)]
    assert db.indexes.remove("names", b"b") and not db.indexes.remove("names", b"b")
    db.indexes.insert("names", b"b", 9)
    assert [r.row_id for r in db.indexes.find("names", b"b").collect()] == [9]
    assert tuple(db.indexes.info("names").first()) == ("names", "btree", 3, 3)
    assert [bytes(x) for x in db.indexes.bounds("names").first()] == [b"a", b"c"]
    assert db.indexes.contains("names", b"c") and [bytes(r.key) for r in db.indexes.prefix("names", b"b").collect()] == [b"b"]
    with pytest.raises(errors.InvalidOperation):
        db.indexes.range("mails", b"a", b"b")
    db.indexes.clear("names")
    assert db.indexes.entries("names").count() == 0 and db.indexes.names() == ["mails", "names"]
    assert db.indexes.drop("names") and not db.indexes.drop("names")
    assert index.KINDS == ("btree", "hash")


def test_snapshots_of_versions(spark):
    store = mvcc.Transactions(spark)
    with store.begin() as t:
        t.put(b"user:1", b"v1")
        t.put(b"user:2", b"x")
        t.put(b"post:1", b"p")
    reader = store.begin("repeatable_read")
    with store.begin() as t:
        t.put(b"user:1", b"v2")
        t.delete(b"user:2")
        assert t.get(b"user:1") == b"v2" and t.get(b"user:2") is None
    assert reader.get(b"user:1") == b"v1" and reader.get(b"user:2") == b"x"
    later = store.begin()
    assert later.get(b"user:1") == b"v2" and [bytes(r.key) for r in later.scan(b"user:").collect()] == [b"user:1"]
    later.put(b"user:0", b"own")
    later.put(b"user:0", b"own2")
    later.delete(b"user:0")
    assert later.get(b"user:0") is None
    later.rollback()
    with pytest.raises(errors.TransactionError):
        later.get(b"user:1")
    assert store.gc() == 0
    reader.rollback()
    # user:1's first version and user:2's go; its tombstone stays
    assert store.gc() == 2 and store.begin().get(b"user:1") == b"v2"
    with pytest.raises(errors.InvalidInput):
        store.begin("chaos")


def test_first_committer_wins_and_a_rolled_back_delete_leaves_no_trace(spark):
    store = mvcc.Transactions(spark)
    with store.begin() as t:
        t.put(b"a", b"1")
    one, two, three = store.begin(), store.begin(), store.begin()
    one.put(b"a", b"2")
    two.put(b"a", b"3")
    three.delete(b"a")
    three.rollback()
    one.commit()
    with pytest.raises(errors.ConflictError):
        two.commit()
    assert store.begin().get(b"a") == b"2"
    again = mvcc.Transactions(spark, store.table.root)
    assert again.begin().get(b"a") == b"2"


WAL = "seq long, op string, tx_id long, key binary, value binary"


def test_log_recovery(spark):
    rows = [(1, "put", None, b"a", b"0"), (2, "begin", 5, None, None), (3, "put", 5, b"a", b"1"), (4, "begin", 6, None, None), (5, "put", 6, b"b", b"2"), (6, "commit", 5, None, None), (7, "delete", None, b"a", None), (8, "checkpoint", None, None, None)]
    log = spark.createDataFrame(rows, WAL)
    assert {r.seq for r in wal.recover(log).collect()} == {1, 3, 7}
    assert {r.seq for r in wal.recover(log, markers=True).collect()} == {1, 2, 3, 6, 7, 8}
    assert {bytes(r.key): bytes(r.value) for r in wal.replay(log).collect()} == {b"a": b"1"}
    assert {tuple(r) for r in wal.stats(log).collect()} == {("put", 3), ("begin", 2), ("commit", 1), ("delete", 1), ("checkpoint", 1), ("incomplete", 1)}
    sealed = wal.sealed(log)
    assert wal.intact(sealed).count() == 8
    damaged = sealed.withColumn("value", F.when(F.col("seq") == 5, F.lit(b"9")).otherwise(F.col("value")))
    assert {r.seq for r in wal.intact(damaged).collect()} == {1, 2, 3, 4}


def test_files_of_a_log(spark):
    files = spark.createDataFrame([("wal/2.log", 5), ("wal/1.log", 7)], "path string, length long")
    assert tuple(wal.segments(files).first()) == (2, 12, "wal/1.log", "wal/2.log")


def test_backup_and_restore(spark, tmp_path):
    source = tmp_path / "db"
    (source / "sst").mkdir(parents=True)
    (source / "wal").mkdir()
    (source / "MANIFEST").write_bytes(b"m")
    (source / "sst" / "a.sst").write_bytes(b"a" * 1000)
    (source / "wal" / "1.wal").write_bytes(b"w")
    (source / ".hidden").write_bytes(b"h")
    (source / "lock").write_bytes(b"l")
    keeper = backup.Snapshots(spark, f"file://{tmp_path}/backup")
    full = keeper.create(f"file://{source}")
    assert {r.relative_path for r in keeper.manifest(full["id"]).collect()} == {"MANIFEST", "sst/a.sst", "wal/1.wal"} and full["total_size"] == 1002
    (source / "sst" / "b.sst").write_bytes(b"b")
    (source / "MANIFEST").write_bytes(b"M")
    more = keeper.create(f"file://{source}", parent=full["id"], include_log=False)
    assert {r.relative_path for r in keeper.manifest(more["id"]).collect()} == {"MANIFEST", "sst/b.sst"} and more["snapshot_type"] == "incremental"
    # with the log left out, what the parent has of it is gone in the child
    assert keeper.restore(more["id"], f"file://{tmp_path}/out") == 3 and not (tmp_path / "out" / "wal").exists()
    (source / "sst" / "a.sst").unlink()
    (source / "c").write_bytes(b"c")
    third = keeper.create(f"file://{source}", parent=more["id"], include_log=False)
    assert {r.relative_path for r in keeper.manifest(third["id"]).collect()} == {"c"} and {r.relative_path for r in keeper.deleted(third["id"]).collect()} == {"sst/a.sst"}
    assert keeper.restore(third["id"], f"file://{tmp_path}/out3") == 3
    assert sorted(str(x.relative_to(tmp_path / "out3")) for x in (tmp_path / "out3").rglob("*") if x.is_file() and not x.name.startswith(".")) == ["MANIFEST", "c", "sst/b.sst"]
    keeper.delete(third["id"])
    assert (tmp_path / "out" / "MANIFEST").read_bytes() == b"M" and (tmp_path / "out" / "sst" / "a.sst").read_bytes() == b"a" * 1000
    (tmp_path / "backup" / full["id"] / "files" / "MANIFEST").write_bytes(b"?")
    with pytest.raises(errors.CorruptionError):
        keeper.restore(full["id"], f"file://{tmp_path}/bad")
    keeper.delete(more["id"])
    assert [x["id"] for x in keeper.list()] == [full["id"]]
    with pytest.raises(errors.NotFound):
        keeper.get(more["id"])


def test_a_segmented_log(spark):
    rows = [(i, "put", None, f"k{i % 9}".encode(), bytes(100)) for i in range(1, 201)]
    log = wal.SegmentedLog(spark, fresh_path(spark, "wal"), segment_bytes=2000)
    log.append(spark.createDataFrame(rows[:150], WAL))
    log.append(spark.createDataFrame(rows[150:], WAL))
    held = log.segments()
    assert 12 <= len(held) <= 16 and sum(x["records"] for x in held) == 200 and all(x["bytes"] <= 2000 + 140 for x in held)
    assert all(a["last"] + 1 == b["first"] for a, b in zip(held, held[1:])) and held[0]["name"] == "wal-0000000000000001.log"
    assert {r.seq for r in log.read().collect()} == set(range(1, 201)) and {r.seq for r in log.read(77).collect()} == set(range(77, 201))
    assert {r.seq for r in log.seek(held[3]["name"]).collect()} == set(range(held[3]["first"], 201))
    gone = log.cleanup_before(held[5]["first"])
    assert gone == 5 and min(r.seq for r in log.read().collect()) == held[5]["first"] and not log.table.files.exists(held[0]["folder"])
    with pytest.raises(errors.NotFound):
        log.seek(held[0]["name"])
    assert log.cleanup_all() == len(held) - 5 and log.read().count() == 0 and log.segments() == []
    log.append(spark.createDataFrame([], WAL))
    assert log.segments() == []


def test_a_damaged_log_leaves_the_others_whole(spark):
    log = wal.sealed(spark.createDataFrame([(d, i, "put", None, b"k", b"v") for d in "ab" for i in range(5)], f"db string, {WAL}"))
    broken = log.withColumn("crc", F.when((F.col("db") == "a") & (F.col("seq") == 2), F.lit(0)).otherwise(F.col("crc")))
    assert sorted((r.db, r.seq) for r in wal.intact(broken, "db").collect()) == [("a", 0), ("a", 1), *[("b", i) for i in range(5)]]


def test_of_two_writers_one_commits(spark):
    from concurrent.futures import ThreadPoolExecutor

    files = Files(spark, fresh_path(spark, "x"))
    for n in range(15):
        at = fresh_path(spark, "claims")
        files.mkdirs(at)
        with ThreadPoolExecutor(4) as pool:
            done = list(pool.map(lambda i: files.publish(f"writer {i}", f"{at}/1.json"), range(4)))
        assert sum(done) == 1 and files.read(f"{at}/1.json") == f"writer {done.index(True)}"


def test_chains(spark):
    rows = [("a", None, "full", 1), ("b", "a", "incremental", 2), ("c", "a", "incremental", 3), ("d", None, "full", 4), ("e", None, "incremental", 5)]
    broken = backup.chain_breaks(spark.createDataFrame(rows, "id string, parent_id string, snapshot_type string, sequence long"))
    assert {r.id for r in broken.collect()} == {"c", "e"}


def test_a_stream_of_changes(spark, tmp_path):
    schema = "k string, eff long, tie long, live boolean, v string, at timestamp"
    folder = f"file://{tmp_path}/log"
    table = ChangeFeedTable(spark, fresh_path(spark, "t"), ["k"], ["v"], buckets=3)
    for batch in ([("a", 2, 0, True, "new")], [("a", 1, 0, True, "old"), ("b", 1, 0, True, "x")], [("b", 2, 0, False, None)]):
        spark.createDataFrame(batch, "k string, eff long, tie long, live boolean, v string").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(folder)
        query = keep_current(read_log(spark, folder, schema), table, f"{tmp_path}/check")
        query.awaitTermination(60)
    assert {(r.k, r.v) for r in table.current().collect()} == {("a", "new")}
    assert table.table.head()["batch"] == 2  # published with the version
    keep_current(read_log(spark, folder, schema), table, f"{tmp_path}/check-again").awaitTermination(60)  # batch 0 again: it is left out
    assert table.table.head()["version"] == 3
    assert windowed_counts(spark.read.schema(schema).parquet(folder), "at").agg(F.sum("n")).first()[0] == 4


def test_logging(tmp_path, monkeypatch):
    from millrace.logs import LogConfig, configure

    logger = configure(LogConfig(output="both", directory=str(tmp_path)))
    logger.info("hello")
    assert "hello" in (tmp_path / "millrace.log").read_text()
    monkeypatch.setenv("MILLRACE_LOG", "error")
    assert configure().level == 40
