"""Queries for the dialect and for the key-value, index, version, log and snapshot operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.database import Database
from millrace.errors import ConflictError, InvalidInput
from millrace.operators import backup, compaction, index, kv, mvcc, wal
from millrace.operators.changefeed import ChangeFeedTable, log_kind
from millrace.functions.text import folded
from millrace.plans import compile_query, parse
from millrace.operators.index import Indexes
from millrace.session import Files, fresh_path
from millrace.sources.tables import load, write_sorted
from millrace.sources.versioned import VersionedTable
from millrace.streaming.changelog import keep_current

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _nulled(df, column: str, value: str):
    """The table with nulls where a column has one value; the driver's tables have none."""
    return df.withColumn(column, F.when(F.col(column) != value, F.col(column)))


#: Extra tables of the dialect queries: name, how it is made, and its SQL.
VIEWS = {
    "customer_n": (lambda s, d: _nulled(load(s, d, "customer"), "c_mktsegment", "BUILDING"), "select * replace (nullif(c_mktsegment, 'BUILDING') as c_mktsegment) from customer"),
    "nation_n": (lambda s, d: load(s, d, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))), "select n_nationkey, n_name, nullif(n_regionkey, 2) as n_regionkey from nation"),
    "region_n": (lambda s, d: load(s, d, "region").withColumn("r_regionkey", F.when(~F.col("r_regionkey").isin(2), F.col("r_regionkey"))).filter(~F.col("r_regionkey").eqNullSafe(0)), "select nullif(r_regionkey, 2) as r_regionkey, r_name from region where r_regionkey <> 0"),
    "customer_some": (lambda s, d: load(s, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "select * from customer where c_mktsegment <> 'BUILDING'"),
    "orders_some": (lambda s, d: load(s, d, "orders").filter("o_orderstatus <> 'P'"), "select * from orders where o_orderstatus <> 'P'"),
    "orders_flag": (lambda s, d: load(s, d, "orders").withColumn("o_open", F.col("o_orderstatus") == "O"), "select *, o_orderstatus = 'O' as o_open from orders"),
    # sums of decimals don't depend on the order of addition
    "orders_exact": (lambda s, d: load(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), "select * replace (cast(o_totalprice as decimal(18,2)) as o_totalprice) from orders"),
    "nobody": (lambda s, d: load(s, d, "customer").filter(F.lit(False)), "select * from customer where false"),
}


def _dialect(name: str, text: str, sql: str | None = None, finish=None) -> None:
    def run(spark, d):
        query = parse(text)
        wanted = {query.table, *(j.table for j in query.joins)}
        tables = {t: VIEWS[t][0](spark, d) if t in VIEWS else load(spark, d, t) for t in wanted}
        df = compile_query(query, tables)
        return finish(df) if finish else df

    run.__name__ = name
    QUERIES[name] = run
    used = ", ".join(f"{v} as ({made})" for v, (_, made) in VIEWS.items() if v in (sql or text))
    SQL[name] = (f"with {used} " if used else "") + (sql or text)


# ---- the dialect; where the second text is left out the first is the SQL as well

_dialect(
    "flagship",
    "SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS revenue FROM customer INNER JOIN orders_exact ON customer.c_custkey = orders_exact.o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 5",
    "SELECT c_mktsegment, count(*) AS n, cast(sum(o_totalprice) AS double) AS revenue FROM customer JOIN orders_exact ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY sum(o_totalprice) DESC LIMIT 5",
    lambda df: df.withColumn("revenue", F.col("revenue").cast("double")),
)
_dialect("scan_project", "SELECT n_name AS nation, n_regionkey FROM nation")
_dialect("scan_star", "SELECT * FROM region")
_dialect("filter_cmp_and_or", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_orderpriority != '1-URGENT'")
_dialect("filter_not_2vl", "SELECT c_custkey FROM customer_n WHERE NOT c_mktsegment > 'F'", "SELECT c_custkey FROM customer_n WHERE NOT coalesce(c_mktsegment > 'F', false)")
_dialect("filter_eq_null", "SELECT c_custkey FROM customer_n WHERE c_mktsegment = NULL", "SELECT c_custkey FROM customer_n WHERE c_mktsegment IS NULL")
_dialect("filter_ne_null", "SELECT c_custkey, c_mktsegment FROM customer_n WHERE c_mktsegment != 'MACHINERY'")
_dialect("filter_like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%re%d%'", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')")
_dialect("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_dialect("filter_in_null", "SELECT c_custkey FROM customer_n WHERE c_mktsegment IN ('AUTOMOBILE', NULL)", "SELECT c_custkey FROM customer_n WHERE c_mktsegment IN ('AUTOMOBILE') OR c_mktsegment IS NULL")
_dialect("filter_in_date", "SELECT o_orderkey FROM orders WHERE o_orderdate IN ('1995-03-15', '1996-01-02', '1994-07-20')")
_dialect("filter_bool", "SELECT o_orderkey FROM orders_flag WHERE o_open = TRUE AND NOT o_open != TRUE")
_dialect("filter_bare_bool", "SELECT o_orderkey FROM orders_flag WHERE o_open AND TRUE")
_dialect("filter_float_equal", "SELECT p_partkey FROM part WHERE p_retailprice = 901.0 OR p_retailprice = 1000.5")
_dialect("filter_qualified", "SELECT customer.c_custkey FROM customer WHERE customer.c_acctbal > 5000")
_dialect("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_dialect("filter_col_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax")
_dialect("filter_mixed_numeric", "SELECT p_partkey FROM part WHERE p_retailprice > 950")
_dialect("filter_mixed_types", "SELECT p_partkey FROM part WHERE NOT p_name = 5 AND p_size > 45", "SELECT p_partkey FROM part WHERE p_size > 45")
for _kind in ("inner", "left", "right", "full"):
    _dialect(
        f"join_{_kind}",
        f"SELECT c_custkey, c_name, o_orderkey FROM customer_some {_kind.upper()} JOIN orders_some ON customer_some.c_custkey = orders_some.o_custkey",
        f"SELECT c_custkey, c_name, o_orderkey FROM customer_some {_kind} JOIN orders_some ON c_custkey = o_custkey",
    )
    _dialect(
        f"join_null_keys_{_kind}",
        f"SELECT n_name, r_name FROM nation_n {_kind.upper()} JOIN region_n ON region_n.r_regionkey = nation_n.n_regionkey",
        f"SELECT n_name, r_name FROM nation_n {_kind} JOIN region_n ON n_regionkey IS NOT DISTINCT FROM r_regionkey",
    )
_dialect("join_theta", "SELECT s_suppkey, n_name FROM supplier INNER JOIN nation ON supplier.s_nationkey < nation.n_nationkey")
_dialect("join_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON customer.c_custkey = orders.o_custkey AND orders.o_totalprice > 300000")
_dialect("join_on_like", "SELECT c_custkey, n_name FROM customer INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey AND nation.n_name LIKE '%AN%' AND NOT customer.c_mktsegment IN ('BUILDING')", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND contains(n_name, 'AN') AND c_mktsegment NOT IN ('BUILDING')")
_dialect("join_same_names", "SELECT nation.n_name, n_regionkey FROM nation_n LEFT JOIN nation ON nation_n.n_nationkey = nation.n_nationkey", "SELECT nation.n_name, nation_n.n_regionkey FROM nation_n LEFT JOIN nation ON nation_n.n_nationkey = nation.n_nationkey")
_dialect(
    "join_chain3",
    "SELECT r_name, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM region JOIN nation ON nation.n_regionkey = region.r_regionkey JOIN customer ON nation.n_nationkey = customer.c_nationkey JOIN orders ON orders.o_custkey = customer.c_custkey GROUP BY r_name",
)
_dialect("join_cross", "SELECT r_name, n_name FROM region JOIN nation ON 1 = 1")
_dialect("join_empty_side", "SELECT n_name, c_name FROM nation LEFT JOIN nobody ON nation.n_nationkey = nobody.c_nationkey")
_dialect(
    "agg_global",
    "SELECT COUNT(*) AS n, COUNT(c_mktsegment) AS known, SUM(c_custkey) AS total, AVG(c_custkey) AS mean, MIN(c_acctbal) AS low, MAX(c_name) AS high FROM customer_n",
    "SELECT count(*) AS n, count(c_mktsegment) AS known, cast(sum(c_custkey) as bigint) AS total, avg(c_custkey) AS mean, min(c_acctbal) AS low, max(c_name) AS high FROM customer_n",
)
_dialect(
    "agg_global_empty", "SELECT COUNT(*) AS n, SUM(c_custkey) AS total, AVG(c_acctbal) AS mean, MIN(c_name) AS low FROM nobody",
    "SELECT count(*) AS n, cast(sum(c_custkey) as bigint) AS total, avg(c_acctbal) AS mean, min(c_name) AS low FROM nobody",
)
_dialect("agg_group_1", "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders GROUP BY o_orderstatus")
_dialect(
    "agg_group_n", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS lines, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(l_linenumber) as bigint) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_dialect("agg_group_null_key", "SELECT c_mktsegment, COUNT(*) AS n FROM customer_n GROUP BY c_mktsegment")
_dialect("agg_distinct_keys", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
_dialect("agg_having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
_dialect("agg_having_key", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING c_mktsegment IN ('BUILDING', 'FURNITURE')")
_dialect("agg_having_global", "SELECT COUNT(*) AS n FROM orders HAVING n > 5", "SELECT count(*) AS n FROM orders HAVING count(*) > 5")
_dialect("agg_having_global_none", "SELECT COUNT(*) AS n FROM orders HAVING n < 5", "SELECT count(*) AS n FROM orders HAVING count(*) < 5")
_dialect("agg_key_alias", "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
_dialect("agg_float_key", "SELECT l_discount, COUNT(*) AS n FROM lineitem GROUP BY l_discount")
_dialect("agg_default_names", "SELECT COUNT(*), MIN(p_size) FROM part", 'SELECT count(*) AS "COUNT(*)", min(p_size) AS "MIN(p_size)" FROM part')
_dialect("sort_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey ASC LIMIT 50")
_dialect("sort_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_dialect("sort_agg_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
_dialect("sort_alias", "SELECT c_custkey, c_acctbal AS balance FROM customer ORDER BY balance DESC, c_custkey LIMIT 20")
_dialect("sort_nulls", "SELECT c_custkey, c_mktsegment FROM customer_n ORDER BY c_mktsegment, c_custkey LIMIT 400", "SELECT c_custkey, c_mktsegment FROM customer_n ORDER BY c_mktsegment ASC NULLS FIRST, c_custkey LIMIT 400")
_dialect("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30")
_dialect("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("select c_custkey as k, c_name as name from customer where c_acctbal > 9000 union all select s_suppkey, s_name from supplier where s_acctbal > 9000")
def prepared_rebind(spark, d):
    """One parsed query over two tables."""
    query = parse("SELECT k, name FROM people WHERE balance > 9000")
    customers = load(spark, d, "customer").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as balance")
    suppliers = load(spark, d, "supplier").selectExpr("s_suppkey as k", "s_name as name", "s_acctbal as balance")
    return compile_query(query, {"people": customers}).unionByName(compile_query(query, {"people": suppliers}))


# ---- keys and values: events are the log, a user is a key, an error deletes


def _log(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return load(spark, d, "events").select(F.struct("ts", "event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), "event_id", F.col("props").alias("value"))


_NEWEST = "newest as (select *, event_type = 'error' as gone from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"


@_query(f"with {_NEWEST} select user_id as key, props as value from newest where not gone")
def kv_latest(spark, d):
    return kv.latest(_log(spark, d))


@_query(f"with {_NEWEST} select event_id, user_id as key, case when gone then 'delete' else 'put' end as op, props as value from newest")
def kv_compact(spark, d):
    return kv.compact(_log(spark, d)).select(F.col("seq.event_id").alias("event_id"), "op", "key", "value")


@_query("select case when event_type = 'error' then 'delete' else 'put' end as op, count(*) as entries, cast(sum(strlen(cast(user_id as varchar))) as bigint) as key_bytes, cast(sum(strlen(props)) as bigint) as value_bytes from events group by 1")
def kv_stats(spark, d):
    return kv.stats(_log(spark, d).withColumn("key", F.col("key").cast("string")))


@_query(f"with {_NEWEST} select user_id as key, props as value from newest where not gone and user_id between 20 and 60")
def kv_range(spark, d):
    return kv.between(kv.latest(_log(spark, d)), 20, 60)


@_query(f"with {_NEWEST} select cast(user_id as varchar) as key, props as value from newest where not gone and starts_with(cast(user_id as varchar), '1')")
def kv_prefix(spark, d):
    return kv.starting(kv.latest(_log(spark, d)).withColumn("key", F.col("key").cast("string")), "1")


@_query("select p_partkey, p_name from part where p_partkey between 100 and 200")
def sorted_file_range(spark, d):
    """A range read of files that were written in key order."""
    path = fresh_path(spark, "sorted")
    write_sorted(load(spark, d, "part"), path, ["p_partkey"])
    return spark.read.parquet(path).filter(F.col("p_partkey").between(100, 200)).select("p_partkey", "p_name")


@_query("select event_id, event_type from events")
def log_append_read(spark, d):
    """A log that was appended in two batches, each published at once."""
    table = VersionedTable(spark, fresh_path(spark, "log"))
    events = load(spark, d, "events").select("event_id", "event_type")
    purchase = F.col("event_type") == "purchase"
    first = table.append(events.filter(purchase), None)
    table.append(events.filter(~purchase), first)
    return table.read()


# ---- indexes over part names


def _index(spark, d):
    return load(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("seq"))


@_query("select p_partkey as row_id from part where p_brand = 'Brand#12'")
def index_find(spark, d):
    return index.find(_index(spark, d), "Brand#12")


@_query("select p_brand as key, p_partkey as row_id from part where p_brand between 'Brand#12' and 'Brand#33'")
def index_range(spark, d):
    return index.search(_index(spark, d), "Brand#12", "Brand#33")


@_query("select p_brand as key, p_partkey as row_id from part where starts_with(p_brand, 'Brand#2')")
def index_prefix(spark, d):
    return index.prefixed(_index(spark, d), "Brand#2")


@_query("select min(p_brand) as min_key, max(p_brand) as max_key from part")
def index_minmax(spark, d):
    return index.bounds(_index(spark, d))


@_query("select 'brands' as name, 'btree' as kind, count(*) as entry_count, count(distinct p_brand) as key_count from part")
def index_info(spark, d):
    return index.info(_index(spark, d), "brands", "btree")


@_query("select p_brand as key, p_partkey as row_id from part where p_brand <> 'Brand#12' or p_partkey > 500")
def index_remove(spark, d):
    """A removal hides the rows of its key that came before it."""
    rows = _index(spark, d).select("seq", F.lit("insert").alias("op"), "key", "row_id")
    gone = spark.createDataFrame([(500, "remove", "Brand#12", None)], "seq long, op string, key string, row_id long")
    return index.entries(rows.unionByName(gone)).select("key", "row_id")


@_query("select c_custkey, count(*) as orders, max(o_totalprice) as largest from customer join orders on o_custkey = c_custkey group by 1")
def index_join(spark, d):
    """Orders of each customer by an index of the foreign key."""
    orders = load(spark, d, "orders")
    by_customer = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row_id"))
    found = index.lookup_join(load(spark, d, "customer").select("c_custkey"), by_customer, "c_custkey")
    return found.join(orders, found["row_id"] == orders["o_orderkey"]).groupBy("c_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))


# ---- versions


_SNAP = "2024-01-15 00:00:00"


def _versions(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), "event_id", "ts", op.alias("op"))


_ORDER = ("ts", "event_id")
_SEEN = f"seen as (select *, event_type = 'error' as gone from events where ts <= timestamp '{_SNAP}' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"


def _snap():
    return F.lit(_SNAP).cast("timestamp_ntz")


@_query(f"with {_SEEN} select user_id as key, event_id, props as value from seen where not gone")
def mvcc_asof(spark, d):
    return mvcc.as_of(_versions(spark, d), _snap(), "key", _ORDER).select("key", "event_id", "value")


@_query(f"with {_SEEN} select cast(user_id as varchar) as key, props as value from seen where not gone and starts_with(cast(user_id as varchar), '1')")
def mvcc_scan_prefix(spark, d):
    kept = _versions(spark, d).withColumn("key", F.col("key").cast("string")).filter(F.startswith("key", F.lit("1")))
    return mvcc.as_of(kept, _snap(), "key", _ORDER).select("key", "value").orderBy("key")


@_query(f"with {_SEEN} select event_id from seen union all select event_id from events where ts > timestamp '{_SNAP}'")
def mvcc_gc(spark, d):
    return mvcc.collectable(_versions(spark, d), _snap(), "key", _ORDER).select("event_id")


# ---- the write-ahead log

_OPS = """
ops as (
  select db_name, seq, tx_id, key, value, case lower(trim(entry_type))
    when 'put' then 'put' when '1' then 'put' when 'delete' then 'delete' when '2' then 'delete' when 'begintx' then 'begin' when '3' then 'begin'
    when 'committx' then 'commit' when '4' then 'commit' when 'checkpoint' then 'checkpoint' when '5' then 'checkpoint' end as op
  from (select distinct on (db_name, seq) * from wal_entry)),
log as (select seq, op, db_name || '/' || tx_id as tx_id, db_name || '/' || hex(key) as key, value from ops where op is not null),
done as (select distinct tx_id from log where op = 'commit' and tx_id is not null)
"""


def _wal(spark, d, *more):
    """The log of all databases in the form of the operators; repeated records are one."""
    rows = load(spark, d, "wal_entry").dropDuplicates(["db_name", "seq"])
    names = {"put": "put", "delete": "delete", "begintx": "begin", "committx": "commit", "checkpoint": "checkpoint"}
    op = F.coalesce(*[F.when(log_kind(k), F.lit(v)) for k, v in names.items()])
    within = lambda c: F.concat(F.col("db_name"), F.lit("/"), c)
    return rows.select(*more, "seq", op.alias("op"), within(F.col("tx_id").cast("string")).alias("tx_id"), within(F.hex("key")).alias("key"), "value").filter(F.col("op").isNotNull())


@_query(f"with {_OPS} select seq, op, key from log where op in ('put', 'delete') and (tx_id is null or tx_id in (select tx_id from done))")
def wal_recover(spark, d):
    return wal.recover(_wal(spark, d)).select("seq", "op", "key")


@_query(f"with {_OPS} select seq, op, key from log where tx_id is null or tx_id in (select tx_id from done)")
def wal_recover_markers(spark, d):
    return wal.recover(_wal(spark, d), markers=True).select("seq", "op", "key")


@_query(
    f"""with {_OPS}, kept as (select *, tx_id is not null as late from log where op in ('put', 'delete') and key is not null and (tx_id is null or tx_id in (select tx_id from done)))
select key, hex(value) as value from (select * from kept qualify row_number() over (partition by key order by late desc, tx_id desc nulls last, seq desc) = 1) where op = 'put'"""
)
def wal_replay(spark, d):
    return wal.replay(_wal(spark, d)).select("key", F.hex("value").alias("value"))


@_query(f"with {_OPS} select op, count(*) as records from log group by op union all select 'incomplete', count(distinct tx_id) from log where tx_id is not null and tx_id not in (select tx_id from done)")
def wal_stats(spark, d):
    return wal.stats(_wal(spark, d))


@_query(
    f"""with {_OPS.replace("log as (select seq,", "log as (select db_name, seq,")}, ends as (select db_name, max(seq) as last from log where db_name < 'm' group by 1)
select l.db_name, l.seq, l.op from log l left join ends e on l.db_name = e.db_name where e.last is null or l.seq < e.last"""
)
def wal_intact(spark, d):
    """Logs of which those of some databases have a damaged last record: only their replay ends before it."""
    log = _wal(spark, d, "db_name")
    last = log.filter("db_name < 'm'").groupBy(F.col("db_name").alias("of")).agg(F.max("seq").alias("last"))
    sealed = wal.sealed(log).join(last, F.col("db_name") == F.col("of"), "left")
    broken = sealed.withColumn("crc", F.when(F.col("seq") == F.col("last"), F.col("crc") + 1).otherwise(F.col("crc"))).drop("of", "last")
    return wal.intact(broken, "db_name").select("db_name", "seq", "op")


@_query("select min(path) as oldest, max(path) as latest, count(*) as segments, cast(sum(size) as bigint) as total_size from segment_info")
def wal_segments(spark, d):
    return wal.segments(load(spark, d, "segment_info").withColumnRenamed("size", "length"))


@_query("select path, db_name from segment_info where sequence < (select max(sequence) from segment_info where sequence <= 19920001000)")
def wal_obsolete(spark, d):
    """Segments that may be cleaned up before a sequence."""
    return wal.obsolete(load(spark, d, "segment_info"), 19920001000).select("path", "db_name")


@_query(
    """with listed as (
  select * from (select db_name, array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/') as plain, sequence, lower(trim(record_type)) as kind, level, file_size, entry_count from manifest_sstable)
  qualify row_number() over (partition by db_name, plain order by sequence desc) = 1)
select level, count(*) as files, cast(sum(file_size) as bigint) as total_size, cast(sum(entry_count) as bigint) as entries from listed where kind in ('addsstable', 'add_sstable') group by level"""
)
def kv_manifest_levels(spark, d):
    """Files and sizes of each level, as the manifest lists them now."""
    return compaction.levels(load(spark, d, "manifest_sstable"))


@_query(f"with {_NEWEST} select user_id, props from newest where not gone")
def stream_latest(spark, d):
    """The events as a stream of changes, applied batch by batch to a change feed table."""
    schema = load(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    changes = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("eff"), F.col("event_id").alias("tie"), (F.col("event_type") != "error").alias("live"), "props")
    table = ChangeFeedTable(spark, fresh_path(spark, "stream"), ["user_id"], ["props"])
    keep_current(changes, table, fresh_path(spark, "stream-progress")).awaitTermination()
    return table.current().select("user_id", "props")


# ---- snapshots


@_query("select event_id as relative_path, value as checksum from events where event_type <> 'view'")
def snap_diff(spark, d):
    """Files of a snapshot that an earlier one has not, or has with another checksum."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("relative_path"), F.col("value").alias("checksum"), "event_type")
    earlier = rows.withColumn("checksum", F.when(F.col("event_type") == "click", F.col("checksum") + 1).otherwise(F.col("checksum"))).filter("event_type in ('view', 'click')")
    return backup.changed_files(rows, earlier).select("relative_path", "checksum")


_METAS = """metas as (
  select trim(lower(id)) as id, db_name, sequence, trim(lower(snapshot_type)) as kind, trim(lower(parent_id), ' ' || chr(9)) as parent
  from snapshot_meta qualify row_number() over (partition by trim(lower(id)) order by listed_at desc, sequence desc) = 1)"""


@_query(
    f"""with {_METAS}, o as (select *, lag(id) over w as before, row_number() over w = 1 as first from metas window w as (partition by db_name order by sequence))
select id, db_name from o where not coalesce(case when first then kind = 'full' else kind = 'full' or parent is not distinct from before end, false)"""
)
def snap_chain_valid(spark, d):
    """Snapshots that break the chain of their database."""
    newest = load(spark, d, "snapshot_meta").select(
        folded(F.col("id")).alias("id"), F.struct("listed_at", "sequence", "db_name", folded(F.col("snapshot_type")).alias("snapshot_type"), folded(F.col("parent_id")).alias("parent_id")).alias("row")
    ).groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*")
    return backup.chain_breaks(newest, "db_name").select("id", "db_name")


# ---- stores at work: small scripts over the driver's tables


def _nations(spark, d):
    return [(r.n_nationkey, r.n_name) for r in load(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows


def _pairs(df):
    return df.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@_query("select 'n' || n_nationkey as key, case when n_nationkey % 5 = 0 then upper(n_name) || '!' else n_name end as value from nation where n_nationkey % 3 <> 1")
def kv_put_delete(spark, d):
    """Puts, overwrites and deletes, a flush by bytes in between, a compaction at the end."""
    db = Database(spark)
    db.BUFFER_BYTES = 200
    for i, name in _nations(spark, d):
        db.put(f"n{i}".encode(), name.encode())
    for i, name in _nations(spark, d):
        if i % 5 == 0:
            db.put(f"n{i}".encode(), f"{name.upper()}!".encode())
        if i % 3 == 1:
            db.delete(f"n{i}".encode())
    db.compact()
    return _pairs(db.view())


@_query("select n_name as value, n_nationkey in (3, 7) as there from nation where n_nationkey in (3, 7)")
def kv_get(spark, d):
    """Point reads before and after a sync."""
    db = Database(spark)
    for i, name in _nations(spark, d):
        db.put(f"n{i}".encode(), name.encode())
    early = db.get(b"n3")
    db.sync()
    return spark.createDataFrame([(early.decode(), True), (db.get(b"n7").decode(), db.get(b"none") is None)], "value string, there boolean")


@_query(f"with {_NEWEST} select count(*) as entries, sum(case when gone then 1 else 0 end)::bigint as tombstones, 0 as overlaps from newest")
def kv_merge_level(spark, d):
    """A log moved to the next level: its entries, tombstones kept, in files whose key ranges don't overlap."""
    path = fresh_path(spark, "level")
    log = _log(spark, d).withColumn("key", F.col("key").cast("long"))
    files = kv.merge_level(log.select("seq", "op", "key", "value"), path, 20_000)
    other = files.select(F.col("path").alias("other"), F.col("min_key").alias("low"), F.col("max_key").alias("high"))
    overlaps = files.join(other, (F.col("path") < F.col("other")) & (F.col("min_key") <= F.col("high")) & (F.col("low") <= F.col("max_key")))
    rows = spark.read.parquet(path).agg(F.count("*").alias("entries"), F.count_if(F.col("op") == "delete").alias("tombstones"))
    return rows.crossJoin(overlaps.agg(F.count("*").cast("int").alias("overlaps")))  # one row each


@_query("select 'n' || n_nationkey as key, n_name as value from nation where n_nationkey <> 4 union all select 'own', 'x'")
def txn_commit(spark, d):
    """Commits of two transactions, read by a third with its own writes."""
    store = mvcc.Transactions(spark)
    with store.begin() as t:
        for i, name in _nations(spark, d):
            t.put(f"n{i}".encode(), name.encode())
    with store.begin("read_committed") as t:
        t.delete(b"n4")
    t = store.begin("repeatable_read")
    t.put(b"own", b"x")
    return _pairs(t.scan())


@_query("select 'first' as value, 'conflict' as second")
def txn_conflict(spark, d):
    """Of two transactions that change one key the first to commit wins."""
    store = mvcc.Transactions(spark)
    one, two = store.begin(), store.begin()
    one.put(b"k", b"first")
    two.put(b"k", b"second")
    one.commit()
    try:
        two.commit()
        second = "committed"
    except ConflictError:
        second = "conflict"
    return spark.createDataFrame([(store.begin().get(b"k").decode(), second)], "value string, second string")


@_query("select 'n' || n_nationkey as key, n_name as value from nation")
def txn_rollback(spark, d):
    """Puts and deletes that are rolled back leave no trace, and neither does garbage collection take what is live."""
    store = mvcc.Transactions(spark)
    with store.begin() as t:
        for i, name in _nations(spark, d):
            t.put(f"n{i}".encode(), b"old")
    with store.begin() as t:
        for i, name in _nations(spark, d):
            t.put(f"n{i}".encode(), name.encode())
    t = store.begin()
    t.delete(b"n1")
    t.put(b"n99", b"x")
    t.rollback()
    store.gc()
    return _pairs(store.begin().scan(b"n"))


@_query("select 'by_name' as name, 'btree' as kind, 25 as entry_count, 24 as key_count")
def index_admin(spark, d):
    """An index that is made, filled, cleared, filled again; another is dropped."""
    indexes = Indexes(spark)
    indexes.create("by_name")
    indexes.create("gone", "hash")
    indexes.insert("by_name", b"x", 1)
    indexes.clear("by_name")
    for i, name in _nations(spark, d):
        indexes.insert("by_name", b"twice" if i < 2 else name.encode(), i)
    indexes.drop("gone")
    return indexes.info(indexes.names()[0]).select("name", "kind", F.col("entry_count").cast("int"), F.col("key_count").cast("int"))


@_query("select o_orderkey from orders where o_orderkey % 2 = 0")
def backup_restore(spark, d):
    """A full snapshot of a table's files, an incremental one after a file was replaced, and the restore of the latter."""
    source, keep, target = (fresh_path(spark, x) for x in ("source", "kept", "restored"))
    orders = load(spark, d, "orders").select("o_orderkey")
    orders.filter("o_orderkey % 4 = 1").coalesce(1).write.parquet(f"{source}/a")
    orders.filter("o_orderkey % 4 = 2").coalesce(1).write.parquet(f"{source}/b")
    keeper = backup.Snapshots(spark, keep)
    full = keeper.create(source)
    Files(spark, source).delete(f"{source}/a")
    orders.filter("o_orderkey % 4 = 0").coalesce(1).write.parquet(f"{source}/c")
    later = keeper.create(source, parent=full["id"])
    keeper.restore(later["id"], target)
    return spark.read.option("recursiveFileLookup", "true").parquet(target)


@_query("select 'full' as snapshot_type, 1 as n union all select 'incremental', 1")
def backup_manifest(spark, d):
    """The catalogue after three snapshots, of which one was deleted."""
    source, keep = fresh_path(spark, "source"), fresh_path(spark, "kept")
    load(spark, d, "region").write.parquet(source)
    keeper = backup.Snapshots(spark, keep)
    full = keeper.create(source)
    keeper.delete(keeper.create(source)["id"])
    keeper.create(source, parent=full["id"])
    return spark.createDataFrame([(x["snapshot_type"], 1) for x in keeper.list()], "snapshot_type string, n int")


def _segmented(spark, d):
    """The events as a segmented log, in two appends."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.lit(None).cast("long").alias("tx_id"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    log = wal.SegmentedLog(spark, fresh_path(spark, "segments"), 64 << 10)
    half = rows.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    log.append(rows.filter(F.col("seq") <= half))
    log.append(rows.filter(F.col("seq") > half))
    return log


@_query("select count(*) as records, min(event_id) as first, max(event_id) as last, 0 as too_large, 0 as gaps from events")
def wal_rotation(spark, d):
    """Segments hold all records, none is over its size by more than a record, and none reaches into the next."""
    held = _segmented(spark, d).segments()
    large = sum(x["bytes"] > (64 << 10) + 1000 for x in held)
    gaps = sum(a["last"] >= b["first"] for a, b in zip(held, held[1:]))
    return spark.createDataFrame([(sum(x["records"] for x in held), held[0]["first"], held[-1]["last"], large, gaps)], "records long, first long, last long, too_large int, gaps int")


@_query("select event_id as seq from events where event_id >= (select max(event_id) * 7 // 10 from events)")
def log_seek(spark, d):
    """The records from a sequence on, from the segments that reach it."""
    at = load(spark, d, "events").agg(F.max("event_id")).first()[0] * 7 // 10
    return _segmented(spark, d).read(at).select("seq")


@_query("select 0 as lost, true as deleted, 0 as left_over")
def wal_cleanup(spark, d):
    """A clean-up before a sequence deletes the segments before it and loses nothing behind it; then all go."""
    log = _segmented(spark, d)
    at = log.segments()[len(log.segments()) // 2]["first"] + 1
    before = log.read(at).count()
    deleted = log.cleanup_before(at) > 0
    lost = before - log.read(at).count()
    log.cleanup_all()
    return spark.createDataFrame([(lost, deleted, log.read().count())], "lost int, deleted boolean, left_over int")


def _refusals(kind: str, texts: list[str]) -> None:
    def run(spark, d):
        tables = {t: load(spark, d, t) for t in ("nation", "orders")}
        rows = []
        for text in texts:
            try:
                compile_query(parse(text), tables)
                rows.append((text, "accepted"))
            except InvalidInput as refused:
                rows.append((text, type(refused).__name__))
        return spark.createDataFrame(rows, "query string, outcome string")

    run.__name__ = kind
    QUERIES[kind] = run
    SQL[kind] = " union all ".join(f"select '{t.replace(chr(39), chr(39) * 2)}' as query, '{'PlanError' if kind == 'refused_plans' else 'ParseError'}' as outcome" for t in texts)


_refusals(
    "refused_plans",
    ["SELECT nothing FROM nation", "SELECT n_name FROM nation WHERE nothing = 1", "SELECT n_regionkey FROM nation GROUP BY nothing", "SELECT n_name, COUNT(*) FROM nation", "SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT SUM(*) FROM nation", "SELECT n_name FROM nation WHERE n_name"],
)
_refusals(
    "refused_texts",
    ["SELECT n_name x FROM nation", "SELECT DISTINCT n_name FROM nation", "SELECT n_name FROM nation WHERE n_name NOT LIKE 'x'", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1)", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1"],
)


@_query("select 'SELECT n_name FROM nation WHERE n_nationkey > 3' as text, true as same, true as has_plan")
def query_explain(spark, d):
    """A query as text that parses to the same tree, and its plan."""
    db = Database(spark)
    db.register_directory(d, "nation")
    text = "SELECT n_name FROM nation WHERE n_nationkey > 3"
    return spark.createDataFrame([(text, parse(str(parse(text))) == parse(text), "Scan parquet" in db.explain(text))], "text string, same boolean, has_plan boolean")


@_query("select r_name from region where r_regionkey < 3")
def database_query(spark, d):
    db = Database(spark)
    db.register_directory(d, "region")
    return db.query("SELECT r_name FROM region WHERE r_regionkey < 3")
