"""Queries of the general data-processing problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import plain_path
from millrace.operators import changefeed, compaction, hierarchy, incremental, snapdiff
from millrace.session import fresh_path
from millrace.sources.tables import load


def p1_found(spark, d):
    return changefeed.current_keys(load(spark, d, "wal_entry"), load(spark, d, "sstable_entry"))


def p1_state_counts(spark, d):
    """Live keys and tombstones of each database; a second, older feed is applied after the first."""
    log, entries = load(spark, d, "wal_entry"), load(spark, d, "sstable_entry")
    table = changefeed.ChangeFeedTable(spark, fresh_path(spark, "changefeed"), ["db_name", "key"])
    changes = changefeed.store_changes(log, entries)
    late = F.col("eff") % 2 == 0
    table.apply(changes.filter(~late))
    table.apply(changes.filter(late))
    return table.state().groupBy("db_name").agg(F.count_if("live").alias("live_keys"), F.count_if(~F.col("live")).alias("tombstones"))


def _links(spark, d):
    return hierarchy.newest_links(load(spark, d, "snapshot_meta"))


def p2_found(spark, d):
    return hierarchy.hierarchy(_links(spark, d), paths=False).select("id", "root_id", "depth")


def p2_paths(spark, d):
    """Path, depth and number of descendants of each node of a tree."""
    tree = hierarchy.hierarchy(_links(spark, d)).filter("depth >= 0")
    return tree.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"), "descendants")


def p2_descendants(spark, d):
    """All pairs of an ancestor and a descendant in trees."""
    tree = hierarchy.hierarchy(_links(spark, d))
    return hierarchy.descendants(tree.filter("depth >= 0"))


def p2_looped_paths(spark, d):
    """Path from its loop's least id and depth (-1 on a loop, -2 behind one) of each node without a root."""
    tree = hierarchy.hierarchy(_links(spark, d)).filter("depth < 0")
    return tree.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_back_edges(spark, d):
    """The link that closes each loop."""
    return hierarchy.back_edges(hierarchy.hierarchy(_links(spark, d), paths=False))


def p3_found(spark, d):
    return snapdiff.snapshot_changes(load(spark, d, "snapshot_meta"), load(spark, d, "snapshot_file"))


def _sources(spark, d):
    return {t: load(spark, d, t) for t in incremental.SOURCES}


def p4_found(spark, d):
    return incremental.unread_sequences(_sources(spark, d), load(spark, d, "ingest_run"))


def p4_second_run(spark, d):
    """The unread sequences after two runs: one before the runs of the log were known, one with them."""
    view = incremental.IncrementalView(spark, fresh_path(spark, "incremental"))
    runs = load(spark, d, "ingest_run")
    view.refresh(_sources(spark, d), runs.filter(F.col("source_table") == "segment_info"))
    view.refresh(_sources(spark, d), runs)
    return view.result()


def p5_found(spark, d):
    job = compaction.compacted(load(spark, d, "manifest_sstable"), load(spark, d, "sstable_entry"), load(spark, d, "level_target"))
    return job.records().select("db_name", "level", F.hex("key").alias("key_hex"), "sequence")


def p5_files(spark, d):
    """Files, bytes and records of each level that were packed, and bins over their target."""
    job = compaction.compacted(load(spark, d, "manifest_sstable"), load(spark, d, "sstable_entry"), load(spark, d, "level_target"))
    return job.bins().groupBy("level").agg(
        F.sum("files_in").alias("files_in"), F.sum("bytes_in").alias("bytes_in"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("bytes_in") > F.col("target")).alias("overfull")
    )


def kv_manifest_commit(spark, d):
    """After a compaction and a second one, which has nothing to do: per level the files that stayed, inputs that are still listed, and records in new files."""
    manifest, entries, targets = load(spark, d, "manifest_sstable"), load(spark, d, "sstable_entry"), load(spark, d, "level_target")
    job = compaction.compacted(manifest, entries, targets)
    job.run(manifest, entries, targets)
    now = compaction.listed_files(job.manifest(manifest))
    new = now.join(job.files().select("db_name", plain_path(F.col("path")).alias("path"), F.lit(True).alias("new")), ["db_name", "path"], "left").join(job.inputs().select("db_name", "path", F.lit(True).alias("input")), ["db_name", "path"], "left")
    return new.groupBy("level").agg(F.count_if(F.col("new").isNull()).alias("stayed"), F.count_if("input").alias("inputs_left"), F.coalesce(F.sum(F.when(F.col("new"), F.col("entry_count"))), F.lit(0)).alias("records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_state_counts, p2_found, p2_paths, p2_descendants, p2_looped_paths, p2_back_edges, p3_found, p4_found, p4_second_run, p5_found, p5_files, kv_manifest_commit)}

_BLANKS = r"'^[\s\p{Z}\x00-\x1f]+|[\s\p{Z}\x00-\x1f]+$', '', 'g'"


def _fold(column: str) -> str:
    return f"lower(regexp_replace({column}, {_BLANKS}))"


def _path(column: str) -> str:
    return f"array_to_string(list_filter(string_split(replace({column}, '\\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/')"


_CHANGES = f"""
rows as (
  select db_name, seq, tx_id, key, case
    when {_fold("entry_type")} in ('put', '1') then 'put' when {_fold("entry_type")} in ('delete', '2') then 'delete'
    when {_fold("entry_type")} in ('committx', '4') then 'committx' end as kind
  from wal_entry),
commits as (select db_name, tx_id, min(seq) as eff from rows where kind = 'committx' and tx_id is not null group by all),
changes as (
  select db_name, key, seq as eff, seq as tie, kind = 'put' as live from rows
  where kind in ('put', 'delete') and key is not null and tx_id is null
  union all
  select r.db_name, r.key, c.eff, r.seq, r.kind = 'put' from rows r join commits c on r.db_name = c.db_name and r.tx_id = c.tx_id
  where r.kind in ('put', 'delete') and r.key is not null
  union all
  select db_name, key, sequence, 9223372036854775807, entry_type = 0 from sstable_entry
  where entry_type in (0, 1) and key is not null and sequence is not null and db_name is not null),
state as (
  select * from changes qualify row_number() over (partition by db_name, key order by eff desc, tie desc, live desc) = 1)
"""

_LINKS = f"""
newest as (
  select {_fold("id")} as id, {_fold("parent_id")} as named from snapshot_meta where id is not null
  qualify row_number() over (partition by {_fold("id")} order by listed_at desc, sequence desc nulls last, {_fold("parent_id")} desc nulls last) = 1),
links as (select n.id, p.id as parent from newest n left join newest p on n.named = p.id)
"""

_TREE = """
tree as (
  select id, id as root_id, 0 as depth, id as path from links where parent is null
  union all
  select l.id, t.root_id, t.depth + 1, t.path || '/' || l.id from links l join tree t on l.parent = t.id)
"""

_CLOSURE = """
closure as (
  select parent as ancestor, id, 1 as distance from links where parent in (select id from tree)
  union all
  select l.parent, c.id, c.distance + 1 from closure c join links l on l.id = c.ancestor where l.parent is not null)
"""

_ENDLESS = """
odd as (select id, parent from links where id not in (select id from tree)),
walk as (
  select id, parent as above from odd
  union
  select w.id, o.parent from walk w join odd o on w.above = o.id),
loops as (select id as node from walk where above = id)
"""

_LOOPED = """
ends as (select w.id, min(l.node) as root_id, bool_or(w.above = w.id) as on_loop from walk w join loops l on w.above = l.node group by w.id),
looped as (
  select id, root_id, id as path from ends where id = root_id
  union all
  select o.id, t.root_id, t.path || '/' || o.id from odd o join looped t on o.parent = t.id where o.id <> t.root_id)
"""


def _sequences(runs: str) -> str:
    parts = []
    for t, columns in {
        "manifest_sstable": "db_name, level, path, min_key, max_key, entry_count, file_size, sequence, record_type",
        "segment_info": "db_name, path, sequence, size",
        "snapshot_meta": "id, db_name, taken_ms, path, source_path, sequence, total_size, snapshot_type, parent_id",
    }.items():
        parts.append(f"select '{t}' as source_table, db_name, sequence, readable_at from (select {columns}, min(listed_at) as readable_at from {t} where db_name is not null and sequence is not null group by all)")
    return f"""
with runs as (
  select * from (select *, row_number() over (partition by run_id order by logged_at desc, {_fold("status")} desc nulls last) as place from {runs})
  where place = 1 and {_fold("status")} = 'success'),
versions as ({" union all ".join(parts)})
select distinct source_table, db_name, sequence from versions v
where not exists (select 1 from runs r where r.source_table = v.source_table and r.db_name = v.db_name
  and r.from_sequence < v.sequence and v.sequence <= r.to_sequence and r.started_at >= v.readable_at)
"""


_SMALL = f"""
listed as (
  select * from (
    select db_name, {_path("path")} as path, sequence, regexp_replace({_fold("record_type")}, '[^a-z]', '', 'g') as kind, level, file_size
    from manifest_sstable where path is not null and sequence is not null)
  qualify row_number() over (partition by db_name, path order by sequence desc) = 1),
small as (
  select l.db_name, l.path, l.level, l.file_size, t.target_file_size as target from listed l join level_target t on l.level = t.level
  where l.kind = 'addsstable' and l.file_size < t.target_file_size)
"""

SQL = {
    "p1_found": f"with {_CHANGES} select db_name, hex(key) as key_hex, eff as seq from state where live",
    "p1_state_counts": f"with {_CHANGES} select db_name, count(*) filter (live) as live_keys, count(*) filter (not live) as tombstones from state group by db_name",
    "p2_found": f"""
with recursive {_LINKS}, {_TREE}, {_ENDLESS}
select id, root_id, depth from tree
union all
select w.id, min(l.node), case when bool_or(w.above = w.id) then -1 else -2 end from walk w join loops l on w.above = l.node group by w.id""",
    "p2_paths": f"""
with recursive {_LINKS}, {_TREE}, {_CLOSURE}, below as (select ancestor, count(*) as n from closure group by 1)
select t.id, t.root_id, t.depth, t.path, coalesce(b.n, 0) as descendants from tree t left join below b on t.id = b.ancestor""",
    "p2_descendants": f"with recursive {_LINKS}, {_TREE}, {_CLOSURE} select ancestor, id, distance from closure",
    "p2_looped_paths": f"""
with recursive {_LINKS}, {_TREE}, {_ENDLESS}, {_LOOPED}
select e.id, e.root_id, case when e.on_loop then -1 else -2 end as depth, l.path from ends e join looped l on e.id = l.id""",
    "p2_back_edges": f"with recursive {_LINKS}, {_TREE}, {_ENDLESS}, {_LOOPED} select o.id, o.parent from odd o join ends e on o.id = e.id and e.id = e.root_id",
    "p3_found": f"""
with metas as (
  select {_fold("id")} as id, db_name, sequence, {_fold("snapshot_type")} as kind from snapshot_meta where id is not null
  qualify row_number() over (partition by {_fold("id")} order by listed_at desc, sequence desc) = 1),
fulls as (
  select id, lag(id) over (partition by db_name order by sequence, id) as before_id from metas where kind = 'full'),
files as (
  select {_fold("snapshot_id")} as id, {_path("relative_path")} as path, size, checksum from snapshot_file
  where relative_path is not null
  qualify row_number() over (partition by {_fold("snapshot_id")}, {_path("relative_path")} order by modified desc nulls last, size desc nulls last, checksum desc nulls last) = 1),
later as (select f.id as snapshot_id, x.path, x.size, x.checksum from fulls f join files x on x.id = f.id where f.before_id is not null),
earlier as (select f.id as snapshot_id, x.path, x.size, x.checksum from fulls f join files x on x.id = f.before_id)
select * from (
  select coalesce(n.snapshot_id, o.snapshot_id) as snapshot_id, coalesce(n.path, o.path) as relative_path, case
    when o.snapshot_id is null then 'added' when n.snapshot_id is null then 'removed'
    when n.size is distinct from o.size or n.checksum <> o.checksum then 'changed' end as change_kind
  from later n full join earlier o on n.snapshot_id = o.snapshot_id and n.path = o.path)
where change_kind is not null""",
    "p4_found": _sequences("ingest_run"),
    "p4_second_run": _sequences("ingest_run"),
    "p5_found": f"with {_SMALL} select distinct e.db_name, s.level, hex(e.key) as key_hex, e.sequence from sstable_entry e join small s on e.db_name = s.db_name and {_path('e.path')} = s.path",
    "p5_files": f"""with {_SMALL},
held as (select s.level, count(*) as records from (select distinct e.db_name, s.level, e.key, e.sequence from sstable_entry e join small s on e.db_name = s.db_name and {_path('e.path')} = s.path) s group by 1)
select s.level, count(*) as files_in, cast(sum(s.file_size) as bigint) as bytes_in, coalesce(max(h.records), 0) as records, 0 as overfull
from small s left join held h on s.level = h.level where s.db_name is not null group by s.level""",
    "kv_manifest_commit": f"""with {_SMALL},
held as (select s.level, count(*) as records from (select distinct e.db_name, s.level, e.key, e.sequence from sstable_entry e join small s on e.db_name = s.db_name and {_path('e.path')} = s.path) s group by 1),
stayed as (select level, count(*) as n from listed where kind = 'addsstable' and (db_name, path) not in (select (db_name, path) from small) group by 1)
select coalesce(s.level, h.level) as level, coalesce(s.n, 0) as stayed, 0 as inputs_left, coalesce(h.records, 0) as records from stayed s full join held h on s.level = h.level""",
}
