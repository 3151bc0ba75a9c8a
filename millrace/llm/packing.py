"""Filling containers of fixed capacity with items of varying length (problem 7).

Method: bounded-space online packing. Each partition keeps a fixed number of open
windows; an item goes to the window that it fills best; when none fits and no
more may be opened, the fullest is emitted. The windows that are open at the end
are merged: their items, a bounded number a partition, are packed again, by
best-fit decreasing, in groups of at most GROUP_ITEMS.

An item over the capacity is divided into full containers of its own and a rest
that is packed like other items; no other item is divided.

Items of length 0 take no room; they are set aside, however many there are, and
dealt to containers that others have made, once these are known.

Defined results: items without length (null) count as of length 0 and so do negative
lengths; if there are no others, they share one container; a capacity below 1 or null
has no containers; repeated ids are items of their own, and so are items without id.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize, ship

#: Windows that a partition keeps open for each capacity.
OPEN_WINDOWS = 1024
#: Containers of a capacity among which items of length 0 are dealt.
HOMES = 256
#: Items that the last merge packs at once.
GROUP_ITEMS = 100_000

_PLACED = "spec_id int, doc_id long, piece_no int, from_token long, to_token long, container_id string, open boolean, capacity long"
_TYPES = [("spec_id", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("from_token", pa.int64()), ("to_token", pa.int64()), ("container_id", pa.string()), ("open", pa.bool_()), ("capacity", pa.int64())]


class Windows:
    """Open windows in order of free room."""

    def __init__(self, capacity: int, most: int | None, prefix: str):
        self.capacity, self.most, self.prefix = capacity, most, prefix
        self.free: list[int] = []
        self.ids: list[int] = []
        self.count = 0

    def place(self, size: int) -> tuple[int, int | None]:
        """The window of an item, and the window that was emitted for it."""
        at, emitted = bisect_left(self.free, size), None
        if at == len(self.free):
            if self.most is not None and len(self.free) >= self.most:
                self.free.pop(0)
                emitted = self.ids.pop(0)
            window, room = self.count, self.capacity
            self.count += 1
        else:
            room, window = self.free.pop(at), self.ids.pop(at)
        room -= size
        to = bisect_left(self.free, room)
        self.free.insert(to, room)
        self.ids.insert(to, window)
        return window, emitted

    def name(self, window: int) -> str:
        return f"{self.prefix}-{window}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], names=[n for n, _ in _TYPES])


def _online(specs: list[tuple[int, int]], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        windows = {s: Windows(c, most, f"{s}-{task}") for s, c in specs}
        held: dict[tuple[int, int], list[tuple]] = {}
        rows: list[tuple] = []
        for batch in batches:
            for doc, size in zip(batch.column("doc_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                for spec, capacity in specs:
                    w = windows[spec]
                    if not size:
                        rows.append((spec, doc, 0, 0, 0, None, False, capacity))
                        continue
                    piece, start = 0, 0
                    while size - start > capacity:
                        rows.append((spec, doc, piece, start, start + capacity, f"{spec}-{task}-full-{w.count}", False, capacity))
                        w.count += 1
                        piece, start = piece + 1, start + capacity
                    window, emitted = w.place(size - start)
                    if emitted is not None:
                        rows.extend((*x, w.name(emitted), False, capacity) for x in held.pop((spec, emitted)))
                    held.setdefault((spec, window), []).append((spec, doc, piece, start, size))
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        for (spec, window), items in held.items():
            rows.extend((*x, windows[spec].name(window), True, windows[spec].capacity) for x in items)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Best-fit decreasing over the items of one group."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: (r["from_token"] - r["to_token"], r["doc_id"] is None, r["doc_id"] or 0, r["piece_no"]))
    name = uuid.uuid5(uuid.NAMESPACE_OID, repr([(r["doc_id"], r["piece_no"], r["container_id"]) for r in rows[:50]])).hex[:12]
    windows = Windows(rows[0]["capacity"], None, f"{rows[0]['spec_id']}-m{rows[0]['part']}-{name}")
    out = [(r["spec_id"], r["doc_id"], r["piece_no"], r["from_token"], r["to_token"], windows.name(windows.place(r["to_token"] - r["from_token"])[0]), False, r["capacity"]) for r in rows]
    return pa.Table.from_batches([_batch(out)])


def fill(items: DataFrame, specs: DataFrame, open_windows: int = OPEN_WINDOWS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, from_token, to_token) for items (doc_id, size) and specs (spec_id, capacity_tokens).

    The specs are few: they go to every task.
    """
    spark = items.sparkSession
    ship(spark)
    known = sorted((r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").distinct().collect() if r[0] is not None and r[1] and r[1] > 0)
    sized = items.select("doc_id", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    placed = materialize(sized.mapInArrow(_online(known, open_windows), _PLACED), "placed")
    left = placed.filter("open")
    counts = left.groupBy("spec_id").agg(F.count("*").alias("items"))
    parts = F.ceil(F.col("items") / F.lit(group_items)).cast("int")
    # whole windows stay together, as they are well filled already; few groups, each of bounded size
    grouped = left.join(F.broadcast(counts), "spec_id").withColumn("part", F.pmod(F.xxhash64("container_id"), parts).cast("int")).drop("items")
    merged = materialize(grouped.groupBy("spec_id", "part").applyInArrow(_merge, _PLACED), "merged")
    columns = ["spec_id", "container_id", "doc_id", "piece_no", "from_token", "to_token"]
    whole = placed.filter("not open and container_id is not null").unionByName(merged)
    aside = placed.filter("container_id is null")
    if aside.isEmpty():
        return whole.select(*columns)
    slot = F.pmod(F.xxhash64("container_id"), F.lit(HOMES))
    homes = whole.groupBy("spec_id", slot.alias("slot")).agg(F.min("container_id").alias("home"))  # HOMES a capacity at most
    any_home = homes.groupBy("spec_id").agg(F.min("home").alias("any_home"))
    dealt = aside.drop("container_id").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(HOMES))).join(F.broadcast(homes), ["spec_id", "slot"], "left").join(F.broadcast(any_home), "spec_id", "left")
    empty = F.concat(F.col("spec_id").cast("string"), F.lit("-none"))
    return whole.select(*columns).unionByName(dealt.withColumn("container_id", F.coalesce("home", "any_home", empty)).select(*columns))
