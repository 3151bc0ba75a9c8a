"""Full hierarchies from parent-child links of unknown depth (problem 2).

Method: connected components first, then each component is brought together
in one task, where an iterative depth-first traversal colours its nodes (white,
grey, black) and puts out path, depth, root, subtree size and the back edges
that close loops.

A node has one parent at most, so components come out of pointer doubling: after
k rounds a node knows its 2^k-th ancestor and the least id on the way. Nodes that
have reached a root leave the rounds; the rest go on until a round settles none
of them (so none is finite) and the steps reach their number, when all pointers stand
on a loop. That takes log2(depth or number of endless nodes) rounds.

A component may be larger than a task should hold. Those over `most_nodes` keep
out of the traversal: the rounds also add up steps and loop minima, so that root
and depth are at hand. Sizes of subtrees come from doubling too: each round adds to a node
what the nodes 2^k below it have; that is one row a node a round. Paths are made only
if they are asked for.

Defined results: ids are folded (lower case, outer white space off); rows without
id are no nodes; of several rows of an id the one listed last counts, at equal
times (no time is the earliest) the one with the greater sequence, then the greater
parent; other columns are ignored; repeated rows change nothing; a parent that
is null, blank or not in the table makes a root; a node that is its own parent is
a loop of one. On loops depth is -1, for nodes that lead into one it is -2, and
the root is the loop's least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.text import folded
from millrace.session import discard, materialize, ship

#: Nodes of a component that one task may hold; beyond it the doubling rounds give the result.
MOST_NODES = 200_000

TRAVERSED = "id string, parent string, component string, root_id string, depth int, path array<string>, descendants long, back_edge boolean"


def newest_links(rows: DataFrame, node: str = "id", parent: str = "parent_id", listed: str = "listed_at", order: str | None = "sequence") -> DataFrame:
    """(id, parent): the row of each id that was listed last; parent is null for roots."""
    rank = [F.col(listed), *([F.col(order)] if order else []), folded(F.col(parent))]
    picked = (
        rows.select(folded(F.col(node)).alias("id"), F.struct(*[x.alias(f"r{i}") for i, x in enumerate(rank)]).alias("rank"))
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("rank").alias("rank"))
        .select("id", F.col(f"rank.r{len(rank) - 1}").alias("named"))
    )
    picked = materialize(picked, "links")
    known = picked.select(F.col("id").alias("parent"))
    return picked.join(known, picked["named"] == known["parent"], "left").select("id", "parent")


def components(links: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(id, parent, component, root_id, steps, on_loop): component is the root or the loop's least id.

    steps is the distance from the root; null where the parents never end. `paths` gets
    where the tables of the rounds lie.
    """
    links = materialize(links, "links", paths)
    settled = links.filter(F.col("parent").isNull()).select("id", "parent", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("steps"))
    active = links.filter(F.col("parent").isNotNull()).select("id", "parent", F.col("parent").alias("at"), F.least("id", "parent").alias("least"), F.lit(1).cast("long").alias("steps"))
    reach, left = 1, -1
    while True:
        # a pointer at a settled node ends here, one at an active node doubles
        ends = settled.select(F.col("id").alias("at"), F.col("root_id"), F.lit(None).cast("string").alias("at2"), F.lit(None).cast("string").alias("least2"), F.col("steps").alias("more"))
        hops = active.select(F.col("id").alias("at"), F.lit(None).cast("string").alias("root_id"), F.col("at").alias("at2"), F.col("least").alias("least2"), F.col("steps").alias("more"))
        merged = active.join(ends.unionByName(hops), "at").select(
            "id", "parent", "root_id", F.col("at2").alias("at"), F.least("least", "least2").alias("least"), (F.col("steps") + F.col("more")).alias("steps")
        )
        seen = Observation()
        merged = materialize(merged.observe(seen, F.count_if(F.col("root_id").isNull()).alias("left")), "doubling", paths)
        settled = settled.unionByName(merged.filter(F.col("root_id").isNotNull()).select("id", "parent", "root_id", "steps"))
        active = merged.filter(F.col("root_id").isNull()).drop("root_id")
        before, left = left, seen.get["left"]
        reach *= 2
        # a finite node of depth >= reach has an ancestor that the next round settles, so a round that settles none leaves endless nodes only
        if left == 0 or (left == before and reach >= left):
            break
    whole = settled.select("id", "parent", F.col("root_id").alias("component"), "root_id", "steps", F.lit(False).alias("on_loop"))
    if left == 0:
        return whole
    # what is left never ends: every walk ends on its loop, and those of a loop's own nodes end on each of them
    ends = active.groupBy("at").agg(F.count("*").alias("walks")).select(F.col("at").alias("id"))
    on = active.join(ends, "id", "left_semi").select(F.col("id").alias("at"), F.col("least").alias("root_id"))
    looped = active.drop("least").join(on, "at").select("id", "parent", "root_id")
    marked = looped.join(on.select(F.col("at").alias("node")), F.col("id") == F.col("node"), "left")
    return whole.unionByName(marked.select("id", "parent", F.col("root_id").alias("component"), "root_id", F.lit(None).cast("long").alias("steps"), F.col("node").isNotNull().alias("on_loop")))


def _traverse(ids: list[str], parents: list[str | None]) -> tuple[list[int], list[int], list[int], list[int], list[int], list[bool]]:
    """Depth-first over one component, with an explicit stack: nodes in preorder, then of each node its level in a path, depth, root, descendants and whether its link closes a loop."""
    place = {x: i for i, x in enumerate(ids)}
    children: list[list[int]] = [[] for _ in ids]
    up = [-1] * len(ids)
    for i, p in enumerate(parents):
        if p is not None:
            up[i] = place[p]
            children[up[i]].append(i)
    white, grey, black = 0, 1, 2
    colour, order = [white] * len(ids), []
    level, depth, root, below, back = [0] * len(ids), [0] * len(ids), [0] * len(ids), [0] * len(ids), [False] * len(ids)

    def descend(start: int) -> None:
        colour[start] = grey
        stack = [(start, iter(children[start]))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                colour[node] = black
                stack.pop()
                if stack:
                    below[stack[-1][0]] += below[node] + 1
            elif colour[child] == white:
                colour[child] = grey
                level[child] = level[node] + 1
                depth[child] = depth[node] + 1 if depth[node] >= 0 else depth[node]
                root[child] = root[node]
                order.append(child)
                stack.append((child, iter(children[child])))
            elif colour[child] == grey:
                back[child] = True  # a link to a node that is still open closes a loop

    for i in [i for i, p in enumerate(up) if p < 0]:
        root[i] = i
        order.append(i)
        descend(i)
    while len(order) < len(ids):
        # no root above: walk up until a node comes again, which is on the loop
        seen, i = set(), next(j for j, c in enumerate(colour) if c == white)
        while i not in seen:
            seen.add(i)
            i = up[i]
        loop, j = [i], up[i]
        while j != i:
            loop.append(j)
            j = up[j]
        least = min(range(len(loop)), key=lambda k: ids[loop[k]])
        loop = loop[least::-1] + loop[:least:-1]  # from the least id downwards, parent before child
        first = len(order)
        for node in loop:
            colour[node] = grey
        back[loop[0]] = True
        for k, node in enumerate(loop):
            root[node], level[node], depth[node] = loop[0], k, -1
            order.append(node)
            for child in children[node]:
                if colour[child] == white:
                    root[child], level[child], depth[child] = loop[0], k + 1, -2
                    order.append(child)
                    descend(child)
        for node in loop:
            below[node] = len(order) - first - 1
    return order, level, depth, root, below, back


def _traverser(paths: bool):
    schema = pa.schema([("id", pa.string()), ("parent", pa.string()), ("component", pa.string()), ("root_id", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("descendants", pa.int64()), ("back_edge", pa.bool_())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive ordered by component; each is traversed when it is complete."""
        held, ids, parents, rows, signs = None, [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows, signs
            order, level, depth, root, below, back = _traverse(ids, parents)
            trail: list[str] = []
            for i in order:
                del trail[level[i] :]
                trail.append(ids[i])
                rows.append((ids[i], parents[i], held, ids[root[i]], depth[i], trail.copy() if paths else None, below[i], back[i]))
                signs += 1 + len(trail) * paths
                if signs > 200_000:
                    yield out(rows)
                    rows, signs = [], 0

        for batch in batches:
            for component, node, parent in zip(*(batch.column(c).to_pylist() for c in ("component", "id", "parent")), strict=True):
                if component != held and ids:
                    yield from close()
                    ids, parents = [], []
                held = component
                ids.append(node)
                parents.append(parent)
        if ids:
            yield from close()
        if rows:
            yield out(rows)

    return run


def _doubled_paths(nodes: DataFrame, rounds: int, paths: list[str]) -> DataFrame:
    """Paths in components too large for a task, by log2(depth) self-joins."""
    walk = nodes.select("id", F.when(~F.col("stop"), F.col("parent")).alias("at"), F.array("id").alias("path"))
    for _ in range(rounds):
        hop = walk.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("path").alias("head"))
        walk = materialize(
            walk.join(hop, "at", "left").select("id", F.when(F.col("at").isNotNull(), F.col("at2")).alias("at"), F.when(F.col("head").isNotNull(), F.concat("head", "path")).otherwise(F.col("path")).alias("path")), "paths", paths
        )
    return walk.select("id", "path")


def _doubled_sizes(nodes: DataFrame, rounds: int, paths: list[str]) -> DataFrame:
    """(id, n): nodes below each node of components too large for a task.

    After k rounds n counts the subtree down to 2^k - 1 levels below; the nodes 2^k below
    have counted the next 2^k levels.
    """
    walk = nodes.select("id", F.when(~F.col("stop"), F.col("parent")).alias("at"), F.lit(1).cast("long").alias("n"))
    for _ in range(rounds):
        more = walk.filter(F.col("at").isNotNull()).groupBy(F.col("at").alias("of")).agg(F.sum("n").alias("more"))
        hop = walk.select(F.col("id").alias("at"), F.col("at").alias("at2"))
        grown = walk.join(more, F.col("id") == F.col("of"), "left").select("id", "at", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        walk = materialize(grown.join(hop, "at", "left").select("id", F.col("at2").alias("at"), "n"), "sizes", paths)
    return walk.select("id", (F.col("n") - 1).alias("n"))


def hierarchy(links: DataFrame, most_nodes: int = MOST_NODES, paths: bool = True) -> DataFrame:
    """(id, parent, component, root_id, depth, path, descendants, back_edge) of every node of `links` (id, parent).

    path runs from the root (on and behind a loop: from its least id) to the node;
    without `paths` it is null, which saves the depth of each node in signs.
    """
    spark, used = links.sparkSession, []
    ship(spark)
    labelled = materialize(components(links, used), "components")
    discard(spark, used)
    sizes = labelled.groupBy("component").agg(F.count("*").alias("nodes"))
    large = materialize(sizes.filter(F.col("nodes") > most_nodes), "large")
    some = not large.isEmpty()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = labelled.join(large, "component", "left_anti") if some else labelled
    traversed = small.select("component", "id", "parent").repartition(partitions, "component").sortWithinPartitions("component", "id").mapInArrow(_traverser(paths), TRAVERSED)
    if not some:
        return traversed
    stop = F.col("parent").isNull() | (F.col("id") == F.col("root_id"))
    big = materialize(labelled.join(large, "component").withColumn("stop", stop), "big")
    deepest = big.agg(F.max(F.coalesce("steps", "nodes"))).first()[0]
    rounds = int(deepest).bit_length()
    done = materialize(_doubled_sizes(big, rounds, used), "subtrees")
    discard(spark, used)
    depth = F.when(F.col("steps").isNotNull(), F.col("steps")).when(F.col("on_loop"), F.lit(-1)).otherwise(F.lit(-2)).cast("int")
    joined, path = big.join(done, "id"), F.lit(None).cast("array<string>")
    if paths:
        walked = materialize(_doubled_paths(big, rounds, used), "walked")
        discard(spark, used)
        joined, path = joined.join(walked, "id"), F.col("path")
    doubled = joined.select("id", "parent", "component", "root_id", depth.alias("depth"), path.alias("path"),
                            F.when(F.col("on_loop"), F.col("nodes") - 1).otherwise(F.col("n")).alias("descendants"),
                            (F.col("on_loop") & (F.col("id") == F.col("root_id"))).alias("back_edge"))
    return traversed.unionByName(doubled)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, id, distance): all pairs of a node and one below it, from the paths; loops count from their least id."""
    spread = tree.select("id", F.posexplode("path").alias("i", "ancestor"), F.size("path").alias("n"))
    return spread.filter(F.col("i") < F.col("n") - 1).select("ancestor", "id", (F.col("n") - 1 - F.col("i")).alias("distance"))


def back_edges(tree: DataFrame) -> DataFrame:
    """(id, parent): the links that close a loop, one of each loop."""
    return tree.filter("back_edge").select("id", "parent")
