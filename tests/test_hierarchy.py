import random

import pytest

from millrace.operators.hierarchy import back_edges, descendants, hierarchy, newest_links

ROWS = "id string, parent_id string, listed_at long, sequence long, path string, component string"


def tree(spark, pairs, **options):
    rows = [(i, p, 0, n, "clash", "clash") for n, (i, p) in enumerate(pairs)]
    return hierarchy(newest_links(spark.createDataFrame(rows, ROWS)), **options)


def brute(pairs):
    parent = dict(pairs)
    out = {}
    for node in parent:
        seen, at = [node], node
        while parent.get(at) in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        above = parent.get(at)
        if above in parent:
            loop = seen[seen.index(above) :]
            out[node] = (min(loop), -1 if node in loop else -2)
        else:
            out[node] = (at, len(seen) - 1)
    return out


def check(spark, pairs, **options):
    got = {r.id: r for r in tree(spark, pairs, **options).collect()}
    want = brute(pairs)
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == want
    for k, r in got.items():
        assert r.path[-1] == k and r.path[0] == r.root_id and len(set(r.path)) == len(r.path)
        parent = dict(pairs)
        assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))
        if r.depth >= 0:
            assert len(r.path) == r.depth + 1
            assert r.descendants == sum(1 for o in got.values() if o.id != k and k in o.path)
    loops = {root for root, depth in want.values() if depth == -1}
    assert {k for k, r in got.items() if r.back_edge} == loops
    return got


def shapes():
    rng = random.Random(4)
    chain = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(150)]
    star = [("s", "gone"), *[(f"s{i}", "s") for i in range(30)]]
    loops = [("x", "z"), ("y", "x"), ("z", "y"), ("t1", "x"), ("t2", "t1"), ("self", "self"), ("behind", "self")]
    wild = [(f"r{i}", f"r{rng.randrange(60)}") for i in range(60)]
    return chain, star, loops, wild


@pytest.mark.parametrize("most", [200_000, 20])
def test_all_shapes_at_both_sizes(spark, most):
    chain, star, loops, wild = shapes()
    check(spark, [*chain, *star, *loops, *wild], most_nodes=most)


@pytest.mark.parametrize("nodes", [5, 11, 150, 300])
@pytest.mark.parametrize("loop", [[], [("x", "z"), ("y", "x"), ("z", "y")]])
def test_lone_chains_keep_their_deep_nodes(spark, nodes, loop):
    chain = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(nodes)]
    got = {r.id: (r.root_id, r.depth) for r in tree(spark, [*chain, *loop], paths=False).collect()}
    assert got == brute([*chain, *loop])


def test_a_long_chain_that_no_task_holds(spark):
    """Sizes and depths without a path array: one row a node a round."""
    n = 30_000
    links = spark.range(n).selectExpr("cast(id as string) as id", "if(id = 0, null, cast(id - 1 as string)) as parent")
    got = hierarchy(links, most_nodes=1000, paths=False)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    wrong = got.filter(f"root_id <> '0' or depth <> cast(id as int) or descendants <> {n - 1} - cast(id as int) or path is not null")
    assert got.count() == n and wrong.count() == 0


def test_written_tables_of_the_rounds_are_deleted(spark):
    from millrace.session import Files, work_dir

    at = f"{work_dir(spark)}/millrace"
    before = set(Files(spark, at).names(at))
    tree(spark, [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(60)], most_nodes=20).count()
    assert not [x for x in set(Files(spark, at).names(at)) - before if x.startswith(("doubling", "sizes", "paths"))]


def test_rows_are_folded_and_the_last_listed_counts(spark):
    rows = [(" A1 ", "zz", 1, 1, "", ""), ("a1", "\tB2 ", 2, 1, "", ""), ("b2", None, 1, 1, "", ""), ("b2", "", 3, 2, "", ""), ("B2", "a1", 3, 1, "", ""), (None, "a1", 1, 1, "", "")]
    got = {r.id: (r.root_id, r.depth) for r in hierarchy(newest_links(spark.createDataFrame(rows, ROWS)), paths=False).collect()}
    assert got == {"a1": ("b2", 1), "b2": ("b2", 0)}


def test_descendants_and_back_edges(spark):
    t = tree(spark, [("a", None), ("b", "a"), ("c", "b"), ("p", "q"), ("q", "p")])
    assert {tuple(r) for r in descendants(t.filter("depth >= 0")).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert [tuple(r) for r in back_edges(t).collect()] == [("p", "q")]


def test_empty_table(spark):
    assert tree(spark, []).count() == 0
