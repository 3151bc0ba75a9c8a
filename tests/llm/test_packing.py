import random

import pytest

from millrace.llm.packing import Windows, fill


def first_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(capacity - s)
        else:
            free[at] -= s
    return len(free)


def check(rows, items, capacities):
    for spec, capacity in capacities.items():
        mine = [r for r in rows if r.spec_id == spec]
        used, pieces = {}, {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.to_token - r.from_token
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.from_token, r.to_token))
        assert max(used.values(), default=0) <= capacity
        assert set(pieces) == {i for i, _ in items}
        for doc, size in items:
            parts = sorted(pieces[doc])
            assert parts[0][1] == 0 and parts[-1][2] == max(0, size or 0)
            assert all(a[2] == b[1] and b[0] == a[0] + 1 for a, b in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-max(0, size or 0) // capacity))
        yield spec, used


def frames(spark, items, capacities):
    df = spark.createDataFrame([(i, s, "clash") for i, s in items], "doc_id long, size long, container_id string")
    return df, spark.createDataFrame([(k, "n", c) for k, c in capacities.items()], "spec_id int, spec_name string, capacity_tokens long")


@pytest.mark.parametrize("parts", [1, 5])
def test_containers_hold_everything_and_are_full(spark, parts):
    rng = random.Random(2)
    items = [(i, rng.choice([rng.randrange(1, 300), rng.randrange(200, 900), rng.randrange(900, 3000)])) for i in range(3000)]
    capacities = {1: 512, 2: 1024, 3: 4096}
    df, specs = frames(spark, items, capacities)
    for spec, used in check(fill(df.repartition(parts), specs).collect(), items, capacities):
        rest = [s % capacities[spec] or capacities[spec] for _, s in items]
        full = sum((s - 1) // capacities[spec] for _, s in items)
        assert len(used) <= 1.06 * (first_fit(rest, capacities[spec]) + full) + 1


def test_edges(spark):
    items = [(1, 0), (2, None), (3, 10), (4, 11), (5, 30), (6, -4), (None, 5), *[(i, 0) for i in range(100, 140)]]
    df, specs = frames(spark, items, {1: 10, 2: 0, 3: -1})
    for _, used in check(fill(df, specs).collect(), items, {1: 10}):
        assert sorted(used.values()) == [6, 10, 10, 10, 10, 10]  # none is empty


@pytest.mark.parametrize("parts", [1, 3])
def test_any_number_of_items_without_length_go_where_others_are(spark, parts):
    items = [*[(i, 0) for i in range(10_050)], (20_000, 10)]
    df, specs = frames(spark, items, {1: 10})
    for _, used in check(fill(df.repartition(parts), specs, group_items=100).collect(), items, {1: 10}):
        assert list(used.values()) == [10]
    df, specs = frames(spark, items[:50], {1: 10})
    for _, used in check(fill(df, specs).collect(), items[:50], {1: 10}):
        assert used == {"1-none": 0}


def test_groups_of_the_merge_are_bounded(spark):
    items = [(i, 3) for i in range(400)]
    df, specs = frames(spark, items, {1: 10})
    for _, used in check(fill(df.repartition(4), specs, open_windows=64, group_items=50).collect(), items, {1: 10}):
        assert len(used) <= 134 + 20


def test_empty_tables(spark):
    df, specs = frames(spark, [], {1: 10})
    assert fill(df, specs).count() == 0
    assert fill(spark.createDataFrame([(1, 2, "")], df.schema), specs.limit(0)).count() == 0


def test_an_item_goes_where_it_fits_best():
    w = Windows(10, 2, "w")
    assert [w.place(s)[0] for s in (6, 8, 2, 4)] == [0, 1, 1, 0]
    assert w.place(5) == (2, 0) or w.place(5)[1] is not None
