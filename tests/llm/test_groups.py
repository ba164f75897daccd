import random

import pytest

from lorefold.llm.groups import connected_groups, look_up

PAIRS = "from_id string, to_id string, group_id string"


def expected(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(x, find(x)) for x in parent}


def got(spark, pairs):
    return {tuple(r) for r in connected_groups(spark.createDataFrame([(a, b, "clash") for a, b in pairs], PAIRS), "from_id", "to_id").collect()}


def test_shapes(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(60)] + [(f"s{i}", f"t{i}") for i in range(0, 60, 3)]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    loop = [("l0", "l1"), ("l1", "l2"), ("l2", "l3"), ("l3", "l0"), ("l0", "tail")]
    odd = [("a", "a"), ("b", None), (None, "c"), (None, None), ("d", "e"), ("e", "d"), ("d", "e")]
    pairs = chain + star + ring + loop + odd
    assert got(spark, pairs) == expected(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for _ in range(60 + 60 * seed)]
    assert got(spark, pairs) == expected(pairs)


def test_empty(spark):
    assert got(spark, []) == set()


def test_hot_keys_are_looked_up_apart(spark):
    rows = spark.createDataFrame([(i, "hub" if i % 3 else f"k{i}") for i in range(60)] + [(99, "none")], "i int, k string")
    held = spark.createDataFrame([("hub", 1), *((f"k{i}", 100 + i) for i in range(0, 60, 3))], "k string, v int")
    plain = {(r.i, r.k, r.v) for r in rows.join(held, "k", "left").collect()}
    for hot_rows in (1, 5, 1000):
        assert {(r.i, r.k, r.v) for r in look_up(rows, "k", held, hot_rows=hot_rows).collect()} == plain
