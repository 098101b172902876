import random

import pytest
from pyspark.sql import functions as F

from weft.llm.groups import UnionFind, linked_groups, resolve_pairs, tidy_id

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
MATCH = f"match_id long, sg_a int, node_a string, bbox_a {BOX}, sg_b int, node_b string, bbox_b {BOX}, matched boolean, nid string, key_a string"
NODE = f"sg_idx int, node_id string, bbox {BOX}, box string"


def brute(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        if s not in out:
            group, stack = {s}, [s]
            while stack:
                for u in near[stack.pop()] - group:
                    group.add(u), stack.append(u)
            out |= {m: min(group) for m in group}
    return out


def groups(spark, pairs, **kw):
    rows = linked_groups(spark.createDataFrame([(a, b, "clash") for a, b in pairs], "a string, b string, node string"), **kw).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.group_id for r in rows}


@pytest.mark.parametrize("bound", [10**6, 500, 60])
def test_against_brute_force(spark, bound):
    rnd = random.Random(bound)
    pairs = [(f"n{rnd.randrange(900)}", f"n{rnd.randrange(900)}") for _ in range(380)]
    pairs += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(250)] + [("hub", f"h{i}") for i in range(200)] + pairs[:50]
    rnd.shuffle(pairs)
    assert groups(spark, pairs, partition_rows=bound) == brute(pairs)


@pytest.mark.parametrize("parts", [2, 3, 9, 20])
def test_many_small_groups_over_many_partitions(spark, parts):
    pairs = [(f"a{i:04d}", f"b{i:04d}") for i in range(9000)] + [(f"b{i:04d}", f"c{i:04d}") for i in range(0, 9000, 2)] + [(f"c{i:04d}", f"c{i + 2:04d}") for i in range(0, 1000, 4)]
    random.Random(parts).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(parts)
    rows = linked_groups(df).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.group_id for r in rows} == brute(pairs)


def test_defined_cases(spark):
    assert groups(spark, [(None, "a"), ("a", None), (None, None), ("b", "b")]) == {}
    assert groups(spark, []) == {}
    assert groups(spark, [("b", "a"), ("a", "b"), ("a", "b"), ("", "c")]) == {"a": "a", "b": "a", "": "", "c": ""}
    long = "x" * 100_000
    assert groups(spark, [(long, "a")]) == {long: "a", "a": "a"}


def test_union_find_roots_at_the_smallest():
    u = UnionFind()
    for a, b in (("d", "c"), ("b", "a"), ("c", "b")):
        u.union(a, b)
    assert sorted(u.stars()) == [("b", "a"), ("c", "a"), ("d", "a")]


def test_tidy_id(spark):
    rows = [(" N-1\t",), (" n-1﻿",), ("  ",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(tidy_id(F.col("v"))).collect()] == ["n-1", "n-1", None, None, None]


def box(x, y, w=0.1):
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + w}


def test_resolving(spark):
    nodes = [(1, "n1", box(0.1, 0.1), "clash"), (1, "n1", box(0.1, 0.1), "again"), (1, "n2", box(0.5, 0.5), None), (2, "n3", box(0.1, 0.1), None), (2, "n4", None, None), (None, "n5", box(0.9, 0.1), None), (3, None, box(0.2, 0.2), None)]
    turned = {"x1": 0.2, "y1": 0.2, "x2": 0.1, "y2": 0.1}
    near = {"x1": 0.1009, "y1": 0.0991, "x2": 0.2005, "y2": 0.1995}
    off = {"x1": 0.1011, "y1": 0.1, "x2": 0.2, "y2": 0.2}
    half = {"x1": 0.1, "y1": None, "x2": 0.2, "y2": 0.2}
    matches = [
        (1, 1, " N1 ", None, 2, "n3", None, True),
        (2, 1, None, near, 1, "n2\t", None, True),
        (3, 2, "", turned, 2, "N4", None, True),
        (4, 1, None, off, 1, "n2", None, True),
        (5, 9, "nobody", box(0.1, 0.1), 1, "n2", None, True),
        (6, None, None, near, 1, "n2", None, True),
        (7, 1, "n1", None, 1, "n2", None, False),
        (8, 1, "n1", None, 1, "n2", None, None),
        (9, 1, None, half, 1, "n2", None, True),
        (10, 3, None, box(0.2, 0.2), 1, "n2", None, True),
    ]
    got = resolve_pairs(spark.createDataFrame([(*m, "clash", "clash") for m in matches], MATCH), spark.createDataFrame(nodes, NODE)).collect()
    assert sorted((r.a, r.b) for r in got) == [("n1", "n2"), ("n1", "n3"), ("n3", "n4")]


def test_resolving_on_cell_borders(spark):
    rnd = random.Random(2)
    nodes, matches = [], []
    for i in range(300):
        b = box(round(rnd.randrange(100) * 0.008 + rnd.choice([0, 1e-4, -1e-4]), 6), round(rnd.randrange(100) * 0.008, 6))
        nodes.append((i, f"n{i}", b, None))
        shifted = {k: v + rnd.uniform(-0.00099, 0.00099) for k, v in b.items()}
        matches.append((i, i, None, shifted, 0, "n0", None, True, None, None))
    got = resolve_pairs(spark.createDataFrame(matches, MATCH), spark.createDataFrame(nodes, NODE))
    assert got.select("a").distinct().count() == 300


def test_resolving_empty(spark):
    assert resolve_pairs(spark.createDataFrame([], MATCH), spark.createDataFrame([], NODE)).count() == 0
