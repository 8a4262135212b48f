"""Groups of linked records against union-find."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moltide.llm import components as CO


def union_find(ids, edges):
    up = {i: i for i in ids if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def groups(spark, ids, edges):
    i = spark.createDataFrame([(x, "e") for x in ids], "id long, group_id string")
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, id int")
    rows = CO.groups(i, e).collect()
    assert len(rows) == len({x for x in ids if x is not None})
    return {r["id"]: r["group_id"] for r in rows}


def test_chains_stars_rings_and_dirt(spark):
    ids = [*range(1, 41), 7, None, 100, 101]
    chain = [(i, i + 1) for i in range(1, 12)]
    star = [(20, i) for i in range(21, 30)]
    ring = [(30, 31), (31, 32), (32, 30), (31, 30), (30, 31)]
    dirt = [(40, 40), (None, 39), (38, None), (39, 999), (998, 997), (101, 100)]
    edges = chain + star + ring + dirt
    random.Random(1).shuffle(edges)
    assert groups(spark, ids, edges) == union_find(ids, edges)


def test_hot_components_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(CO, "HOT_LEAST", 10)
    monkeypatch.setattr(CO, "HOT", 5)
    edges = [(1, i) for i in range(2, 60)] + [(59, 100), (100, 101), (200, 201)]
    ids = [*range(1, 60), 100, 101, 200, 201]
    assert groups(spark, ids, edges) == union_find(ids, edges)


@pytest.mark.parametrize("ids,edges", [([], []), ([3, 1], []), ([], [(1, 2)])])
def test_empty(spark, ids, edges):
    assert groups(spark, ids, edges) == union_find(ids, edges)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_any_graph(spark, edges):
    ids = list(range(20))
    assert groups(spark, ids, edges) == union_find(ids, edges)
