import random

import pytest

from twinfold.operators import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("single", [20_000, 0])
@pytest.mark.parametrize("edges", [[], [(1, 1)], [(0, 1), (1, 2), (3, 4)], [(i, i + 1) for i in range(60)], [(7, i) for i in range(40)]])
def test_fixed_graphs(spark, monkeypatch, edges, single):
    monkeypatch.setattr(components, "SINGLE_TASK_EDGES", single)
    df = spark.createDataFrame([*edges, *edges], "src long, dst long").repartition(3)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == brute(edges)


def test_random_graph(spark, monkeypatch):
    monkeypatch.setattr(components, "SINGLE_TASK_EDGES", 0)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "src long, dst long")
    got = {x.node: x.component for x in components.connected_components(df).collect()}
    assert got == brute(edges)
