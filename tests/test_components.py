"""Components against union-find, with and without hubs."""

import random

import pytest

from strandframe.operators import components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hub", [1, components.HUB])
def test_against_union_find(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    edges += [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + i, 4000) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7), (9999, 9999)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == plain(edges)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
