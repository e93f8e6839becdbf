"""Connected components against union-find, with and without the last step in one task."""

import random

import pytest

from sayframe.llm import graph
from sayframe.llm.storage import Scratch


def _least(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for e in links if e[0] != e[1] for x in e}


@pytest.mark.parametrize("rest", [0, 3, 1 << 16])
def test_components_are_brute_force(spark, monkeypatch, rest):
    monkeypatch.setattr(graph, "REST", rest)
    r = random.Random(5)
    path = [(i, i + 1) for i in range(100, 160)]
    links = path + [(7, x) for x in range(20, 40)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(90)] + [(3, 3), (101, 100), (7, 20)]
    r.shuffle(links)
    edges = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = graph.components(edges, Scratch(spark, "test")).collect()
    assert len(got) == len({x["id"] for x in got})
    assert {x["id"]: x["component_id"] for x in got} == _least(links)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long"), Scratch(spark, "test")).isEmpty()
