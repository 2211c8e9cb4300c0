import random

import pytest

from spanveil.llm import graph


def plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return sorted((x, root(x)) for x in parent if root(x) != x)


def shapes():
    draw = random.Random(2)
    yield []
    yield [(5, 5)]
    yield [(i, i + 1) for i in range(70)]  # a chain
    yield [(0, i) for i in range(1, 200)] + [(200, i) for i in range(150, 260)]  # two stars that meet
    yield [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    yield [(-(1 << 62), 1 << 62), (7, -(1 << 62)), (7, 7), (7, -(1 << 62))]


@pytest.mark.parametrize("links", list(shapes()), ids=range(6))
def test_components(spark, links):
    got = graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == plain(links)
