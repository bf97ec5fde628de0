"""Rounds of the components: none for stars, and roots as a plain search finds them."""

import random

from kinfold.llm import components


def roots_of(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for n in sorted(near):
        todo = [n] if n not in out else []
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = n
                todo += near[at]
    return out


def written(spark, monkeypatch, edges):
    n, cut = [0], components.cut

    def counted(df):
        n[0] += 1
        return cut(df)

    monkeypatch.setattr(components, "cut", counted)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == roots_of(edges)
    return n[0]


def test_stars_cost_no_round(spark, monkeypatch):
    assert written(spark, monkeypatch, [(0, i) for i in range(1, 50)] + [(100, 101), (102, 100)]) == 1


def test_random_graphs_as_a_search(spark, monkeypatch):
    deal = random.Random(3)
    for n in (30, 90):
        edges = [(a, b) for a, b in ((deal.randrange(n), deal.randrange(n)) for _ in range(n * 2 // 3)) if a != b]
        assert written(spark, monkeypatch, edges) > 1
