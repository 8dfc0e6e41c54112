import random

import numpy as np
import pytest

from stopwise.llm import components


def test_unfinished_rounds_raise(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(5)], "u long, v long")
    monkeypatch.setattr(components, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError):
        components.star_components(path)


def least_of_each(links):
    least = {x: x for link in links for x in link}
    while True:
        now = {**least}
        for u, v in links:
            now[u] = now[v] = min(now[u], now[v])
        if now == least:
            return {x: m for x, m in least.items() if x != m}
        least = now


def graphs():
    rng = random.Random(3)
    hub = [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 520)]
    line = [(i, i + 1) for i in range(1000, 1060)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    shuffled = rng.sample([(-3 * b, -3 * a) for a, b in line], len(line))
    return [hub, line, some, shuffled, [(4, 4)], []]


@pytest.mark.parametrize("links", graphs())
def test_equal_plain_components(spark, links):
    rows = [*links, *links[:5], (None, 7), (7, None), (8, 8)]
    found = components.star_components(spark.createDataFrame(rows, "u long, v long").repartition(7)).collect()
    assert len(found) == len({r["u"] for r in found})
    assert {r["u"]: r["v"] for r in found} == least_of_each([(u, v) for u, v in links if u != v])


def test_stars_of_arrays():
    for links in graphs()[:4]:
        u, v = components.stars(*np.array(links, np.int64).T)
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == least_of_each(links)


def test_finished_stars_take_no_step(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "_large_star", lambda links: steps.append(1) or links)
    links = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(30, i) for i in range(31, 40)], "u long, v long")
    found = components.star_components(links)
    assert not steps and {(r["u"], r["v"]) for r in found.collect()} == {(i, 0) for i in range(1, 20)} | {(i, 30) for i in range(31, 40)}
