"""Accounts two steps away, against brute force, and that a hub's pairs are never rows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from riskgraph.operators import graph, reach


def brute(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    return {x: len(set().union(*(near[m] for m in near[x]))) for x in near}


def test_two_hop_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(reach, "LINKS", 60)
    draw = random.Random(5)
    edges = [(draw.randrange(-40, 40), draw.randrange(200, 260)) for _ in range(150)] + [(7, k) for k in range(100, 180)] + [(5, 5), (None, 3), (3, None), (7, 100), (100, 7)]
    nodes = [*range(-40, 261), 9999]
    want = brute(edges)
    got = graph.two_hop(spark.createDataFrame([(n,) for n in nodes], "account long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.account: r.two_hop for r in got} == {n: want.get(n, 0) for n in nodes} and len(got) == len(nodes)
    named = [(None if a is None else f"a{a}", None if b is None else f"a{b}") for a, b in edges]
    got = graph.two_hop(spark.createDataFrame([(f"a{n}",) for n in nodes], "account string"), spark.createDataFrame(named, "src string, dst string")).collect()
    assert {r.account: r.two_hop for r in got} == {f"a{n}": want.get(n, 0) for n in nodes}
    none = graph.two_hop(spark.createDataFrame([(1,)], "account long"), spark.createDataFrame([], "src long, dst long")).collect()
    assert [tuple(r) for r in none] == [(1, 0)]


def test_distinct_ends_cut_anywhere(monkeypatch):
    draw = np.random.default_rng(1)
    for _ in range(200):
        monkeypatch.setattr(reach, "AT_ONCE", int(draw.integers(1, 200)))
        monkeypatch.setattr(reach, "CELLS", int(draw.integers(1, 400)))
        span = int(draw.integers(1, 60))
        left, right = (draw.integers(-span, span, (int(draw.integers(0, 80)), 2)) for _ in range(2))
        want = defaultdict(set)
        for x, m in left.tolist():
            for by, end in right.tolist():
                if by == m:
                    want[x].add(end)
        src, many = reach.distinct_ends(left[:, 0].copy(), left[:, 1].copy(), right[:, 0].copy(), right[:, 1].copy())
        assert dict(zip(src.tolist(), many.tolist(), strict=True)) == {x: len(ends) for x, ends in want.items()}


def test_hub_makes_no_rows_of_pairs(spark):
    """A hub of 3000 links has nine million ways of two steps; of which not even a tenth of a byte each may be shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(k) for k in range(s.size())])(sc.statusStore().executorList(False)))

    before = written()
    got = graph.two_hop(spark.range(3001).withColumnRenamed("id", "account"), spark.range(1, 3001).selectExpr("0L AS src", "id AS dst")).collect()
    assert {(r.account > 0, r.two_hop) for r in got} == {(False, 1), (True, 3000)}
    assert written() - before < 1_000_000
