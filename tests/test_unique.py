"""Worst paths through different vertices, against all paths by brute force."""

from __future__ import annotations

import pytest

from tests.test_paths import EDGE, all_paths, random_graph
from voltgrain.operators import graph as gr
from voltgrain.operators.paths import k_worst_unique, rank_slacks, unique_ends, unique_lists


@pytest.mark.parametrize("seed,which,k", [(3, "max", 3), (5, "min", 3), (7, "max", 200)])
def test_unique_paths_equal_all_paths(spark, seed, which, k):
    edges = random_graph(seed, n=11, m=44)
    seeds = [(0, "rise", 1, 3, 1), (0, "fall", 1, 0, 0), (1, "rise", 2, 2, 2), (4, "fall", 1, 9, 0)]
    g = gr.Levelled(spark.createDataFrame(edges, EDGE))
    sd = spark.createDataFrame(seeds, "v long, rf string, clk int, a_max long, a_min long")
    found = k_worst_unique(g, sd, k, which=which)
    paths = unique_ends(found, spark.createDataFrame([(v,) for v in range(8, 11)], "v long"), k, which=which)
    got = {}
    for r in unique_lists(found, paths, g.depth).orderBy("rank").collect():
        got.setdefault((r.v, r.clk), []).append((r.time, tuple(r.vertices)))
    worst = max if which == "max" else min
    want = {}
    for (v, _, clk), time, pts, _ in all_paths(edges, seeds, which):
        if v >= 8:
            lists = want.setdefault((v, clk), {})
            names = tuple(p[0] for p in reversed(pts))
            lists[names] = worst(time, lists.get(names, time))
    assert set(got) == set(want)
    merged = 0
    for end, rows in got.items():
        every = sorted(want[end].values(), reverse=which == "max")
        assert [t for t, _ in rows] == every[:k]
        assert len({p for _, p in rows}) == len(rows)          # no list twice
        assert all(want[end][p] == t for t, p in rows)         # each with its own worst time
        merged += len(every)
    assert merged < sum(1 for (v, _, _), *_ in all_paths(edges, seeds, which) if v >= 8)


def test_latch_ends_of_slack_zero_go_by_borrow(spark):
    rows = [(1, 0, 5), (2, 0, 9), (3, -1, None), (4, 0, None), (5, 2, 0)]
    e = spark.createDataFrame(rows, "v long, slack long, borrow long").selectExpr("*", "1 as clk")
    got = [r.v for r in rank_slacks(e, 4, "clk", ["v"]).orderBy("group_rank").collect()]
    assert got == [3, 2, 1, 4]
