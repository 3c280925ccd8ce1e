"""Slews carried with delays, k worst paths by diversions, and exceptions with ordered through points, against brute force."""

from __future__ import annotations

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from voltgrain.operators import exceptions as ex, graph as gr
from voltgrain.operators.paths import PathSearch
from voltgrain.operators.slew import edge_delays, slew_arrivals

EDGE = "e_id long, from_v long, from_rf string, to_v long, to_rf string, d_max long, d_min long"


def random_graph(seed, n=14, m=40):
    r = random.Random(seed)
    rows = set()
    while len(rows) < m:
        a, b = sorted(r.sample(range(n), 2))
        rows.add((a, r.choice(["rise", "fall"]), b, r.choice(["rise", "fall"]), len(rows)))
    return [(i, a, x, b, y, 5 + r.randint(0, 6), r.randint(0, 5)) for i, (a, x, b, y, _) in enumerate(sorted(rows))]


def all_paths(edges, seeds, which):
    """(end, time, points from end to start, edges) of every path from a seed."""
    out, d = [], 5 if which == "max" else 6

    def walk(v, rf, clk, time, pts, es):
        out.append(((v, rf, clk), time, [(v, rf, time), *pts], es))
        for e in edges:
            if (e[1], e[2]) == (v, rf):
                walk(e[3], e[4], clk, time + e[d], [(v, rf, time), *pts], [e[0], *es])

    for v, rf, clk, a_max, a_min in seeds:
        walk(v, rf, clk, a_max if which == "max" else a_min, [], [])
    return out


@pytest.mark.parametrize("which,k", [("max", 4), ("min", 4), ("max", 500)])
def test_k_worst_paths_equal_all_paths(spark, which, k):
    edges = random_graph(3)
    # vertex 5 is a start inside the graph
    seeds = [(0, "rise", 1, 3, 1), (0, "fall", 1, 0, 0), (1, "rise", 2, 2, 2), (5, "fall", 1, 9, 0), (5, "rise", 2, 1, 1)]
    g = gr.Levelled(spark.createDataFrame(edges, EDGE))
    sd = spark.createDataFrame(seeds, "v long, rf string, clk int, a_max long, a_min long")
    arr = gr.arrivals(g, sd)
    search = PathSearch(g, sd, arr, which=which)
    ends = arr.filter("v >= 11").select(F.concat_ws("/", "v", "clk").alias("end_id"), "v", "rf", "clk")
    paths = search.k_worst(ends, k)
    got = {}
    for r in paths.collect():
        got.setdefault(r.end_id, []).append((r["rank"], r.total))
    sign = -1 if which == "max" else 1
    want = {}
    for (v, _, clk), time, pts, es in all_paths(edges, seeds, which):
        if v >= 11:
            want.setdefault(f"{v}/{clk}", []).append((time, pts, es))
    assert sorted(got) == sorted(want)
    for end, rows in got.items():
        assert [t for _, t in sorted(rows)] == sorted((t for t, _, _ in want[end]), key=lambda t: sign * t)[:k]
    walked = {}
    for r in search.points(paths).collect():
        walked.setdefault((r.end_id, r["rank"]), []).append((r.step, r.v, r.rf, r.time, r.e_id))
    assert len(walked) == sum(map(len, got.values()))
    seen = set()
    for (end, rank), pts in walked.items():
        pts.sort()
        es = [p[4] for p in pts if p[4] is not None]
        assert (dict(got[end])[rank], [tuple(p[1:4]) for p in pts], es) in want[end]
        assert (end, tuple(es), pts[-1][1:3]) not in seen
        seen.add((end, tuple(es), pts[-1][1:3]))


def bilinear(ax1, ax2, vals, x, y):
    i, j = (min(max(bisect_right(a, z) - 1, 0), len(a) - 2) for a, z in ((ax1, x), (ax2, y)))
    u, w = (x - ax1[i]) / (ax1[i + 1] - ax1[i]), (y - ax2[j]) / (ax2[j + 1] - ax2[j])
    f = lambda a, b: vals[a * len(ax2) + b]
    return (1 - u) * ((1 - w) * f(i, j) + w * f(i, j + 1)) + u * ((1 - w) * f(i + 1, j) + w * f(i + 1, j + 1))


TABLES = [(1, [0.1, 0.4], [1.0, 2.0], [1.0, 2.0, 3.0, 5.0], [0.2, 0.3, 0.5, 0.9]), (2, [0.1, 0.2, 0.4], [1.0, 3.0], [2.0, 2.5, 2.0, 4.0, 6.0, 7.0], [0.1, 0.15, 0.2, 0.3, 0.25, 0.6])]
T_SCHEMA = "table_id int, axis1 array<double>, axis2 array<double>, delay_values array<double>, slew_values array<double>"
S_SCHEMA = "v long, rf string, clk int, a_max double, a_min double, slew_max double, slew_min double"
W_EDGE = "e_id long, from_v long, from_rf string, to_v long, to_rf string, table_id int, load double, wire_delay double"


def test_slew_changes_the_delays_of_a_three_stage_chain(spark):
    edges = [(i, i, "rise", i + 1, "rise", 1, 1.5, None) for i in range(3)]
    g = gr.Levelled(spark.createDataFrame(edges, W_EDGE))
    t = spark.createDataFrame(TABLES, T_SCHEMA)
    got = {r.v: r for r in slew_arrivals(g, spark.createDataFrame([(0, "rise", 1, 0.0, 0.0, 0.2, 0.1)], S_SCHEMA), t).collect()}
    slew, time = 0.2, 0.0
    for v in (1, 2, 3):
        time += bilinear(*TABLES[0][1:4], slew, 1.5)
        slew = bilinear(*TABLES[0][1:3], TABLES[0][4], slew, 1.5)
        assert (got[v].a_max, got[v].slew_max) == pytest.approx((time, slew))
    fixed = 3 * bilinear(*TABLES[0][1:4], 0.2, 1.5)
    assert abs(got[3].a_max - fixed) > 0.1


def test_slew_and_arrival_merge_apart(spark):
    r = random.Random(2)
    edges = [(i, a, x, b, y, r.choice([1, 2, None]), r.choice([0.5, 1.5, 4.0]), r.choice([0.25, 1.0])) for i, (_, a, x, b, y, _, _) in enumerate(random_graph(8))]
    seeds = [(0, "rise", 1, 3.0, 1.0, 0.2, 0.1), (0, "fall", 1, 0.0, 0.0, 0.5, 0.3), (1, "rise", 2, 2.0, 2.0, 0.15, 0.15), (1, "fall", 2, 0.0, 0.0, 0.3, 0.01)]
    table = {t[0]: t[1:] for t in TABLES}
    state = {s[:3]: list(s[3:]) for s in seeds}
    for v in range(14):
        for e in edges:
            if e[1] == v:
                for clk in (1, 2):
                    if s := state.get((v, e[2], clk)):
                        new = []
                        for a, slew in ((s[0], s[2]), (s[1], s[3])):
                            t = table.get(e[5])
                            new.append((a + (bilinear(*t[:3], slew, e[6]) if t else e[7]), bilinear(*t[:2], t[3], slew, e[6]) if t else slew))
                        (a1, s1), (a2, s2) = new
                        o = state.setdefault((e[3], e[4], clk), [a1, a2, s1, s2])
                        state[(e[3], e[4], clk)] = [max(o[0], a1), min(o[1], a2), max(o[2], s1), min(o[3], s2)]
    g, t = gr.Levelled(spark.createDataFrame(edges, W_EDGE)), spark.createDataFrame(TABLES, T_SCHEMA)
    out = slew_arrivals(g, spark.createDataFrame(seeds, S_SCHEMA), t)
    got = {(x.v, x.rf, x.clk): (x.a_max, x.a_min, x.slew_max, x.slew_min) for x in out.collect()}
    assert got.keys() == state.keys() and all(got[k] == pytest.approx(tuple(state[k])) for k in got)
    fixed = {x.e_id: x for x in edge_delays(spark.createDataFrame(edges, W_EDGE), out, t).collect()}
    for e in edges:
        slews = [s for (v, rf, _), s in state.items() if (v, rf) == (e[1], e[2])]
        if slews:
            w = [max(s[2] for s in slews), min(s[3] for s in slews)]
            want = [bilinear(*table[e[5]][:3], x, e[6]) if e[5] else e[7] for x in w]
            assert (fixed[e[0]].d_max, fixed[e[0]].d_min) == pytest.approx(tuple(want))


EXC = "exc_id long, kind string, value long, minmax string, from_pin long, from_clk int, to_pin long, to_clk int"
EXCEPTIONS = [
    (1, "false", 0, "all", None, None, None, None), (2, "false", 0, "all", None, None, None, None), (3, "multicycle", 3, "max", None, 1, None, None), (4, "multicycle", 2, "all", None, 1, None, None),
    (5, "path_delay", 40, "max", None, None, 13, None), (6, "path_delay", 2, "min", None, None, 13, None), (7, "path_delay", 4, "min", None, None, 13, None), (8, "multicycle", 5, "min", 0, None, None, 2), (9, "false", 0, "min", 1, None, 12, None),
]
# 1: a vertex of A, then one of B; 2: B, then A (never in this order); 8: 6 falling or 7
A, B = (2, 3, 4, 5), (8, 9, 10)
THROUGH = [*((1, 0, v, None) for v in A), *((1, 1, v, None) for v in B), *((2, 0, v, None) for v in B), *((2, 1, v, None) for v in A), (8, 0, 6, "fall"), (8, 0, 7, None)]


def test_exceptions_follow_the_order_of_through_points(spark):
    edges = random_graph(5, m=46)
    seeds = [(0, "rise", 1, 3, 1), (0, "fall", 2, 0, 0), (1, "rise", 2, 2, 2), (1, "fall", 1, 2, 2)]
    exc, thru = spark.createDataFrame(EXCEPTIONS, EXC), spark.createDataFrame(THROUGH, "exc_id long, pos int, v long, rf string")
    g = gr.Levelled(ex.mark_edges(spark.createDataFrame(edges, EDGE), exc, thru))
    sd = ex.start_states(spark.createDataFrame(seeds, "v long, rf string, clk int, a_max long, a_min long"), exc)
    tags = ("clk", "state")
    arr = gr.arrivals(g, sd, tags, {"state": ex.advance()})
    ends = arr.filter("v >= 11").withColumn("capture_clk", F.col("clk"))
    base = {1: 4000, 2: 4000, 5: 3032, 6: 3032, 7: 3032, 3: 2008, 4: 2008, 8: 2000 + 64 + 16 + 4, 9: 4000 + 64 + 32}
    base[1] += 16
    base[2] += 16
    hits = set()
    for side in ("max", "min"):
        want = {}
        for (v, rf, clk), time, pts, _ in all_paths(edges, seeds, side):
            if v < 11:
                continue
            start, fit = pts[-1], []
            for i, kind, value, mm, fp, fc, tp, tc in EXCEPTIONS:
                if (fp is not None and fp != start[0]) or (fc is not None and fc != clk) or (tp is not None and tp != v) or (tc is not None and tc != clk):
                    continue
                if mm not in ("all", side) and not (kind == "multicycle" and side == "min"):
                    continue
                need = max((p for e, p, _, _ in THROUGH if e == i), default=-1) + 1
                done = 0
                for pv, prf, _ in reversed(pts[:-1]):
                    done += any(e == i and p == done and x == pv and y in (None, prf) for e, p, x, y in THROUGH)
                if done < need:
                    continue
                one = (1 if mm == "all" else 2 if mm == side else 0) if kind == "multicycle" else 0
                fit.append((base[i] + one, value if (kind, mm) == ("path_delay", "min") else -value, -i))
            hits.add((side, best := -max(fit)[2] if fit else None))
            k = (v, rf, clk, best)
            want[k] = (max if side == "max" else min)(want.get(k, time), time)
        m = ex.match_states(ends, exc, thru, side, ["v", "rf", "clk", "state"])
        got = m.groupBy("v", "rf", "clk", "exc_id").agg(F.max("a_max").alias("hi"), F.min("a_min").alias("lo")).collect()
        assert {(r.v, r.rf, r.clk, r.exc_id): r.hi if side == "max" else r.lo for r in got} == want
    assert {b for _, b in hits} >= {1, 3, 5, 7} and 2 not in {b for _, b in hits}
    # the search for paths keeps the states apart too
    search = PathSearch(g, sd, arr, tags, "max", {"state": ex.advance()})
    passed = ends.filter("exists(state, s -> s.exc = 1 and s.next = 2)").select(F.lit(0).alias("end_id"), "v", "rf", *tags)
    got = sorted((-r.total for r in search.k_worst(passed, 10).collect()))
    want = []
    for (v, _, _), time, pts, _ in all_paths(edges, seeds, "max"):
        on = [p[0] for p in reversed(pts[:-1])]
        first = min((on.index(x) for x in A if x in on), default=99)
        if v >= 11 and set(B) & set(on[first + 1 :]):
            want.append(-time)
    assert got == sorted(want)[:10]


@pytest.mark.parametrize("inst,pin,fanin", [(2, 0, False), (2, 3, True), (0, 0, False)])
def test_cones_against_a_search_of_all_ways(spark, inst, pin, fanin):
    from voltgrain.operators.fan import cone, cone_cells

    r = random.Random(11)
    edges = sorted({(a, b, r.choice(["wire", "arc"]), r.random() < 0.1, r.random() < 0.1) for a, b in (r.sample(range(16), 2) for _ in range(34))})
    stop = {7, 9}
    best, todo, use = {}, [(0, 0, 0)], [(b, a, *x) if fanin else (a, b, *x) for a, b, *x in edges]
    use = [e for e in use if not e[3] and not e[4]]
    ways = set()
    while todo:
        v, i, p = todo.pop()
        if (v, i, p) in ways or p > 20:
            continue
        ways.add((v, i, p))
        best[v] = min(best.get(v, (99, 99)), (i, p))
        if v not in stop and (not inst or i < inst) and (not pin or p < pin):
            todo += [(e[1], i + (e[2] != "wire"), p + 1) for e in use if e[0] == v]
    e = spark.createDataFrame(edges, "from_v int, to_v int, role string, disabled boolean, constant boolean")
    st, sp = spark.createDataFrame([(0,)], "v int"), spark.createDataFrame([(x,) for x in stop], "v int")
    got = cone(e, st, fanin=fanin, inst_levels=inst, pin_levels=pin, stop_at=sp)
    assert {x.v: (x.inst_level, x.pin_level) for x in got.collect()} == best
    ends = cone(e, st, fanin=fanin, inst_levels=inst, pin_levels=pin, stop_at=sp, ends_only=True)
    assert {x.v for x in ends.collect()} == {v for v in best if v in stop or all(x[0] != v for x in use)}
    pins = spark.createDataFrame([(v, v // 4) for v in range(16)], "pin_id int, inst_id int")
    assert {x.inst_id for x in cone_cells(pins, got).collect()} == {v // 4 for v in best}
