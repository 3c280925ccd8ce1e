"""Constants through registers and three-state outputs, and inferred gating, against brute force on small netlists."""

from __future__ import annotations

import itertools
import random

import pytest

from voltgrain.functions.logic import truth_bits
from voltgrain.operators.constants import settle_constants
from voltgrain.operators.gating import gated_enables, gating_ends, gating_pins

GATE = "gate string, out_net string, kind string, tt array<int>, en array<int>, inverted boolean"
INPUT = "gate string, pin_idx int, net string"
HELD = "net string, value int"


def fixed(bits, pins, value):
    """Output of a function for every completion of the unknown inputs."""
    free = [range(2) if value.get(n, 2) == 2 else [value[n]] for n in pins]
    got = {bits[sum(b << i for i, b in enumerate(c))] for c in itertools.product(*free)}
    return got.pop() if len(got) == 1 else 2


def simulate(gates, pins, held, thru):
    """All gates again and again until nothing changes."""
    value = {n: v for n, v in held.items()}
    while True:
        new = {}
        for g, out, kind, tt, en, inv in gates:
            if kind == "clock_gate":
                v = 0 if any(value.get(n) == 0 for n in pins[g]) else 2
            else:
                v = fixed(tt, pins[g], value)
                if kind == "seq":
                    v = 2 if not thru or v == 2 else 1 - v if inv else v
            if en is not None and fixed(en, pins[g], value) != 1:
                v = 2
            if v != 2 and out not in value:
                new[out] = v
        if not new:
            return {n: v for n, v in value.items() if v != 2}
        value.update(new)


@pytest.mark.parametrize("seed,thru", [(1, True), (1, False), (2, True), (3, True)])
def test_settled_constants_equal_repeated_evaluation(spark, seed, thru):
    r = random.Random(seed)
    nets = [f"n{i}" for i in range(40)]
    gates, pins = [], {}
    for i in range(30):  # any net may feed any gate: loops through registers and through logic
        kind = r.choice(["logic", "logic", "seq", "clock_gate"])
        ins = r.sample(nets, 3)
        tt = truth_bits(r.choice(["A&B&C", "A|B", "A^B", "!A", "B&C", "A|!C"]), ["A", "B", "C"])
        en = truth_bits("C", ["A", "B", "C"]) if r.random() < .2 else None
        gates.append((f"g{i}", nets[i], kind, tt, en, r.random() < .5))
        pins[f"g{i}"] = ins
    held = {nets[i]: r.choice([0, 0, 1, 1, 2]) for i in [3, 7, *range(30, 40)]}
    rows = [(g, i, n) for g, ns in pins.items() for i, n in enumerate(ns)]
    got, _ = settle_constants(spark.createDataFrame(gates, GATE), spark.createDataFrame(rows, INPUT), spark.createDataFrame(list(held.items()), HELD), thru)
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(set(n for n, _ in got))
    assert dict(got) == simulate(gates, pins, held, thru)


def test_constant_functions_conflicts_and_empty_tables(spark):
    one, buf, inv = [1, 1], [0, 1], [1, 0]
    gates = [("t", "a", None, one, None, None), ("q", "b", "seq", buf, None, True), ("i", "c", "logic", inv, None, None), ("u", None, "logic", buf, None, None)]
    ins = [("q", 0, "a"), ("i", 0, "b"), ("u", 0, "a"), ("u", 1, None)]
    g, i = spark.createDataFrame(gates, GATE), spark.createDataFrame(ins, INPUT)
    values, differ = settle_constants(g, i, spark.createDataFrame([("c", 0)], HELD), True)
    # c would be 1 but is held at 0 and stays there
    assert sorted(map(tuple, values.collect())) == [("a", 1), ("b", 0), ("c", 0)]
    assert [tuple(x) for x in differ.collect()] == [("c", 1, 0)]
    values, differ = settle_constants(g.limit(0), i.limit(0), spark.createDataFrame([], HELD), True)
    assert values.count() == differ.count() == 0


FUNC = "cell string, out_pin string, n_pins int, tt array<int>"


def test_gating_pins_equal_the_definition(spark):
    texts = ["A&B&C", "A|(B&C)", "!(A&B)", "A^B", "!A&(B|C)", "A&B|!B&C", "A", "1", "!(A|!B)", "(A|B)&(A|C)"]
    rows = [(t, "Z", 3, truth_bits(t, ["A", "B", "C"])) for t in texts]
    want = set()
    for t, _, n, tt in rows:
        for c in range(n):
            sides = [[s for s in range(8) if (s >> c & 1) == on] for on in (0, 1)]
            const = [len({tt[s] for s in side}) == 1 for side in sides]
            if const[0] == const[1]:
                continue
            active = 0 if const[1] else 1
            want |= {(t, "Z", c, e, active) for e in range(n) if e != c and any(tt[s] != tt[s ^ (1 << e)] for s in sides[active])}
    got = [tuple(x) for x in gating_pins(spark.createDataFrame(rows, FUNC)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # factored differently, the same function gates alike
    assert {x[2:] for x in want if x[0] == "A|(B&C)"} == {x[2:] for x in want if x[0] == "(A|B)&(A|C)"}


def test_gating_ends_take_edges_and_margins_in_order(spark):
    f = spark.createDataFrame([("and", "Z", 2, [0, 0, 0, 1]), ("or", "Z", 2, [0, 1, 1, 1])], FUNC)
    insts = spark.createDataFrame([(1, "and"), (2, "or"), (3, "and")], "inst int, cell string")
    pins = spark.createDataFrame([(i, p, i * 10 + p) for i in (1, 2, 3) for p in (0, 1)], "inst int, pin_idx int, v int")
    clk = spark.createDataFrame([(10,), (20,), (30,), (31,)], "v int")  # both pins of 3 are clocks: no check
    en = gated_enables(insts, pins, f, clk)
    assert sorted(map(tuple, en.collect())) == [(1, 10, 11, 1), (2, 20, 21, 0)]
    off = spark.createDataFrame([(1, None), (None, 21)], "inst int, v int")
    assert gated_enables(insts, pins, f, clk, off).count() == 0
    arr = spark.createDataFrame([(v, rf, 7, 12, 4) for v in (11, 21) for rf in ("rise", "fall")], "v int, rf string, clk int, a_max int, a_min int")
    ca = spark.createDataFrame([(v, rf, 8, 3, 1) for v in (10, 20) for rf in ("rise", "fall")], "v int, rf string, clk int, a_max int, a_min int")
    cap = spark.createDataFrame([(7, 8, rf, k, t) for rf, k, t in (("rise", "gate_setup", 20), ("fall", "gate_setup", 30), ("rise", "gate_hold", 0), ("fall", "gate_hold", 10))],
                                "lclk int, cclk int, clk_rf string, kind string, capture int")
    m = spark.createDataFrame([("en_v", "11", "gate_setup", "rise", 5), ("inst", "1", "gate_setup", None, 2), ("global", None, "gate_hold", None, 1)],
                              "scope string, key string, kind string, rf string, margin int")
    got = {(r.inst, r.rf, r.kind): (r.clk_rf, r.required, r.slack) for r in gating_ends(en, arr, ca, cap, m).collect()}
    assert got == {(1, "rise", "gate_setup"): ("rise", 16, 4), (1, "fall", "gate_setup"): ("rise", 19, 7),
                   (1, "rise", "gate_hold"): ("fall", 14, -10), (1, "fall", "gate_hold"): ("fall", 14, -10),
                   (2, "rise", "gate_setup"): ("fall", 31, 19), (2, "fall", "gate_setup"): ("fall", 31, 19),
                   (2, "rise", "gate_hold"): ("rise", 4, 0), (2, "fall", "gate_hold"): ("rise", 4, 0)}
    assert gating_ends(en, arr, ca, cap, None, spark.createDataFrame([(7, 8)], "lclk int, cclk int")).count() == 0
