"""Paths found from the ends, packed slacks, narrow numbers and registers in modules against the operators that hold single rows; and how much the queries move."""

from __future__ import annotations

import math

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from voltgrain.functions.logic import truth_bits
from voltgrain.operators import graph as gr
from voltgrain.operators.activity import propagate_with_registers, register_value
from voltgrain.operators.modules import ModuleGate, propagate_in_modules, propagate_registers_in_modules
from voltgrain.operators.paths import PathSearch, k_worst_from_ends
from voltgrain.session import cut

from .test_layers import layers, moved_mb, rows_of


@pytest.mark.parametrize("which", ["max", "min"])
def test_paths_from_ends_equal_diversions(spark, which):
    """Seeds on two levels; ends are groups of vertices. Also on the plain graph, with ends on several levels."""
    plain, layered, seeds = layers(spark, 3)
    a = cut(gr.arrivals(plain, seeds))
    one = a.filter("v >= 30").select(F.col("clk").cast("bigint").alias("end_id"), "v", "rf", "clk")
    many = a.filter("v >= 10").select((F.col("v") * 10 + F.col("clk")).alias("end_id"), "v", "rf", "clk")
    for g, ends in ((layered, one), (plain, many)):
        want = PathSearch(plain, seeds, a, which=which).k_worst(ends, 5).select("end_id", "rank", "total")
        got = cut(k_worst_from_ends(g, seeds, a, ends, 5, which=which))
        assert rows_of(got.select("end_id", "rank", "total")) == rows_of(want)
        for r in got.collect():
            assert sum(p.d for p in r.points) == r.total and (r.points[0].v, r.points[0].rf) == (r.ev, r.erf)
            assert all(p.e_id == q.v * 1000 + p.v for p, q in zip(r.points, r.points[1:])) and r.points[-1].e_id is None


def test_packed_slack_equals_rows(spark):
    plain, layered, seeds = layers(spark, 2)
    a = gr.arrivals(layered, seeds, track=False, packed=True)
    ends = gr.unpack(a).filter("v >= 30").select("v", "rf", "clk", (F.col("v") * 9).alias("r_max"), F.lit(40).cast("bigint").alias("r_min"))
    want = gr.slack(gr.arrivals(plain, seeds), gr.required(plain, ends)).select("v", "rf", "clk", "slack_max", "slack_min")
    assert rows_of(gr.slack_by_vertex(a, gr.required(layered, ends, packed=True))) == rows_of(want)
    p = gr.slack_by_vertex(gr.arrivals(plain, seeds, packed=True), gr.required(plain, ends, packed=True))
    assert rows_of(p) == rows_of(want)


def test_narrow_numbers_come_back(spark):
    big = (1 << 63) - 1
    longs = [[1, 2, 200], [0, 256], [-40000, 20000], [0, 1 << 40], [-big, big], [None, 3], [], [big, big - 1], None]
    doubles = [[1.0, 250.0], [1.0, 0.5], [-0.0, 1.0], [math.nan, 1.0], [math.inf, 1.0], [2.0 ** 60, 2.0 ** 60 + 256], [None, 1.0], [-3.0, 60000.0], None]
    df = spark.createDataFrame([(i, x, y, ["a"]) for i, (x, y) in enumerate(zip(longs, doubles))], "i int, x array<bigint>, y array<double>, s array<string>")
    kinds = {"x": "bigint", "y": "double", "s": "string"}
    back = gr.narrow(df, kinds).select("i", *[gr.widen(c, t) for c, t in kinds.items()])
    assert [str(r) for r in back.orderBy("i").collect()] == [str(r) for r in df.orderBy("i").collect()]
    sent = {r.i: (r.x_0, r.y_1, r.x, r.y) for r in gr.narrow(df, kinds).collect()}
    assert sent[0][0] == [-128, -127, 71] and sent[0][2] is None and sent[7][1] == [-32768, 27235] and sent[7][3] is None


def test_registers_in_modules_equal_passes(spark):
    """A tree, a loop of registers, one behind it, and one behind a register that does not exist."""
    up = {0: None, 1: 0, 2: 1, 3: 1, 4: 6, 5: 4, 6: 5, 7: 6, 8: 99, 9: 8}
    port = {i: ((1 + i % 5) / 6, (1 + i % 3) / 4) for i in up}
    tt = {0: truth_bits("B", ["A", "B"]), 1: truth_bits("A&B", ["A", "B"])}
    df = spark.createDataFrame([(i, u, i % 2 == 0, port[i]) for i, u in up.items()], "inst long, up long, inverted boolean, c struct<activity:double,duty:double>")

    def output(rows):
        none = F.struct(F.lit(0.0).alias("activity"), F.lit(0.0).alias("duty"))
        rows = propagate_in_modules(rows.withColumn("u", F.coalesce("up_q", none)), ["u", "c"], [ModuleGate("g", ("u", "c"), F.col("up").isNotNull().cast("int"))], tt)
        return rows.withColumn("q", F.struct(*register_value(F.col("g.activity"), F.col("g.duty"), F.lit(False), F.col("inverted"))))
    got = {r.inst: (round(r.activity, 2), round(r.duty, 2)) for r in propagate_registers_in_modules(df, output).collect()}
    gates = [(f"G{i}", f"d{i}", tt[1], 2) for i, u in up.items() if u is not None]
    pins = [(f"G{i}", k, n) for i, u in up.items() if u is not None for k, n in enumerate((f"q{u}", f"c{i}"))]
    nets = propagate_with_registers(spark.createDataFrame(gates, "gate string, out_net string, tt array<int>, n_in int"), spark.createDataFrame(pins, "gate string, pin_idx int, net string"),
                                    spark.createDataFrame([(f"c{i}", *p) for i, p in port.items()], "net string, activity double, duty double"),
                                    spark.createDataFrame([(f"d{i}" if i else "c0", f"q{i}", i % 2 == 0, False) for i in up], "d_net string, q_net string, inverted boolean, level_sensitive boolean"), max_pins=2)
    want = {int(r.net[1:]): (round(r.activity, 2), round(r.duty, 2)) for r in nets.collect() if r.net[0] == "q"}
    assert set(want) == {0, 1, 2, 3, 4, 5, 6, 7} and got == want


@pytest.mark.parametrize("name,most", [("g8_k_worst_both_sides", 60), ("m8_register_outputs", 6), ("o4_ordered_throughs", 18), ("g5_required_slack", 17)])
def test_little_is_moved(spark, name, most):
    """Over sf0.1 g8_k_worst_both_sides moved 9264 MB and m8_register_outputs 290 MB; now 312 and 15 MB."""
    assert moved_mb(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()) < most
