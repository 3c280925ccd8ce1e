"""Sweeps by slots against sweeps of rows; unique paths from the ends; how much f1_unique_paths moves."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from voltgrain.operators import graph as gr, slots
from voltgrain.operators.paths import k_worst_unique, k_worst_unique_from_ends, unique_ends
from voltgrain.session import cut

from .test_layers import layers, moved_mb, rows_of


def with_slots(g, rfs=("rise", "fall")):
    g.rfs = rfs
    return g


def test_slots_equal_rows(spark):
    """Some starts have one transition only, some numbers are null, some lie far apart, and one start is a vertex on the second level."""
    plain, layered, seeds = layers(spark, 2)
    odd = seeds.withColumns({"a_max": F.when(F.col("v") == 3, None).when(F.col("v") == 2, F.col("a_max") + (1 << 40)).otherwise(F.col("a_max")), "a_min": F.when(F.col("v") == 1, -70000).otherwise(F.col("a_min"))}).filter("v <> 4 or rf = 'rise'")
    want = gr.arrivals(plain, odd, track=False)
    assert slots.sweep(layered, odd, ["clk"], {"a_max": ("d_max", 1, "max")}) is None
    got = slots.sweep(with_slots(layered), odd, ["clk"], {"a_max": ("d_max", 1, "max"), "a_min": ("d_min", 1, "min")})
    assert len(got.keys) == 4 and rows_of(got.rows()) == rows_of(want)
    assert rows_of(gr.arrivals(layered, odd, track=False, sides=("max",))) == rows_of(want.drop("a_min"))

    def due(a):
        return a.filter("v >= 30").select("v", "rf", "clk", (F.col("v") * 9).alias("r_max"), F.lit(40).cast("bigint").alias("r_min"))
    a = gr.arrivals(plain, odd)
    slack = gr.slack(a, gr.required(plain, due(a))).select("v", "rf", "clk", "slack_max", "slack_min")
    assert rows_of(gr.slacks(layered, odd, due)) == rows_of(slack)
    assert rows_of(gr.slacks(with_slots(layered, None), odd, due)) == rows_of(slack)


def test_many_keys_keep_rows(spark):
    """More tags than slots, a null tag, or a transition not named: no slots, and the sweep holds all the same."""
    plain, layered, seeds = layers(spark, 2)
    many = seeds.withColumn("clk", F.explode(F.sequence(F.lit(0), F.lit(slots.MAX_SLOTS))))
    for s, rfs in ((many, ("rise", "fall")), (seeds.withColumn("clk", F.when(F.col("clk") == 1, 1)), ("rise", "fall")), (seeds, ("rise",))):
        g = with_slots(layered, rfs)
        assert slots.sweep(g, s, ["clk"], {"a_max": ("d_max", 1, "max")}) is None
        assert rows_of(gr.arrivals(g, s, track=False)) == rows_of(gr.arrivals(plain, s, track=False))


@pytest.mark.parametrize("which", ["max", "min"])
def test_unique_paths_from_ends(spark, which):
    """The times of the k worst vertex lists of each end, as from the operator that keeps k at every vertex; ends on one and on several levels."""
    plain, layered, seeds = layers(spark, 3)
    a = cut(gr.arrivals(plain, seeds))
    all_lists = cut(k_worst_unique(plain, seeds, 5, which=which))
    for g, low in ((layered, 30), (plain, 10)):
        ends = a.filter(F.col("v") >= low).select((F.col("v") * 10 + F.col("clk")).alias("end_id"), "v", "rf", "clk")
        want = unique_ends(all_lists, ends, 5, which=which).select((F.col("v") * 10 + F.col("clk")).alias("end_id"), "rank", "time")
        got = cut(k_worst_unique_from_ends(g, seeds, a, ends, 5, which=which))
        assert rows_of(got.select("end_id", "rank", "time")) == rows_of(want)
        lists = [(r.end_id, tuple(r.vertices)) for r in got.collect()]
        assert len(set(lists)) == len(lists) and all(v[-1] == e // 10 and list(v) == sorted(v) for e, v in lists)


@pytest.mark.parametrize("name,most", [("f1_unique_paths", 9), ("g5_required_slack", 20)])
def test_little_is_moved(spark, name, most):
    """f1_unique_paths moved 5126 MB over four times sf0.1 and kept three lists at every vertex."""
    assert moved_mb(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()) < most
