"""Cell delays whose look-up needs the slew that arrives: arrival and slew carried together, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lut import add_lut2
from .graph import Levelled


def _looked_up(rows: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Add delay_<side> and out_<side> from the row's tables at (slew_<side>, load); a row without a table is a wire: ``wire_delay``, slew unchanged."""
    for side in sides:
        slew = F.col(f"slew_{side}")
        for out, vals in ((f"delay_{side}", "delay_values"), (f"out_{side}", "slew_values")):
            rows = add_lut2(rows, out, "axis1", "axis2", vals, slew, F.col("load"))
        wire = F.col("table_id").isNull()
        rows = rows.withColumns({f"delay_{side}": F.when(wire, F.col("wire_delay")).otherwise(F.col(f"delay_{side}")), f"out_{side}": F.when(wire, slew).otherwise(F.col(f"out_{side}"))})
    return rows


def slew_arrivals(g: Levelled, seeds: DataFrame, tables: DataFrame, tags: Sequence[str] = ("clk",), track: bool = True) -> DataFrame:
    """Latest and earliest arrival and largest and smallest slew of every (v, rf, tags).

    Edges carry table_id (null: a wire), load and wire_delay; ``tables`` has table_id, axis1 (slew), axis2 (load), delay_values and slew_values,
    row-major. Seeds: v, rf, tags, a_max, a_min, slew_max, slew_min. The late side looks up with the largest slew, the early side
    with the smallest; arrival and slew are merged each on its own, so the worst slew of a vertex may come by another edge than its worst arrival.
    e_max and e_min are the edges of the worst arrivals; ties go to the smaller edge. Without ``track`` they are left out.
    """
    prev = ["e_max", "e_min"] if track else []
    start = g.place(seeds.select("v", "rf", *tags, *[F.col(c).cast("double").alias(c) for c in ("a_max", "a_min", "slew_max", "slew_min")], *[F.lit(None).cast("bigint").alias(c) for c in prev]))

    def receive(j: DataFrame) -> DataFrame:
        j = _looked_up(j.join(tables, "table_id", "left"), ("max", "min"))
        return j.select(F.col("to_v").alias("v"), F.col("to_rf").alias("rf"), *tags, (F.col("a_max") + F.col("delay_max")).alias("a_max"), (F.col("a_min") + F.col("delay_min")).alias("a_min"),
                        F.col("out_max").alias("slew_max"), F.col("out_min").alias("slew_min"), *[F.col("e_id").alias(c) for c in prev], "to_level")

    def merge(rows: DataFrame) -> DataFrame:
        if not track:
            return rows.groupBy("v", "rf", *tags).agg(F.max("a_max").alias("a_max"), F.min("a_min").alias("a_min"), F.max("slew_max").alias("slew_max"), F.min("slew_min").alias("slew_min"), F.min("level").alias("level"))
        late, early = F.max(F.struct("a_max", (-F.col("e_max")).alias("e"))), F.min(F.struct("a_min", F.col("e_min").alias("e")))
        m = rows.groupBy("v", "rf", *tags).agg(late.alias("l"), early.alias("s"), F.max("slew_max").alias("slew_max"), F.min("slew_min").alias("slew_min"), F.first("level").alias("level"))
        return m.select("v", "rf", *tags, F.col("l.a_max").alias("a_max"), F.col("s.a_min").alias("a_min"), "slew_max", "slew_min", (-F.col("l.e")).alias("e_max"), F.col("s.e").alias("e_min"), "level")

    return g.sweep(start, receive, merge, drop=prev)


def edge_delays(edges: DataFrame, slews: DataFrame, tables: DataFrame) -> DataFrame:
    """The edges with d_max and d_min looked up at the worst slews of their start over all tags, for sweeps that need fixed delays (required times, k worst paths)."""
    worst = slews.groupBy(F.col("v").alias("from_v"), F.col("rf").alias("from_rf")).agg(F.max("slew_max").alias("slew_max"), F.min("slew_min").alias("slew_min"))
    j = _looked_up(edges.drop("d_max", "d_min").join(worst, ["from_v", "from_rf"]).join(tables, "table_id", "left"), ("max", "min"))
    return j.select(*[c for c in edges.columns if c not in ("d_max", "d_min")], F.col("delay_max").alias("d_max"), F.col("delay_min").alias("d_min"))


def table_of(base: Column, axis1: Sequence[float], axis2: Sequence[float], step1: float, step2: float, scale: float = 1.0) -> Column:
    """Row-major entries (base + step1 i + step2 j + i j) / scale of a generated table."""
    n2 = len(axis2)
    at = F.array(*map(F.lit, range(len(axis1) * n2)))
    return F.transform(at, lambda k: ((base + step1 * F.floor(k / n2) + step2 * (k % n2) + F.floor(k / n2) * (k % n2)) / scale).cast("double"))
