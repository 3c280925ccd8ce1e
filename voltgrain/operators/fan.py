"""Fan-in and fan-out cones counted in instances and in pins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut, cut_watch
from .graph import reverse, union_all

#: Which arcs are followed: those not disabled and not constant, those not disabled, all.
TRACE = {"timing": "not disabled and not constant", "enabled": "not disabled", "all": "true"}


def usable(edges: DataFrame, trace: str = "timing", flat: bool = True) -> DataFrame:
    """(from_v, to_v, cost): the arcs that a cone follows, a wire costing no instance level. Missing flag columns count as false."""
    flags = {c: F.lit(False) for c in ("disabled", "constant", "crosses") if c not in edges.columns}
    e = edges.withColumns(flags).filter(TRACE[trace])
    e = e if flat else e.filter("not crosses")
    return e.groupBy("from_v", "to_v").agg(F.min(F.when(F.col("role") == "wire", 0).otherwise(1)).alias("cost"))


def cone(edges: DataFrame, starts: DataFrame, *, fanin: bool = False, inst_levels: int = 0, pin_levels: int = 0, stop_at: DataFrame | None = None,
         ends_only: bool = False, trace: str = "timing", flat: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, v, inst_level, pin_level) of every pin of the cone of ``starts`` (v and keys).

    A pin is passed while fewer than ``inst_levels`` cells and ``pin_levels`` pins lie behind it (0: no limit); pins of ``stop_at`` (register clocks
    for a fan-in, end points for a fan-out) are reached but not passed. ``ends_only`` keeps those and the pins at which no followed arc goes on. inst_level is
    the least number of cells over all ways, pin_level the least number of arcs among the ways with that number.

    Each round follows one arc. A pin enters the next round only if it was reached with fewer cells than in any round before: more arcs and no fewer
    cells can reach nothing new under either limit.
    """
    keys = list(keys)
    e = usable(reverse(edges) if fanin else edges, trace, flat)
    out = e
    if stop_at is not None:
        e = e.join(stop_at.select(F.col("v").alias("from_v")).distinct(), "from_v", "left_anti")
    e = cut(e)
    found = [cut(starts.select(*keys, "v").distinct().withColumns({"inst_level": F.lit(0), "pin_level": F.lit(0)}))]
    hop = 0
    while not pin_levels or hop < pin_levels:
        front = found[-1].filter(F.col("inst_level") < inst_levels) if inst_levels else found[-1]
        j = front.select(*keys, F.col("v").alias("from_v"), "inst_level").join(e, "from_v")
        new = j.groupBy(*keys, F.col("to_v").alias("v")).agg(F.min(F.col("inst_level") + F.col("cost")).alias("inst_level"))
        known = union_all(found).groupBy(*keys, "v").agg(F.min("inst_level").alias("best"))
        new = new.join(known, [*keys, "v"], "left").filter("best is null or inst_level < best").drop("best")
        hop += 1
        new, n = cut_watch(new.withColumn("pin_level", F.lit(hop)), F.lit(True))
        if not n:
            break
        found.append(new)
    least = union_all(found).groupBy(*keys, "v").agg(F.min(F.struct("inst_level", "pin_level")).alias("x")).select(*keys, "v", "x.*")
    if not ends_only:
        return least
    going = out.select(F.col("from_v").alias("v")).distinct().withColumn("on", F.lit(True))
    least = least.join(going, "v", "left")
    if stop_at is not None:
        least = least.join(stop_at.select("v").distinct().withColumn("stops", F.lit(True)), "v", "left").filter("on is null or stops").drop("stops")
    else:
        least = least.filter("on is null")
    return least.select(*keys, "v", "inst_level", "pin_level")


def cone_cells(pins: DataFrame, of_cone: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, inst_id): the instances that own a pin of a cone (``pins``: pin_id, inst_id)."""
    return of_cone.join(pins.select(F.col("pin_id").alias("v"), "inst_id"), "v").select(*keys, "inst_id").distinct()
