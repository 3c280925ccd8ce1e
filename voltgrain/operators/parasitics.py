"""RC networks and delay tables: tree folds, pi models, wire loads, cell delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, cut_watch
from .graph import union_all


def root_tree(res: DataFrame, drivers: DataFrame) -> DataFrame:
    """Give every RC node a parent: (net_id, node, parent, ohm, depth).

    ``res``: net_id, n1, n2, ohm. ``drivers``: net_id, node. Breadth first from the driver;
    a resistor that would reach a node a second time closes a loop and is cut.
    """
    both = res.select("net_id", F.explode(F.array(
        F.struct(F.col("n1").alias("parent"), F.col("n2").alias("node")),
        F.struct(F.col("n2").alias("parent"), F.col("n1").alias("node")))).alias("x"), "ohm")
    arcs = cut(both.select("net_id", "x.*", "ohm").filter("parent <> node"))
    node_t = drivers.schema["node"].dataType
    seen = cut(drivers.select("net_id", "node", F.lit(None).cast(node_t).alias("parent"), F.lit(0.0).alias("ohm"), F.lit(0).alias("depth")))
    d = 0
    while True:
        front = seen.filter(F.col("depth") == d).select("net_id", F.col("node").alias("parent"))
        new = (front.join(arcs, ["net_id", "parent"]).groupBy("net_id", "node")
               .agg(F.min(F.struct("parent", "ohm")).alias("p"))
               .join(seen.select("net_id", "node"), ["net_id", "node"], "left_anti")
               .select("net_id", "node", "p.*", F.lit(d + 1).alias("depth")))
        new, n = cut_watch(new, F.lit(True))
        if not n:
            return seen
        seen = seen.unionByName(new)
        d += 1


def moments(tree: DataFrame, caps: DataFrame) -> DataFrame:
    """Admittance moments y1, y2, y3 of every node; y1 is also the capacitance below it.

    Folded one depth at a time from the leaves, each fold a partial-sum aggregate
    by parent, so a net of any size spreads over all tasks.
    """
    t = cut(tree.join(caps.groupBy("net_id", "node").agg(F.sum("cap").alias("cap")), ["net_id", "node"], "left")
            .withColumn("cap", F.coalesce("cap", F.lit(0.0))), by="depth")
    depth = t.agg(F.max("depth")).first()[0]
    out, below = [], None
    y1, y2, y3, r = (F.col(c) for c in ("y1", "y2", "y3", "ohm"))
    for k in range(depth, -1, -1):
        here = t.filter(F.col("depth") == k)
        if below is None:
            here = here.withColumns({"y1": F.col("cap"), "y2": F.lit(0.0), "y3": F.lit(0.0)})
        else:
            here = here.join(below, ["net_id", "node"], "left").withColumns({
                "y1": F.col("cap") + F.coalesce("u1", F.lit(0.0)), "y2": F.coalesce("u2", F.lit(0.0)), "y3": F.coalesce("u3", F.lit(0.0))})
        here = cut(here.select("net_id", "node", "parent", "ohm", "depth", "y1", "y2", "y3"))
        out.append(here)
        below = here.groupBy("net_id", F.col("parent").alias("node")).agg(
            F.sum("y1").alias("u1"), F.sum(y2 - r * y1 * y1).alias("u2"),
            F.sum(y3 - 2 * r * y1 * y2 + r * r * y1 * y1 * y1).alias("u3"))
    return union_all(out)


def pi_model(m: DataFrame) -> DataFrame:
    """Near cap c2, resistance and far cap c1 seen by each driver (the node at depth 0)."""
    y1, y2, y3 = (F.col(c) for c in ("y1", "y2", "y3"))
    flat = (y2 == 0) & (y3 == 0)
    return m.filter("depth = 0").select(
        "net_id", F.when(flat, 0.0).otherwise(y1 - y2 * y2 / y3).alias("c2"),
        F.when(flat, 0.0).otherwise(-y3 * y3 / (y2 * y2 * y2)).alias("rpi"),
        F.when(flat, y1).otherwise(y2 * y2 / y3).alias("c1"))


def elmore(m: DataFrame) -> DataFrame:
    """Delay of every node from its driver: resistances times the capacitance below them."""
    m = cut(m.select("net_id", "node", "parent", "depth", (F.col("ohm") * F.col("y1")).alias("step")), by="depth")
    depth = m.agg(F.max("depth")).first()[0]
    cur = m.filter("depth = 0").select("net_id", "node", F.lit(0.0).alias("tau"))
    out = [cur]
    for k in range(1, depth + 1):
        here = m.filter(F.col("depth") == k)
        cur = cut(here.join(cur.select("net_id", F.col("node").alias("parent"), F.col("tau").alias("up")), ["net_id", "parent"])
                  .select("net_id", "node", (F.col("up") + F.col("step")).alias("tau")))
        out.append(cur)
    return union_all(out)


def network_cap(nodes: DataFrame, coupling: DataFrame, factor: float) -> DataFrame:
    """Ground capacitance plus scaled coupling capacitance per net."""
    rows = nodes.select("net_id", F.col("gnd_cap").alias("c")).unionByName(coupling.select("net_id", (F.col("farad") * factor).alias("c")))
    return rows.groupBy("net_id").agg(F.sum("c").alias("cap"))


def driver_load(pin_cap: Column, net_wire: Column, user_load: Column, rc_cap: Column, reduced_cap: Column) -> Column:
    """Pin plus wire capacitance.

    A user load on the net wins over parasitics, a detailed network adds its own
    capacitance, a reduced model counts only when it covers the pins.
    """
    wire = (F.when(user_load.isNotNull(), user_load).when(rc_cap.isNotNull(), net_wire + rc_cap)
            .when(reduced_cap.isNotNull() & (reduced_cap >= pin_cap), reduced_cap - pin_cap)
            .when(reduced_cap.isNotNull(), 0.0).otherwise(net_wire))
    return pin_cap + wire


def wire_length(fanouts: Column, lengths: Column, slope: Column, n: Column) -> Column:
    """Length by fan-out: table inside, slope outside, never below zero."""
    from ..functions.lut import lut1
    lo, hi = F.get(fanouts, F.lit(0)), F.element_at(fanouts, -1)
    return (F.when(n < lo, F.greatest(F.lit(0.0), F.get(lengths, F.lit(0)) - (lo - n) * slope))
            .when(n >= hi, F.element_at(lengths, -1) + (n - hi) * slope)
            .otherwise(lut1(fanouts, lengths, n)))


def wire_tree(tree: Column, wire_cap: Column, wire_res: Column, pin_cap: Column, drvr_cap: Column, fanout: Column,
              sum_sq: Column, sum_cu: Column) -> Column:
    """struct(c2, rpi, c1) of a wire-load estimate.

    ``sum_sq`` / ``sum_cu`` are the sums of squares and cubes of (load pin cap + cap per
    fan-out), so a balanced tree needs only an aggregate over the loads.
    """
    rf = wire_res / fanout
    y1 = pin_cap + wire_cap
    y2, y3 = -rf * sum_sq, rf * rf * sum_cu
    lumped = F.struct((wire_cap + pin_cap).alias("c2"), F.lit(0.0).alias("rpi"), F.lit(0.0).alias("c1"))
    far = F.struct(drvr_cap.alias("c2"), wire_res.alias("rpi"), (pin_cap - drvr_cap + wire_cap).alias("c1"))
    even = F.struct(F.greatest(F.lit(0.0), y1 - y2 * y2 / y3).alias("c2"), (-y3 * y3 / (y2 * y2 * y2)).alias("rpi"), (y2 * y2 / y3).alias("c1"))
    return F.when(tree == "worst", far).when((tree == "best") | (wire_res == 0) | (fanout == 0), lumped).otherwise(even)


def threshold_adjust(delay: Column, slew: Column, rise: Column, drvr: dict[str, float], load: dict[str, float]) -> Column:
    """struct(delay, slew) at the load library's thresholds."""
    dd = drvr["upper"] - drvr["lower"]
    ld = load["upper"] - load["lower"]
    delta = slew * ((load["vth"] - drvr["vth"]) / dd)
    return F.struct((delay + F.when(rise, delta).otherwise(-delta)).alias("delay"),
                    (slew * ((ld / load["derate"]) / (dd / drvr["derate"]))).alias("slew"))


def apply_annotation(delay: Column, annotated: Column, increment: Column) -> Column:
    """An annotated value replaces the computed delay, or adds to it."""
    return F.when(annotated.isNull(), delay).when(increment, delay + annotated).otherwise(annotated)


def normal_condition(text: Column) -> Column:
    """Conditions compare without blanks and with one spelling of and, or, not."""
    t = F.regexp_replace(F.lower(text), r"\s+|==1'b1|==1", "")
    return F.regexp_replace(F.regexp_replace(t, "&&", "&"), r"\|\|", "|")


def pvt_scale(value: Column, kp: Column, kv: Column, kt: Column, dp: Column, dv: Column, dt: Column) -> Column:
    return value * (1 + dp * kp) * (1 + dv * kv) * (1 + dt * kt)


def parallel_drivers(drivers: DataFrame) -> DataFrame:
    """Common delay and slew of drivers that share a net.

    Needs net_id, rf, delay (loaded), intrinsic, slew. Load delays and slews combine like
    parallel resistors; zeros do not take part.
    """
    load = F.col("delay") - F.col("intrinsic")
    h = drivers.groupBy("net_id", "rf").agg(
        F.sum(F.when(load != 0, 1.0 / load)).alias("_d"), F.sum(F.when(F.col("slew") != 0, 1.0 / F.col("slew"))).alias("_s"))
    j = drivers.drop("slew").join(h, ["net_id", "rf"])
    return j.withColumns({
        "gate_delay": F.col("intrinsic") + F.coalesce(1.0 / F.col("_d"), F.lit(0.0)),
        "drvr_slew": F.coalesce(1.0 / F.col("_s"), F.lit(0.0))}).drop("_d", "_s")
