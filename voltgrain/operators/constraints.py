"""Joins that resolve constraints: clocks, cycles, exceptions, derates, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Base priority of each exception kind and of what it names.
KIND_PRIORITY = {"false": 4000, "path_delay": 3000, "multicycle": 2000, "filter": 1000, "group": 0}
POINT_PRIORITY = {"from_pin": 64, "to_pin": 32, "through": 16, "from_clk": 8, "to_clk": 4, "minmax": 1}


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of positive ticks (64 halving rounds cover a BIGINT)."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def cycle_distances(pairs: DataFrame) -> DataFrame:
    """Smallest setup and hold distance of launch and capture edges over their common period.

    ``pairs``: s_period, s_edge, t_period, t_edge, t_opp in ticks. Edge distances repeat
    modulo the greatest common divisor of the periods, so no edges are enumerated.
    ``required`` counts from the start of the launch cycle.
    """
    g, s, t, o = (F.col(c) for c in ("_g", "s_edge", "t_edge", "t_opp"))

    def after(x: Column) -> Column:       # smallest distance > 0
        return F.pmod(x - 1, g) + 1
    p = pairs.withColumn("_g", gcd(F.col("s_period"), F.col("t_period")))
    setup, hold = after(t - s), F.pmod(s - t, g)
    latch = after(o - s)
    # The enable edge is the one before the disable edge.
    open_to_close = F.when(t > o, o - t + F.col("t_period")).otherwise(o - t)
    return p.withColumns({
        "setup_delay": setup, "setup_required": setup + s,
        "hold_delay": hold, "hold_required": s - hold,
        "latch_delay": latch, "latch_required": latch + s - open_to_close,
        "data_setup_delay": hold, "data_setup_required": s - hold,
    }).drop("_g")


def multicycle_setup(mult: Column, default_cycles: int, use_end: Column, start_period: Column, end_period: Column) -> Column:
    return F.coalesce((mult - default_cycles) * F.when(use_end, end_period).otherwise(start_period), F.lit(0))


def multicycle_hold(setup_mult: Column, hold_mult: Column, setup_end: Column, hold_end: Column, start_period: Column, end_period: Column) -> Column:
    ts = F.when(setup_end, end_period).otherwise(start_period)
    th = F.when(hold_end, end_period).otherwise(start_period)
    return (F.when(setup_mult.isNotNull() & hold_mult.isNotNull(), (setup_mult - 1) * ts - hold_mult * th)
            .when(hold_mult.isNotNull(), -hold_mult * th)
            .when(setup_mult.isNotNull(), (setup_mult - 1) * ts).otherwise(0))


def exception_priority(exc: DataFrame) -> DataFrame:
    """Priority from the kind and the points an exception row names (null: not named)."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in KIND_PRIORITY.items()])
    pts = sum((F.when(F.col(c).isNotNull(), p).otherwise(0) for c, p in POINT_PRIORITY.items() if c in exc.columns), F.lit(0))
    return exc.withColumn("priority", kind + pts)


def match_exceptions(paths: DataFrame, exc: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Best exception of every path.

    A null field matches anything. Rows are grouped by which fields they name, and each
    group is an equi-join on those fields. Higher priority wins, then the tighter value: the larger one for a
    path delay whose ``minmax`` is ``min``, else the smaller one.
    """
    pri = exception_priority(exc)
    least = (F.col("kind") == "path_delay") & (F.col("minmax") == "min") if "minmax" in exc.columns else F.lit(False)
    tight = F.when(least, F.col("value")).otherwise(-F.col("value"))
    named = pri.select(F.concat_ws(",", *[F.when(F.col(f).isNotNull(), f) for f in fields]).alias("k")).distinct()
    best = None
    for r in sorted(x.k for x in named.collect()):    # at most 2^fields kinds
        on = [f for f in r.split(",") if f]
        cond = F.lit(True)
        for f in fields:
            cond = cond & (F.col(f).isNotNull() if f in on else F.col(f).isNull())
        rows = pri.filter(cond).select(*on, F.struct("priority", tight.alias("tight"), (-F.col("exc_id")).alias("o"), F.col("kind").alias("kind"), F.col("value").alias("value")).alias("_x"))
        rows = rows.groupBy(*on).agg(F.max("_x").alias("_x")) if on else rows.agg(F.max("_x").alias("_x"))
        hit = paths.join(rows, on, "left") if on else paths.join(F.broadcast(rows), F.lit(True), "left")
        name = f"_x{0 if best is None else len(best[1])}"
        paths = hit.withColumnRenamed("_x", name)
        best = (None, (best[1] if best else []) + [name])
    cols = best[1] if best else []
    if not cols:
        return paths.withColumns({"exc_kind": F.lit(None).cast("string"), "exc_value": F.lit(None).cast("bigint")})
    top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    return paths.withColumn("_t", top).withColumns({"exc_kind": F.col("_t.kind"), "exc_value": F.col("_t.value")}).drop("_t", *cols)


def exclude_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Drop clock pairs of different groups of one exclusive set, in either direction.

    ``groups``: launch_clk, capture_clk rows of excluded pairs.
    """
    both = groups.select("launch_clk", "capture_clk").unionAll(groups.select("capture_clk", "launch_clk")).distinct()
    return pairs.join(both, ["launch_clk", "capture_clk"], "left_anti")


def uncertainty(inter: Column, pin: Column, clk: Column, setup: bool) -> Column:
    """Inter-clock value, else the capture pin's, else the clock's; negative for setup roles."""
    u = F.coalesce(inter, pin, clk, F.lit(0))
    return -u if setup else u


def clock_latency(insertion: Column, network: Column, included: Column) -> Column:
    """Source insertion plus network latency, unless the figure already includes them."""
    return F.coalesce(insertion, F.lit(0)) + F.when(included, 0).otherwise(F.coalesce(network, F.lit(0)))


def path_group(user: Column, kind: Column, capture_clk: Column) -> Column:
    return (F.when(user.isNotNull(), user).when(kind == "unconstrained", "unconstrained")
            .when(kind == "path_delay", "path delay").when(kind.isin("recovery", "removal"), "asynchronous")
            .when(kind.isin("gate_setup", "gate_hold"), "gated clock").otherwise(capture_clk))


def first_existing(levels: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first level that has a row at all; that row may lack the value and still ends the search."""
    out = None
    for exists, value in levels:
        out = F.when(exists, value) if out is None else out.when(exists, value)
    return out.otherwise(default)


def delete_constraints(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def generated_waveform(df: DataFrame) -> DataFrame:
    """Period and waveform of generated clocks from their masters.

    Columns: m_period, m_wave, divide_by, multiply_by, edges, edge_shifts, invert, duty_cycle.
    """
    P, wv, d, m = F.col("m_period"), F.col("m_wave"), F.col("divide_by"), F.col("multiply_by")
    rise0 = F.get(wv, F.lit(0))
    power2 = (d > 1) & (F.call_function("bit_count", d) == 1)
    scale = F.when(d > 1, d.cast("double")).otherwise(1.0 / m)
    n = F.size(wv)

    def edge_at(i: int) -> Column:
        k = F.get(F.col("edges"), F.lit(i)) - 1
        base = F.get(wv, (k % n).cast("int")) + F.floor(k / n) * P
        return base + F.coalesce(F.get(F.col("edge_shifts"), F.lit(i)), F.lit(0.0))
    third = edge_at(2) - edge_at(0)
    scaled_p = P * scale
    duty = F.col("duty_cycle")
    scaled = F.when(duty > 0, F.array(rise0 * scale, rise0 * scale + scaled_p * duty / 100.0)).otherwise(F.transform(wv, lambda x: x * scale))
    scaled_any = (d > 1) | (m >= 1)
    period = (F.when(d == 1, P).when(power2, P * d).when(scaled_any, scaled_p)
              .otherwise(third))
    wave = (F.when(d == 1, F.slice(wv, 1, 2)).when(power2, F.array(rise0, rise0 + P * d / 2.0)).when(scaled_any, scaled)
            .otherwise(F.array(edge_at(0), edge_at(1))))
    out = df.withColumns({"period": period.cast("double"), "_w": wave.cast("array<double>")})
    first, off = F.get(F.col("_w"), F.lit(0)), F.when(F.get(F.col("_w"), F.lit(0)) >= F.col("period"), F.col("period")).otherwise(0.0)
    turned = F.concat(F.transform(F.slice("_w", F.lit(2), F.size("_w") - 1), lambda x: x - off), F.array(first - off + F.col("period")))
    return out.withColumn("waveform", F.when(F.col("invert"), turned).otherwise(F.col("_w"))).drop("_w")
