"""Time-based power: leakage by held state, switching and internal energy per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import edge, n_rise, n_toggle
from ..functions.lut import add_lut2
from .events import asof_inputs, glitch_ratio
from ..session import bounded_broadcast, cut
from .ordered import ordered, time_block

MAX_STATE_PINS = 16


# ------------------------------------------------------------------ leakage
def expand_leakage(leak: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, state) -> power; a later row overwrites an earlier one.

    ``cells`` carries cell_name, n_pin and default_leakage. Cells with too many pins
    for a state table keep one unconditional value under a null state.
    """
    small = cells.filter(F.col("n_pin") <= MAX_STATE_PINS)
    states = small.select("cell_name", "default_leakage", F.explode(
        F.expr("sequence(0, shiftleft(1, n_pin) - 1)")).alias("state"))
    hit = states.join(bounded_broadcast(leak), "cell_name", "left").withColumn(
        "hit", F.col("state").bitwiseAND(F.col("care_mask")) == F.col("value_mask"))
    best = hit.groupBy("cell_name", "state").agg(
        F.max_by("power", F.when(F.col("hit"), F.col("ord"))).alias("p"),
        F.first("default_leakage").alias("d"))
    small_out = best.select("cell_name", "state", F.coalesce("p", "d", F.lit(0.0)).alias("power"))
    big = cells.filter(F.col("n_pin") > MAX_STATE_PINS).select(
        "cell_name", F.lit(None).cast("int").alias("state"), F.coalesce("default_leakage", F.lit(0.0)).alias("power"))
    return small_out.unionByName(big)


def hold_intervals(ticks: DataFrame, time_max: Column) -> DataFrame:
    """[t0, t1) during which a gate keeps ``state``; the last one runs to ``time_max``."""
    return ticks.select("gate", F.col("t").alias("t0"), F.coalesce("next_t", time_max).alias("t1"),
                        F.col("state_after").alias("state"), "blk")


def leakage_intervals(holds: DataFrame, gates: DataFrame, table: DataFrame) -> DataFrame:
    """Attach the leakage of the held state (0 where the cell has none)."""
    return (holds.join(gates, "gate").join(bounded_broadcast(table), ["cell_name", "state"], "left")
            .withColumn("power", F.coalesce("power", F.lit(0.0))))


def leakage_per_gate(intervals: DataFrame, time_max: Column) -> DataFrame:
    """Mean leakage of each gate over the whole trace."""
    # Sum the ticks of each power level first: whole numbers, so the order of adding is free.
    level = intervals.groupBy("gate", "power").agg(F.sum(F.col("t1") - F.col("t0")).alias("ticks"))
    return level.groupBy("gate").agg((F.sum(F.col("power") * F.col("ticks")) / time_max).alias("leakage"))


def overlap_cycles(intervals: DataFrame, cycle_ticks: int) -> DataFrame:
    """One row per (interval, cycle) with the ticks they share."""
    T = int(cycle_ticks)
    c = intervals.filter("t1 > t0").withColumn("cycle", F.explode(F.expr(f"sequence(t0 div {T}, (t1 - 1) div {T})")))
    return c.withColumn("overlap", F.least("t1", (F.col("cycle") + 1) * T) - F.greatest("t0", F.col("cycle") * T))


def leakage_per_cycle(intervals: DataFrame, cycle_ticks: int, cycles_per_block: int = 4096) -> DataFrame:
    """Total leakage of every cycle, from the interval ends only.

    An interval adds its level at its first cycle and takes it off at its last;
    a prefix sum over cycles restores the whole cycles in between. The work grows
    with the events, not with idle gates times cycles.
    """
    T = int(cycle_ticks)
    iv = intervals.filter("t1 > t0").withColumns({
        "c0": F.expr(f"t0 div {T}"), "c1": F.expr(f"(t1 - 1) div {T}")})
    same = F.col("c0") == F.col("c1")
    first = F.struct(F.col("c0").alias("cycle"),
                     (F.col("power") * (F.least("t1", (F.col("c0") + 1) * T) - F.col("t0"))).alias("part"),
                     F.lit(0.0).alias("step"))
    start = F.struct((F.col("c0") + 1).alias("cycle"), F.lit(0.0).alias("part"), F.col("power").alias("step"))
    last = F.struct(F.col("c1").alias("cycle"),
                    (F.col("power") * (F.col("t1") - F.col("c1") * T)).alias("part"), (-F.col("power")).alias("step"))
    pts = iv.select(F.explode(F.when(same, F.array(first)).otherwise(F.array(first, start, last))).alias("x")).select("x.*")
    per = pts.groupBy("cycle").agg(F.sum("part").alias("part"), F.sum("step").alias("step"))
    # Cycles in which nothing starts or ends keep the running level.
    per = per.withColumn("blk", time_block("cycle", cycles_per_block))
    run = ordered(per, [], ["cycle"], "blk", sum_before={"level": F.col("step")}, lead={"nxt": F.col("cycle")})
    run = run.withColumn("level", F.col("level") + F.col("step"))
    gaps = run.filter("nxt > cycle + 1").select(
        F.explode(F.expr("sequence(cycle + 1, nxt - 1)")).alias("cycle"), F.col("level").alias("leakage"))
    return run.select("cycle", (F.col("level") + F.col("part") / T).alias("leakage")).unionByName(gaps)


# ------------------------------------------------------------------ dynamic energy
def expand_internal(tables: DataFrame, n_pin: int) -> DataFrame:
    """First table in library order for each (cell, pin, related pin, edge, state)."""
    st = tables.withColumn("state", F.explode(F.expr(f"sequence(0, {(1 << n_pin) - 1})"))).filter(
        F.col("state").bitwiseAND(F.col("care_mask")) == F.col("value_mask"))
    return st.groupBy("cell_name", "pin_idx", "rel_idx", "rf", "state").agg(
        F.min_by(F.struct("axis1", "axis2", "vals"), "ord").alias("tbl"))


def nearest_cause(outputs: DataFrame, arcs: DataFrame, n_inputs: int, cycle_ticks: int, time_max: Column,
                  same_cycle: bool = True) -> DataFrame:
    """Input pin whose change best explains an output change (null when none does).

    Distance is |t - delay - t_in| in ticks over the latest earlier change of each
    input with an arc; ties go to the lower pin index.
    """
    T = int(cycle_ticks)
    per_cell = arcs.groupBy("cell_name").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("/", F.col("pin_idx").cast("string"), "from_rf", "to_rf"), "delay"))).alias("arc"))
    df = outputs.join(bounded_broadcast(per_cell), "cell_name", "left").withColumn("to_rf", edge(F.col("pv"), F.col("v")))
    cand = []
    for k in range(n_inputs):
        c = F.col(f"in{k}")
        from_rf = edge(c["pv"], c["v"])
        delay = F.try_element_at("arc", F.concat_ws("/", F.lit(str(k)), from_rf, "to_rf"))
        diff = F.abs(F.col("t") - delay - c["t"])
        ok = diff.isNotNull() & (diff < time_max)
        if same_cycle:
            ok = ok & (F.floor(c["t"] / T) == F.floor(F.col("t") / T))
        cand.append(F.when(ok, F.struct(diff.alias("diff"), F.lit(k).alias("rel_idx"), from_rf.alias("from_rf"))))
    best = F.array_min(F.array(*cand))  # skips the inputs that do not qualify
    return df.withColumn("cause", best).drop("arc")


def default_output_energy(pins: DataFrame, tables: DataFrame, n_inputs: int) -> DataFrame:
    """Mean over all (input, from edge, table) of an output pin and edge.

    ``pins`` has one row per (gate, pin) with cell_name, slew_rise, slew_fall, load_cap.
    """
    ins = pins.filter(F.col("pin_idx") < n_inputs).select(
        "gate", "cell_name", F.col("pin_idx").alias("rel_idx"),
        F.explode(F.array("slew_rise", "slew_fall")).alias("slew"))
    outs = pins.filter(F.col("pin_idx") >= n_inputs).select("gate", "pin_idx", "load_cap")
    rows = ins.join(outs, "gate").join(bounded_broadcast(tables), ["cell_name", "pin_idx", "rel_idx"])
    rows = add_lut2(rows, "e", "axis1", "axis2", "vals", F.col("slew"), F.col("load_cap"))
    return rows.groupBy("gate", "pin_idx", "rf").agg(F.avg("e").alias("default_energy"))


def energy_per_change(flagged: DataFrame, ticks: DataFrame, gates: DataFrame, pin_env,
                      tables: DataFrame, arcs: DataFrame, n_inputs: int, n_pin: int, cycle_ticks: int,
                      time_max: Column, ticks_per_slew: float, on_miss: str = "zero", pins: DataFrame | None = None) -> DataFrame:
    """Internal and switching energy of every change, and its glitch ratio.

    ``flagged``: all changes with their glitch pulse. State means the state before the tick
    for all pins that change in it. ``on_miss='mean'`` uses the mean energy when the cause has
    no matching table. ``pins`` names all pins of the gates where ``flagged`` is only part of a log. The rows carry their columns along, so the only wide joins are the
    state per (gate, tick) and the carried values of the as-of pass.
    """
    before = ticks.select("gate", "t", F.col("state_before").alias("state"))
    full = flagged.join(before, ["gate", "t"]).join(gates.select("gate", "cell_name"), "gate")
    full = pin_env(full)
    full = cut(full.withColumns({
        "rf": edge(F.col("pv"), F.col("v")),
        "ratio": glitch_ratio(F.col("pulse"), (F.col("slew_rise") + F.col("slew_fall")) * ticks_per_slew)}))
    exp = bounded_broadcast(expand_internal(tables, n_pin))

    inp = full.filter((F.col("pin_idx") < n_inputs) & F.col("pv").isNotNull()).withColumns({
        "rel_idx": F.lit(-1), "slew": F.when(F.col("rf") == "rise", F.col("slew_rise")).otherwise(F.col("slew_fall")),
        "cap": F.lit(0.0)})
    inp = inp.join(exp, ["cell_name", "pin_idx", "rel_idx", "rf", "state"], "left").withColumn("default_energy", F.lit(None).cast("double"))

    outs = asof_inputs(full, n_inputs).filter("pv is not null")
    out = nearest_cause(outs, arcs, n_inputs, cycle_ticks, time_max).withColumn("rel_idx", F.col("cause.rel_idx"))
    # The related pin's slews come from the same pin rule, evaluated for the related index.
    own = out.withColumnRenamed("pin_idx", "_own").withColumnsRenamed(
        {"slew_rise": "_sr", "slew_fall": "_sf", "load_cap": "cap", "volt": "_v"}).withColumn("pin_idx", F.col("rel_idx"))
    own = pin_env(own).withColumn(
        "slew", F.when(F.col("cause.from_rf") == "rise", F.col("slew_rise")).otherwise(F.col("slew_fall")))
    own = own.drop("pin_idx", "slew_rise", "slew_fall", "load_cap", "volt").withColumnsRenamed(
        {"_own": "pin_idx", "_sr": "slew_rise", "_sf": "slew_fall", "_v": "volt"}).withColumn("load_cap", F.col("cap"))
    own = own.join(exp, ["cell_name", "pin_idx", "rel_idx", "rf", "state"], "left")
    pins = pin_env((full if pins is None else pins).select("gate", "pin_idx").distinct()).join(gates.select("gate", "cell_name"), "gate")
    means = default_output_energy(pins, tables.filter("rel_idx >= 0"), n_inputs)
    own = own.join(means, ["gate", "pin_idx", "rf"], "left")
    if on_miss != "mean":
        own = own.withColumn("default_energy", F.when(F.col("rel_idx").isNull(), F.col("default_energy")))

    both = inp.unionByName(own.select(*inp.columns))
    both = add_lut2(both.select("*", "tbl.*"), "e", "axis1", "axis2", "vals", F.col("slew"), F.col("cap"))
    toggles = n_toggle(F.col("pv"), F.col("v"))
    swing = F.when(F.col("pin_idx") >= n_inputs,
                   n_rise(F.col("pv"), F.col("v")) * F.col("load_cap") * F.col("volt") * F.col("volt")).otherwise(0.0)
    return both.select(
        "sig_id", "gate", "pin_idx", "t", "pv", "v", "state", "rel_idx", "ratio",
        F.expr(f"t div {int(cycle_ticks)}").alias("cycle"),
        (F.coalesce("e", "default_energy", F.lit(0.0)) * toggles).alias("internal"),
        swing.alias("switching"))


def split_glitch(energy: DataFrame) -> DataFrame:
    """Four energy columns: regular and glitch parts; a ratio above 0 moves a change to glitch."""
    g = F.coalesce(F.col("ratio") > 0, F.lit(False))
    cols = {}
    for c in ("internal", "switching"):
        cols[f"glitch_{c}"] = F.when(g, F.col("ratio") * F.col(c)).otherwise(0.0)
    for c in ("internal", "switching"):
        cols[c] = F.when(g, 0.0).otherwise(F.col(c))
    return energy.withColumns(cols)


def cell_power(split: DataFrame, leak: DataFrame, seconds: Column) -> DataFrame:
    """Per gate: five separate components and the three reported ones, which include glitch."""
    parts = ["internal", "glitch_internal", "switching", "glitch_switching"]
    dyn = split.groupBy("gate").agg(*[(F.sum(c) / seconds).alias(c) for c in parts])
    out = leak.join(dyn, "gate", "left").na.fill(0.0, parts)
    return out.withColumns({
        "reported_internal": F.col("internal") + F.col("glitch_internal"),
        "reported_switching": F.col("switching") + F.col("glitch_switching")}).withColumn(
        "total", F.col("reported_internal") + F.col("reported_switching") + F.col("leakage"))


def cycle_power(split: DataFrame, leak_cycle: DataFrame, period: float) -> DataFrame:
    """Long table (cycle, component, power); internal and switching include glitch."""
    g = split.groupBy("cycle").agg(
        F.sum(F.col("internal") + F.col("glitch_internal")).alias("internal"), F.sum("glitch_internal").alias("glitch_internal"),
        F.sum(F.col("switching") + F.col("glitch_switching")).alias("switching"), F.sum("glitch_switching").alias("glitch_switching"))
    parts = ["internal", "glitch_internal", "switching", "glitch_switching"]
    dyn = g.select("cycle", F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), (F.col(c) / period).alias("power")) for c in parts])).alias("x")).select("cycle", "x.*")
    lk = leak_cycle.select("cycle", F.lit("leakage").alias("component"), F.col("leakage").alias("power"))
    return dyn.unionByName(lk)


def power_class(macro: Column, pad: Column, clock: Column, seq: Column) -> Column:
    """First matching class wins."""
    return (F.when(macro, "macro").when(pad, "pad").when(clock, "clock")
            .when(seq, "sequential").otherwise("combinational"))


def group_table(cells: DataFrame, components: list[str]) -> DataFrame:
    """Sum per class plus a total row, with each row's share of the total in percent."""
    sums = cells.rollup("class").agg(*[F.sum(c).alias(c) for c in components])
    named = sums.withColumn("class", F.coalesce("class", F.lit("total")))
    row_total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    named = named.withColumn("total", row_total)
    whole = F.max(F.when(F.col("class") == "total", F.col("total"))).over(_whole())
    return named.withColumn("pct", F.when((whole == 0) | F.isnan(whole), 0.0).otherwise(F.col("total") / whole * 100.0))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))  # a handful of class rows
