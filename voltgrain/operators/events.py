"""Value-change events: clean-up, activity statistics, running state, glitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import n_transition, state_bit
from .ordered import ordered, time_block

SIG = ["sig_id", "gate", "pin_idx"]


def dedup_changes(events: DataFrame, block_ticks: int, initial: int = 2) -> DataFrame:
    """One change per (signal, tick), no repeats of a value, a start value at tick 0.

    ``pv`` is the value before the change; null for the first row of a signal.
    """
    # One exchange by (signal, block) serves the grouping, the carry join and the window.
    ev = events.withColumn("blk", time_block("t", block_ticks)).repartition(*SIG, "blk")
    one = ev.groupBy(*SIG, "blk", "t").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))
    lagged = ordered(one, SIG, ["t"], "blk", lag={"pv": F.col("v")})
    # A signal's first row, when late, brings its start row along.
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("blk"), zero.alias("t"), F.lit(-1).cast("bigint").alias("seq"), F.lit(initial).alias("v"), F.lit(None).cast("int").alias("pv"))
    same = F.struct("blk", "t", "seq", "v", "pv")
    after = F.struct("blk", "t", "seq", "v", F.lit(initial).alias("pv"))
    rows = F.when(F.col("pv").isNull() & (F.col("t") > 0), F.array(start, after)).otherwise(F.array(same))
    full = lagged.select(*SIG, F.explode(rows).alias("x")).select(*SIG, "x.t", "x.seq", "x.v", "x.blk", "x.pv")
    return full.filter(F.col("pv").isNull() | (F.col("pv") != F.col("v")))


def split_bus(bus: DataFrame) -> DataFrame:
    """Bus changes (``bits`` text, msb, lsb) -> one row per bit.

    A value with an unknown leading digit makes every bit 0. Short values are
    extended with zeros. The pin index runs from lsb towards msb.
    """
    bad = F.lower(F.substring("bits", 1, 1)).isin("x", "z", "u")
    padded = F.expr("lpad(bits, width, '0')")
    rows = bus.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    digit = F.substring(padded, F.col("width") - F.col("bit"), F.lit(1))
    return rows.select(
        "sig_id", "bit", (F.col("lsb") + F.col("bit") * F.signum(F.col("msb") - F.col("lsb"))).cast("int").alias("pin_index"),
        "t", F.when(bad, 0).otherwise((digit == "1").cast("int")).alias("v"))


def activity(changes: DataFrame, time_max: Column, block_ticks: int) -> DataFrame:
    """Per signal: weighted transitions and ticks spent at 1 up to ``time_max``."""
    nxt = ordered(changes, SIG, ["t"], "blk", lead={"next_t": F.col("t")})
    weight2 = F.when(F.col("pv").isNull(), 0).otherwise(n_transition(F.col("pv"), F.col("v")) * 2).cast("bigint")
    held = F.coalesce(F.col("next_t"), time_max) - F.col("t")
    return nxt.groupBy(*SIG).agg(
        F.sum(weight2).alias("transitions2"),
        F.sum(F.when(F.col("v") == 1, held).otherwise(0)).alias("high_ticks"),
        F.count("pv").alias("n_event"))


def value_counts(changes: DataFrame) -> DataFrame:
    """Per signal: rises, falls, unknowns, and unknowns after the start row."""
    c, p, t = F.col("v"), F.col("pv"), F.col("t")
    return changes.groupBy("sig_id").agg(
        F.count_if((c == 1) & p.isNotNull()).alias("n_rise"), F.count_if((c == 0) & p.isNotNull()).alias("n_fall"),
        F.count_if(c == 2).alias("n_x"), F.count_if((c == 2) & (t > 0)).alias("n_non_initial_x"))


def gate_ticks(changes: DataFrame) -> DataFrame:
    """State of each gate around every tick at which one of its pins changes.

    ``state_before`` / ``state_after`` have bit k set when pin k is exactly 1;
    ``next_t`` is the gate's next tick. Simultaneous changes count as one step.
    """
    delta = state_bit(F.col("v"), F.col("pin_idx")) - state_bit(F.coalesce(F.col("pv"), F.lit(0)), F.col("pin_idx"))
    step = changes.repartition("gate", "blk").groupBy("gate", "blk", "t").agg(F.sum(delta).alias("delta"))
    st = ordered(step, ["gate"], ["t"], "blk", sum_before={"state_before": F.col("delta")},
                 lead={"next_t": F.col("t")})
    return st.select("gate", "blk", "t", "next_t", F.col("state_before").cast("int").alias("state_before"),
                     (F.col("state_before") + F.col("delta")).cast("int").alias("state_after"))


def glitch_flags(changes: DataFrame, cycle_ticks: int) -> DataFrame:
    """Flag the first even number of changes of a (pin, cycle); the start row is no change.

    Only the last change of an odd group stays unflagged, so a count and a last
    tick per (pin, cycle) decide every row and no group is ever sorted.
    Clock pins (``is_clock`` where present) are never flagged.
    """
    cyc = changes.withColumn("cycle", F.expr(f"t div {int(cycle_ticks)}"))
    per = (cyc.filter("pv is not null").groupBy(*SIG, "cycle")
           .agg(F.count("*").alias("_n"), F.max("t").alias("_last")))
    odd_last = (F.col("_n") % 2 == 1) & (F.col("t") == F.col("_last"))
    flag = F.col("pv").isNotNull() & (F.col("_n") >= 2) & ~odd_last
    if "is_clock" in changes.columns:
        flag = flag & ~F.col("is_clock")
    return (cyc.join(per, [*SIG, "cycle"], "left")
            .withColumn("glitch", F.coalesce(flag, F.lit(False))).drop("_n", "_last"))


def glitch_width(flagged: DataFrame, neighbour: str = "any") -> DataFrame:
    """Widest gap from a flagged change to a flagged neighbour; null when it has none.

    ``neighbour='cycle'`` only looks at neighbours in the same cycle.
    """
    me = F.struct("t", "glitch", "cycle")
    nb = ordered(flagged, SIG, ["t"], "blk", lag={"_p": me}, lead={"_n": me})

    def gap(side: str, dist: Column) -> Column:
        ok = F.col(f"{side}.glitch")
        if neighbour == "cycle":
            ok = ok & (F.col(f"{side}.cycle") == F.col("cycle"))
        return F.when(ok, dist)

    wide = F.greatest(gap("_p", F.col("t") - F.col("_p.t")), gap("_n", F.col("_n.t") - F.col("t")))
    return nb.withColumn("pulse", F.when(F.col("glitch"), wide)).drop("_p", "_n")


def glitch_ratio(pulse: Column, slew_sum: Column) -> Column:
    """Share of a full swing a pulse reaches: min(1, (2w / slews)^2); null without a pulse."""
    r = 2.0 * pulse / slew_sum
    return F.when(pulse.isNull(), None).when(slew_sum == 0, 1.0).otherwise(F.least(F.lit(1.0), r * r))


def asof_inputs(changes: DataFrame, n_inputs: int, first_fallback: bool = False) -> DataFrame:
    """Every output change with, per input pin, its latest change strictly before it.

    Columns ``in<k>`` hold struct(t, pv, v). Rows are ordered so that probes of a
    tick come before the input changes of that tick. Cleaned logs give every signal a
    row at tick 0, so an earlier change always exists; for other logs
    ``first_fallback`` takes an input's first change when none is earlier.
    """
    is_out = F.col("pin_idx") >= n_inputs
    # The input's own previous value: a first change counts as coming from itself.
    seen = F.struct("t", F.coalesce("pv", "v").alias("pv"), "v")
    rows = changes.withColumn("_kind", F.when(is_out, 0).otherwise(1))
    lasts = {f"in{k}": F.when(F.col("pin_idx") == k, seen) for k in range(n_inputs)}
    got = ordered(rows, ["gate"], ["t", "_kind", "pin_idx"], "blk", last_before=lasts).filter(is_out).drop("_kind")
    if not first_fallback:
        return got
    first = changes.filter(~is_out).groupBy("gate").agg(
        *[F.min_by(F.when(F.col("pin_idx") == k, seen), F.when(F.col("pin_idx") == k, F.col("t"))).alias(f"_f{k}")
          for k in range(n_inputs)])
    out = got.join(first, "gate", "left")
    return out.withColumns({f"in{k}": F.coalesce(f"in{k}", f"_f{k}") for k in range(n_inputs)}).drop(
        *[f"_f{k}" for k in range(n_inputs)])


def resample(changes: DataFrame, step: int, time_max: Column, keys: list[str], block_ticks: int) -> DataFrame:
    """Value of each signal at every multiple of ``step`` up to ``time_max``."""
    ends = changes.select(*keys).distinct()
    first = (F.ceil(F.col("_b") * F.lit(block_ticks) / step) * step).cast("bigint")
    last = F.least(((F.col("_b") + 1) * F.lit(block_ticks) - 1).cast("bigint"), time_max)
    grid = (ends.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor(time_max / block_ticks).cast("int"))))
            # a block may hold no grid point
            .withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))))
            .select(*keys, "t", F.lit(1).alias("_probe"), F.lit(None).cast("int").alias("v")))
    both = changes.select(*keys, "t", F.lit(0).alias("_probe"), "v").unionByName(grid).withColumn(
        "blk", time_block("t", block_ticks))
    got = ordered(both, keys, ["t", "_probe"], "blk", last_before={"value": F.col("v")})
    return got.filter("_probe = 1").select(*keys, "t", "value")


def events_per_cycle(changes: DataFrame, cycle_ticks: int) -> DataFrame:
    """Event density of each (signal, cycle)."""
    return (changes.filter("pv is not null").groupBy("sig_id", F.expr(f"t div {int(cycle_ticks)}").alias("cycle"))
            .agg(F.count("*").alias("n_event")))


def min_time_step(events: DataFrame, block_ticks: int) -> DataFrame:
    """Smallest gap between two distinct event times of the whole trace."""
    times = events.select("t").distinct().withColumn("blk", time_block("t", block_ticks))
    got = ordered(times, [], ["t"], "blk", lag={"pt": F.col("t")})
    return got.agg(F.min(F.col("t") - F.col("pt")).alias("min_step"))
