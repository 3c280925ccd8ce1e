"""Pin activities: priority of sources, propagation through logic, averaged power."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import (
    by_function, function_index, known_functions, probability, probability_expr, toggle_rate, toggle_rate_expr)
from ..session import cut, cut_watch

CLOCK_ACTIVITY = 2.0          # toggles per cycle of a clock nobody described
INPUT_ACTIVITY, INPUT_DUTY = 0.1, 0.5
TOLERANCE = 1e-3
TINY = 1e-10
MAX_PASSES = 100
PERIOD_TOLERANCE = 0.1


def clip(a: Column) -> Column:
    return F.when(F.abs(a) < TINY, 0.0).otherwise(a)


def resolve_activity(pins: DataFrame, user: DataFrame, propagated: DataFrame, global_activity: float | None) -> DataFrame:
    """Activity and origin per pin: constant, clock (user, else default), global, propagated, user, unknown."""
    j = (pins.join(user.select("pin_id", F.col("activity").alias("_u")), "pin_id", "left")
         .join(propagated.select("pin_id", F.col("activity").alias("_p")), "pin_id", "left"))
    g = F.lit(global_activity).cast("double")
    const, clk = F.col("is_constant"), F.col("is_clock")
    act = (F.when(const, 0.0).when(clk, F.coalesce("_u", F.lit(CLOCK_ACTIVITY)))
           .otherwise(F.coalesce(g, "_p", "_u", F.lit(0.0))))
    origin = (F.when(const, "constant").when(clk & F.col("_u").isNotNull(), "user").when(clk, "clock")
              .when(g.isNotNull(), "global").when(F.col("_p").isNotNull(), "propagated")
              .when(F.col("_u").isNotNull(), "user").otherwise("unknown"))
    return j.withColumns({"activity": act, "origin": origin}).drop("_u", "_p")


def traced_periods(changes: DataFrame, key: str = "sig_id") -> DataFrame:
    """Mean ticks from one rise to the next of every signal that rises twice or more; needs no sort."""
    rises = changes.filter("v = 1 and pv is not null").groupBy(key).agg(F.count("*").alias("_n"), F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return rises.filter("_n > 1").select(key, ((F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1)).alias("period"))


def period_mismatch(traced: DataFrame, declared: Column, tolerance: float = PERIOD_TOLERANCE) -> DataFrame:
    """Traced clocks whose period is off the declared one by more than the tolerance."""
    return traced.withColumn("declared", declared).filter(F.abs(F.col("period") - F.col("declared")) / F.col("declared") > tolerance)


def pin_count_coverage(gates: DataFrame, thresholds: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """Gates (n_pin, n_event) with more pins than each threshold: their number, their events and their share of all gates."""
    h = gates.groupBy("n_pin").agg(F.count("*").alias("n_gate"), F.sum("n_event").alias("n_event"))
    t = h.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.col("n_pin") > F.col("threshold")
    above = F.coalesce(F.sum(F.when(over, F.col("n_gate"))), F.lit(0))
    return t.groupBy("threshold").agg(above.alias("n_gate"), F.coalesce(F.sum(F.when(over, F.col("n_event"))), F.lit(0)).alias("n_event"), (above / F.sum("n_gate")).alias("ratio"))


# ------------------------------------------------------------------ propagation
def seed_roots(roots: DataFrame, user: DataFrame) -> DataFrame:
    """User value of a root net, else the input default."""
    u = user.select("net", F.col("activity").alias("_a"), F.col("duty").alias("_d"))
    return roots.join(u, "net", "left").select(
        "net", F.coalesce("_a", F.lit(INPUT_ACTIVITY)).alias("activity"), F.coalesce("_d", F.lit(INPUT_DUTY)).alias("duty"),
        F.when(F.col("_a").isNotNull(), "user").otherwise("input").alias("origin"))


def gate_output(tt: Column, duty: Column, act: Column):
    return toggle_rate(tt, duty, act), probability(tt, duty)


def clock_gate_output(clk_act: Column, clk_duty: Column, en_act: Column, en_duty: Column):
    return clk_act * en_duty + en_act * clk_duty, clk_duty * en_duty


class LogicNet:
    """Gates and their input pins, written once and reused by every propagation.

    ``gates``: gate, out_net, tt, n_in. ``inputs``: gate, pin_idx, net, with pin_idx < ``max_pins``.
    """

    def __init__(self, gates: DataFrame, inputs: DataFrame, max_pins: int = 16):
        g = cut(gates.select("gate", "out_net", "tt", "n_in"))
        self.functions = known_functions(g, max_pins)
        # Few functions: keep a number per gate and evaluate plain arithmetic per function.
        self.gates = g if self.functions is None else g.select("gate", "out_net", function_index(F.col("tt"), self.functions).alias("tt"), "n_in")
        self.inputs = cut(inputs.select("gate", "pin_idx", "net"))
        self.max_pins = max_pins

    def propagate(self, seeds: DataFrame) -> DataFrame:
        """(net, activity, duty) of every net behind the seeds, one logic level per round.

        Each round joins only the nets found in the round before, so an input pin takes part
        in one join in all; gates still waiting for inputs keep one row with what they have.
        """
        pins = range(self.max_pins)
        slots = [f"_{c}{k}" for c in "ad" for k in pins]
        fresh = cut(seeds.select("net", "activity", "duty"))
        found, waiting = [fresh], None
        while True:
            pin = fresh.join(self.inputs, "net").select("gate", F.lit(1).alias("k"), *[
                F.when(F.col("pin_idx") == k, F.col(c)).alias(f"_{c[0]}{k}") for c in ("activity", "duty") for k in pins])
            rows = pin if waiting is None else pin.unionByName(waiting)
            per = rows.groupBy("gate").agg(F.sum("k").cast("int").alias("k"), *[F.max(x).alias(x) for x in slots])
            per, n = cut_watch(per.join(self.gates, "gate"), F.col("k") == F.col("n_in"))
            if not n:
                return reduce(DataFrame.unionByName, found)
            a, p = self.output(pins)
            ready = per.filter("k = n_in").select(F.col("out_net").alias("net"), "tt", "n_in", *slots)
            fresh = ready.select("net", clip(a).alias("activity"), p.alias("duty"))
            found.append(fresh)
            waiting = per.filter("k < n_in").select("gate", "k", *slots)

    def output(self, pins) -> tuple[Column, Column]:
        if self.functions is None:
            duty, act = (F.slice(F.array(*[F.col(f"_{c}{k}") for k in pins]), F.lit(1), F.col("n_in")) for c in "da")
            return gate_output(F.col("tt"), duty, act)
        table = dict(enumerate(self.functions))

        def cols(c: str, bits: list[int]) -> list[Column]:
            return [F.col(f"_{c}{k}") for k in range(len(bits).bit_length() - 1)]
        return (by_function(F.col("tt"), table, lambda t: toggle_rate_expr(t, cols("d", t), cols("a", t))),
                by_function(F.col("tt"), table, lambda t: probability_expr(t, cols("d", t))))


def propagate_activity(gates: DataFrame, inputs: DataFrame, seeds: DataFrame, max_pins: int = 16) -> DataFrame:
    return LogicNet(gates, inputs, max_pins).propagate(seeds)


def register_value(activity: Column, duty: Column, level_sensitive: Column, inverted: Column) -> tuple[Column, Column]:
    """Activity and duty of a Q from its D's: at most 1 for edge-triggered, duty turned for QN."""
    return (F.when(level_sensitive, activity).otherwise(F.least(activity, F.lit(1.0))).alias("activity"),
            F.when(inverted, 1.0 - duty).otherwise(duty).alias("duty"))


def register_outputs(regs: DataFrame, nets: DataFrame) -> DataFrame:
    """Q nets take their D's ``register_value``."""
    j = regs.join(nets.withColumnRenamed("net", "d_net"), "d_net")
    return j.select(F.col("q_net").alias("net"), *register_value(F.col("activity"), F.col("duty"), F.col("level_sensitive"), F.col("inverted")))


def propagate_with_registers(gates: DataFrame, inputs: DataFrame, seeds: DataFrame, regs: DataFrame, max_passes: int = MAX_PASSES, max_pins: int = 16) -> DataFrame:
    """Repeat logic propagation and register hand-over until nothing moves by more than the tolerance."""
    regs = cut(regs)
    logic = LogicNet(gates, inputs, max_pins)
    q = cut(regs.select(F.col("q_net").alias("net"), F.lit(0.0).alias("activity"), F.lit(0.0).alias("duty")))
    for _ in range(max_passes):
        nets = logic.propagate(seeds.select("net", "activity", "duty").unionByName(q))
        new = register_outputs(regs, nets).join(q.withColumnsRenamed({"activity": "_a", "duty": "_d"}), "net")
        moved = (F.abs(F.col("activity") - F.col("_a")) > TOLERANCE) | (F.abs(F.col("duty") - F.col("_d")) > TOLERANCE)
        q, n = cut_watch(new, moved)
        q = q.select("net", "activity", "duty")
        if not n:
            break
    return nets


# ------------------------------------------------------------------ averaged power
def when_duty(care: Column, value: Column, duty: Column) -> Column:
    """Chance that a conjunction over independent pins holds."""
    return F.aggregate(F.sequence(F.lit(0), F.size(duty) - 1), F.lit(1.0), lambda a, i: F.when(
        F.call_function("shiftright", care, i).bitwiseAND(F.lit(1)) == 0, a).when(
        F.call_function("shiftright", value, i).bitwiseAND(F.lit(1)) == 1, a * F.get(duty, i)).otherwise(a * (1.0 - F.get(duty, i))))


def averaged_leakage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Leakage from condition duties.

    ``rows`` has one row per (instance, table row): power, cond_duty (null: unconditional),
    default_leakage (null: none). Unconditional rows count only without conditional ones;
    the default fills the share no positive row covers.
    """
    c = F.col("cond_duty")
    g = rows.groupBy(*keys).agg(
        F.sum(F.when(c.isNotNull(), F.col("power") * c)).alias("cond"), F.sum(F.when(c.isNull(), F.col("power"))).alias("uncond"),
        F.sum(F.when(c.isNotNull() & (F.col("power") > 0), c).otherwise(0.0)).alias("covered"), F.first("default_leakage").alias("d"))
    base = F.coalesce("cond", "uncond", F.lit(0.0))
    return g.select(*keys, (base + F.coalesce(F.col("d") * (1.0 - F.col("covered")), F.lit(0.0))).alias("leakage"))


def output_weights(rows: DataFrame, keys: list[str], pg: str = "pg_pin") -> DataFrame:
    """Share of each table: from-activity times duty over its sum per (instance, port, power pin)."""
    w = F.col("from_activity") * F.col("duty")
    tot = rows.groupBy(*keys, pg).agg(F.sum(w).alias("_t"))
    j = rows.join(tot, [*keys, pg])
    return j.withColumn("weight", F.when(F.col("_t") != 0, w / F.col("_t")).otherwise(0.0)).drop("_t")


def weighted_output(rows: DataFrame, keys: list[str], counts: Column, value: Column) -> DataFrame:
    """``value`` summed by the shares of ``output_weights`` of one power pin, in one aggregation: (keys, value).

    As a share is a weight over the sum of those rows that ``counts``, the quotient of the two sums is taken at the end; 0 where all weights are 0.
    """
    w = F.col("from_activity") * F.col("duty")
    g = rows.groupBy(*keys).agg(F.sum(F.when(counts, w)).alias("_t"), F.sum(w * value).alias("_v"))
    return g.select(*keys, F.when(F.col("_t") != 0, F.col("_v") / F.col("_t")).otherwise(0.0).alias("value"))
