"""Constants through logic, registers, three-state outputs and clock gates, settled by rounds over what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import X, ternary_value
from ..session import cut, cut_watch
from .graph import union_all


def output_value(thru_registers: bool) -> Column:
    """0, 1 or unknown of an output whose known inputs are the masks km (which) and kv (those at 1).

    Needs kind, tt, en, inverted. ``logic``: the function. ``seq``: the data function, inverted on an inverted output,
    unknown unless registers are passed. ``clock_gate``: 0 if one of its clock and enable pins is 0. An output with an
    enable function is unknown unless the enable is known to be 1.
    """
    km, kv = F.col("km"), F.col("kv")
    f = ternary_value(F.col("tt"), km, kv)
    data = F.when(F.lit(not thru_registers) | (f == X), X).when(F.col("inverted"), 1 - f).otherwise(f)
    value = (F.when(F.col("kind") == "clock_gate", F.when(km != kv, 0).otherwise(X))
             .when(F.col("kind") == "seq", data).otherwise(f))
    return F.when(F.col("en").isNotNull() & (ternary_value(F.col("en"), km, kv) != 1), X).otherwise(value)


def settle_constants(gates: DataFrame, inputs: DataFrame, held: DataFrame, thru_registers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(net, value) of every net fixed to 0 or 1, and (net, value, held) of outputs that disagree with a held value.

    ``gates``: one row per output: gate, out_net, kind (logic / seq / clock_gate), tt, en (truth table of the enable or
    null), inverted. ``inputs``: gate, pin_idx, net, with the pin order of both truth tables; of a clock gate only its
    clock and enable pins. ``held``: net, value 0, 1, or 2 for a net that must stay unknown; held nets are never changed.
    Null kinds are logic, null ``inverted`` is false, rows without a net are unconnected pins and ignored. A net with
    several drivers takes the value of those that are fixed first, the smaller one if they disagree.

    A net becomes known once, so loops through registers end. Known pins are kept as a log, one row a pin; a round evaluates
    the gates behind nets of the round before only, from the log rows of these gates. Both look-ups into what came
    before (the log, the known nets) go by semi joins on the side that is new, which Spark broadcasts while it is small.
    """
    ins = cut(inputs.filter("net is not null").select("gate", "net", F.call_function("shiftleft", F.lit(1), F.col("pin_idx").cast("int")).alias("km")))
    gates = cut(gates.select("gate", "out_net", F.coalesce("kind", F.lit("logic")).alias("kind"), "tt", "en", F.coalesce("inverted", F.lit(False)).alias("inverted")))
    held = cut(held.groupBy("net").agg(F.min("value").cast("int").alias("value")))
    if not thru_registers:
        gates = gates.filter("kind <> 'seq'")
    value = output_value(thru_registers)

    def decided(touched: DataFrame) -> tuple[DataFrame, int]:
        return cut_watch(touched.select("gate", "km", "kv", F.col("out_net").alias("net"), value.alias("value")), F.lit(True))

    def new_nets(val: DataFrame, known: list[DataFrame]) -> tuple[DataFrame, int]:
        cand = val.filter((F.col("value") != X) & F.col("net").isNotNull()).groupBy("net").agg(F.min("value").alias("value"))
        old = union_all([t.select("net") for t in known]).join(cand.select("net"), "net", "left_semi")
        return cut_watch(cand.join(old, "net", "left_anti"), F.lit(True))

    # Round 0: held values and outputs that are constant whatever their inputs.
    first, _ = decided(gates.withColumns({"km": F.lit(0), "kv": F.lit(0)}).filter(value != X))
    tied, _ = new_nets(first, [held])
    said = [first]
    fresh = cut(held.filter(F.col("value") != X).unionByName(tied))
    known, log = [held, tied], []
    while True:
        pins, n = cut_watch(fresh.join(ins, "net").select("gate", "km", (F.col("km") * F.col("value")).alias("kv")), F.lit(True))
        if not n:
            break
        log.append(pins)
        touched = union_all(log).join(pins.select("gate").distinct(), "gate", "left_semi").groupBy("gate").agg(
            F.bit_or("km").cast("int").alias("km"), F.bit_or("kv").cast("int").alias("kv"))
        val, n = decided(touched.join(gates, "gate"))
        if not n:
            break
        said.append(val)
        fresh, n = new_nets(val, known)
        if not n:
            break
        known.append(fresh)
    against = held.filter(F.col("value") != X).select("net", F.col("value").alias("held"))
    differ = union_all([s.filter(F.col("value") != X).select("net", "value") for s in said]).distinct().join(against, "net").filter("value <> held")
    return union_all(known).filter(F.col("value") != X), differ
