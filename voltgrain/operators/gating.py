"""Clock gating checks inferred from functions, with arrivals carried to the enable pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import sized


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i.cast("int"))


def gating_pins(functions: DataFrame) -> DataFrame:
    """(cell, out_pin, clk_idx, en_idx, active) of every input pair in which one pin gates the other.

    ``functions``: cell, out_pin, n_pins, tt; distinct library rows. Pin c is gated if exactly one of the cofactors f(c=0), f(c=1) is constant;
    the other one is what the enables decide, so ``active`` is the value c has there, and every pin it depends on is an enable.
    """
    tt = F.col("tt")
    states = F.sequence(F.lit(0), F.size(tt) - 1)
    f = functions.filter("tt is not null and n_pins >= 2").withColumn("clk_idx", F.explode(F.sequence(F.lit(0), F.col("n_pins") - 1)))
    c = _bit(F.col("clk_idx"))

    def values(on: bool) -> Column:
        side = F.filter(states, lambda s: (s.bitwiseAND(c) != 0) == F.lit(on))
        return F.size(F.array_distinct(F.transform(side, lambda s: F.get(tt, s))))

    f = f.withColumns({"_n0": values(False), "_n1": values(True)}).filter("(_n0 = 1) <> (_n1 = 1)")
    f = f.withColumn("active", F.when(F.col("_n1") == 1, 0).otherwise(1))
    f = f.withColumn("en_idx", F.explode(F.sequence(F.lit(0), F.col("n_pins") - 1))).filter("en_idx <> clk_idx")
    e, c = _bit(F.col("en_idx")), _bit(F.col("clk_idx"))
    depends = F.exists(states, lambda s: ((s.bitwiseAND(c) != 0).cast("int") == F.col("active")) & (F.get(tt, s) != F.get(tt, s.bitwiseXOR(e))))
    return f.filter(depends).select("cell", "out_pin", "clk_idx", "en_idx", "active")


def gated_enables(insts: DataFrame, pins: DataFrame, functions: DataFrame, clock_pins: DataFrame,
                  disabled: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(inst, clk_v, en_v, active): enable pins that gate a clock. Active 1 or 0; one row per pair even if several outputs agree, the higher value if they do not.

    ``insts``: inst, cell. ``pins``: inst, pin_idx, v. ``clock_pins``: v, the clock network; the enable must lie outside it.
    ``disabled``: inst, v; a row with an instance only turns all its checks off, one with a pin those of that pin.
    ``overrides``: clk_v, en_v, active set by the user; it beats the function. All of them may grow with the instances, so only library rows are broadcast.
    """
    marked = pins.join(clock_pins.select("v").distinct().withColumn("_c", F.lit(True)).hint("merge"), "v", "left")
    if disabled is not None:
        marked = marked.join(disabled.filter("v is not null").select("v").distinct().hint("merge"), "v", "left_anti")
        insts = insts.join(disabled.filter("v is null and inst is not null").select("inst").distinct().hint("merge"), "inst", "left_anti")
    clk = marked.filter("_c").select("inst", F.col("pin_idx").alias("clk_idx"), F.col("v").alias("clk_v"))
    en = marked.filter("_c is null").select("inst", F.col("pin_idx").alias("en_idx"), F.col("v").alias("en_v"))
    # Only instances with a clock pin and another pin get as far as the library rows.
    pair = clk.join(insts.select("inst", "cell").hint("merge"), "inst").join(sized(gating_pins(functions)), ["cell", "clk_idx"]).join(en.hint("merge"), ["inst", "en_idx"])
    out = pair.groupBy("inst", "clk_v", "en_v").agg(F.max("active").alias("active"))
    if overrides is not None:
        out = out.join(overrides.select("clk_v", "en_v", F.col("active").alias("_o")).hint("merge"), ["clk_v", "en_v"], "left").withColumn("active", F.coalesce("_o", "active")).drop("_o")
    return out.select("inst", "clk_v", "en_v", "active")


MARGIN_ORDER = ("en_v", "inst", "clk_v", "cclk", None)


def gating_ends(enables: DataFrame, arrivals: DataFrame, clock_arrivals: DataFrame, capture: DataFrame,
                margins: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Setup and hold ends of the enables: inst, en_v, clk_v, rf, lclk, cclk, kind, clk_rf, required, slack.

    ``arrivals``: v, rf, clk, a_max, a_min of data. ``clock_arrivals``: v, rf, clk, a_max, a_min of clock paths.
    ``capture``: lclk, cclk, clk_rf, kind, capture, the clock edge each check is held against. ``excluded``: lclk, cclk.
    ``margins``: scope (one of enable pin en_v, inst, clk_v, cclk, or global), key (text; null for global), kind, rf (null: both), margin;
    the first scope in that order that names the end is taken, a row of its own edge before one for both; without any the margin is 0.

    The enable must be stable while the clock is at its active value: setup against the edge into it, hold against the edge out of it.
    """
    d = arrivals.select(F.col("v").alias("en_v"), "rf", F.col("clk").alias("lclk"), "a_max", "a_min")
    c = clock_arrivals.select(F.col("v").alias("clk_v"), F.col("rf").alias("clk_rf"), F.col("clk").alias("cclk"), F.col("a_max").alias("c_max"), F.col("a_min").alias("c_min"))
    into, out_of = (F.when(F.col("active") == 1, a).otherwise(b) for a, b in (("rise", "fall"), ("fall", "rise")))
    e = enables.withColumn("_k", F.explode(F.array(
        F.struct(F.lit("gate_setup").alias("kind"), into.alias("clk_rf")), F.struct(F.lit("gate_hold").alias("kind"), out_of.alias("clk_rf")))))
    e = e.select("inst", "clk_v", "en_v", "_k.*").join(c.hint("merge"), ["clk_v", "clk_rf"]).join(d.hint("merge"), "en_v")
    if excluded is not None:
        e = e.join(sized(excluded.select("lclk", "cclk").distinct()), ["lclk", "cclk"], "left_anti")
    e = e.join(sized(capture), ["lclk", "cclk", "clk_rf", "kind"])
    found = []
    for i, scope in enumerate(MARGIN_ORDER if margins is not None else ()):
        m = margins.filter(F.col("scope") == (scope or "global")).groupBy(*(["key"] if scope else []), "kind").agg(
            *[F.max(F.when(cond, F.col("margin"))).alias(n) for n, cond in (("_r", F.col("rf") == "rise"), ("_f", F.col("rf") == "fall"), ("_b", F.col("rf").isNull()))])
        m = m.withColumnsRenamed({"key": f"_key{i}", "kind": "_kind"})
        m = sized(m) if scope else F.broadcast(m)  # without a scope one row for each of the two kinds
        on = F.col("kind") == F.col("_kind")
        if scope:
            on = on & (F.col(scope).cast("string") == F.col(f"_key{i}"))
        e = e.join(m, on, "left").withColumn(f"_m{i}", F.coalesce(F.when(F.col("rf") == "rise", F.col("_r")).otherwise(F.col("_f")), F.col("_b"))).drop("_r", "_f", "_b", "_kind", f"_key{i}")
        found.append(f"_m{i}")
    margin = F.coalesce(*found, F.lit(0))
    setup = F.col("kind") == "gate_setup"
    req = F.when(setup, F.col("capture") + F.col("c_min") - margin).otherwise(F.col("capture") + F.col("c_max") + margin)
    e = e.withColumn("required", req).withColumn("slack", F.when(setup, F.col("required") - F.col("a_max")).otherwise(F.col("a_min") - F.col("required")))
    return e.select("inst", "en_v", "clk_v", "rf", "lclk", "cclk", "kind", "clk_rf", "required", "slack")
