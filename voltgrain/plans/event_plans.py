"""Event-log queries: clean-up, statistics, running state, glitches, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic
from ..operators import events as ev
from ..operators.ordered import equal_event_slices
from . import bindings as b
from .registry import query

T6, HOUR = b.T6, b.HOUR


@query("a3_dedup_initial_x", f"WITH {b.CH} SELECT sig_id, t, pv, v FROM ch")
def a3(spark, d):
    return b.changes(spark, d).select("sig_id", "t", "pv", "v")


BUS = """bus AS (SELECT event_id AS sig_id, user_id % 8 + 1 AS width, epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01') AS t,
  CASE WHEN event_type='error' AND event_id%4=0 THEN 'x' ELSE ltrim(format('{:b}', event_id % 256), '') END AS raw FROM events)"""


@query("a4_bus_split", """
WITH b AS (SELECT event_id AS sig_id, CAST(user_id % 8 + 8 AS INT) AS width, epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01') AS t,
  event_id % 256 AS val, event_type='error' AS bad, user_id % 2 = 0 AS down FROM events)
SELECT sig_id, CAST(i AS INT) AS bit, CAST(CASE WHEN down THEN i ELSE width - 1 - i END AS INT) AS pin_index, t,
  CAST(CASE WHEN bad THEN 0 ELSE (val >> i) & 1 END AS INT) AS v
FROM (SELECT *, unnest(range(0, width)) AS i FROM b)""")
def a4(spark, d):
    e = b.table(spark, d, "events").withColumn("width", (F.col("user_id") % 8 + 8).cast("int"))
    down = F.col("user_id") % 2 == 0
    bus = e.select(
        F.col("event_id").alias("sig_id"), "width",
        F.when(down, F.col("width") - 1).otherwise(0).alias("msb"), F.when(down, 0).otherwise(F.col("width") - 1).alias("lsb"),
        F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01' as timestamp))").alias("t"),
        F.when(F.col("event_type") == "error", "x1").otherwise(F.bin(F.col("event_id") % 256)).alias("bits"))
    return ev.split_bus(bus)


@query("a10_signal_values", f"WITH {b.CH} SELECT sig_id, t, v, row_number() OVER (PARTITION BY sig_id ORDER BY t) - 1 AS pos FROM ch")
def a10(spark, d):
    from ..operators.ordered import ordered
    c = ordered(b.changes(spark, d), ["sig_id"], ["t"], "blk", sum_before={"pos": F.lit(1).cast("bigint")})
    return c.select("sig_id", "t", "v", "pos")


@query("a11_min_time_step", f"WITH {b.EV0}, u AS (SELECT DISTINCT t FROM ev0) SELECT min(g) AS min_step FROM (SELECT t - lag(t) OVER (ORDER BY t) AS g FROM u)")
def a11(spark, d):
    return ev.min_time_step(b.raw_events(spark, d), b.block_ticks(spark, d, ()))


ACT = b.CH + """,
nx AS (SELECT *, lead(t) OVER (PARTITION BY sig_id ORDER BY t) AS nt FROM ch),
act AS (SELECT sig_id, gate, pin_idx,
  CAST(sum(CASE WHEN pv IS NULL THEN 0 WHEN pv>=2 OR v>=2 THEN 1 ELSE 2 END) AS BIGINT) AS transitions2,
  CAST(sum(CASE WHEN v=1 THEN coalesce(nt,(SELECT time_max FROM tmax)) - t ELSE 0 END) AS BIGINT) AS high_ticks, count(pv) AS n_event
  FROM nx GROUP BY sig_id, gate, pin_idx)"""


@query("d1_transition_count", f"WITH {ACT} SELECT sig_id, transitions2 / 2e0 AS transitions FROM act")
def d1(spark, d):
    return _act(spark, d).select("sig_id", (F.col("transitions2") / 2.0).alias("transitions"))


@query("d2_duty", f"WITH {ACT} SELECT sig_id, CAST(high_ticks AS DOUBLE) / (SELECT time_max FROM tmax) AS duty FROM act")
def d2(spark, d):
    return _act(spark, d).select("sig_id", (F.col("high_ticks") / _tm(spark, d)).alias("duty"))


@query("d3_activity_per_cycle", f"""WITH {ACT} SELECT sig_id,
  round((transitions2 / 2e0) / ((SELECT time_max FROM tmax) / {T6}e0), 9) AS activity FROM act""")
def d3(spark, d):
    return _act(spark, d).select("sig_id", F.round((F.col("transitions2") / 2.0) / (_tm(spark, d) / float(T6)), 9).alias("activity"))


def _tm(spark, d):
    return b.time_max(spark, d).scalar()


def _act(spark, d):
    return ev.activity(b.changes(spark, d), _tm(spark, d), b.block_ticks(spark, d))


LO, HI = 100 * HOUR, 400 * HOUR


@query("d4_event_count", f"""WITH {b.CH} SELECT sig_id, count(pv) AS n_event,
  count(CASE WHEN pv IS NOT NULL AND t >= {LO} AND t < {HI} THEN 1 END) AS n_event_range FROM ch GROUP BY sig_id""")
def d4(spark, d):
    inside = F.col("pv").isNotNull() & (F.col("t") >= LO) & (F.col("t") < HI)
    return b.changes(spark, d).groupBy("sig_id").agg(
        F.count("pv").alias("n_event"), F.count_if(inside).alias("n_event_range"))


# Clock signals (gate % 5 = 2) and signals that match no pin (sig_id % 11 = 0) are left out and counted.
@query("d5_activity_factor", f"""WITH {b.CH}, s AS (SELECT sig_id, t // {24*T6} AS slice, pv, gate % 5 = 2 AS is_clk, sig_id % 11 = 0 AS unmatched FROM ch),
 k AS (SELECT count(DISTINCT sig_id) FILTER (NOT is_clk AND NOT unmatched) AS n_signal,
       count(DISTINCT sig_id) FILTER (is_clk) AS n_clock, count(DISTINCT sig_id) FILTER (NOT is_clk AND unmatched) AS n_unmatched FROM s)
 SELECT slice, count(CASE WHEN NOT is_clk AND NOT unmatched THEN pv END) AS n_event, min(n_signal) AS n_signal, min(n_clock) AS n_clock,
   min(n_unmatched) AS n_unmatched,
   round(count(CASE WHEN NOT is_clk AND NOT unmatched THEN pv END) / (min(n_signal) * 24e0), 9) AS activity_factor
 FROM s, k GROUP BY slice""")
def d5(spark, d):
    c = b.changes(spark, d).withColumns({"is_clk": F.col("gate") % 5 == 2, "unmatched": F.col("sig_id") % 11 == 0})
    used = ~F.col("is_clk") & ~F.col("unmatched")
    sig = c.groupBy("sig_id").agg(F.first("is_clk").alias("is_clk"), F.first("unmatched").alias("unmatched"))
    k = sig.agg(F.count_if(used).alias("n_signal"), F.count_if("is_clk").alias("n_clock"),
                F.count_if(~F.col("is_clk") & F.col("unmatched")).alias("n_unmatched"))
    per = c.groupBy(F.expr(f"t div {24*T6}").alias("slice")).agg(F.count(F.when(used, F.col("pv"))).alias("n_event"))
    for n in ("n_signal", "n_clock", "n_unmatched"):
        per = per.withColumn(n, k.select(n).scalar())
    return per.withColumn("activity_factor", F.round(F.col("n_event") / (F.col("n_signal") * 24.0), 9))


@query("d6_value_counts", f"""WITH {b.CH} SELECT sig_id, count(*) FILTER (v=1 AND pv IS NOT NULL) AS n_rise, count(*) FILTER (v=0 AND pv IS NOT NULL) AS n_fall,
  count(*) FILTER (v=2) AS n_x, count(*) FILTER (v=2 AND t>0) AS n_non_initial_x FROM ch GROUP BY sig_id""")
def d6(spark, d):
    return ev.value_counts(b.changes(spark, d))


# Pins using a signal: 1 + sig_id % 4 of them.
@query("d7_workload_activity", f"""WITH {b.CH}, u AS (SELECT t // {24*T6} AS slice, 1 + sig_id % 4 AS n_pin, gate % 5 = 2 AS is_clk, pv FROM ch)
  SELECT slice, CAST(sum(CASE WHEN pv IS NULL THEN 0 ELSE n_pin END) AS BIGINT) AS pin_events,
   CAST(sum(CASE WHEN pv IS NULL OR is_clk THEN 0 ELSE n_pin END) AS BIGINT) AS pin_events_no_clock FROM u GROUP BY slice""")
def d7(spark, d):
    c = b.changes(spark, d)
    uses = c.select("sig_id", "gate").distinct().select("sig_id", (1 + F.col("sig_id") % 4).alias("n_pin"), (F.col("gate") % 5 == 2).alias("is_clk"))
    n = c.groupBy("sig_id", F.expr(f"t div {24*T6}").alias("slice")).agg(F.count("pv").alias("n_event"))
    w = F.col("n_event") * F.col("n_pin")
    return n.join(uses, "sig_id").groupBy("slice").agg(
        F.sum(w).alias("pin_events"), F.sum(F.when(F.col("is_clk"), 0).otherwise(w)).alias("pin_events_no_clock"))


@query("e1_cycle_index", f"WITH {b.EV0} SELECT seq, t // {T6} AS cycle FROM ev0")
def e1(spark, d):
    return b.raw_events(spark, d).select("seq", F.expr(f"t div {T6}").alias("cycle"))


ST = b.CH + """,
tick AS (SELECT gate, t, sum(((CASE WHEN v=1 THEN 1 ELSE 0 END) - (CASE WHEN pv=1 THEN 1 ELSE 0 END)) << pin_idx) AS delta FROM ch GROUP BY gate, t),
st AS (SELECT gate, t, CAST(sum(delta) OVER w AS INT) AS state_after, CAST(sum(delta) OVER w - delta AS INT) AS state_before,
       lead(t) OVER (PARTITION BY gate ORDER BY t) AS next_t FROM tick WINDOW w AS (PARTITION BY gate ORDER BY t))"""


@query("e2_state_index", "WITH " + ST.replace("<< pin_idx", "* (CASE pin_idx WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)") + " SELECT gate, t, state_before, state_after FROM st")
def e2(spark, d):
    return ev.gate_ticks(b.changes(spark, d)).select("gate", "t", "state_before", "state_after")


ST = ST.replace("<< pin_idx", "* (CASE pin_idx WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)")


@query("e3_prev_next", f"WITH {b.CH} SELECT sig_id, t, v, pv AS prev_v, lead(t) OVER (PARTITION BY sig_id ORDER BY t) AS next_t FROM ch")
def e3(spark, d):
    from ..operators.ordered import ordered
    c = ordered(b.changes(spark, d), ["sig_id"], ["t"], "blk", lead={"next_t": F.col("t")})
    return c.select("sig_id", "t", "v", F.col("pv").alias("prev_v"), "next_t")


GL = b.CH + f""",
gl0 AS (SELECT *, t // {T6} AS cycle, row_number() OVER (PARTITION BY sig_id, t // {T6}, pv IS NULL ORDER BY t) AS rn,
        count(*) OVER (PARTITION BY sig_id, t // {T6}, pv IS NULL) AS n FROM ch),
gl1 AS (SELECT *, pv IS NOT NULL AND n >= 2 AND rn <= n - n % 2 AND gate % 5 <> 2 AS glitch FROM gl0),
gl AS (SELECT *, CASE WHEN glitch THEN greatest(CASE WHEN lag(glitch) OVER w THEN t - lag(t) OVER w END,
        CASE WHEN lead(glitch) OVER w THEN lead(t) OVER w - t END) END AS pulse
       FROM gl1 WINDOW w AS (PARTITION BY sig_id ORDER BY t))"""


def glitches(spark, d):
    c = b.changes(spark, d).withColumn("is_clock", F.col("gate") % 5 == 2)
    return ev.glitch_width(ev.glitch_flags(c, T6))


@query("e4_glitch_flag", f"WITH {GL} SELECT sig_id, t, cycle, glitch FROM gl")
def e4(spark, d):
    c = b.changes(spark, d).withColumn("is_clock", F.col("gate") % 5 == 2)
    return ev.glitch_flags(c, T6).select("sig_id", "t", "cycle", "glitch")


@query("e5_glitch_width", f"WITH {GL} SELECT sig_id, t, pulse FROM gl WHERE glitch")
def e5(spark, d):
    return glitches(spark, d).filter("glitch").select("sig_id", "t", "pulse")


SLEW_TICKS = 60.0 * HOUR  # ticks per unit of slew, so that pulses and slews compare

RATIO = f"""CASE WHEN pulse IS NULL THEN NULL WHEN slew_rise+slew_fall = 0 THEN 1e0
  ELSE least(1e0, (2e0*pulse/((slew_rise+slew_fall)*{SLEW_TICKS:.0f}e0)) * (2e0*pulse/((slew_rise+slew_fall)*{SLEW_TICKS:.0f}e0))) END"""


@query("e6_glitch_ratio", f"WITH {GL} SELECT sig_id, t, round({RATIO}, 9) AS ratio FROM (SELECT *, {b.ENV} FROM gl)")
def e6(spark, d):
    g = b.pin_env(glitches(spark, d))
    r = ev.glitch_ratio(F.col("pulse"), (F.col("slew_rise") + F.col("slew_fall")) * SLEW_TICKS)
    return g.select("sig_id", "t", F.round(r, 9).alias("ratio"))


@query("e7_resample", f"""WITH {b.CH}, g AS (SELECT s.sig_id, i * {24*HOUR} AS t FROM (SELECT DISTINCT sig_id FROM ch) s,
  (SELECT unnest(range(0, (SELECT time_max // {24*HOUR} + 1 FROM tmax))) AS i))
  SELECT g.sig_id, g.t, ch.v AS value FROM g ASOF JOIN ch ON g.sig_id = ch.sig_id AND g.t >= ch.t""")
def e7(spark, d):
    return ev.resample(b.changes(spark, d), 24 * HOUR, _tm(spark, d), ["sig_id"], b.block_ticks(spark, d))


@query("e8_equal_event_slices", f"""WITH {b.CH}, c AS (SELECT t // {T6} AS cycle, count(pv) AS n FROM ch GROUP BY t // {T6})
  SELECT cycle, n, CAST(cum AS BIGINT) AS cum_before, CAST(cum // 500 AS BIGINT) AS slice_id
  FROM (SELECT cycle, n, coalesce(sum(n) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM c)""")
def e8(spark, d):
    n = b.changes(spark, d).groupBy(F.expr(f"t div {T6}").alias("cycle")).agg(F.count("pv").alias("n"))
    return equal_event_slices(n, "cycle", "n", 500, 16)


@query("e9_event_density", f"WITH {b.CH} SELECT sig_id, t // {T6} AS cycle, count(*) AS n_event FROM ch WHERE pv IS NOT NULL GROUP BY sig_id, t // {T6}")
def e9(spark, d):
    return ev.events_per_cycle(b.changes(spark, d), T6)


@query("f6_signals_by_number", f"WITH {b.EV0} SELECT sig_id, count(*) AS n, min(t) AS first_t FROM ev0 GROUP BY sig_id ORDER BY sig_id")
def f6(spark, d):
    s = b.raw_events(spark, d).groupBy(F.col("sig_id").cast("string").alias("id")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"))
    return s.select(F.col("id").cast("bigint").alias("sig_id"), "n", "first_t").orderBy("sig_id")


@query("k1_n_rise", f"WITH {b.CH} SELECT sig_id, t, CASE WHEN pv=0 AND v=1 THEN 1e0 WHEN (pv=0 AND v=2) OR (pv=2 AND v=1) THEN 5e-1 ELSE 0e0 END AS n_rise FROM ch WHERE pv IS NOT NULL")
def k1(spark, d):
    c = b.changes(spark, d).filter("pv is not null")
    return c.select("sig_id", "t", logic.n_rise(F.col("pv"), F.col("v")).alias("n_rise"))


@query("k2_n_toggle", f"""WITH {b.CH} SELECT sig_id, t, CASE WHEN pv=2 OR v=2 THEN 5e-1 ELSE 1e0 END AS n_toggle,
  CASE WHEN pv IN (2,3) OR v IN (2,3) THEN 5e-1 ELSE 1e0 END AS n_transition FROM ch WHERE pv IS NOT NULL""")
def k2(spark, d):
    c = b.changes(spark, d).filter("pv is not null")
    return c.select("sig_id", "t", logic.n_toggle(F.col("pv"), F.col("v")).alias("n_toggle"),
                    logic.n_transition(F.col("pv"), F.col("v")).alias("n_transition"))


@query("k3_edge", f"WITH {b.CH} SELECT sig_id, t, CASE WHEN (pv=0 AND v IN (1,2)) OR (pv=2 AND v=1) THEN 'rise' ELSE 'fall' END AS rf FROM ch WHERE pv IS NOT NULL")
def k3(spark, d):
    return b.changes(spark, d).filter("pv is not null").select("sig_id", "t", logic.edge(F.col("pv"), F.col("v")).alias("rf"))


@query("k4_state_label", f"""WITH {ST} SELECT gate, t, concat(CASE WHEN state_after % 2 = 1 THEN 'A' ELSE '!A' END, ' ',
  CASE WHEN state_after // 2 % 2 = 1 THEN 'B' ELSE '!B' END, ' ', CASE WHEN state_after // 4 = 1 THEN 'Y' ELSE '!Y' END) AS label FROM st""")
def k4(spark, d):
    s = ev.gate_ticks(b.changes(spark, d))
    bits = [logic.state_label(F.shiftright("state_after", k).bitwiseAND(F.lit(1)), F.lit(p)) for k, p in enumerate("ABY")]
    return s.select("gate", "t", F.concat_ws(" ", *bits).alias("label"))


# ---- causes
ASOF = b.CH + """,
outs AS (SELECT * FROM ch WHERE pin_idx = 2 AND pv IS NOT NULL),
ins AS (SELECT gate, pin_idx, t, coalesce(pv, v) AS pv, v FROM ch WHERE pin_idx < 2),
ao AS (SELECT o.gate, o.sig_id, o.t, o.pv, o.v, i.pin_idx AS k, i.t AS ti, i.pv AS ipv, i.v AS iv
  FROM (SELECT o.*, p.k FROM outs o, (VALUES (0),(1)) AS p(k)) o ASOF JOIN ins i ON o.gate = i.gate AND o.k = i.pin_idx AND o.t > i.t)"""


@query("c4_asof_inputs", f"""WITH {ASOF} SELECT o.sig_id, o.t, a.ti AS in0_t, a.iv AS in0_v, b.ti AS in1_t, b.iv AS in1_v FROM outs o
  LEFT JOIN (SELECT * FROM ao WHERE k=0) a ON a.sig_id=o.sig_id AND a.t=o.t LEFT JOIN (SELECT * FROM ao WHERE k=1) b ON b.sig_id=o.sig_id AND b.t=o.t""")
def c4(spark, d):
    o = ev.asof_inputs(b.changes(spark, d), 2).filter("pv is not null")
    return o.select("sig_id", "t", F.col("in0.t").alias("in0_t"), F.col("in0.v").alias("in0_v"),
                    F.col("in1.t").alias("in1_t"), F.col("in1.v").alias("in1_v"))
