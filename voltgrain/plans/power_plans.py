"""Time-based power queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lut
from ..operators import events as ev
from ..operators import power as pw
from . import bindings as b
from .event_plans import ASOF, GL, RATIO, SLEW_TICKS, ST, _tm, glitches
from .registry import query

T6, HOUR = b.T6, b.HOUR
DAY = 24 * HOUR

# ---------------------------------------------------------------- state tables
EXPL = f"""{b.LEAK}, {b.DEFLEAK},
expl AS (SELECT d.cell_name, CAST(s.state AS INT) AS state, coalesce(arg_max(l.power, l.ord), any_value(d.dpower)) * 1e0 AS power
  FROM defleak d CROSS JOIN (SELECT unnest(range(0,8)) AS state) s LEFT JOIN leak l ON l.cell_name = d.cell_name AND (s.state & l.care) = l.val
  GROUP BY d.cell_name, s.state)"""


def leak_table(spark):
    cells = b.default_leakage(spark).withColumn("n_pin", F.lit(b.N_PIN))
    return pw.expand_leakage(b.leakage_rows(spark), cells)


LK = f"""{ST}, {b.GATES}, {EXPL},
hold AS (SELECT gate, t AS t0, coalesce(next_t, (SELECT time_max FROM tmax)) AS t1, state_after AS state FROM st),
lk AS (SELECT h.*, g.cell_name, g.class, coalesce(e.power, 0e0) AS power FROM hold h JOIN gates g USING (gate)
       LEFT JOIN expl e ON e.cell_name = g.cell_name AND e.state = h.state)"""


def leak_intervals(spark, d, ticks=None):
    ticks = ticks if ticks is not None else ev.gate_ticks(b.changes(spark, d))
    holds = pw.hold_intervals(ticks, _tm(spark, d))
    return pw.leakage_intervals(holds, b.gates(spark, d).select("gate", "cell_name"), leak_table(spark))


# Gates are cells c0..c3, so each gate meets the 8 rows of its cell's table.
@query("k14_expand_dont_care", f"WITH {b.GATES}, {EXPL} SELECT g.gate, e.state, e.power FROM gates g JOIN expl e USING (cell_name)")
def k14(spark, d):
    return b.gates(spark, d).join(F.broadcast(leak_table(spark)), "cell_name").select("gate", "state", "power")


@query("c6_state_lookup", f"WITH {LK} SELECT gate, t0, state, power FROM lk")
def c6(spark, d):
    return leak_intervals(spark, d).select("gate", "t0", "state", "power")


@query("c8_interval_overlap", f"""WITH {LK} SELECT gate, t0, c AS cycle, least(t1, (c+1)*{DAY}) - greatest(t0, c*{DAY}) AS overlap
  FROM (SELECT gate, t0, t1, unnest(range(t0 // {DAY}, (t1-1) // {DAY} + 1)) AS c FROM lk WHERE t1 > t0)""")
def c8(spark, d):
    iv = pw.overlap_cycles(leak_intervals(spark, d), DAY)
    return iv.select("gate", "t0", "cycle", "overlap")


@query("l1_leakage", f"WITH {LK} SELECT gate, round(sum(power*(t1-t0)) / (SELECT time_max FROM tmax), 6) AS leakage FROM lk GROUP BY gate")
def l1(spark, d):
    tm = _tm(spark, d)
    return pw.leakage_per_gate(leak_intervals(spark, d), tm).select("gate", F.round("leakage", 6).alias("leakage"))


LC = f"""lc AS (SELECT c AS cycle, sum(power * (least(t1, (c+1)*{T6}) - greatest(t0, c*{T6}))) / {T6}e0 AS leakage
  FROM (SELECT power, t0, t1, unnest(range(t0 // {T6}, (t1-1) // {T6} + 1)) AS c FROM lk WHERE t1 > t0) GROUP BY c)"""


@query("l2_leakage_per_cycle", f"WITH {LK}, {LC} SELECT cycle, round(leakage, 5) AS leakage FROM lc")
def l2(spark, d):
    lc = pw.leakage_per_cycle(leak_intervals(spark, d), T6, 16)
    # The tail's last cycle only carries the step that ends the running level.
    return lc.join(_in_trace(spark, d), "cycle", "left_semi").select("cycle", F.round("leakage", 5).alias("leakage"))


def _in_trace(spark, d):
    return b.time_max(spark, d).select(F.explode(F.expr(f"sequence(0L, (time_max - 1) div {T6})")).alias("cycle"))


# ---------------------------------------------------------------- dynamic energy
EXPI = f"""{b.INTP}, {b.ARCS},
expi AS (SELECT cell_name, pin_idx, rel_idx, rf, CAST(s.state AS INT) AS state, arg_min(base, ord) AS base
  FROM intp CROSS JOIN (SELECT unnest(range(0,8)) AS state) s WHERE (s.state & care) = val GROUP BY ALL)"""

CAUSE = f"""{EXPI},
dif AS (SELECT a.sig_id, a.t, a.k, abs(a.t - r.delay - a.ti) AS diff, r.from_rf
  FROM (SELECT ao.*, 'c' || CAST(gate % 4 AS VARCHAR) AS cell_name,
        CASE WHEN (ipv=0 AND iv IN (1,2)) OR (ipv=2 AND iv=1) THEN 'rise' ELSE 'fall' END AS frf,
        CASE WHEN (pv=0 AND v IN (1,2)) OR (pv=2 AND v=1) THEN 'rise' ELSE 'fall' END AS trf FROM ao) a
  JOIN arcs r ON r.cell_name=a.cell_name AND r.pin_idx=a.k AND r.from_rf=a.frf AND r.to_rf=a.trf
  WHERE a.ti // {T6} = a.t // {T6}),
cause AS (SELECT sig_id, t, arg_min(k, diff * 2 + k) AS rel, arg_min(from_rf, diff * 2 + k) AS from_rf, min(diff) AS diff FROM dif GROUP BY sig_id, t)"""


@query("c5_nearest_cause", f"WITH {ASOF}, {CAUSE} SELECT o.sig_id, o.t, CAST(c.rel AS INT) AS rel_idx, c.from_rf, c.diff FROM outs o LEFT JOIN cause c USING (sig_id, t)")
def c5(spark, d):
    o = ev.asof_inputs(b.changes(spark, d), 2).filter("pv is not null")
    o = b.gate_attributes(o.select("gate").distinct()).select("gate", "cell_name").join(o, "gate")
    c = pw.nearest_cause(o, b.arc_rows(spark), 2, T6, _tm(spark, d))
    return c.select("sig_id", "t", F.col("cause.rel_idx").alias("rel_idx"), F.col("cause.from_rf").alias("from_rf"),
                    F.col("cause.diff").alias("diff"))


DYN_CTES = (
    GL + "," + ST[len(b.CH) + 1:] + "," + ASOF[len(b.CH) + 1:] + f", {b.GATES}, {CAUSE}" + f""",
full_ev AS (SELECT x.*, s.state_before AS state, 'c' || CAST(x.gate % 4 AS VARCHAR) AS cell_name, {RATIO} AS ratio,
   CASE WHEN (pv=0 AND v IN (1,2)) OR (pv=2 AND v=1) THEN 'rise' ELSE 'fall' END AS rf
   FROM (SELECT *, {b.ENV} FROM gl WHERE pv IS NOT NULL) x JOIN st s ON s.gate=x.gate AND s.t=x.t),
einp AS (SELECT f.*, -1 AS rel_idx, CASE WHEN rf='rise' THEN slew_rise ELSE slew_fall END AS slew, 0e0 AS cap FROM full_ev f WHERE pin_idx < 2),
eout0 AS (SELECT f.*, c.rel, c.from_rf FROM full_ev f LEFT JOIN cause c USING (sig_id, t) WHERE pin_idx = 2),
eout AS (SELECT * EXCLUDE (rel, from_rf), CAST(rel AS INT) AS rel_idx,
   CASE WHEN from_rf='rise' THEN 4e-2 + ((gate*7+rel) % 13) / 50e0 ELSE 5e-2 + ((gate*3+rel) % 11) / 40e0 END AS slew, load_cap AS cap FROM eout0),
eall AS (SELECT * FROM einp UNION ALL BY NAME SELECT * FROM eout),
defe AS (SELECT g.gate, i.rf, avg({b.lut_sql('sl.slew', 'g.cap', 'i.base')}) AS de FROM (SELECT gate, cell_name, (5e-1 + ((gate*5+2) % 9) / 2e0) AS cap FROM gates) g
   JOIN (SELECT gate, p AS rel, unnest([4e-2 + ((gate*7+p) % 13) / 50e0, 5e-2 + ((gate*3+p) % 11) / 40e0]) AS slew
         FROM gates, (VALUES (0),(1)) AS pp(p)) sl ON sl.gate = g.gate
   JOIN intp i ON i.cell_name=g.cell_name AND i.pin_idx=2 AND i.rel_idx=sl.rel GROUP BY g.gate, i.rf),
eng AS (SELECT e.*, t // {T6} AS cycle,
   (CASE WHEN e.pin_idx = 2 AND e.rel_idx IS NULL THEN coalesce(de.de, 0e0) WHEN x.base IS NULL THEN 0e0 ELSE {b.lut_sql('e.slew', 'e.cap', 'x.base')} END)
     * (CASE WHEN pv=2 OR v=2 THEN 5e-1 ELSE 1e0 END) AS internal,
   CASE WHEN e.pin_idx = 2 THEN (CASE WHEN pv=0 AND v=1 THEN 1e0 WHEN (pv=0 AND v=2) OR (pv=2 AND v=1) THEN 5e-1 ELSE 0e0 END) * load_cap * volt * volt ELSE 0e0 END AS switching
   FROM eall e LEFT JOIN expi x ON x.cell_name=e.cell_name AND x.pin_idx=e.pin_idx AND x.rel_idx=e.rel_idx AND x.rf=e.rf AND x.state=e.state
   LEFT JOIN defe de ON de.gate=e.gate AND de.rf=e.rf),
sp AS (SELECT * EXCLUDE (internal, switching), internal AS e_int, switching AS e_sw,
   CASE WHEN ratio > 0 THEN 0e0 ELSE internal END AS internal, CASE WHEN ratio > 0 THEN ratio*internal ELSE 0e0 END AS glitch_internal,
   CASE WHEN ratio > 0 THEN 0e0 ELSE switching END AS switching, CASE WHEN ratio > 0 THEN ratio*switching ELSE 0e0 END AS glitch_switching FROM eng)""")


def energies(spark, d):
    """Energy of every change; the cleaned log is written once and read by all branches."""
    from ..session import cut
    tm = _tm(spark, d)
    ch = cut(b.changes(spark, d))
    flagged = ev.glitch_width(ev.glitch_flags(ch.withColumn("is_clock", F.col("gate") % 5 == 2), T6))
    ticks = cut(ev.gate_ticks(ch))
    g = b.gates(spark, d)
    e = pw.energy_per_change(flagged, ticks, g, b.pin_env, b.int_power_rows(spark), b.arc_rows(spark), 2, b.N_PIN,
                             T6, tm, SLEW_TICKS)
    return e, ticks


DYN = "WITH " + DYN_CTES


@query("l3_switching_energy", DYN + " SELECT sig_id, t, round(e_sw, 9) AS switching FROM sp WHERE pin_idx=2")
def l3(spark, d):
    from ..functions.logic import n_rise
    c = b.pin_env(b.changes(spark, d).filter("pin_idx = 2 and pv is not null"))
    e = n_rise(F.col("pv"), F.col("v")) * F.col("load_cap") * F.col("volt") * F.col("volt")
    return c.select("sig_id", "t", F.round(e, 9).alias("switching"))


@query("l4_internal_input", DYN + " SELECT sig_id, t, state, round(e_int, 9) AS internal FROM sp WHERE pin_idx<2")
def l4(spark, d):
    e, _ = energies(spark, d)
    return e.filter("pin_idx < 2").select("sig_id", "t", "state", F.round("internal", 9).alias("internal"))


@query("l5_internal_output", DYN + " SELECT sig_id, t, state, rel_idx, round(e_int, 9) AS internal FROM sp WHERE pin_idx=2")
def l5(spark, d):
    e, _ = energies(spark, d)
    return e.filter("pin_idx = 2").select("sig_id", "t", "state", "rel_idx", F.round("internal", 9).alias("internal"))


@query("l6_default_output_energy", DYN + " SELECT gate, rf, round(de, 9) AS default_energy FROM defe")
def l6(spark, d):
    g = b.gates(spark, d).select("gate", "cell_name")
    pins = b.pin_env(g.withColumn("pin_idx", F.explode(F.array(*[F.lit(k) for k in range(3)]))))
    out = pw.default_output_energy(pins, b.int_power_rows(spark).filter("rel_idx >= 0"), 2)
    return out.select("gate", "rf", F.round("default_energy", 9).alias("default_energy"))


@query("l7_glitch_split", DYN + """ SELECT sig_id, t, round(internal,9) AS internal, round(glitch_internal,9) AS glitch_internal,
  round(switching,9) AS switching, round(glitch_switching,9) AS glitch_switching FROM sp""")
def l7(spark, d):
    e, _ = energies(spark, d)
    s = pw.split_glitch(e)
    return s.select("sig_id", "t", *[F.round(c, 9).alias(c) for c in ("internal", "glitch_internal", "switching", "glitch_switching")])


CELL = DYN + f""", {EXPL},
hold AS (SELECT gate, t AS t0, coalesce(next_t, (SELECT time_max FROM tmax)) AS t1, state_after AS state FROM st),
lk AS (SELECT h.*, g.cell_name, coalesce(e.power, 0e0) AS power FROM hold h JOIN gates g USING (gate) LEFT JOIN expl e ON e.cell_name=g.cell_name AND e.state=h.state),
lg AS (SELECT gate, sum(power*(t1-t0)) / (SELECT time_max FROM tmax) AS leakage FROM lk GROUP BY gate),
{LC},
sec AS (SELECT time_max / {T6}e0 AS s FROM tmax),
dg AS (SELECT gate, sum(internal)/(SELECT s FROM sec) AS internal, sum(glitch_internal)/(SELECT s FROM sec) AS glitch_internal,
   sum(switching)/(SELECT s FROM sec) AS switching, sum(glitch_switching)/(SELECT s FROM sec) AS glitch_switching FROM sp GROUP BY gate),
cp AS (SELECT lg.gate, g.class, g.cell_name, leakage, coalesce(internal,0e0) AS internal, coalesce(glitch_internal,0e0) AS glitch_internal, coalesce(switching,0e0) AS switching,
   coalesce(glitch_switching,0e0) AS glitch_switching FROM lg JOIN gates g USING (gate) LEFT JOIN dg ON dg.gate = lg.gate),
cpt AS (SELECT *, internal+glitch_internal AS reported_internal, switching+glitch_switching AS reported_switching,
   internal+glitch_internal+switching+glitch_switching+leakage AS total FROM cp)"""
COMPS = ["internal", "glitch_internal", "switching", "glitch_switching", "leakage"]


def cells(spark, d):
    tm = _tm(spark, d)
    e, ticks = energies(spark, d)
    leak = pw.leakage_per_gate(leak_intervals(spark, d, ticks), tm)
    return pw.cell_power(pw.split_glitch(e), leak, tm / float(T6))


@query("l8_cell_power", CELL + " SELECT gate, " + ", ".join(f"round({c},6) AS {c}" for c in COMPS + ["reported_internal", "reported_switching", "total"]) + " FROM cpt")
def l8(spark, d):
    return cells(spark, d).select("gate", *[F.round(c, 6).alias(c) for c in COMPS + ["reported_internal", "reported_switching", "total"]])


@query("d15_cycle_power", CELL + f""", cy AS (SELECT cycle, sum(internal+glitch_internal) AS internal, sum(glitch_internal) AS glitch_internal,
   sum(switching+glitch_switching) AS switching, sum(glitch_switching) AS glitch_switching FROM sp GROUP BY cycle)
 SELECT cycle, component, round(power, 5) AS power FROM (
   SELECT cycle, 'leakage' AS component, leakage AS power FROM lc UNION ALL SELECT cycle, 'internal', internal FROM cy
   UNION ALL SELECT cycle, 'glitch_internal', glitch_internal FROM cy UNION ALL SELECT cycle, 'switching', switching FROM cy
   UNION ALL SELECT cycle, 'glitch_switching', glitch_switching FROM cy)""")
def d15(spark, d):
    e, ticks = energies(spark, d)
    lc = pw.leakage_per_cycle(leak_intervals(spark, d, ticks), T6, 16).join(_in_trace(spark, d), "cycle", "left_semi")
    return pw.cycle_power(pw.split_glitch(e), lc, 1.0).select("cycle", "component", F.round("power", 5).alias("power"))


@query("d10_group_power_table", CELL + """, gr AS (SELECT coalesce(class,'total') AS class, sum(reported_internal) AS internal, sum(reported_switching) AS switching, sum(leakage) AS leakage
  FROM cpt GROUP BY ROLLUP (class)) SELECT class, round(internal,6) AS internal, round(switching,6) AS switching, round(leakage,6) AS leakage,
  round(internal+switching+leakage,6) AS total, round((internal+switching+leakage) / (SELECT internal+switching+leakage FROM gr WHERE class='total') * 100, 6) AS pct FROM gr""")
def d10(spark, d):
    g = b.gates(spark, d).withColumn("class", pw.power_class(F.col("is_macro"), F.col("is_pad"), F.col("is_clock"), F.col("has_seq")))
    c = cells(spark, d).drop("internal", "switching").withColumnsRenamed({"reported_internal": "internal", "reported_switching": "switching"})
    out = pw.group_table(c.join(g.select("gate", "class"), "gate"), ["internal", "switching", "leakage"])
    return out.select("class", *[F.round(x, 6).alias(x) for x in ("internal", "switching", "leakage", "total", "pct")])


@query("d11_column_percent", CELL + """, s AS (SELECT sum(reported_internal) AS i, sum(reported_switching) AS w, sum(leakage) AS l, sum(total) AS t FROM cpt)
  SELECT gate, round(CASE WHEN t=0 THEN 0 ELSE total/t*100 END,6) AS pct_total, round(CASE WHEN i=0 THEN 0 ELSE reported_internal/i*100 END,6) AS pct_internal,
  round(CASE WHEN w=0 THEN 0 ELSE reported_switching/w*100 END,6) AS pct_switching, round(CASE WHEN l=0 THEN 0 ELSE leakage/l*100 END,6) AS pct_leakage FROM cpt, s""")
def d11(spark, d):
    from ..session import cut
    c = cut(cells(spark, d))
    tot = c.agg(*[F.sum(x).alias(x) for x in ("total", "reported_internal", "reported_switching", "leakage")])
    names = {"total": "pct_total", "reported_internal": "pct_internal", "reported_switching": "pct_switching", "leakage": "pct_leakage"}

    def pct(x):
        whole = tot.select(x).scalar()
        return F.round(F.when((whole == 0) | F.isnan(whole), 0.0).otherwise(F.col(x) / whole * 100.0), 6).alias(names[x])
    return c.select("gate", *[pct(x) for x in names])


# Gate paths: top / g<gate % 7> / g<gate % 3> / g<gate>; every prefix gets the sum of what lies below.
@query("d12_hierarchy_rollup", CELL + """, p AS (SELECT total, ['top', 'a' || CAST(gate%7 AS VARCHAR), 'b' || CAST(gate%3 AS VARCHAR), 'g' || CAST(gate AS VARCHAR)] AS parts FROM cpt)
  SELECT array_to_string(parts[1:n], '/') AS path, round(sum(total),6) AS total, count(*) AS n_leaf FROM (SELECT *, unnest([1,2,3,4]) AS n FROM p) GROUP BY 1""")
def d12(spark, d):
    parts = F.array(F.lit("top"), F.concat(F.lit("a"), (F.col("gate") % 7).cast("string")),
                    F.concat(F.lit("b"), (F.col("gate") % 3).cast("string")), F.concat(F.lit("g"), F.col("gate").cast("string")))
    c = cells(spark, d).withColumn("parts", parts)
    out = rollup_paths(c, "parts", {"total": F.sum("total"), "n_leaf": F.count("*")})
    return out.select("path", F.round("total", 6).alias("total"), "n_leaf")


def rollup_paths(df, parts, aggs):
    n = df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts))))
    return n.groupBy(F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "/").alias("path")).agg(*[e.alias(k) for k, e in aggs.items()])


@query("d13_instance_power_list", CELL + " SELECT gate, round(total,6) AS total FROM cpt WHERE gate IN (SELECT gate FROM gates WHERE cell_name IN ('c1','c3')) ORDER BY total DESC, gate")
def d13(spark, d):
    wanted = b.gates(spark, d).filter(F.col("cell_name").isin("c1", "c3"))
    c = cells(spark, d).join(wanted, "gate", "left_semi")
    return c.orderBy(F.desc("total"), "gate").select("gate", F.round("total", 6).alias("total"))


# A gate whose supply is 0 and load is 0 would divide 0 by 0: here gates with gate % 17 = 3 do.
@query("d14_nan_instances", CELL + " SELECT min(gate) AS gate FROM cpt WHERE gate % 17 = 3")
def d14(spark, d):
    c = cells(spark, d).withColumn("total", F.when(F.col("gate") % 17 == 3, F.lit(float("nan"))).otherwise(F.col("total")))
    return c.filter(F.isnan("total")).agg(F.min("gate").alias("gate"))


@query("l9_initial_constants", f"""WITH {b.CH}, p AS (SELECT DISTINCT gate, k.k AS pin_idx FROM ch, (VALUES (0),(1),(2),(3)) AS k(k)),
  f AS (SELECT gate, pin_idx, arg_min(v, t) AS v FROM ch GROUP BY gate, pin_idx)
  SELECT p.gate, CAST(p.pin_idx AS INT) AS pin_idx, CAST(coalesce(f.v, CASE WHEN p.gate % 3 = 0 THEN 1 END, 2) AS INT) AS v FROM p LEFT JOIN f USING (gate, pin_idx)""")
def l9(spark, d):
    c = b.changes(spark, d)
    first = c.groupBy("gate", "pin_idx").agg(F.min_by("v", "t").alias("v0"))
    pins = first.select("gate").distinct().withColumn("pin_idx", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    case = F.when(F.col("gate") % 3 == 0, 1)
    return pins.join(first, ["gate", "pin_idx"], "left").select("gate", "pin_idx", F.coalesce("v0", case, F.lit(2)).alias("v"))


# Cell sizes from the parts: a part with p_size pins; small cells get a full state table.
@query("l10_wide_cell_leakage", f"""
  WITH n AS (SELECT p_partkey, 'c' || CAST(p_partkey % 4 AS VARCHAR) AS kind, CAST(3 + p_size % 16 AS INT) AS n_pin, (p_size % 16) * 1e0 AS dflt FROM part), {b.LEAK},
  m AS (SELECT cell_name, s, arg_max(power, ord) AS power FROM leak, (SELECT unnest(range(0,8)) AS s) WHERE (s & care) = val GROUP BY cell_name, s),
  k AS (SELECT cell_name, sum(power) AS sp, count(*) AS c FROM m GROUP BY cell_name)
  SELECT p_partkey, CAST(CASE WHEN n_pin > 16 THEN 1 ELSE (1 << n_pin) END AS BIGINT) AS n_state,
   CASE WHEN n_pin > 16 THEN dflt ELSE (sp * 1e0 + (8 - c) * dflt) * ((1 << n_pin) // 8) END AS power FROM n JOIN k ON k.cell_name = n.kind""")
def l10(spark, d):
    # Cells with the same rows and default share one expanded table.
    p = b.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("c"), (F.col("p_partkey") % 4).cast("string")).alias("kind"),
        (3 + F.col("p_size") % 16).alias("n_pin"), (F.col("p_size") % 16).cast("double").alias("dflt"))
    key = F.concat_ws("|", "kind", F.col("n_pin").cast("string"), F.col("dflt").cast("string"))
    p = p.withColumn("cell_name", key)
    cell = p.select("cell_name", "kind", "n_pin", F.col("dflt").alias("default_leakage")).distinct()
    rows = b.leakage_rows(spark).withColumnRenamed("cell_name", "kind").join(cell.select("cell_name", "kind"), "kind").drop("kind")
    ex = pw.expand_leakage(rows, cell.drop("kind")).groupBy("cell_name").agg(F.count("*").alias("n_state"), F.sum("power").alias("power"))
    return p.join(ex, "cell_name").select("p_partkey", "n_state", "power")


# Leakage and dynamic power computed in separate passes over one written state table.
@query("l16_separate_passes", CELL + " SELECT gate, 'dynamic' AS pass, round(internal+glitch_internal+switching+glitch_switching,6) AS power FROM cpt UNION ALL SELECT gate, 'leakage', round(leakage,6) FROM cpt")
def l16(spark, d):
    tm = _tm(spark, d)
    e, ticks = energies(spark, d)
    leak = pw.leakage_per_gate(leak_intervals(spark, d, ticks), tm)
    s = pw.split_glitch(e)
    dyn = s.groupBy("gate").agg((F.sum(F.col("internal") + F.col("glitch_internal") + F.col("switching") + F.col("glitch_switching")) / (tm / float(T6))).alias("p"))
    dyn = leak.select("gate").join(dyn, "gate", "left").select("gate", F.lit("dynamic").alias("pass"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("power"))
    return dyn.unionByName(leak.select("gate", F.lit("leakage").alias("pass"), F.round("leakage", 6).alias("power")))


@query("l17_lookup_slew", f"""WITH p AS (SELECT DISTINCT user_id // 3 AS gate, CAST(user_id % 3 AS INT) AS pin_idx, user_id AS sig_id FROM events),
  c AS (SELECT s_suppkey, s_nationkey, round(s_acctbal/10000,4) AS slew FROM supplier WHERE s_nationkey < 20),
  m AS (SELECT s_nationkey AS k, max(slew) AS clk_slew FROM c GROUP BY s_nationkey)
  SELECT sig_id, round(CASE WHEN sig_id % 5 = 0 THEN coalesce(m.clk_slew, 0e0) ELSE slew_rise END, 6) AS slew FROM (SELECT *, {b.ENV} FROM p) p LEFT JOIN m ON m.k = p.sig_id % 25""")
def l17(spark, d):
    e = b.table(spark, d, "events").select(F.expr("user_id div 3").alias("gate"), (F.col("user_id") % 3).cast("int").alias("pin_idx"), F.col("user_id").alias("sig_id")).distinct()
    clk = b.table(spark, d, "supplier").filter("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.max(F.round(F.col("s_acctbal") / 10000, 4)).alias("clk_slew"))
    p = b.pin_env(e).withColumn("k", (F.col("sig_id") % 25).cast("int")).join(clk, "k", "left")
    ideal = F.col("sig_id") % 5 == 0
    return p.select("sig_id", F.round(F.when(ideal, F.coalesce("clk_slew", F.lit(0.0))).otherwise(F.col("slew_rise")), 6).alias("slew"))


# ---------------------------------------------------------------- tables
@query("c7_first_match", f"""WITH {ST}, {b.GATES}, {EXPI}, g2 AS (SELECT gate, cell_name FROM gates)
  SELECT s.gate, s.t, x.pin_idx, x.base * 1e0 AS first_entry FROM st s JOIN g2 USING (gate) JOIN expi x ON x.cell_name=g2.cell_name AND x.state=s.state_before WHERE x.rel_idx=-1 AND x.rf='rise'""")
def c7(spark, d):
    st = ev.gate_ticks(b.changes(spark, d)).select("gate", "t", F.col("state_before").alias("state")).join(
        b.gates(spark, d).select("gate", "cell_name"), "gate")
    exp = pw.expand_internal(b.int_power_rows(spark).filter("rel_idx = -1 and rf = 'rise'"), b.N_PIN)
    return st.join(F.broadcast(exp), ["cell_name", "state"]).select("gate", "t", "pin_idx", F.col("tbl.vals")[0].alias("first_entry"))


@query("c9_axis_segment", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS INT) AS seg FROM lineitem")
def c9(spark, d):
    axis = F.array(*[F.lit(x) for x in (2.0, 5.0, 20.0, 40.0)])
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lut.segment(axis, F.col("l_quantity")).alias("seg"))


K5X, K5Y = "(l_quantity/200e0)", "(l_tax*60e0)"


@query("k5_lut_value", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity < 10 THEN 3 + (l_quantity-2)*(7-3)/8e0 ELSE 7+(l_quantity-10)*(20-7)/30e0 END, 6) AS v1,
  round(CASE WHEN l_quantity < 2 THEN 0 WHEN l_quantity >= 40 THEN 20 WHEN l_quantity < 10 THEN 3 + (l_quantity-2)*(7-3)/8e0 ELSE 7+(l_quantity-10)*(20-7)/30e0 END, 6) AS v1_clip,
  round({b.lut_sql(K5X, K5Y, '(1e0)')}, 6) AS v2, round({b.lut_sql(K5X, K5Y, '(1e0)')} + 100e0 * l_discount / 5e-2 , 6) AS v3 FROM lineitem""")
def k5(spark, d):
    li = b.table(spark, d, "lineitem")
    a1 = F.array(*[F.lit(x) for x in (2.0, 10.0, 40.0)])
    y1 = F.array(*[F.lit(x) for x in (3.0, 7.0, 20.0)])
    ax1, ax2 = F.array(*map(F.lit, b.AX1)), F.array(*map(F.lit, b.AX2))
    flat = [1.0 + 3 * i + 2 * j + i * j for i in range(3) for j in range(4)]
    vals = F.array(*map(F.lit, flat))
    axp, cube = F.array(F.lit(0.0), F.lit(0.05)), F.array(*map(F.lit, flat + [x + 100.0 for x in flat]))
    x, y = F.col("l_quantity") / 200.0, F.col("l_tax") * 60.0
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(lut.lut1(a1, y1, F.col("l_quantity")), 6).alias("v1"),
        F.round(lut.lut1_clip(a1, y1, F.col("l_quantity")), 6).alias("v1_clip"),
        F.round(lut.lut2(ax1, ax2, vals, x, y), 6).alias("v2"),
        F.round(lut.lut3(axp, ax1, ax2, cube, F.col("l_discount"), x, y), 6).alias("v3"))


@query("k6_axis_order", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({b.lut_sql(K5X, K5Y, '(1e0)')}, 6) AS energy FROM lineitem")
def k6(spark, d):
    """Even parts store the table load-first; the value must not depend on it."""
    li = b.table(spark, d, "lineitem")
    ax1, ax2 = F.array(*map(F.lit, b.AX1)), F.array(*map(F.lit, b.AX2))
    rows = [1.0 + 3 * i + 2 * j + i * j for i in range(3) for j in range(4)]
    cols = [1.0 + 3 * i + 2 * j + i * j for j in range(4) for i in range(3)]
    cap_first = F.col("l_partkey") % 2 == 0
    df = li.withColumns({
        "var1": F.when(cap_first, "total_output_net_capacitance").otherwise("input_transition_time"),
        "a1": F.when(cap_first, ax2).otherwise(ax1), "a2": F.when(cap_first, ax1).otherwise(ax2),
        "vals": F.when(cap_first, F.array(*map(F.lit, cols))).otherwise(F.array(*map(F.lit, rows)))})
    e = lut.lut2_by_name(F.col("var1"), F.col("a1"), F.col("a2"), F.col("vals"), F.col("l_quantity") / 200.0, F.col("l_tax") * 60.0)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(e, 6).alias("energy"))
