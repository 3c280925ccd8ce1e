"""Trace text, RC text, sinks, slices and streams over the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators.ordered import equal_event_slices
from ..schemas import _s
from ..session import checkpoint_dir, cut
from ..sources import rcnet, tables, trace
from ..streaming import cycle_power as cp, power_stream as st
from . import bindings as b
from .event_plans import SLEW_TICKS
from .power_plans import leak_table
from .registry import ORACLES, query

T6 = b.T6


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def body_lines(spark, d):
    """The event log as trace text: a time line, then one or two values per line."""
    e = b.raw_events(spark, d)
    ch = F.element_at(F.array(*map(F.lit, ["0", "1", "x", "z"])), F.col("v") + 1)
    sid = F.concat(F.lit("s"), F.col("sig_id").cast("string"))
    vec = F.col("seq") % 7 == 0
    two = F.col("seq") % 5 == 0
    val = F.when(vec, F.concat(F.lit("b10"), ch, F.lit(" "), sid)).when(two, F.concat(ch, sid, F.lit(" "), ch, sid, F.lit("_copy"))).otherwise(F.concat(ch, sid))
    lines = F.array(F.struct(F.lit(0).cast("bigint").alias("line"), F.concat(F.lit("#"), F.col("t").cast("string")).alias("text")),
                    F.struct((F.col("seq") + 1).alias("line"), val.alias("text")))
    return e.select("t", F.explode(lines).alias("x")).select(F.lit("trace").alias("trace"), F.expr(f"t div {b.block_ticks(spark, d, ())}").alias("blk"), F.col("t").alias("at"), "x.*")


@query("a1_trace_ingest", f"""WITH {b.EV0} SELECT t, 's' || CAST(sig_id AS VARCHAR) AS code, CASE WHEN seq % 7 = 0 THEN '10' ELSE '' END || ['0','1','x','z'][v+1] AS bits FROM ev0
  UNION ALL SELECT t, 's' || CAST(sig_id AS VARCHAR) || '_copy', ['0','1','x','z'][v+1] FROM ev0 WHERE seq % 5 = 0 AND seq % 7 <> 0""")
def a1(spark, d):
    return trace.parse_changes(body_lines(spark, d), ["at", "line"]).select("t", "code", "bits")


@query("a2_trace_header", """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS code, replace(r_name, ' ', '_') || '.' || n_name AS scope, c_name || '\\/q' AS name, CASE WHEN c_custkey % 3 = 0 THEN 'reg' ELSE 'wire' END AS type,
  CAST(1 + c_custkey % 8 AS INT) AS width, CAST(c_custkey % 8 AS INT) AS msb, 0 AS lsb FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey""")
def a2(spark, d):
    """Regions and nations are scopes, customers are variables."""
    n, r, c = (b.table(spark, d, t) for t in ("nation", "region", "customer"))
    L = lambda x: F.lit(x).cast("bigint")
    rk, nk = F.col("r_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint")
    end = L(10 ** 15)

    def row(df, nation, pos, text):
        return df.select(F.lit("h").alias("trace"), rk.alias("reg"), nation.alias("nat"), pos.alias("line"), text.alias("text"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cr = c.join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    var = F.concat(F.lit("$var "), F.when(k % 3 == 0, "reg").otherwise("wire"), F.lit(" "), (1 + k % 8).cast("string"), F.lit(" c"), k.cast("string"), F.lit(" "), F.col("c_name"), F.lit("/q"),
                   F.when(k % 8 > 0, F.concat(F.lit(" ["), (k % 8).cast("string"), F.lit(":0]"))).otherwise(F.lit("")), F.lit(" $end"))
    up = F.lit("$upscope $end")
    lines = (row(r, L(-1), L(0), F.concat(F.lit("$scope module "), F.regexp_replace("r_name", " ", "_"), F.lit(" $end")))
             .unionAll(row(nr, nk, L(0), F.concat(F.lit("$scope module "), "n_name", F.lit(" $end"))))
             .unionAll(row(cr, nk, k + 1, var)).unionAll(row(nr, nk, end, up)).unionAll(row(r, L(1000), end, up)))
    h = trace.parse_header(lines.withColumn("blk", F.col("reg")), ["reg", "nat", "line"])
    return h.select("code", F.array_join("scope", ".").alias("scope"), "name", "type", "width", "msb", "lsb")


# One net record per order: two pins, two ground capacitors, one coupling capacitor, two resistors.
@query("a5_rc_ingest", """SELECT 'cap' AS kind, 'net' || CAST(o_orderkey AS VARCHAR) AS net_id, 'net' || CAST(o_orderkey AS VARCHAR) || ':1' AS a, NULL AS b, (o_orderkey % 7) * 1e0 AS val FROM orders
  UNION ALL SELECT 'coupling', 'net' || CAST(o_orderkey AS VARCHAR), 'net' || CAST(o_orderkey AS VARCHAR) || ':1', 'net' || CAST(o_custkey AS VARCHAR) || ':9', 25e-2 FROM orders
  UNION ALL SELECT 'res', 'net' || CAST(o_orderkey AS VARCHAR), 'net' || CAST(o_orderkey AS VARCHAR) || ':' || CAST(i AS VARCHAR), 'net' || CAST(o_orderkey AS VARCHAR) || ':' || CAST(i+1 AS VARCHAR), i + 5e-1 FROM orders, (VALUES (1),(2)) AS v(i)
  UNION ALL SELECT 'conn', 'net' || CAST(o_orderkey AS VARCHAR), 'u' || CAST(o_custkey AS VARCHAR) || ':A', 'I', NULL FROM orders""")
def a5(spark, d):
    o = b.table(spark, d, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("*D_NET *"), k, F.lit(" 1.0\n*CONN\n*I u"), c, F.lit(":A I\n*CAP\n1 *"), k, F.lit(":1 "), (F.col("o_orderkey") % 7).cast("string"), F.lit("\n2 *"), k, F.lit(":1 *"), c,
                    F.lit(":9 0.25\n*RES\n1 *"), k, F.lit(":1 *"), k, F.lit(":2 1.5\n2 *"), k, F.lit(":2 *"), k, F.lit(":3 2.5\n"))
    rec = o.select(text.alias("text"))
    # The name map covers every order and customer number.
    ids = o.select(k.alias("i")).union(b.table(spark, d, "customer").select(F.col("c_custkey").cast("string"))).distinct()
    names = ids.select(F.concat(F.lit("*"), "i").alias("short"), F.concat(F.lit("net"), "i").alias("name"))
    none = F.lit(None).cast("string")
    parts = (rcnet.caps(rec).select(F.lit("cap").alias("kind"), "net_id", F.col("node").alias("a"), none.alias("b"), F.col("gnd_cap").alias("val"))
             .unionAll(rcnet.coupling(rec).select(F.lit("coupling"), "net_id", "n1", "n2_other", "farad"))
             .unionAll(rcnet.resistors(rec).select(F.lit("res"), "net_id", "n1", "n2", "ohm"))
             .unionAll(rcnet.connections(rec).select(F.lit("conn"), "net_id", "pin", "dir", F.lit(None).cast("double"))))
    for col in ("net_id", "a", "b"):
        parts = rcnet.expand_names(parts, col, names)
    return parts


@query("a6_declared_tables", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def a6(spark, d):
    from pyspark.sql import types as T
    return tables.load(spark, f"{d}/orders.parquet", schema=_s(o_orderkey=T.LongType(), o_orderstatus=T.StringType(), o_totalprice=T.DoubleType()))


@query("a7_cell_power_file", "SELECT CAST(l_suppkey AS VARCHAR) AS cell, CAST(sum(l_quantity) AS BIGINT) AS internal, count(*) AS switching, max(l_linenumber) AS leakage FROM lineitem GROUP BY l_suppkey")
def a7(spark, d):
    """Write the tab-separated file, then read it back."""
    p = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("cell")).agg(
        F.sum("l_quantity").cast("bigint").alias("internal"), F.count("*").alias("switching"), F.max("l_linenumber").alias("leakage"))
    path = scratch(spark)
    tables.write_cell_power(p, path)
    return tables.load(spark, path, schema=p.schema, fmt="csv", sep="\t", header=True)


@query("a8_cycle_power_wide", f"""WITH {b.EV0} SELECT t // {T6} AS cycle, sum(CASE WHEN v=1 THEN 1e0 ELSE 0 END) AS internal, 0e0 AS glitch_internal, sum(CASE WHEN v=0 THEN 1e0 ELSE 0 END) AS switching, 0e0 AS glitch_switching, sum(CASE WHEN v>1 THEN 1e0 ELSE 0 END) AS leakage FROM ev0 GROUP BY 1""")
def a8(spark, d):
    comp = F.when(F.col("v") == 1, "internal").when(F.col("v") == 0, "switching").otherwise("leakage")
    long = b.raw_events(spark, d).groupBy(F.expr(f"t div {T6}").alias("cycle"), comp.alias("component")).agg(F.count("*").cast("double").alias("power"))
    return tables.wide_cycles(long)


@query("a9_redirect_append", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT * FROM lineitem WHERE l_returnflag='A' UNION ALL SELECT * FROM lineitem WHERE l_returnflag<>'A') GROUP BY 1, 2")
def a9(spark, d):
    """A second report goes behind the first; an overwrite would have replaced it."""
    path = scratch(spark)
    g = b.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    tables.redirect(g.filter("l_returnflag <> 'N'"), path)
    tables.redirect(g.filter("l_returnflag = 'A'"), path)
    tables.redirect(g.filter("l_returnflag <> 'A'"), path, append=True)
    return tables.load(spark, path, schema=g.schema)


# ---------------------------------------------------------------- slices
@query("j1_event_budget_slices", f"WITH {b.EV0}, c AS (SELECT t // {T6} AS cycle, count(*) AS n FROM ev0 GROUP BY 1), s AS (SELECT cycle, n, coalesce(sum(n) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 700 AS sl FROM c) SELECT CAST(sl AS BIGINT) AS slice_id, min(cycle) * {T6} AS t0, (max(cycle) + 1) * {T6} AS t1, CAST(sum(n) AS BIGINT) AS n_event FROM s GROUP BY sl")
def j1(spark, d):
    n = b.raw_events(spark, d).groupBy(F.expr(f"t div {T6}").alias("cycle")).agg(F.count("*").alias("n"))
    s = equal_event_slices(n, "cycle", "n", 700, 16)
    return s.groupBy("slice_id").agg((F.min("cycle") * T6).alias("t0"), ((F.max("cycle") + 1) * T6).alias("t1"), F.sum("n").alias("n_event"))


@query("j2_align_to_cycle", f"WITH {b.EV0} SELECT seq, CAST(ceil(t / {T6}e0) AS BIGINT) * {T6} AS boundary FROM ev0")
def j2(spark, d):
    return b.raw_events(spark, d).select("seq", st.align_slice(F.col("t"), T6).alias("boundary"))


TOG = f"tog AS (SELECT t // {T6} AS cycle, CAST(sum(CASE WHEN pv=2 OR v=2 THEN 1 ELSE 2 END) AS BIGINT) AS toggles2, CAST(sum(CASE WHEN pv=0 AND v=1 THEN 2 WHEN (pv=0 AND v=2) OR (pv=2 AND v=1) THEN 1 ELSE 0 END) AS BIGINT) AS rises2 FROM ch WHERE pv IS NOT NULL GROUP BY 1)"


def three_slices(spark, d):
    """The trace in three consecutive parts of ten days."""
    e = b.raw_events(spark, d)
    part = F.least(F.expr(f"t div {240 * b.HOUR}"), F.lit(2).cast("bigint"))
    return [e.filter(part == i) for i in range(3)]


@query("j3_carried_state", f"WITH {b.CH} SELECT sig_id, t, pv, v FROM ch")
def j3(spark, d):
    """Slice by slice with carried last values: the same changes as in one go."""
    state, out = None, None
    for part in three_slices(spark, d):
        ch, nxt, _ = st.slice_changes(part, state, b.block_ticks(spark, d))
        state = cut(nxt)
        ch = ch.select("sig_id", "t", "pv", "v")
        out = ch if out is None else out.unionAll(ch)
    return out


@query("j4_sum_over_slices", f"WITH {b.CH}, {TOG} SELECT cycle, toggles2, rises2 FROM tog")
def j4(spark, d):
    state, parts = None, []
    for part in three_slices(spark, d):
        ch, nxt, _ = st.slice_changes(part, state, b.block_ticks(spark, d))
        state = cut(nxt)
        parts.append(st.cycle_toggles(ch, T6))
    from ..operators.graph import union_all
    return st.add_slices(union_all(parts), ["cycle"], ["toggles2", "rises2"])


@query("j5_streaming_power", f"WITH {b.CH}, {TOG} SELECT cycle, toggles2, rises2, CAST(0 AS BIGINT) AS late FROM tog")
def j5(spark, d):
    """Three arrivals of the log, each drained by the same stream."""
    folder = scratch(spark)
    src = f"{folder}/in"
    run = st.SlicedTrace(spark, folder, T6, b.block_ticks(spark, d))
    for part in three_slices(spark, d):
        part.write.mode("append").parquet(src)
        run.run(spark.readStream.schema(part.schema).parquet(src))
    return run.totals()


@query("j5_cycle_power", ORACLES["d15_cycle_power"])
def j5_power(spark, d):
    """Five power components per cycle, the log drained by one stream in three arrivals."""
    signals = cut(b.raw_events(spark, d).select("sig_id", "gate", "pin_idx").distinct())
    model = cp.PowerModel(signals, b.gates(spark, d).select("gate", "cell_name"), leak_table(spark), b.int_power_rows(spark), b.arc_rows(spark), b.pin_env, F.col("gate") % 5 == 2, 2, b.N_PIN, SLEW_TICKS)
    folder = scratch(spark)
    src = f"{folder}/in"
    run = cp.CyclePower(spark, folder, T6, b.block_ticks(spark, d), model)
    for part in three_slices(spark, d):
        part.write.mode("append").parquet(src)
        run.run(spark.readStream.schema(part.schema).parquet(src))
    return run.totals().select("cycle", "component", F.round("power", 5).alias("power"))


@query("j6_tumbling_counts", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def j6(spark, d):
    schema = b.table(spark, d, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    stream = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        e = stream.parquet(f"{d}/events.parquet")
    else:
        e = stream.option("pathGlobFilter", "events.parquet").parquet(d)
    e = e.select(F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    run = cp.TumblingTable(spark, scratch(spark), "6 hours")
    run.run(e)
    return run.totals().withColumn("start", F.col("start").cast("timestamp_ntz"))
