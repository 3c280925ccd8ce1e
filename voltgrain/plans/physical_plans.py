"""Parasitics, delays, library and hierarchy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lut import add_lut2
from ..operators import equivalence as eq
from ..operators import library as lib
from ..operators import parasitics as ps
from ..operators.annotation import annotate_arcs
from ..operators.graph import union_all
from ..operators.slew import slew_arrivals, table_of
from ..session import cut
from . import bindings as b, graph_plans
from .graph_plans import BASE_SQL, SEED_SQL
from .registry import query

KEY4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# One net per region: region - nation - customer - order.
RC = """res AS (SELECT n_regionkey AS net_id, 'n' || CAST(n_nationkey AS VARCHAR) AS node, 'r' || CAST(n_regionkey AS VARCHAR) AS parent, (1 + n_nationkey % 4) / 1024e0 AS ohm, 1e0 AS cap FROM nation
  UNION ALL SELECT n_regionkey, 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR), (1 + c_custkey % 3) / 64e0, 2e0 FROM customer JOIN nation ON n_nationkey=c_nationkey
  UNION ALL SELECT n_regionkey, 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), (1 + o_orderkey % 5) / 16e0, 1e0 + o_orderkey % 3 FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey),
 m3 AS (SELECT net_id, node, parent, ohm, cap AS y1, 0e0 AS y2, 0e0 AS y3 FROM res WHERE node LIKE 'o%'),
 u3 AS (SELECT parent, sum(y1) AS u1, sum(y2 - ohm*y1*y1) AS u2, sum(y3 - 2*ohm*y1*y2 + ohm*ohm*y1*y1*y1) AS u3 FROM m3 GROUP BY parent),
 m2 AS (SELECT net_id, node, res.parent, ohm, cap + coalesce(u1,0) AS y1, coalesce(u2,0) AS y2, coalesce(u3,0) AS y3 FROM res LEFT JOIN u3 ON u3.parent=res.node WHERE node LIKE 'c%'),
 u2 AS (SELECT parent, sum(y1) AS u1, sum(y2 - ohm*y1*y1) AS u2, sum(y3 - 2*ohm*y1*y2 + ohm*ohm*y1*y1*y1) AS u3 FROM m2 GROUP BY parent),
 m1 AS (SELECT net_id, node, res.parent, ohm, cap + coalesce(u1,0) AS y1, coalesce(u2,0) AS y2, coalesce(u3,0) AS y3 FROM res LEFT JOIN u2 ON u2.parent=res.node WHERE node LIKE 'n%'),
 m0 AS (SELECT net_id, sum(y1) + 3 AS y1, sum(y2 - ohm*y1*y1) AS y2, sum(y3 - 2*ohm*y1*y2 + ohm*ohm*y1*y1*y1) AS y3 FROM m1 GROUP BY net_id)"""


def rc_tables(spark, d):
    n, c, o, r = (b.table(spark, d, t) for t in ("nation", "customer", "orders", "region"))
    k = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    cn = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    on = o.join(cn, F.col("o_custkey") == F.col("c_custkey"))
    res = union_all([
        n.select(F.col("n_regionkey").alias("net_id"), k("r", "n_regionkey").alias("n1"), k("n", "n_nationkey").alias("n2"), ((1 + F.col("n_nationkey") % 4) / 1024.0).alias("ohm")),
        cn.select(F.col("n_regionkey").alias("net_id"), k("c", "c_custkey").alias("n1"), k("n", "n_nationkey").alias("n2"), ((1 + F.col("c_custkey") % 3) / 64.0).alias("ohm")),
        on.select(F.col("n_regionkey").alias("net_id"), k("c", "c_custkey").alias("n1"), k("o", "o_orderkey").alias("n2"), ((1 + F.col("o_orderkey") % 5) / 16.0).alias("ohm"))])
    caps = union_all([
        r.select(F.col("r_regionkey").alias("net_id"), k("r", "r_regionkey").alias("node"), F.lit(3.0).alias("cap")),
        n.select(F.col("n_regionkey").alias("net_id"), k("n", "n_nationkey").alias("node"), F.lit(1.0).alias("cap")),
        cn.select(F.col("n_regionkey").alias("net_id"), k("c", "c_custkey").alias("node"), F.lit(2.0).alias("cap")),
        on.select(F.col("n_regionkey").alias("net_id"), k("o", "o_orderkey").alias("node"), (1.0 + F.col("o_orderkey") % 3).alias("cap"))])
    drv = r.select(F.col("r_regionkey").alias("net_id"), k("r", "r_regionkey").alias("node"))
    return res, caps, drv


def rc_moments(spark, d):
    res, caps, drv = rc_tables(spark, d)
    return ps.moments(ps.root_tree(res, drv), caps)


@query("h1_driver_load", """WITH n AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus='F' THEN l_quantity END) AS f, sum(CASE WHEN l_linestatus='O' THEN l_quantity END) AS r FROM lineitem GROUP BY 1),
  c AS (SELECT l_orderkey, rf, coalesce(cap,0) AS pin FROM (SELECT l_orderkey, 'fall' AS rf, f AS cap FROM n UNION ALL SELECT l_orderkey, 'rise', r FROM n))
  SELECT l_orderkey, max(pin + CASE WHEN o_orderstatus='P' THEN 7e0 WHEN o_orderpriority='1-URGENT' THEN 2e0 + l_orderkey % 10 WHEN o_orderpriority='2-HIGH' AND 40 + l_orderkey % 60 >= pin THEN 40 + l_orderkey % 60 - pin WHEN o_orderpriority='2-HIGH' THEN 0 ELSE 2e0 END) AS load FROM c JOIN orders ON o_orderkey=l_orderkey GROUP BY 1""")
def h1(spark, d):
    q = F.col("l_quantity")
    n = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", q)), F.lit(0.0)).alias("fall"), F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", q)), F.lit(0.0)).alias("rise"))
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    k, pr = F.col("l_orderkey"), F.col("o_orderpriority")
    user, rc, red = F.when(F.col("o_orderstatus") == "P", 7.0), F.when(pr == "1-URGENT", (k % 10).cast("double")), F.when(pr == "2-HIGH", (40 + k % 60).cast("double"))

    def one(pin):
        return ps.driver_load(F.col(pin), F.lit(2.0), user, rc, red)
    return n.join(o, "l_orderkey").select("l_orderkey", F.greatest(one("rise"), one("fall")).alias("load"))


@query("h2_pi_model", f"WITH {RC} SELECT net_id, round(y1 - y2*y2/y3, 4) AS c2, round(-y3*y3/(y2*y2*y2), 6) AS rpi, round(y2*y2/y3, 4) AS c1 FROM m0")
def h2(spark, d):
    p = ps.pi_model(rc_moments(spark, d))
    return p.select("net_id", F.round("c2", 4).alias("c2"), F.round("rpi", 6).alias("rpi"), F.round("c1", 4).alias("c1"))


@query("h3_elmore", f"""WITH {RC}, t1 AS (SELECT node, ohm*y1 AS tau FROM m1), t2 AS (SELECT m2.node, t1.tau + ohm*y1 AS tau FROM m2 JOIN t1 ON t1.node=m2.parent), t3 AS (SELECT m3.node, t2.tau + ohm*y1 AS tau FROM m3 JOIN t2 ON t2.node=m3.parent)
  SELECT node, tau FROM t3""")
def h3(spark, d):
    return ps.elmore(rc_moments(spark, d)).filter("node like 'o%'").select("node", "tau")


@query("h4_network_cap", "SELECT l_orderkey AS net_id, sum(l_quantity) + 5e-1 * sum(CASE WHEN l_tax > 4e-2 THEN 3e0 ELSE 0e0 END) AS cap FROM lineitem GROUP BY 1")
def h4(spark, d):
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "net_id")
    return ps.network_cap(li.select("net_id", F.col("l_quantity").alias("gnd_cap")), li.filter("l_tax > 0.04").select("net_id", F.lit(3.0).alias("farad")), 0.5)


WL = """w AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS pc FROM lineitem GROUP BY 1), z AS (SELECT w.*, CASE WHEN n < 2 THEN greatest(0, 10 - (2 - n) * 3e0) WHEN n >= 8 THEN 44 + (n - 8) * 3e0 WHEN n < 4 THEN 10 + (n-2)*5e0 ELSE 20 + (n-4)*6e0 END AS len FROM w)"""


@query("h5_wire_load", f"""WITH {WL}, e AS (SELECT z.*, len * 25e-2 AS wc, len * 5e-1 AS wr FROM z), s AS (SELECT l_orderkey, sum(power(l_quantity + wc/n, 2)) AS s2, sum(power(l_quantity + wc/n, 3)) AS s3 FROM lineitem JOIN e USING (l_orderkey) GROUP BY 1),
  p AS (SELECT e.*, o_orderstatus AS st, s2, s3, -(wr/n)*s2 AS y2, (wr/n)*(wr/n)*s3 AS y3, 1 + pc + wc AS y1 FROM e JOIN s USING (l_orderkey) JOIN orders ON o_orderkey=l_orderkey)
  SELECT l_orderkey, round(CASE st WHEN 'F' THEN 1 WHEN 'O' THEN wc + pc + 1 ELSE greatest(0, y1 - y2*y2/y3) END, 6) AS c2, round(CASE st WHEN 'F' THEN wr WHEN 'O' THEN 0 ELSE -y3*y3/(y2*y2*y2) END, 6) AS rpi, round(CASE st WHEN 'F' THEN pc + wc WHEN 'O' THEN 0 ELSE y2*y2/y3 END, 6) AS c1 FROM p""")
def h5(spark, d):
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("pc"), F.sum(F.pow("l_quantity", F.lit(2))).alias("q2"), F.sum(F.pow("l_quantity", F.lit(3))).alias("q3"))
    fan, ln = F.array(F.lit(2.0), F.lit(4.0), F.lit(8.0)), F.array(F.lit(10.0), F.lit(20.0), F.lit(44.0))
    n = n.withColumn("len", ps.wire_length(fan, ln, F.lit(3.0), F.col("n")))
    n = n.withColumns({"wc": F.col("len") * 0.25, "wr": F.col("len") * 0.5}).withColumn("a", F.col("wc") / F.col("n"))
    a, q1 = F.col("a"), F.col("pc")
    s2 = F.col("q2") + 2 * a * q1 + F.col("n") * a * a
    s3 = F.col("q3") + 3 * a * F.col("q2") + 3 * a * a * q1 + F.col("n") * a * a * a
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "worst").when(F.col("o_orderstatus") == "O", "best").otherwise("balanced").alias("tree"))
    x = ps.wire_tree(F.col("tree"), F.col("wc"), F.col("wr"), 1 + q1, F.lit(1.0), F.col("n"), s2, s3)
    return n.join(o, "l_orderkey").select("l_orderkey", x.alias("x")).select("l_orderkey", *[F.round(f"x.{c}", 6).alias(c) for c in ("c2", "rpi", "c1")])


X6, Y6 = "(l_tax*2+3e-2)", "(l_quantity/10e0)"


@query("h6_cell_delay", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({b.lut_sql(X6, Y6, '(p_size*1e0)')}, 6) AS delay, round({b.lut_sql(X6, Y6, '(p_size*2e0)')}, 6) AS slew FROM lineitem JOIN part ON p_partkey=l_partkey")
def h6(spark, d):
    return cell_delay(spark, d).select(*KEY4, F.round("delay", 6).alias("delay"), F.round("slew", 6).alias("slew"))


def cell_delay(spark, d):
    """Delay and output slew tables of each part, entries size + 3i + 2j + ij."""
    idx = F.array(*map(F.lit, range(12)))

    def vals(base):
        return F.transform(idx, lambda k: (base + 3 * F.floor(k / 4) + 2 * (k % 4) + F.floor(k / 4) * (k % 4)).cast("double"))
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", F.array(*map(F.lit, b.AX1)).alias("axis1"), F.array(*map(F.lit, b.AX2)).alias("axis2"),
                                         vals(F.col("p_size")).alias("dv"), vals(F.col("p_size") * 2).alias("sv"))
    j = b.table(spark, d, "lineitem").select(*KEY4, "l_tax", "l_quantity", "l_returnflag").join(p, "l_partkey")
    x, y = F.col("l_tax") * 2 + 0.03, F.col("l_quantity") / 10.0
    return add_lut2(add_lut2(j, "delay", "axis1", "axis2", "dv", x, y), "slew", "axis1", "axis2", "sv", x, y)


# Slew carried with the delay: suppliers, parts, orders, customers; each edge has a table by its end and a load by its quantity.
SLEW_SQL = ", ".join(["sw0 AS MATERIALIZED (SELECT v, rf, clk, a_max * 1e0 AS a_max, a_min * 1e0 AS a_min, 5e-2 + (v % 10) * 1e-2 AS s_max, 3e-2 + (v % 7) * 1e-2 AS s_min FROM seeds)"] + [
    f"""sw{k} AS MATERIALIZED (SELECT v, rf, clk, max(a_max + {b.lut_sql('s_max', 'y', 'td')}) AS a_max, min(a_min + {b.lut_sql('s_min', 'y', 'td')}) AS a_min,
  max({b.lut_sql('s_max', 'y', 'ts')} / 187e0) AS s_max, min({b.lut_sql('s_min', 'y', 'ts')} / 187e0) AS s_min
  FROM (SELECT e.to_v AS v, e.to_rf AS rf, clk, a.a_max, a.a_min, a.s_max, a.s_min, (e.d_max % 40) / 1e1 AS y, (1 + e.to_v % 5) * 1e0 AS td, (2 + e.to_v % 5) * 2e0 AS ts FROM sw{k - 1} a JOIN edges e ON e.from_v = a.v AND e.from_rf = a.rf AND e.layer = {k - 1}) GROUP BY v, rf, clk)""" for k in (1, 2, 3)])


@query("h6_slew_sweep", f"WITH {BASE_SQL}, {SEED_SQL}, {SLEW_SQL}, a AS (" + " UNION ALL ".join(f"SELECT * FROM sw{k}" for k in range(4)) + ") SELECT v, rf, clk, round(a_max, 6) AS a_max, round(a_min, 6) AS a_min, round(s_max, 6) AS slew_max, round(s_min, 6) AS slew_min FROM a")
def h6_sweep(spark, d):
    """Delays looked up level by level with the slew that arrives; the output slew goes on to the next stage."""
    g = graph_plans.levelled(spark, d, 3, lambda x: {"table_id": (x["to_v"] % 5).cast("int"), "load": (x["d_max"] % 40) / 10.0, "wire_delay": F.lit(None).cast("double")})
    t = spark.range(5).select(F.col("id").cast("int").alias("table_id"), F.array(*map(F.lit, b.AX1)).alias("axis1"), F.array(*map(F.lit, b.AX2)).alias("axis2"),
                              table_of(F.col("id") + 1, b.AX1, b.AX2, 3, 2).alias("delay_values"), table_of((F.col("id") + 2) * 2, b.AX1, b.AX2, 3, 2, 187.0).alias("slew_values"))
    s = graph_plans.seeds(spark, d).withColumns({"slew_max": 0.05 + F.col("v") % 10 * 0.01, "slew_min": 0.03 + F.col("v") % 7 * 0.01})
    out = slew_arrivals(g, s, t, track=False)
    return out.select("v", "rf", "clk", *[F.round(c, 6).alias(c) for c in ("a_max", "a_min", "slew_max", "slew_min")])


@query("h7_check_margin", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({b.lut_sql('(l_discount+3e-2)', '(l_tax*50e0)', '(5e0)')}, 6) AS margin FROM lineitem WHERE l_returnflag='A'")
def h7(spark, d):
    """Setup margin by clock slew and data slew."""
    vals = [5.0 + 3 * i + 2 * j + i * j for i in range(3) for j in range(4)]
    li = b.table(spark, d, "lineitem").filter("l_returnflag='A'").withColumns({"a1": F.array(*map(F.lit, b.AX1)), "a2": F.array(*map(F.lit, b.AX2)), "v": F.array(*map(F.lit, vals))})
    return add_lut2(li, "m", "a1", "a2", "v", F.col("l_discount") + 0.03, F.col("l_tax") * 50.0).select(*KEY4, F.round("m", 6).alias("margin"))


@query("h8_threshold_adjust", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + CASE WHEN l_linestatus='F' THEN 1 ELSE -1 END * l_tax * ((45e-2 - 5e-1) / 6e-1), 9) AS delay, round(l_tax * ((8e-1 / 1e0) / (6e-1 / 5e-1)), 9) AS slew FROM lineitem")
def h8(spark, d):
    x = ps.threshold_adjust(F.col("l_quantity"), F.col("l_tax"), F.col("l_linestatus") == "F", {"vth": 0.5, "lower": 0.2, "upper": 0.8, "derate": 0.5}, {"vth": 0.45, "lower": 0.1, "upper": 0.9, "derate": 1.0})
    return b.table(spark, d, "lineitem").select(*KEY4, x.alias("x")).select(*KEY4, F.round("x.delay", 9).alias("delay"), F.round("x.slew", 9).alias("slew"))


@query("h9_apply_annotation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_nationkey > 15 THEN l_quantity WHEN s_nationkey % 2 = 0 THEN l_quantity + (s_nationkey + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) ELSE s_nationkey + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END END AS delay FROM lineitem JOIN supplier ON s_suppkey=l_suppkey")
def h9(spark, d):
    """min / typ / max triple per instance, picked by returnflag; even nations give increments."""
    n = F.col("s_nationkey")
    an = b.table(spark, d, "supplier").filter("s_nationkey <= 15").select(F.col("s_suppkey").alias("l_suppkey"), F.array(n + 1, n + 2, n + 3).alias("triple"), (n % 2 == 0).alias("inc"))
    j = b.table(spark, d, "lineitem").join(an, "l_suppkey", "left")
    pick = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return j.select(*KEY4, ps.apply_annotation(F.col("l_quantity"), F.get("triple", pick), F.col("inc")).alias("delay"))


@query("h10_condition_match", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'A & B' WHEN 1 THEN '!A' END AS cond, l_quantity FROM lineitem),
  a AS (SELECT p_partkey, 'A&&B' AS c, p_size * 1e0 AS d FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '!a', p_size + 5e-1 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, NULL, p_size + 25e-2 FROM part WHERE p_size % 5 = 0)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(x.d, y.d, l_quantity) AS delay FROM l LEFT JOIN a x ON x.p_partkey=l_partkey AND x.c = CASE cond WHEN 'A & B' THEN 'A&&B' WHEN '!A' THEN '!a' END LEFT JOIN a y ON y.p_partkey=l_partkey AND y.c IS NULL""")
def h10(spark, d):
    """Equal normalized conditions match first; an unconditioned annotation covers the rest."""
    p = b.table(spark, d, "part")
    s = F.col("p_size")
    an = union_all([p.filter(s % 2 == 0).select("p_partkey", F.lit("A&&B").alias("c"), s.cast("double").alias("d")), p.filter(s % 3 == 0).select("p_partkey", F.lit("!a").alias("c"), (s + 0.5).alias("d"))])
    an = an.select(F.col("p_partkey").alias("l_partkey"), ps.normal_condition(F.col("c")).alias("nc"), "d")
    free = p.filter(s % 5 == 0).select(F.col("p_partkey").alias("l_partkey"), (s + 0.25).alias("f"))
    cond = F.when(F.col("l_linenumber") % 3 == 0, "A & B").when(F.col("l_linenumber") % 3 == 1, "!A")
    li = b.table(spark, d, "lineitem").select(*KEY4, "l_quantity", ps.normal_condition(cond).alias("nc"))
    return li.join(an, ["l_partkey", "nc"], "left").join(free, "l_partkey", "left").select(*KEY4, F.coalesce("d", "f", "l_quantity").alias("delay"))


@query("h10_condition_use", """WITH arcs AS (SELECT p_partkey, k AS arc, CASE k WHEN 0 THEN 'A & B' WHEN 1 THEN '!A' END AS w, p_size * 1e0 AS base FROM part CROSS JOIN (VALUES (0), (1), (2)) t(k)),
  an AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'A&B' WHEN 1 THEN '! A' WHEN 2 THEN 'B' END AS c, l_linenumber = 7 AS celse, l_quantity * 1e0 AS lo, l_quantity * 1e0 + l_linenumber AS hi FROM lineitem),
  m AS (SELECT p_partkey, arc, seq, lo, hi, c IS NOT NULL AND w IS NULL AS used FROM arcs JOIN an ON l_partkey=p_partkey WHERE w IS NULL OR (NOT celse AND (c IS NULL OR replace(c, ' ', '') = replace(w, ' ', '')))),
  s AS (SELECT p_partkey, arc, max(CASE WHEN NOT used THEN seq END) AS s0 FROM m GROUP BY ALL),
  r AS (SELECT p_partkey, arc, min(lo) AS lo, max(hi) AS hi FROM m JOIN s USING (p_partkey, arc) WHERE s0 IS NULL OR seq >= s0 GROUP BY ALL)
  SELECT p_partkey, arc, coalesce(lo, base) AS d_min, coalesce(hi, base) AS d_max, hi IS NOT NULL AS annotated FROM arcs LEFT JOIN r USING (p_partkey, arc)""")
def h10_use(spark, d):
    """Three arcs a part, annotated in the order of lines; conditions that the library does not know widen the arc without one."""
    arc, n, q = F.col("arc"), F.col("l_linenumber"), F.col("l_quantity").cast("double")
    base = F.col("p_size").cast("double")
    arcs = b.table(spark, d, "part").select("p_partkey", base.alias("d_min"), base.alias("d_max"), F.explode(F.array(*map(F.lit, range(3)))).alias("arc")).withColumn("when", F.when(arc == 0, "A & B").when(arc == 1, "!A"))
    notes = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + n).alias("seq"), F.when(n % 4 == 0, "A&B").when(n % 4 == 1, "! A").when(n % 4 == 2, "B").alias("cond"),
                                                 (n == 7).alias("condelse"), q.alias("a_min"), (q + n).alias("a_max"))
    return annotate_arcs(arcs, notes, ["p_partkey"], "both").drop("when")


@query("h11_pvt_scale", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * (1 + l_tax*2e-1) * (1 - l_discount*5e-1) * (1 + (l_linenumber*10 - 25)*1e-3), 9) AS delay FROM lineitem")
def h11(spark, d):
    v = ps.pvt_scale(F.col("l_quantity"), F.lit(0.2), F.lit(-0.5), F.lit(0.001), F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber") * 10 - 25)
    return b.table(spark, d, "lineitem").select(*KEY4, F.round(v, 9).alias("delay"))


@query("h12_delay_report", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({X6}, 9) AS in_slew, {Y6} AS load, p_size * 1e0 AS first_cell, p_size + 16e0 + 2 AS last_cell, round({b.lut_sql(X6, Y6, '(p_size*1e0)')}, 6) AS delay FROM lineitem JOIN part ON p_partkey=l_partkey WHERE p_type='PROMO'")
def h12(spark, d):
    r = cell_delay(spark, d).filter("p_type='PROMO'")
    return r.select(*KEY4, F.round(F.col("l_tax") * 2 + 0.03, 9).alias("in_slew"), (F.col("l_quantity") / 10.0).alias("load"), F.col("dv")[0].alias("first_cell"), F.element_at("dv", -1).alias("last_cell"), F.round("delay", 6).alias("delay"))


@query("h13_input_drive", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 7 / 10e0 END, CASE WHEN s_nationkey < 10 THEN s_nationkey * 3 / 100e0 END, CASE WHEN s_nationkey > 20 THEN 2e0 * (s_suppkey % 9) / 100 END, 0) AS slew FROM supplier")
def h13(spark, d):
    """Fixed transition, else driving cell at the load, else drive resistance times load, else 0."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return b.table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.when(k % 5 == 0, k % 7 / 10.0), F.when(n < 10, n * 3 / 100.0), F.when(n > 20, 2.0 * (k % 9) / 100), F.lit(0.0)).alias("slew"))


@query("h14_parallel_drivers", """WITH x AS (SELECT l_orderkey, l_linestatus AS rf, l_partkey, l_suppkey, l_linenumber, l_quantity + l_tax * 10 AS delay, l_quantity AS intrinsic, l_discount AS slew FROM lineitem),
  h AS (SELECT l_orderkey, rf, sum(CASE WHEN delay - intrinsic <> 0 THEN 1 / (delay - intrinsic) END) AS d, sum(CASE WHEN slew <> 0 THEN 1 / slew END) AS s FROM x GROUP BY 1, 2)
  SELECT x.l_orderkey, l_linenumber, l_partkey, l_suppkey, round(intrinsic + coalesce(1/d, 0), 6) AS gate_delay, round(coalesce(1/s, 0), 9) AS drvr_slew FROM x JOIN h ON h.l_orderkey=x.l_orderkey AND h.rf=x.rf""")
def h14(spark, d):
    x = b.table(spark, d, "lineitem").select(*KEY4, F.col("l_orderkey").alias("net_id"), F.col("l_linestatus").alias("rf"), (F.col("l_quantity") + F.col("l_tax") * 10).alias("delay"), F.col("l_quantity").alias("intrinsic"), F.col("l_discount").alias("slew"))
    return ps.parallel_drivers(x).select(*KEY4, F.round("gate_delay", 6).alias("gate_delay"), F.round("drvr_slew", 9).alias("drvr_slew"))


# ---------------------------------------------------------------- library, hierarchy, edits
@query("p1_equivalent_cells", "WITH c AS (SELECT p_partkey, p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS rank FROM part WHERE p_name NOT LIKE 'old%') SELECT p_partkey, rank FROM c")
def p1(spark, d):
    c = b.table(spark, d, "part").withColumns({"cell_name": F.col("p_partkey"), "dont_use": F.col("p_name").startswith("old"), "drive": F.col("p_size")})
    return lib.equivalent_cells(c, ["p_brand", "p_type"], block=F.floor(-F.col("p_size") / 8)).select("p_partkey", "rank")


# Libraries are nation-like brands of parts; each function is written in two ways, some outputs have an enable, some cells a register.
SPELLED = ["A&B", "B*A", "A|B", "!(!A & !B)", "A^B", "!A"]
SPELLED_SQL = "CASE WHEN p_partkey % 6 <= 1 THEN 'and' WHEN p_partkey % 6 <= 3 THEN 'or' WHEN p_partkey % 6 = 4 THEN 'xor' ELSE 'not' END"


@query("p1_equivalence_across", f"""WITH c AS (SELECT p_brand AS lib, p_partkey AS cell, p_size, {SPELLED_SQL} AS f, p_size % 7 = 0 AS en, p_size % 5 = 0 AS sq FROM part WHERE p_name NOT LIKE 'old%'),
  k AS (SELECT f, en, sq, min(lib || '/' || CAST(cell AS VARCHAR)) AS class_id, count(*) AS n_members FROM c WHERE lib IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL HAVING count(*) > 1)
  SELECT lib, cell, class_id, n_members, row_number() OVER (PARTITION BY class_id ORDER BY p_size DESC, lib, cell) AS rank, false AS mapped FROM c JOIN k USING (f, en, sq) WHERE lib IN ('Brand#1', 'Brand#2', 'Brand#3')
  UNION ALL SELECT lib, cell, class_id, n_members, NULL, true FROM c JOIN k USING (f, en, sq) WHERE lib IN ('Brand#4', 'Brand#5')""")
def p1_across(spark, d):
    """Cells of three libraries by what they compute, and the cells of two other libraries mapped to them."""
    none, k = F.lit(None).cast("string"), F.col("p_partkey")
    p = b.table(spark, d, "part").withColumns({"lib": F.col("p_brand"), "cell": k, "is_seq": F.col("p_size") % 5 == 0})
    cells = p.select("lib", "cell", F.col("p_size").alias("drive"), F.col("p_name").startswith("old").alias("dont_use"))
    f = F.get(F.array(*map(F.lit, SPELLED)), k % 6)

    def port(name, kind, function=none, enable=none):
        return F.struct(F.lit(name).alias("port"), F.lit(kind).alias("dir"), function.alias("function"), enable.alias("enable"))
    z = port("Z", "output", F.when(~F.col("is_seq"), f).otherwise("IQ"), F.when(F.col("p_size") % 7 == 0, F.when(k % 2 == 0, "B & B").otherwise("B")))
    some = F.array(port("A", "input"), port("B", "input"), z, port("VDD", "primary_power"))
    ports = p.select("lib", "cell", F.explode(F.when(F.col("is_seq"), F.concat(some, F.array(port("CK", "input")))).otherwise(some)).alias("x")).select("lib", "cell", "x.*")
    seqs = p.filter("is_seq").select("lib", "cell", F.lit(True).alias("is_register"), F.lit("CK").alias("clock"), f.alias("data"), none.alias("clear"), none.alias("preset"), F.lit("IQ").alias("out"), F.lit("IQN").alias("out_inv"))
    return eq.equivalent_across(eq.described_cells(cells, ports, seqs), ["Brand#1", "Brand#2", "Brand#3"], ["Brand#4", "Brand#5"], block=F.floor(-F.col("drive") / 8))


@query("p2_buffer_inverter", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'buffer' WHEN 1 THEN 'inverter' ELSE 'none' END AS kind FROM part")
def p2(spark, d):
    from ..functions.logic import truth_bits
    tts = F.array(*[F.array(*map(F.lit, truth_bits(f, ports))) for f, ports in (("A", ["A"]), ("!A", ["A"]), ("A&B", ["A", "B"]), ("1", ["A"]), ("A^B", ["A", "B"]))])
    return b.table(spark, d, "part").select("p_partkey", lib.buffer_kind(F.get(tts, F.col("p_size") % 5)).alias("kind"))


@query("p3_what_if_edits", """SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'SWAPPED' ELSE c_mktsegment END AS cell, c_nationkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 10000000 + s_suppkey, 'NEW', s_nationkey FROM supplier WHERE s_acctbal < 0""")
def p3(spark, d):
    c = b.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cell"), "c_nationkey", "c_acctbal")
    new = b.table(spark, d, "supplier").filter("s_acctbal < 0").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("cell"), F.col("s_nationkey").alias("c_nationkey"))
    return lib.apply_edits(c.drop("c_acctbal"), c.filter("c_acctbal < 0"), new, c.filter("c_acctbal > 9000").withColumn("cell", F.lit("SWAPPED")), "c_custkey", "cell").select("c_custkey", "cell", "c_nationkey")


@query("p4_drive_resistance", "SELECT l_partkey, round((max(l_extendedprice) - min(l_extendedprice)) / (max(l_quantity) - min(l_quantity)), 9) AS drive, min(l_extendedprice) AS intrinsic FROM lineitem GROUP BY 1 HAVING max(l_quantity) > min(l_quantity)")
def p4(spark, d):
    g = b.table(spark, d, "lineitem").groupBy("l_partkey").agg(*[f(c).alias(n) for f, c, n in ((F.min, "l_extendedprice", "d0"), (F.max, "l_extendedprice", "d1"), (F.min, "l_quantity", "c0"), (F.max, "l_quantity", "c1"))])
    return g.filter("c1 > c0").select("l_partkey", F.round(lib.drive_resistance(F.col("d0"), F.col("d1"), F.col("c0"), F.col("c1")), 9).alias("drive"), F.col("d0").alias("intrinsic"))


@query("c18_flatten_nets", """WITH RECURSIVE r(net, cur, st) AS (SELECT o_orderkey, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT r.net, o.o_orderkey, o.o_orderstatus FROM r JOIN orders o ON o.o_orderkey = r.cur // 10 WHERE r.st IN ('F','O') AND r.cur > 0)
  SELECT net, min(cur) AS root FROM r GROUP BY net""")
def c18(spark, d):
    """Order n hangs on order n div 10 unless its status is P."""
    o = b.table(spark, d, "orders")
    pairs = o.filter("o_orderstatus in ('F','O') and o_orderkey > 0").select(F.col("o_orderkey").alias("a"), F.expr("o_orderkey div 10").alias("b"))
    return lib.flatten_nets(o.select(F.col("o_orderkey").alias("net")), pairs)


@query("c19_elaborate", """WITH RECURSIVE t AS (SELECT c_custkey // 6 AS module, c_custkey AS child FROM customer WHERE c_custkey > 0), hasbody AS (SELECT DISTINCT module FROM t), leaf AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT module FROM hasbody) AND c_acctbal >= 0),
  r(path, module) AS (SELECT 'u' || CAST(child AS VARCHAR), child FROM t WHERE module = 0 UNION ALL SELECT path || '/u' || CAST(t.child AS VARCHAR), t.child FROM r JOIN t ON t.module = r.module)
  SELECT path, module, CASE WHEN module IN (SELECT c_custkey FROM leaf) THEN 'leaf' ELSE 'black_box' END AS kind FROM r WHERE module NOT IN (SELECT module FROM hasbody)""")
def c19(spark, d):
    """Customer n is instantiated in module n div 6; those without a body and with debt are unknown."""
    c = b.table(spark, d, "customer")
    t = c.filter("c_custkey > 0").select(F.expr("c_custkey div 6").alias("module"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("inst"), F.col("c_custkey").alias("child"))
    leaf = c.filter("c_acctbal >= 0").join(t.select(F.col("module").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("module"))
    return lib.elaborate(t, leaf, F.lit(0)).select("path", "module", "kind")
