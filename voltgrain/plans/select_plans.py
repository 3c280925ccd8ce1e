"""Object selection, joins on names, sets and scalar name functions.

Customers are instances (path region/nation/customer), orders are pins and nets,
parts are library cells, suppliers are top ports, nations are clocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import activity as ac
from ..operators import select as sel
from . import bindings as b
from .registry import query

I_SQL = """insts AS (SELECT c_custkey AS inst_id, r_name || '/' || n_name || '/' || c_name AS path, c_mktsegment AS cell_name, c_acctbal, n_name, r_name, c_name, c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
P_SQL = """pins AS (SELECT o_orderkey AS pin_id, o_custkey AS inst_id, path || '/p' || CAST(o_orderkey AS VARCHAR) AS path, path AS inst_path, 'p' || CAST(o_orderkey AS VARCHAR) AS port,
  CASE o_orderstatus WHEN 'F' THEN 'input' WHEN 'O' THEN 'output' ELSE 'inout' END AS dir, o_orderpriority AS prio, o_totalprice FROM orders JOIN insts ON inst_id = o_custkey)"""


def insts(spark, d):
    c, n, r = (b.table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = F.array("r_name", "n_name", "c_name")
    return j.select(F.col("c_custkey").alias("inst_id"), F.array_join(parts, "/").alias("path"), parts.alias("path_parts"),
                    F.col("c_mktsegment").alias("cell_name"), "c_acctbal", "c_nationkey", "n_name", "r_name", "c_name")


def pins(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("pin_id"), F.col("o_custkey").alias("inst_id"), "o_orderstatus", F.col("o_orderpriority").alias("prio"), "o_totalprice")
    i = insts(spark, d).select("inst_id", F.col("path").alias("inst_path"), "path_parts")
    port = F.concat(F.lit("p"), F.col("pin_id").cast("string"))
    dirn = F.when(F.col("o_orderstatus") == "F", "input").when(F.col("o_orderstatus") == "O", "output").otherwise("inout")
    return o.join(i, "inst_id").select(
        "pin_id", "inst_id", F.concat_ws("/", "inst_path", port).alias("path"), "inst_path", port.alias("port"), dirn.alias("dir"), "prio", "o_totalprice",
        F.array_append("path_parts", port).alias("path_parts"))


@query("b1_get_cells", f"""WITH {I_SQL} SELECT path FROM insts WHERE r_name GLOB 'A*' AND n_name GLOB 'NATION_1?' AND c_name GLOB '*7'
  UNION ALL SELECT path FROM insts WHERE r_name GLOB 'AS*' AND n_name GLOB 'NATION_*' AND c_name GLOB '*77'
  UNION ALL SELECT path FROM insts WHERE c_name GLOB 'Customer#*00?'
  UNION ALL SELECT path FROM insts WHERE regexp_full_match(lower(path), 'europe/nation_[0-9]/customer#0*5')""")
def b1(spark, d):
    i = insts(spark, d)
    plain = sel.by_levels(i, "path_parts", ["A*/NATION_1?/*7", "AS*/NATION_*/*77"])
    deep = sel.by_leaf(i, "path_parts", ["Customer#*00?"])
    rx = sel.by_name(i, "path", ["europe/nation_[0-9]/customer#0*5"], regexp=True, nocase=True)
    return plain.unionAll(deep).unionAll(rx).select("path")


@query("b2_get_pins", f"WITH {I_SQL}, {P_SQL} SELECT path, dir FROM pins WHERE inst_path GLOB 'ASIA/NATION_*/Customer#*' AND port GLOB 'p*1' AND dir <> 'inout'")
def b2(spark, d):
    p = sel.by_levels(pins(spark, d), "path_parts", ["ASIA/NATION_*/Customer#*/p*1"])
    return sel.property_filter(p, "dir!=inout").select("path", "dir")


@query("b3_get_nets", """SELECT l_orderkey AS net_id, l_partkey AS pin FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name GLOB 'red*'""")
def b3(spark, d):
    """Nets of the selected cells: one row per attachment."""
    cells = sel.by_name(b.table(spark, d, "part"), "p_name", ["red*"]).select(F.col("p_partkey").alias("l_partkey"))
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return sel.of_objects(li, cells, ["l_partkey"]).select(F.col("l_orderkey").alias("net_id"), F.col("l_partkey").alias("pin"))


@query("b4_get_ports", "SELECT s_name AS port FROM supplier WHERE s_name GLOB 'Supplier#*[13579]' AND s_acctbal > 0")
def b4(spark, d):
    return sel.by_name(b.table(spark, d, "supplier").filter("s_acctbal > 0"), "s_name", ["Supplier#.*[13579]"], regexp=True).select(F.col("s_name").alias("port"))


@query("b5_get_lib_cells", """SELECT p_brand AS lib, p_name AS cell_name, p_type AS pin FROM part WHERE p_brand GLOB 'Brand#1?' AND p_name GLOB '*bolt' AND p_type GLOB '*M*'
  UNION ALL SELECT DISTINCT p_brand, NULL, NULL FROM part WHERE p_brand GLOB '*2'""")
def b5(spark, d):
    p = b.table(spark, d, "part").withColumn("parts", F.array("p_brand", "p_name", "p_type"))
    pin = sel.by_levels(p, "parts", ["Brand#1?/*bolt/*M*"]).select(F.col("p_brand").alias("lib"), F.col("p_name").alias("cell_name"), F.col("p_type").alias("pin"))
    libs = sel.by_name(p.select("p_brand").distinct(), "p_brand", ["*2"]).select("p_brand", F.lit(None).cast("string"), F.lit(None).cast("string"))
    return pin.unionAll(libs)


@query("b6_clocks_and_ports", """SELECT 'clock' AS kind, n_name AS name FROM nation UNION ALL
  SELECT 'input', s_name FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL
  SELECT 'output', s_name FROM supplier WHERE s_suppkey % 2 = 1""")
def b6(spark, d):
    s, n = b.table(spark, d, "supplier"), b.table(spark, d, "nation")
    clk_src = n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return (n.select(F.lit("clock").alias("kind"), F.col("n_name").alias("name"))
            .unionAll(sel.subtract(s.filter("s_suppkey % 2 = 0"), clk_src, ["s_nationkey"]).select(F.lit("input"), "s_name"))
            .unionAll(s.filter("s_suppkey % 2 = 1").select(F.lit("output"), "s_name")))


@query("b7_glob_match", """SELECT p_partkey, p_name GLOB '?e*g*' AS plain, lower(p_name) GLOB '?e*g*' AS nocase, regexp_full_match(p_name, '[a-m].*t') AS rx FROM part""")
def b7(spark, d):
    n = F.col("p_name")
    return b.table(spark, d, "part").select("p_partkey", nm.matches(n, "?e*g*").alias("plain"), nm.matches(n, "?E*G*", nocase=True).alias("nocase"),
                                            nm.matches(n, "[a-m].*t", regexp=True).alias("rx"))


PROP = "p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS kind, CAST(p_size AS VARCHAR) AS size FROM part)"


def _props(spark, d):
    return b.table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("kind"), F.col("p_size").alias("size"))


@query("b8_property_filter", f"""WITH {PROP} SELECT 'eq' AS op, p_partkey FROM p WHERE kind = 'PROMO' UNION ALL SELECT 'ne', p_partkey FROM p WHERE kind <> 'PROMO'
  UNION ALL SELECT 'like', p_partkey FROM p WHERE kind GLOB 'S*L*' UNION ALL SELECT 'notlike', p_partkey FROM p WHERE NOT kind GLOB 'S*L*' UNION ALL SELECT 'num', p_partkey FROM p WHERE size = '7'""")
def b8(spark, d):
    p = _props(spark, d)
    terms = {"eq": "kind==PROMO", "ne": "kind!=PROMO", "like": "kind=~S*L*", "notlike": "kind!~S*L*", "num": "size==7"}
    out = [sel.property_filter(p, e).select(F.lit(k).alias("op"), "p_partkey") for k, e in terms.items()]
    return sel._concat(out)


@query("b9_filter_and", f"WITH {PROP} SELECT p_partkey FROM p WHERE kind GLOB 'S*' AND size GLOB '1*'")
def b9(spark, d):
    return sel.property_filter(_props(spark, d), "kind=~S* && size=~1*").select("p_partkey")


@query("b10_filter_or", f"WITH {PROP} SELECT p_partkey FROM p WHERE kind GLOB 'S*' UNION ALL SELECT p_partkey FROM p WHERE size GLOB '1*'")
def b10(spark, d):
    return sel.property_filter(_props(spark, d), "kind=~S* || size=~1*").select("p_partkey")


@query("b11_get_property", f"""WITH {I_SQL} SELECT 'lib_cell' AS class, p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, 'area' AS prop, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT 'lib_cell', p_name || '_' || CAST(p_partkey AS VARCHAR), 'library', p_brand FROM part
  UNION ALL SELECT 'instance', path, 'ref_name', cell_name FROM insts UNION ALL SELECT 'port', s_name, 'direction', CASE WHEN s_suppkey % 2 = 0 THEN 'input' ELSE 'output' END FROM supplier
  UNION ALL SELECT 'clock', n_name, 'period', CAST(10 + n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'net', CAST(o_orderkey AS VARCHAR), 'name', o_orderpriority FROM orders""")
def b11(spark, d):
    cell = b.table(spark, d, "part").withColumn("name", F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")))
    views = {
        "lib_cell": (cell, {"area": F.col("p_size"), "library": F.col("p_brand")}),
        "instance": (insts(spark, d).withColumn("name", F.col("path")), {"ref_name": F.col("cell_name")}),
        "port": (b.table(spark, d, "supplier").withColumn("name", F.col("s_name")), {"direction": F.when(F.col("s_suppkey") % 2 == 0, "input").otherwise("output")}),
        "clock": (b.table(spark, d, "nation").withColumn("name", F.col("n_name")), {"period": 10 + F.col("n_regionkey")}),
        "net": (b.table(spark, d, "orders").withColumn("name", F.col("o_orderkey").cast("string")), {"name": F.col("o_orderpriority")}),
    }
    return sel._concat([properties(df, cls, props) for cls, (df, props) in views.items()])


def properties(df, cls, props):
    """Long (class, name, prop, value) rows of a wide object view."""
    pairs = F.array(*[F.struct(F.lit(k).alias("prop"), e.cast("string").alias("value")) for k, e in props.items()])
    return df.select(F.lit(cls).alias("class"), F.col("name"), F.explode(pairs).alias("x")).select("class", "name", "x.*")


@query("b12_scope_filter", f"WITH {I_SQL} SELECT inst_id, substr(path, 6) AS name FROM insts WHERE path LIKE 'ASIA%'")
def b12(spark, d):
    return sel.in_scope(insts(spark, d).withColumnRenamed("path", "name"), "name", "ASIA").select("inst_id", "name")


@query("b13_type_filter", """WITH s AS (SELECT c_custkey AS sig_id, CASE c_custkey % 5 WHEN 0 THEN 'wire' WHEN 1 THEN 'reg' WHEN 2 THEN 'tri' WHEN 3 THEN 'real' ELSE 'integer' END AS type FROM customer)
  SELECT 'activity' AS use, sig_id FROM s WHERE type IN ('wire','reg') UNION ALL SELECT 'statistics', sig_id FROM s WHERE type IN ('wire','reg','tri')""")
def b13(spark, d):
    k = F.col("c_custkey") % 5
    s = b.table(spark, d, "customer").select(F.col("c_custkey").alias("sig_id"), F.when(k == 0, "wire").when(k == 1, "reg").when(k == 2, "tri").when(k == 3, "real").otherwise("integer").alias("type"))
    return sel.of_types(s, sel.ACTIVITY_TYPES).select(F.lit("activity").alias("use"), "sig_id").unionAll(
        sel.of_types(s, sel.STATISTIC_TYPES).select(F.lit("statistics"), "sig_id"))


ROLE = "CASE l_returnflag WHEN 'A' THEN 'setup' WHEN 'R' THEN 'reg_clk_q' ELSE 'combinational' END"


def lib_edges(spark, d):
    role = F.when(F.col("l_returnflag") == "A", "setup").when(F.col("l_returnflag") == "R", "reg_clk_q").otherwise("combinational")
    return b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_pin"), F.col("l_orderkey").alias("to_pin"), role.alias("role"),
                                                F.col("l_suppkey").alias("inst_id"), "l_linenumber", "l_linestatus", "l_quantity")


@query("b14_all_registers", f"""WITH e AS (SELECT l_partkey AS f, l_orderkey AS t, l_suppkey AS i, {ROLE} AS role, l_linestatus AS ls FROM lineitem),
  clk AS (SELECT p_partkey AS f FROM part WHERE p_size <= 25)
  SELECT DISTINCT 'data' AS kind, t AS obj FROM e WHERE role='setup' AND ls='F' AND f IN (SELECT f FROM clk) UNION ALL SELECT DISTINCT 'clock', f FROM e WHERE role IN ('setup','reg_clk_q') AND ls='F' AND f IN (SELECT f FROM clk)
  UNION ALL SELECT DISTINCT 'output', t FROM e WHERE role='reg_clk_q' AND ls='F' AND f IN (SELECT f FROM clk) UNION ALL SELECT DISTINCT 'instance', i FROM e WHERE role IN ('setup','reg_clk_q') AND ls='F' AND f IN (SELECT f FROM clk)""")
def b14(spark, d):
    """Registers clocked by the rising edge (linestatus F) of the clocks with p_size <= 25."""
    clk = b.table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("from_pin"))
    return registers(sel.intersects(lib_edges(spark, d).filter("l_linestatus = 'F'"), clk, ["from_pin"]))


def registers(edges):
    """(kind, obj) of register data / clock / output pins and instances, from edge roles."""
    reg = edges.filter(F.col("role").isin("setup", "reg_clk_q"))
    kinds = F.array(
        F.when(F.col("role") == "setup", F.struct(F.lit("data").alias("kind"), F.col("to_pin").alias("obj"))),
        F.struct(F.lit("clock").alias("kind"), F.col("from_pin").alias("obj")),
        F.when(F.col("role") == "reg_clk_q", F.struct(F.lit("output").alias("kind"), F.col("to_pin").alias("obj"))),
        F.struct(F.lit("instance").alias("kind"), F.col("inst_id").alias("obj")))
    return reg.select(F.explode(F.array_compact(kinds)).alias("x")).select("x.*").distinct()


@query("b15_sorted_names", f"WITH {I_SQL} SELECT path AS full_name, c_name AS name FROM insts ORDER BY path")
def b15(spark, d):
    return insts(spark, d).orderBy("path").select(F.col("path").alias("full_name"), nm.last_level(F.col("path")).alias("name"))


@query("b16_delete_from_list", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def b16(spark, d):
    gone = b.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return sel.subtract(b.table(spark, d, "orders"), gone, ["o_orderkey"]).select("o_orderkey")


@query("b17_timing_edges", f"WITH e AS (SELECT l_partkey AS from_pin, l_orderkey AS to_pin, {ROLE} AS role FROM lineitem) SELECT e.* FROM e JOIN part ON p_partkey = from_pin WHERE p_brand = 'Brand#7' AND role <> 'combinational'")
def b17(spark, d):
    own = b.table(spark, d, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("from_pin"))
    return sel.intersects(lib_edges(spark, d), own, ["from_pin"]).filter("role <> 'combinational'").select("from_pin", "to_pin", "role")


@query("b18_net_detail", f"""WITH {I_SQL}, {P_SQL} SELECT inst_id AS net_id, count(*) FILTER (dir IN ('output','inout')) AS n_driver, count(*) FILTER (dir IN ('input','inout')) AS n_load,
  count(*) AS n_pin, round(min(o_totalprice),2) AS min_cap, round(max(o_totalprice),2) AS max_cap FROM pins GROUP BY inst_id""")
def b18(spark, d):
    return net_detail(pins(spark, d).withColumn("net_id", F.col("inst_id")), "o_totalprice").select(
        "net_id", "n_driver", "n_load", "n_pin", F.round("min_cap", 2).alias("min_cap"), F.round("max_cap", 2).alias("max_cap"))


def net_detail(pins, cap):
    drv, load = F.col("dir").isin("output", "inout"), F.col("dir").isin("input", "inout")
    return pins.groupBy("net_id").agg(F.count_if(drv).alias("n_driver"), F.count_if(load).alias("n_load"), F.count("*").alias("n_pin"),
                                      F.min(cap).alias("min_cap"), F.max(cap).alias("max_cap"))


@query("b19_clock_properties", """SELECT s_name AS clk, 5e0 + s_suppkey % 7 AS period, 0e0 AS rise_edge, (5e0 + s_suppkey % 7) / 2 AS fall_edge, s_nationkey > 12 AS propagated,
  CASE WHEN s_suppkey % 3 = 0 THEN 'generated' ELSE 'source' END AS kind FROM supplier""")
def b19(spark, d):
    s = b.table(spark, d, "supplier").withColumn("period", 5.0 + F.col("s_suppkey") % 7).withColumn("waveform", F.array(F.lit(0.0), F.col("period") / 2))
    return s.select(F.col("s_name").alias("clk"), "period", F.col("waveform")[0].alias("rise_edge"), F.col("waveform")[1].alias("fall_edge"),
                    (F.col("s_nationkey") > 12).alias("propagated"), F.when(F.col("s_suppkey") % 3 == 0, "generated").otherwise("source").alias("kind"))


@query("b20_report_slews", """SELECT l_partkey AS pin, l_linestatus AS rf, max(CASE WHEN l_returnflag='A' THEN l_tax END) AS slow, max(CASE WHEN l_returnflag='N' THEN l_tax END) AS typ,
  max(CASE WHEN l_returnflag='R' THEN l_tax END) AS fast FROM lineitem GROUP BY 1, 2""")
def b20(spark, d):
    s = b.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pin"), F.col("l_linestatus").alias("rf")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_tax"))
    return s.withColumnsRenamed({"A": "slow", "N": "typ", "R": "fast"})


# ---------------------------------------------------------------- joins
@query("c1_cell_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS cell_name, p_type AS kind, p_retailprice * p_size AS area FROM lineitem JOIN part ON p_partkey = l_partkey")
def c1(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("cell_name"), F.col("p_type").alias("kind"), (F.col("p_retailprice") * F.col("p_size")).alias("area"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey")


@query("c2_annotate_signals", f"""WITH {I_SQL}, s AS (SELECT inst_id AS sig_id, CASE inst_id % 4 WHEN 0 THEN path WHEN 1 THEN path || '/q' WHEN 2 THEN r_name || '/' || n_name || '\\/' || c_name ELSE 'no' || path END AS name, inst_id FROM insts)
  SELECT sig_id, CASE WHEN inst_id % 4 < 3 THEN inst_id END AS net_id, CASE inst_id % 4 WHEN 0 THEN 'net' WHEN 1 THEN 'pin' WHEN 2 THEN 'alias' END AS match FROM s""")
def c2(spark, d):
    i = insts(spark, d)
    k = F.col("inst_id") % 4
    s = i.select(F.col("inst_id").alias("sig_id"), F.when(k == 0, F.col("path")).when(k == 1, F.concat("path", F.lit("/q")))
                 .when(k == 2, F.concat("r_name", F.lit("/"), "n_name", F.lit("\\/"), "c_name")).otherwise(F.concat(F.lit("no"), "path")).alias("name"))
    nets = i.select("path", F.col("inst_id").alias("net_id"))
    pin = i.select(F.concat("path", F.lit("/q")).alias("path"), F.col("inst_id").alias("net_id"))
    return sel.annotate_signals(s, nets, pin).select("sig_id", "net_id", "match")


@query("c3_drivers_to_loads", """SELECT d.l_orderkey AS net_id, d.l_partkey AS driver, d.l_linenumber AS drv_no, l.l_partkey AS load, l.l_linenumber AS load_no
  FROM (SELECT l_orderkey, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey) d
  JOIN lineitem l ON l.l_orderkey = d.l_orderkey""")
def c3(spark, d):
    """The first line of an order drives its net, every line loads it."""
    li = b.table(spark, d, "lineitem")
    first = F.col("l_linenumber") * F.lit(1000000000).cast("bigint") + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    drv = li.groupBy("l_orderkey").agg(F.min_by("l_partkey", first).alias("driver"), F.min("l_linenumber").alias("drv_no"))
    load = li.select("l_orderkey", F.col("l_partkey").alias("load"), F.col("l_linenumber").alias("load_no"))
    return drivers_to_loads(drv, load, "l_orderkey").withColumnRenamed("l_orderkey", "net_id")


def drivers_to_loads(drivers, loads, net):
    """Each driver with the loads of its net; a net has few drivers, so rows grow with the loads."""
    return drivers.join(loads, net)


@query("c13_unmatched", "SELECT 'no_order' AS what, c_custkey AS obj FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no_line', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def c13(spark, d):
    c, o, li = (b.table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    a = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("no_order").alias("what"), F.col("c_custkey").alias("obj"))
    return a.unionAll(o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select(F.lit("no_line"), "o_orderkey"))


@query("c14_intersecting", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R')")
def c14(spark, d):
    o = b.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    li = sel.intersects(b.table(spark, d, "lineitem").filter("l_returnflag = 'R'"), o, ["l_orderkey"]).select(F.col("l_partkey").alias("p_partkey"))
    return sel.intersects(b.table(spark, d, "part"), li, ["p_partkey"]).select("p_partkey")


@query("c15_fallback_chain", """WITH g AS (SELECT 3e-1 AS a), u AS (SELECT l_partkey, max(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 48 GROUP BY 1),
  pr AS (SELECT l_partkey, min(l_tax) AS a FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
  SELECT p_partkey, CASE WHEN p_size = 1 THEN 0e0 WHEN p_type = 'PROMO' THEN coalesce(u.a, 2e0) WHEN pr.a IS NOT NULL THEN pr.a WHEN u.a IS NOT NULL THEN u.a ELSE 0e0 END AS activity,
   CASE WHEN p_size = 1 THEN 'constant' WHEN p_type = 'PROMO' AND u.a IS NOT NULL THEN 'user' WHEN p_type = 'PROMO' THEN 'clock' WHEN pr.a IS NOT NULL THEN 'propagated' WHEN u.a IS NOT NULL THEN 'user' ELSE 'unknown' END AS origin
  FROM part LEFT JOIN u ON u.l_partkey = p_partkey LEFT JOIN pr ON pr.l_partkey = p_partkey""")
def c15(spark, d):
    from ..operators.activity import resolve_activity
    li, p = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    user = li.filter("l_returnflag = 'R' and l_linestatus = 'O' and l_quantity > 48").groupBy(F.col("l_partkey").alias("pin_id")).agg(F.max("l_quantity").alias("activity"))
    prop = li.filter("l_quantity > 40").groupBy(F.col("l_partkey").alias("pin_id")).agg(F.min("l_tax").alias("activity"))
    pins_ = p.select(F.col("p_partkey").alias("pin_id"), (F.col("p_size") == 1).alias("is_constant"), (F.col("p_type") == "PROMO").alias("is_clock"))
    out = resolve_activity(pins_, user, prop, global_activity=None)
    return out.select(F.col("pin_id").alias("p_partkey"), "activity", "origin")


@query("c16_override", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(i.f, c.f, 11e-1) AS factor FROM lineitem
  LEFT JOIN (SELECT s_suppkey, 1 + s_nationkey / 100e0 AS f FROM supplier WHERE s_nationkey < 5) i ON i.s_suppkey = l_suppkey
  LEFT JOIN (SELECT p_partkey, 1 - p_size / 100e0 AS f FROM part WHERE p_size > 30) c ON c.p_partkey = l_partkey""")
def c16(spark, d):
    inst = b.table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"), (1 + F.col("s_nationkey") / 100.0).alias("factor"))
    cell = b.table(spark, d, "part").filter("p_size > 30").select(F.col("p_partkey").alias("l_partkey"), (1 - F.col("p_size") / 100.0).alias("factor"))
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sel.override(li, [(inst, ["l_suppkey"]), (cell, ["l_partkey"])], "factor", F.lit(1.1))


@query("c17_corner_fanout", """SELECT l_partkey, c.corner, CAST(sum(CAST(l_quantity AS BIGINT) * c.k) AS BIGINT) AS delay FROM lineitem, (VALUES ('fast',2),('typ',3),('slow',4)) AS c(corner,k) GROUP BY 1,2""")
def c17(spark, d):
    """Aggregate first, then fan the small result out to the corners."""
    one = b.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return one.select("l_partkey", "q", F.explode(F.create_map(F.lit("fast"), F.lit(2), F.lit("typ"), F.lit(3), F.lit("slow"), F.lit(4))).alias("corner", "k")).select(
        "l_partkey", "corner", (F.col("q") * F.col("k")).alias("delay"))


@query("c10_slice_of_time", f"WITH {b.EV0}, s AS (SELECT *, coalesce(lead(lo) OVER (ORDER BY lo), 9e18::BIGINT) AS hi FROM (VALUES (CAST(0 AS BIGINT)),({50*b.HOUR}),({200*b.HOUR}),({500*b.HOUR})) AS v(lo)) SELECT seq, (SELECT count(*) FROM s WHERE lo <= t) - 1 AS slice FROM ev0")
def c10(spark, d):
    bounds = F.array(*[F.lit(x * b.HOUR) for x in (50, 200, 500)])
    return b.raw_events(spark, d).select("seq", F.size(F.filter(bounds, lambda x: x <= F.col("t"))).cast("bigint").alias("slice"))


# ---------------------------------------------------------------- sets, order
@query("f3_set_operations", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40 AND l_returnflag='R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 5 AND l_returnflag='A')
  SELECT 'except' AS op, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def f3(spark, d):
    li = b.table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    x, y = li.filter("l_quantity > 40 and l_returnflag='R'").select("k"), li.filter("l_quantity < 5 and l_returnflag='A'").select("k")
    return x.subtract(y).select(F.lit("except").alias("op"), "k").unionAll(x.intersect(y).select(F.lit("intersect"), "k"))


@query("f3_compare_sets", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='O')
  SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, FALSE AS equal""")
def f3b(spark, d):
    o = b.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return sel.compare_sets(o.filter("o_orderstatus='F'").select("k"), o.filter("o_orderstatus='O'").select("k"), ["k"]).select(
        F.col("n_left").cast("bigint").alias("n_left"), F.col("n_right").cast("bigint").alias("n_right"), F.col("n_both").cast("bigint").alias("n_both"), "equal")


@query("f4_union_all_vs_distinct", "SELECT 'all' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_tax=0 UNION ALL SELECT l_partkey FROM lineitem WHERE l_discount=0) UNION ALL SELECT 'distinct', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_tax=0 UNION SELECT l_partkey FROM lineitem WHERE l_discount=0)")
def f4(spark, d):
    li = b.table(spark, d, "lineitem")
    u = li.filter("l_tax=0").select("l_partkey").unionAll(li.filter("l_discount=0").select("l_partkey"))
    return u.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n").unionAll(u.distinct().agg(F.count("*").alias("n")).select(F.lit("distinct"), "n"))


@query("f7_fuzzy_tie_order", """SELECT o_custkey, arg_min(o_orderkey, CAST(round(o_totalprice / 1000) AS BIGINT) * 1000000000 + o_orderkey) AS first_order FROM orders GROUP BY o_custkey""")
def f7(spark, d):
    """Near-equal slacks tie; the lower index then wins."""
    o = b.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.round(F.col("o_totalprice") / 1000).cast("bigint"), "o_orderkey")).alias("first_order"))


# ---------------------------------------------------------------- scalars
@query("k7_units", "SELECT o_orderkey, o_totalprice / 1e3 AS kilo, printf('%.5f', o_totalprice / 1e3) || 'kOhm' AS label FROM orders")
def k7(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", nm.to_unit(F.col("o_totalprice"), "k").alias("kilo"), nm.format_unit(F.col("o_totalprice"), "k", "Ohm", 5).alias("label"))


@query("k8_fuzzy_compare", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 / 10 = l_discount OR (l_discount <> 0 AND abs(l_discount*10/10 - l_discount) < 1e-6 * greatest(l_discount*10/10, l_discount)) AS eq,
   l_tax < l_discount AND abs(l_tax - l_discount) >= 1e-6 * greatest(l_tax, l_discount) AS lt FROM lineitem""")
def k8(spark, d):
    x, t = F.col("l_discount"), F.col("l_tax")
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nm.fuzzy_equal(x * 10 / 10, x).alias("eq"), nm.fuzzy_less(t, x).alias("lt"))


BN = "CASE p_partkey % 4 WHEN 0 THEN p_name || '[' || CAST(p_size AS VARCHAR) || ':0]' WHEN 1 THEN p_name || '[' || CAST(p_size AS VARCHAR) || ']' WHEN 2 THEN p_name || '[*]' ELSE p_name END"


@query("k9_bus_name", f"""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS base, CASE WHEN p_partkey % 4 < 2 THEN p_size END AS "from",
  CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size END AS "to", CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 = 2 END AS wildcard FROM part""")
def k9(spark, d):
    k, n, s = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(n, F.lit("["), s, F.lit(":0]"))).when(k == 1, F.concat(n, F.lit("["), s, F.lit("]"))).when(k == 2, F.concat(n, F.lit("[*]"))).otherwise(n)
    return b.table(spark, d, "part").select("p_partkey", nm.bus_parts(name).alias("x")).select("p_partkey", "x.*")


@query("k10_escape_names", r"""SELECT page_id, replace(url, '/', '\/') AS escaped, url AS back, '\' || url || ' ' AS netlist, url AS plain,
  CASE WHEN contains(url, '/') THEN left(url, length(url) - strpos(reverse(url), '/')) || '|' || right(url, strpos(reverse(url), '/') - 1) ELSE url END AS last_swapped FROM pages""")
def k10(spark, d):
    u = F.col("url")
    e, n = nm.escape_divider(u), nm.to_netlist_name(u)
    return b.table(spark, d, "pages").select("page_id", e.alias("escaped"), nm.unescape(e).alias("back"), n.alias("netlist"), nm.from_netlist_name(n).alias("plain"),
                                             nm.replace_last(u, "/", "|").alias("last_swapped"))


@query("k11_path_levels", "SELECT page_id, split_part(url,'/',1) AS first, split_part(url,'/',-1) AS last, CAST(len(string_split(url,'/')) AS INT) AS depth FROM pages")
def k11(spark, d):
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", nm.first_level(u).alias("first"), nm.last_level(u).alias("last"), nm.depth(u).alias("depth"))


@query("k15_pin_voltage", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN p_size > 25 THEN p_size / 10e0 END, CASE WHEN s_nationkey < 10 THEN 12e-1 END, CASE WHEN p_type='PROMO' THEN 9e-1 END, 0e0) AS volt
  FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey""")
def k15(spark, d):
    """Supply of the pin's power pin, else operating condition, else library default, else 0."""
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.col("p_size") / 10.0).alias("v1"), F.when(F.col("p_type") == "PROMO", 0.9).alias("v3"))
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_nationkey") < 10, 1.2).alias("v2"))
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(p, "l_partkey").join(s, "l_suppkey").select(*li.columns, F.coalesce("v1", "v2", "v3", F.lit(0.0)).alias("volt"))


@query("k16_clip_activity", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 1e-9 < 1e-10 THEN 0 ELSE l_discount * 1e-9 END AS activity FROM lineitem")
def k16(spark, d):
    a = F.col("l_discount") * 1e-9
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.abs(a) < 1e-10, 0.0).otherwise(a).alias("activity"))


@query("k17_clock_duty", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN (3e0 + s_nationkey % 4) / (10 + s_nationkey % 3) WHEN s_suppkey % 2 = 0 THEN 5e-1 ELSE (3e0 + (s_nationkey + 1) % 4) / (10 + (s_nationkey + 1) % 3) END AS duty FROM supplier")
def k17(spark, d):
    """Own high time over period; a generated clock uses its master's, 0.5 when it has none."""
    s = b.table(spark, d, "supplier")
    def duty(n):
        return (3.0 + n % 4) / (10 + n % 3)
    gen, orphan = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 2 == 0
    return s.select("s_suppkey", F.when(~gen, duty(F.col("s_nationkey"))).when(orphan, 0.5).otherwise(duty(F.col("s_nationkey") + 1)).alias("duty"))


@query("k18_max_frequency", "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN round(1e-6 / ((p_size % 5) * 1e-9), 6) END AS mhz FROM part")
def k18(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.round(nm.max_frequency_mhz((F.col("p_size") % 5) * 1e-9), 6).alias("mhz"))


@query("d8_circuit_statistics", """WITH g AS (SELECT o_custkey AS gate, count(*) AS n_pin, CAST(sum(n_ev) AS BIGINT) AS n_event FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_ev FROM lineitem GROUP BY 1) e ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT coalesce(c_mktsegment, 'total') AS class, count(*) AS n_gate, CAST(sum(n_pin) AS BIGINT) AS n_pin, CAST(sum(coalesce(n_event,0)) AS BIGINT) AS n_event, min(n_pin) AS min_pin, max(n_pin) AS max_pin, min(n_event) AS min_event, max(n_event) AS max_event
  FROM g JOIN customer ON c_custkey = gate GROUP BY ROLLUP (c_mktsegment)""")
def d8(spark, d):
    n = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_ev"))
    g = b.table(spark, d, "orders").join(n, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_pin"), F.sum("n_ev").alias("n_event"))
    c = b.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    r = g.join(c, "c_custkey").rollup("c_mktsegment").agg(
        F.count("*").alias("n_gate"), F.sum("n_pin").alias("n_pin"), F.sum(F.coalesce("n_event", F.lit(0))).alias("n_event"), F.min("n_pin").alias("min_pin"),
        F.max("n_pin").alias("max_pin"), F.min("n_event").alias("min_event"), F.max("n_event").alias("max_event"))
    return r.withColumn("class", F.coalesce("c_mktsegment", F.lit("total"))).drop("c_mktsegment")


@query("d9_pin_count_coverage", """WITH g AS (SELECT l_partkey, count(*) AS n_pin, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_event FROM lineitem GROUP BY 1)
  SELECT CAST(t AS INT) AS threshold, count(*) FILTER (n_pin > t) AS n_gate, CAST(coalesce(sum(n_event) FILTER (n_pin > t),0) AS BIGINT) AS n_event, round(count(*) FILTER (n_pin > t) / count(*)::DOUBLE, 9) AS ratio FROM g, (VALUES (4),(8),(16),(32)) AS v(t) GROUP BY t""")
def d9(spark, d):
    """A part is a gate, each of its lines a pin with as many events as its quantity."""
    g = b.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_pin"), F.sum(F.col("l_quantity").cast("bigint")).alias("n_event"))
    return ac.pin_count_coverage(g).withColumn("ratio", F.round("ratio", 9))


@query("d17_percentiles", "WITH g AS (SELECT l_partkey, l_orderkey % 10 AS grp, count(*) AS n FROM lineitem GROUP BY 1,2) SELECT grp, round(quantile_cont(n,0.5),6) AS p50, round(quantile_cont(n,0.9),6) AS p90, round(quantile_cont(n,0.99),6) AS p99 FROM g GROUP BY grp")
def d17(spark, d):
    """Exact percentiles from value counts, so a group's rows never meet in one buffer."""
    g = b.table(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_orderkey") % 10).alias("grp")).agg(F.count("*").alias("n"))
    h = g.groupBy("grp", "n").agg(F.count("*").alias("w"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("w"))
    return h.groupBy("grp").agg(q.alias("q")).select("grp", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("d18_work_summary", """WITH g AS (SELECT l_partkey, count(*) AS n_event FROM lineitem GROUP BY 1), w AS (SELECT l_partkey, n_event, greatest(1, CAST(ceil(n_event / 8e0) AS BIGINT)) AS active FROM g),
  x AS (SELECT *, CAST(ceil(active / 32e0) AS BIGINT) * 32 AS launched FROM w) SELECT count(*) AS n_gate, CAST(sum(active) AS BIGINT) AS active, CAST(sum(launched) AS BIGINT) AS launched, CAST(sum(launched-active) AS BIGINT) AS padding,
  count(*) FILTER (n_event < 8) AS n_sparse, round(sum(2 * (1 + log2(n_event))), 4) AS search_cost FROM x""")
def d18(spark, d):
    g = b.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_event"))
    active = F.greatest(F.lit(1), F.ceil(F.col("n_event") / 8.0))
    x = g.withColumn("active", active).withColumn("launched", F.ceil(F.col("active") / 32.0) * 32)
    return x.agg(F.count("*").alias("n_gate"), F.sum("active").alias("active"), F.sum("launched").alias("launched"), F.sum(F.col("launched") - F.col("active")).alias("padding"),
                 F.count_if(F.col("n_event") < 8).alias("n_sparse"), F.round(F.sum(2 * (1 + F.log2("n_event"))), 4).alias("search_cost"))


@query("d22_fanout_load", "SELECT l_orderkey AS net_id, CAST(sum(CASE WHEN p_size > 10 THEN p_size WHEN p_type='PROMO' THEN 2 ELSE 1 END) AS BIGINT) AS fanout_load, count(*) AS n_load FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1")
def d22(spark, d):
    """Pin's own load, else the library default, else 1; pre-summed per (net, cell)."""
    li = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 10, F.col("p_size")).when(F.col("p_type") == "PROMO", 2).otherwise(1).alias("fl"))
    return li.join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("net_id")).agg(F.sum(F.col("fl") * F.col("n")).alias("fanout_load"), F.sum("n").alias("n_load"))


@query("d23_net_capacitance",
       "SELECT l_orderkey AS net_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pin_cap, round(any_value(o_totalprice), 2) AS wire_cap, CAST(min(l_quantity) AS BIGINT) AS min_cap, CAST(max(l_quantity) AS BIGINT) AS max_cap FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1")
def d23(spark, d):
    q = F.col("l_quantity").cast("bigint")
    n = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("net_id")).agg(F.sum(q).alias("pin_cap"), F.min(q).alias("min_cap"), F.max(q).alias("max_cap"))
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("net_id"), F.round("o_totalprice", 2).alias("wire_cap"))
    return n.join(o, "net_id")


@query("d24_annotation_coverage", "SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (l_tax > 0) AS n_annotated, count(*) FILTER (l_tax = 0) AS n_missing FROM lineitem GROUP BY 1")
def d24(spark, d):
    return b.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0).alias("n_annotated"), F.count_if(F.col("l_tax") == 0).alias("n_missing"))


@query("d25_object_counts", "SELECT 'pins' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'nets', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'instances', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'leafs', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def d25(spark, d):
    li = b.table(spark, d, "lineitem")
    def n(df, k):
        return df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return sel._concat([n(li, "pins"), n(li.select("l_orderkey").distinct(), "nets"), n(li.select("l_suppkey").distinct(), "instances"), n(li.select("l_suppkey", "l_partkey").distinct(), "leafs")])


@query("d16_two_phase_sum", "SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2")
def d16(spark, d):
    return b.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count("*").alias("n"))
