"""Domain tables made from the benchmark tables, with the same rules as SQL text.

Each function returns a domain table for Spark; the upper-case strings hold the
same table as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.logic import state_bit  # noqa: F401
from ..operators import events as ev
from ..operators.ordered import plan_block_ticks

HOUR = 3_600_000_000  # ticks (micro-seconds) per hour
T6 = 6 * HOUR         # clock cycle of the event tables
N_PIN = 3             # pins per gate: two inputs, then the output


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- event log
def raw_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01' as timestamp))")
    kind = F.col("event_type")
    v = (F.when(kind.isin("click", "purchase"), 1)
         .when((kind == "error") & (F.col("event_id") % 4 == 0), 3)
         .when(kind == "error", 2).otherwise(0))
    return e.select(
        F.col("user_id").alias("sig_id"), F.expr("user_id div 3").alias("gate"),
        (F.col("user_id") % 3).cast("int").alias("pin_idx"), t.alias("t"),
        F.col("event_id").alias("seq"), v.alias("v"))


EV0 = """ev0 AS (
  SELECT user_id AS sig_id, user_id // 3 AS gate, CAST(user_id % 3 AS INT) AS pin_idx,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t, event_id AS seq,
         CASE WHEN event_type IN ('click','purchase') THEN 1 WHEN event_type = 'error' AND event_id % 4 = 0 THEN 3
              WHEN event_type = 'error' THEN 2 ELSE 0 END AS v
  FROM events),
tmax AS (SELECT max(t) AS time_max FROM ev0)"""

CH = EV0 + """,
one AS (SELECT sig_id, gate, pin_idx, t, max(seq) AS seq, arg_max(v, seq) AS v FROM ev0 GROUP BY sig_id, gate, pin_idx, t),
zero AS (SELECT sig_id, gate, pin_idx, CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS seq, 2 AS v
         FROM one GROUP BY sig_id, gate, pin_idx HAVING min(t) > 0),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY sig_id ORDER BY t) AS pv FROM (SELECT * FROM one UNION ALL SELECT * FROM zero)),
ch AS (SELECT * FROM lagged WHERE pv IS NULL OR pv <> v)"""


def time_max(spark: SparkSession, d: str) -> DataFrame:
    """One row, taken in by the callers as a scalar subquery."""
    return raw_events(spark, d).agg(F.max("t").alias("time_max"))


_blocks: dict[tuple, int] = {}


def block_ticks(spark: SparkSession, d: str, keys: tuple[str, ...] = ("gate",)) -> int:
    """Time block of the ordered operators, from the counts of the log; measured once per session, table and key. It decides the plan only, never a result."""
    at = (spark.sparkContext.applicationId, d, keys)
    if at not in _blocks:
        _blocks[at] = plan_block_ticks(raw_events(spark, d), keys, "t", T6)
    return _blocks[at]


def changes(spark: SparkSession, d: str) -> DataFrame:
    return ev.dedup_changes(raw_events(spark, d), block_ticks(spark, d))


# ---------------------------------------------------------------- gates, pins
CLASS_FLAGS = "CASE g % 5 WHEN 0 THEN 'macro' WHEN 1 THEN 'pad' WHEN 2 THEN 'clock' WHEN 3 THEN 'sequential' ELSE 'combinational' END"
CLASSES = "('macro'),('pad'),('clock'),('sequential'),('combinational')"


def gates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").select(F.expr("user_id div 3").alias("gate")).distinct()
    return gate_attributes(g)


def gate_attributes(g: DataFrame) -> DataFrame:
    """Cell and flags of a gate, by rule from its number."""
    k = F.col("gate") % 5
    return g.select(
        "gate", F.concat(F.lit("c"), (F.col("gate") % 4).cast("string")).alias("cell_name"),
        (k == 0).alias("is_macro"), ((k == 1) | (k == 0)).alias("is_pad"),
        (k.isin(2, 1)).alias("is_clock"), (k.isin(3, 2)).alias("has_seq"))


GATES = """gates AS (
  SELECT gate, 'c' || CAST(gate % 4 AS VARCHAR) AS cell_name,
         CASE gate % 5 WHEN 0 THEN 'macro' WHEN 1 THEN 'pad' WHEN 2 THEN 'clock' WHEN 3 THEN 'sequential'
              ELSE 'combinational' END AS class
  FROM (SELECT DISTINCT user_id // 3 AS gate FROM events))"""


def pin_env(df: DataFrame) -> DataFrame:
    """Slews, load and supply of each (gate, pin_idx) row, by rule."""
    g, p = F.col("gate"), F.col("pin_idx")
    return df.withColumns({
        "slew_rise": 0.04 + ((g * 7 + p) % 13) / 50.0,
        "slew_fall": 0.05 + ((g * 3 + p) % 11) / 40.0,
        "load_cap": 0.5 + ((g * 5 + p) % 9) / 2.0,
        "volt": F.when(g % 2 == 0, 1.5).otherwise(1.0)})


ENV = ("(4e-2 + ((gate*7+pin_idx) % 13) / 50e0) AS slew_rise, (5e-2 + ((gate*3+pin_idx) % 11) / 40e0) AS slew_fall, "
       "(5e-1 + ((gate*5+pin_idx) % 9) / 2e0) AS load_cap, CASE WHEN gate % 2 = 0 THEN 15e-1 ELSE 1e0 END AS volt")

# ---------------------------------------------------------------- library
# Leakage rows: cell, order, care mask, value mask, power. Later rows win.
LEAK_ROWS = [
    (f"c{c}", o, care, val, float(p + 11 * c))
    for c in range(4)
    for o, care, val, p in ((0, 0b001, 0b001, 20), (1, 0b011, 0b010, 35), (2, 0b101, 0b101, 50), (3, 0b110, 0b110, 61))
]
DEFAULT_LEAK = [("c0", 5.0), ("c1", 7.0), ("c2", 9.0), ("c3", 0.0)]
# Internal energy rows: cell, toggling pin, related pin (-1: none), order, care, value, edge, base.
# The first matching row wins.
INT_ROWS = [
    (f"c{c}", pin, rel, o, care, val, rf, float(base + 2 * c + (1 if rf == "rise" else 0)))
    for c in range(4)
    for pin, rel, o, care, val, base in (
        (0, -1, 0, 0b010, 0b010, 3), (0, -1, 1, 0b000, 0b000, 8),
        (1, -1, 0, 0b001, 0b001, 4), (1, -1, 1, 0b101, 0b100, 6),
        (2, 0, 0, 0b010, 0b010, 10), (2, 0, 1, 0b000, 0b000, 14),
        (2, 1, 0, 0b001, 0b000, 12), (2, 1, 1, 0b001, 0b001, 17))
    for rf in ("rise", "fall")
]
# Arc delays in ticks: cell, input pin, from edge, to edge, delay. No row: no arc.
ARC_ROWS = [
    (f"c{c}", pin, fr, to, 1_000_000 * (50 + 300 * pin + 90 * c + (400 if fr == "rise" else 0) + (1000 if to == "rise" else 0)))
    for c in range(4) for pin in (0, 1) for fr in ("rise", "fall") for to in ("rise", "fall")
    if not (c == 3 and pin == 1 and fr == to)
]
AX1, AX2 = [0.05, 0.1, 0.2], [0.5, 1.0, 2.0, 4.0]
AX1_SQL, AX2_SQL = "[5e-2, 1e-1, 2e-1]", "[5e-1, 1e0, 2e0, 4e0]"


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    body = ",".join("(" + ",".join(f"'{x}'" if isinstance(x, str) else f"{x:.0f}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({cols}))"


LEAK = _values("leak", "cell_name, ord, care, val, power", LEAK_ROWS)
DEFLEAK = _values("defleak", "cell_name, dpower", DEFAULT_LEAK)
INTP = _values("intp", "cell_name, pin_idx, rel_idx, ord, care, val, rf, base", INT_ROWS)
ARCS = _values("arcs", "cell_name, pin_idx, from_rf, to_rf, delay", ARC_ROWS)


def _inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal table the optimizer knows the size of (no job, no Python rows)."""
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    body = ",".join("(" + ",".join(repr(x) for x in r) + ")" for r in rows)
    pick = ", ".join(f"cast(`{n}` as {t}) as `{n}`" for n, t in cols)
    return spark.sql(f"SELECT {pick} FROM VALUES {body} AS v({', '.join(n for n, _ in cols)})")


def leakage_rows(spark: SparkSession) -> DataFrame:
    return _inline(spark, "cell_name string, ord int, care_mask int, value_mask int, power double", LEAK_ROWS)


def default_leakage(spark: SparkSession) -> DataFrame:
    return _inline(spark, "cell_name string, default_leakage double", DEFAULT_LEAK)


def arc_rows(spark: SparkSession) -> DataFrame:
    return _inline(spark, "cell_name string, pin_idx int, from_rf string, to_rf string, delay bigint", ARC_ROWS)


def int_power_rows(spark: SparkSession) -> DataFrame:
    """Energy tables; entry (i, j) of a table is base + 3i + 2j + ij."""
    df = _inline(spark, "cell_name string, pin_idx int, rel_idx int, ord int, care_mask int, value_mask int, rf string, base double", INT_ROWS)
    idx = F.array(*[F.lit(k) for k in range(len(AX1) * len(AX2))])
    n2 = len(AX2)
    vals = F.transform(idx, lambda k: F.col("base") + 3 * F.floor(k / n2) + 2 * (k % n2) + F.floor(k / n2) * (k % n2))
    return df.select(
        "cell_name", "pin_idx", "rel_idx", "ord", "care_mask", "value_mask", "rf",
        F.array(*[F.lit(x) for x in AX1]).alias("axis1"), F.array(*[F.lit(x) for x in AX2]).alias("axis2"),
        F.transform(vals, lambda x: x.cast("double")).alias("vals"))


def lut_sql(x: str, y: str, base: str) -> str:
    """The same table's bilinear value written with CASE and the entry rule."""
    i = f"(CASE WHEN {x} < 1e-1 THEN 0 ELSE 1 END)"
    j = f"(CASE WHEN {y} < 1e0 THEN 0 WHEN {y} < 2e0 THEN 1 ELSE 2 END)"
    x0, x1 = f"{AX1_SQL}[{i}+1]", f"{AX1_SQL}[{i}+2]"
    y0, y1 = f"{AX2_SQL}[{j}+1]", f"{AX2_SQL}[{j}+2]"
    fx, fy = f"(({x}-{x0})/({x1}-{x0}))", f"(({y}-{y0})/({y1}-{y0}))"

    def at(a, b):
        return f"({base} + 3*({i}+{a}) + 2*({j}+{b}) + ({i}+{a})*({j}+{b}))"
    return (f"((1-{fx})*((1-{fy})*{at(0,0)} + {fy}*{at(0,1)}) + {fx}*((1-{fy})*{at(1,0)} + {fy}*{at(1,1)}))")
