"""Timing checks: path ends, limits, skew, pulse width, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut


def top_paths(ends: DataFrame, per_end: int, per_group: int, group: str = "clk", rank_by: str = "slack") -> DataFrame:
    """The worst ``per_end`` paths of each end point, then the worst ``per_group`` of each group.

    Both limits are applied inside each task before the shuffle, so a group holding a
    third of all ends sends only its first rows to the ranking task.
    """
    w1 = W.partitionBy("v", group).orderBy(rank_by, "rf")
    w2 = W.partitionBy(group).orderBy(rank_by, "v", "rf")
    first = ends.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= per_end).drop("_r")
    return first.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= per_group)


# ------------------------------------------------------------------ path ends
def setup_required(capture: Column, margin: Column, credit: Column, uncertainty: Column) -> Column:
    """Latest allowed data time: capture edge less margin and uncertainty plus credit."""
    return capture - margin - uncertainty + credit


def hold_required(capture: Column, margin: Column, credit: Column, uncertainty: Column) -> Column:
    return capture + margin + uncertainty - credit


def register_ends(ends: DataFrame) -> DataFrame:
    """Required time and slack of register checks.

    Needs kind (setup / recovery / hold / removal), a_max, a_min, capture, margin,
    credit, uncertainty. The late kinds use the latest arrival, the early kinds the earliest.
    """
    late = F.col("kind").isin("setup", "recovery", "output_setup", "gate_setup", "data_setup")
    args = [F.col(c) for c in ("capture", "margin", "credit", "uncertainty")]
    req = F.when(late, setup_required(*args)).otherwise(hold_required(*args))
    return ends.withColumn("required", req).withColumn(
        "slack", F.when(late, F.col("required") - F.col("a_max")).otherwise(F.col("a_min") - F.col("required")))


def output_required(capture: Column, ext_delay: Column, late: bool) -> Column:
    """An external delay leaves that much less of the cycle (late) or must be covered (early)."""
    return capture - ext_delay


def latch_borrow(data: Column, enable: Column, max_borrow: Column, uncertainty: Column, credit: Column, shift: Column):
    """struct(required, borrow, adjusted, given) of a transparent latch.

    Data before the opening edge waits for it; later data borrows time up to the limit.
    """
    early = data <= enable
    want = data - enable
    borrow = F.when(early, 0).otherwise(F.least(want, max_borrow))
    req = F.when(early, enable).when(want <= max_borrow, data).otherwise(enable + max_borrow)
    return F.struct(
        req.alias("required"), borrow.alias("borrow"),
        F.when(early, data).otherwise(req + shift).alias("adjusted"),
        F.when(early, 0).otherwise(borrow + uncertainty + credit).alias("given"))


def latch_max_borrow(limit: Column, pulse_width: Column, latency_diff: Column, credit_diff: Column, margin: Column) -> Column:
    return F.coalesce(limit, pulse_width - latency_diff - credit_diff - margin)


def pulse_width(open_t: Column, close_t: Column, open_edge: Column, close_edge: Column, period: Column, credit: Column) -> Column:
    """Close minus open, one period later when the closing edge comes first in the waveform."""
    return close_t + F.when(open_edge > close_edge, period).otherwise(0) - open_t + credit


def tightest(*limits: Column, lower: bool = False) -> Column:
    """Smallest upper limit or largest lower limit; missing ones do not count."""
    return F.greatest(*limits) if lower else F.least(*limits)


def limit_slack(value: Column, limit: Column, lower: bool = False) -> Column:
    return value - limit if lower else limit - value


def common_path_credit(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pessimism credit of launch/capture clock paths.

    ``pairs``: pair_id, launch_path, capture_path (source first). The last pin common to both
    gives min(late - early) of its two sides. Pin names ask for the same pin; pin/edge
    names ask for the same pin and the same edge.
    """
    common = F.array_intersect("launch_path", "capture_path")
    p = pairs.withColumn("node", F.try_element_at(common, F.lit(-1)))
    j = p.join(nodes, "node", "left")
    gap = F.least(F.col("launch_late") - F.col("launch_early"), F.col("capture_late") - F.col("capture_early"))
    return j.withColumn("credit", F.coalesce(gap, F.lit(0)))


def clock_skew(pairs: DataFrame) -> DataFrame:
    """Worst skew per (clock, kind): latest launch less earliest capture for setup, reversed for hold."""
    rows = pairs.select("clk", "launch", "capture", F.explode(F.array(
        F.struct(F.lit("setup").alias("kind"), (F.col("l_late") - F.col("c_early")).alias("skew")),
        F.struct(F.lit("hold").alias("kind"), (F.col("l_early") - F.col("c_late")).alias("skew")))).alias("x")).select("clk", "launch", "capture", "x.*")
    key = F.struct(F.abs("skew").alias("a"), "launch", "capture", "skew")
    return rows.groupBy("clk", "kind").agg(F.max(key).alias("w")).select("clk", "kind", F.col("w.skew").alias("skew"), F.col("w.launch").alias("launch"), F.col("w.capture").alias("capture"))


def min_period(ends: DataFrame) -> DataFrame:
    """Smallest period at which every same-edge single-cycle path of a clock still meets setup."""
    e = ends.filter("launch_clk = capture_clk and launch_rf = capture_rf and not multicycle")
    return e.groupBy(F.col("launch_clk").alias("clk")).agg(F.max(F.col("period") - F.col("slack")).alias("min_period"))


# ------------------------------------------------------------------ report over all kinds
#: Kinds of a check report, late and early side first, as users name them.
CHECK_KINDS = ("setup", "hold", "recovery", "removal", "gate_setup", "gate_hold", "max_slew", "min_slew", "max_fanout", "min_fanout",
               "max_capacitance", "min_capacitance", "min_pulse_width", "min_period", "max_skew")


def check_rows(rows: DataFrame, kind: Column | str, obj: Sequence[str | Column], slack: str = "slack") -> DataFrame:
    """(check, obj, slack) of one check table; ``obj`` columns are joined by a slash, rows without a slack are left out."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(name.alias("check"), F.concat_ws("/", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in obj]).alias("obj"),
                       F.col(slack).cast("double").alias("slack")).filter("slack is not null")


def check_report(rows: DataFrame, kinds: Sequence[str] = CHECK_KINDS, violators: bool = False) -> DataFrame:
    """The worst object of each chosen kind, or with ``violators`` every one of negative slack. Ties go to the first name.

    ``rows``: unions of ``check_rows``. The worst is a plain aggregate, so a kind with a third of all rows sends one row a task.
    """
    unknown = set(kinds) - set(CHECK_KINDS)
    if unknown:
        raise ValueError(f"no such checks: {sorted(unknown)}")
    some = rows.filter(F.col("check").isin(*kinds))
    if violators:
        return some.filter("slack < 0").select("check", "obj", "slack")
    worst = some.groupBy("check").agg(F.min(F.struct("slack", "obj")).alias("_w"))
    return worst.select("check", F.col("_w.obj").alias("obj"), F.col("_w.slack").alias("slack"))


def violators_and_worst(rows: DataFrame, kinds: Sequence[str] = CHECK_KINDS) -> tuple[DataFrame, DataFrame]:
    """Both reports of ``check_report``. Only violators are written; the worst of a kind is one of them, and only kinds without any are read again."""
    bad = cut(check_report(rows, kinds, violators=True))
    found = sorted(r[0] for r in bad.select("check").distinct().collect())
    calm = [k for k in kinds if k not in found]
    worst = check_report(bad, found)
    return bad, worst.unionByName(check_report(rows, calm)) if calm else worst
