"""Path exceptions with ordered through points: each is an automaton, and the state reached is a key of the sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import sized
from .constraints import exception_priority

STATE = "array<struct<exc:bigint,next:int>>"
FROM, TO = ("from_pin", "from_clk", "from_rf"), ("to_pin", "to_clk", "to_rf")


def _named(exc: DataFrame, fields: Sequence[str]) -> Column:
    out = F.lit(False)
    for f in fields:
        if f in exc.columns:
            out = out | F.col(f).isNotNull()
    return out


def _pairs(rows: DataFrame, exc: DataFrame, fields: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Rows and the exceptions whose named fields equal the row's; grouped by which fields are named, each group an equi-join."""
    on = [f for f in fields if f in exc.columns]
    mask = F.concat_ws(",", *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in on])
    x, out = exc.withColumn("_m", mask), None
    for m in sorted(r[0] for r in x.select("_m").distinct().collect()):  # at most 2^fields kinds
        named = [f for f in m.split(",") if f]
        if not named:
            continue
        part = sized(x.filter(F.col("_m") == m).select("exc_id", *named))
        hit = rows.withColumns({f: F.col(fields[f]) for f in named}).join(part, named).select(*keep, "exc_id")
        out = hit if out is None else out.unionByName(hit)
    return rows.select(*keep, F.lit(None).cast("bigint").alias("exc_id")).limit(0) if out is None else out


def start_states(seeds: DataFrame, exc: DataFrame, clk: str = "clk") -> DataFrame:
    """``seeds`` with ``state``: the exceptions that name a start and name this one, at their first through point. Others start anywhere and are not listed."""
    keys = ["v", "rf", clk]
    hit = _pairs(seeds.select(*keys).distinct(), exc.filter(_named(exc, FROM)), {"from_pin": "v", "from_clk": clk, "from_rf": "rf"}, keys)
    st = hit.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("exc_id").alias("exc"), F.lit(0).alias("next")))).cast(STATE).alias("state"))
    return seeds.join(st.hint("merge"), keys, "left").withColumn("state", F.coalesce("state", F.array().cast(STATE)))


def mark_edges(edges: DataFrame, exc: DataFrame, throughs: DataFrame) -> DataFrame:
    """Edges with ``thru``: (exc, pos, free) of the through points their end is one of. ``throughs``: exc_id, pos (0, 1, …), v and rf (null: both)."""
    # An exception may have very many through points: their kinds are few, the points are not.
    free = sized(exc.join(throughs.select("exc_id").distinct(), "exc_id", "left_semi").select("exc_id", (~_named(exc, FROM)).alias("free")))
    t = throughs.join(free, "exc_id").select(F.col("v").alias("to_v"), F.explode(F.when(F.col("rf").isNull(), F.array(F.lit("rise"), F.lit("fall"))).otherwise(F.array("rf"))).alias("to_rf"),
                                             F.struct(F.col("exc_id").alias("exc"), F.col("pos").cast("int").alias("pos"), "free").alias("t"))
    t = t.groupBy("to_v", "to_rf").agg(F.array_sort(F.collect_set("t")).alias("thru"))
    return edges.join(t.hint("merge"), ["to_v", "to_rf"], "left")


def end_marks(exc: DataFrame, throughs: DataFrame) -> DataFrame:
    """``thru`` of ``mark_edges`` by the end alone: to_v, thru_rise, thru_fall."""
    ends = throughs.select(F.col("v").alias("to_v")).distinct().select("to_v", F.explode(F.array(F.lit("rise"), F.lit("fall"))).alias("to_rf"))
    m = mark_edges(ends, exc, throughs)
    return m.groupBy("to_v").agg(*[F.first(F.when(F.col("to_rf") == rf, F.col("thru")), ignorenulls=True).alias(f"thru_{rf}") for rf in ("rise", "fall")])


def advance(state: str = "state", thru: str = "thru") -> Column:
    """The state behind an edge: an exception moves on only if the edge's end is in its next set, so points count in their order and one at a time."""
    s, t = F.col(state), F.col(thru)

    def at(x: Column) -> Column:
        own = F.filter(s, lambda y: y["exc"] == x["exc"])
        return F.coalesce(F.get(own, F.lit(0))["next"], F.when(x["free"], 0).otherwise(-1))

    hit = F.filter(t, lambda x: at(x) == x["pos"])
    stay = F.filter(s, lambda y: ~F.exists(hit, lambda x: x["exc"] == y["exc"]))
    more = F.transform(hit, lambda x: F.struct(x["exc"].alias("exc"), (x["pos"] + 1).cast("int").alias("next")))
    return F.when(t.isNull(), s).otherwise(F.array_sort(F.concat(stay, more)).cast(STATE))


def match_states(ends: DataFrame, exc: DataFrame, throughs: DataFrame, side: str, keys: Sequence[str], clk: str = "capture_clk") -> DataFrame:
    """``ends`` with exc_kind, exc_value and exc_id of the exception that holds for each (null: none) on one side, ``max`` (setup) or ``min`` (hold).

    ``ends``: v, rf, ``clk``, state and ``keys``, which name a row. An exception holds if all its through points are passed, it names this end or none, and it is for this
    side or both; a multicycle for setup also moves the hold check. Rank: kind, then what is named, then for multicycles one side (2) over both sides (1)
    over the other side (0), then the tighter value (larger for a minimum delay), then the smaller number.
    """
    n = throughs.groupBy("exc_id").agg((F.max("pos") + 1).alias("n_thru"))
    x = exc.join(sized(n), "exc_id", "left").withColumns({"n_thru": F.coalesce("n_thru", F.lit(0)), "minmax": F.coalesce("minmax", F.lit("all")) if "minmax" in exc.columns else F.lit("all"), "through": F.when(F.col("n_thru") > 0, 1)})
    x = x.filter((F.col("minmax").isin("all", side)) | ((F.col("kind") == "multicycle") & F.lit(side == "min")))
    x = exception_priority(x.withColumnRenamed("minmax", "_side")).withColumnRenamed("_side", "minmax")
    one_side = F.when(F.col("kind") != "multicycle", 0).when(F.col("minmax") == "all", 1).when(F.col("minmax") == side, 2).otherwise(0)
    tight = F.when((F.col("kind") == "path_delay") & (F.col("minmax") == "min"), F.col("value")).otherwise(-F.col("value"))
    x = x.withColumn("_x", F.struct((F.col("priority") + one_side).alias("p"), tight.alias("t"), (-F.col("exc_id")).alias("o"), F.col("kind").alias("kind"), F.col("value").alias("value")))
    started = _named(x, FROM) | (F.col("n_thru") > 0)
    to_fields = {"to_pin": "v", "to_clk": clk, "to_rf": "rf"}
    cols = [f for f in TO if f in x.columns]
    fits = F.lit(True)
    for f in cols:
        fits = fits & (F.col(f"_{f}").isNull() | (F.col(f"_{f}") == F.col(to_fields[f])))
    reached = ends.select(*keys, "v", "rf", clk, F.explode("state").alias("s")) if not {"v", "rf", clk} <= set(keys) else ends.select(*keys, F.explode("state").alias("s"))
    listed = sized(x.filter(started).select(F.col("exc_id").alias("_id"), "n_thru", "_x", *[F.col(f).alias(f"_{f}") for f in cols]))
    a = reached.join(listed, (F.col("s.exc") == F.col("_id")) & (F.col("s.next") == F.col("n_thru"))).filter(fits).select(*keys, "_x")
    b = _pairs(ends, x.filter(~started), to_fields, keys).join(sized(x.filter(~started).select("exc_id", "_x")), "exc_id").select(*keys, "_x")
    best = a.unionByName(b).groupBy(*keys).agg(F.max("_x").alias("_x"))
    return ends.join(best.hint("merge"), list(keys), "left").withColumns({"exc_kind": F.col("_x.kind"), "exc_value": F.col("_x.value"), "exc_id": -F.col("_x.o")}).drop("_x")


def required_with(exc_kind: Column, exc_value: Column, required: Column, period: Column) -> Column:
    """The time an end is due: none on a false path, the value of a path delay, (value - 1) periods later for a multicycle."""
    return F.when(exc_kind == "false", None).when(exc_kind == "path_delay", exc_value).when(exc_kind == "multicycle", required + (exc_value - 1) * period).otherwise(required)
