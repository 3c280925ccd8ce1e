"""Netlists made of instances of one module: nets inside an instance are settled in its own row, only nets between instances are joined."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import X, by_function, probability_expr, toggle_rate_expr
from ..session import cut, cut_watch
from .activity import MAX_PASSES, TOLERANCE, clip
from .constants import output_value
from .graph import union_all


class ModuleGate(NamedTuple):
    """A gate of a module: its output net, its input nets in the order of the truth table, and as columns of the instance's row ``tt``, ``en`` and ``inverted`` as in ``settle_constants``."""

    out: str
    pins: Sequence[str]
    tt: Column | None = None
    kind: str = "logic"
    en: Column | None = None
    inverted: Column | None = None


def with_ports(rows: DataFrame, ports: Mapping[str, str], values: Mapping[str, DataFrame]) -> DataFrame:
    """``rows`` (one per instance) with the values of the nets at its ports, one join per port.

    ``ports``: for each port the column of ``rows`` that numbers its net. ``values``: for each port a table with that column, one row per net, and the
    value in a column named like the port. A net without a row is null. Nets with very many instances are split by Spark.
    """
    for port, key in ports.items():
        rows = rows.join(values[port].select(key, port), key, "left")
    return rows


def _in_order(gates: Sequence[ModuleGate], ports: Sequence[str]) -> None:
    known = set(ports)
    for g in gates:
        if not set(g.pins) <= known:
            raise ValueError(f"{g.out} reads {sorted(set(g.pins) - known)}, which no port or gate before it drives")
        known.add(g.out)


def settle_in_modules(rows: DataFrame, ports: Sequence[str], gates: Sequence[ModuleGate], held: Sequence[str] = (), thru_registers: bool = False) -> DataFrame:
    """``settle_constants`` where all gates of an instance lie in one row: adds a column per output, 0, 1 or 2 (unknown), and ``said_<net>``, what its gate gives, for held nets.

    ``rows`` has the value of each port (null: unknown) and ``held_<net>`` (0, 1, 2: must stay unknown, null: not held) for the nets in ``held``, which are never
    changed. Gates come in the order of the logic; a module with a loop, or whose outputs drive ports of others, needs ``settle_constants``.
    """
    _in_order(gates, ports)
    rows = rows.withColumns({p: F.coalesce(F.col(p), F.lit(X)) for p in ports})
    none = F.lit(None).cast("array<int>")
    for g in gates:
        def mask(fixed):
            return sum((fixed(F.col(p)).cast("int") * (1 << i) for i, p in enumerate(g.pins)), F.lit(0))
        rows = rows.withColumns({"km": mask(lambda v: v != X), "kv": mask(lambda v: v == 1), "kind": F.lit(g.kind), "tt": none if g.tt is None else g.tt,
                                 "en": none if g.en is None else g.en, "inverted": F.lit(False) if g.inverted is None else g.inverted})
        rows = rows.withColumn(g.out, output_value(thru_registers))
        if g.out in held:
            rows = rows.withColumn(f"said_{g.out}", F.col(g.out)).withColumn(g.out, F.coalesce(F.col(f"held_{g.out}"), F.col(g.out)))
        rows = rows.drop("km", "kv", "kind", "tt", "en", "inverted")
    return rows


def propagate_in_modules(rows: DataFrame, ports: Sequence[str], gates: Sequence[ModuleGate], functions: Mapping[int, list[int]]) -> DataFrame:
    """``propagate_activity`` where all gates of an instance lie in one row: adds a column (activity, duty) per output, null unless all its inputs are known.

    ``rows`` has (activity, duty) of each port; ``tt`` of a gate is a key of ``functions``, its truth tables.
    """
    _in_order(gates, ports)
    for g in gates:
        def of(field, bits):
            return [F.col(f"{p}.{field}") for p in g.pins[: len(bits).bit_length() - 1]]
        act = by_function(g.tt, functions, lambda t: toggle_rate_expr(t, of("duty", t), of("activity", t)))
        duty = by_function(g.tt, functions, lambda t: probability_expr(t, of("duty", t)))
        known = F.lit(True)
        for p in g.pins:
            known = known & F.col(p).isNotNull()
        rows = rows.withColumn(g.out, F.when(known, F.struct(clip(act).alias("activity"), duty.alias("duty"))))
    return rows


def propagate_registers_in_modules(rows: DataFrame, output: Callable[[DataFrame], DataFrame], max_passes: int = MAX_PASSES) -> DataFrame:
    """(inst, activity, duty) of one register per instance, as ``propagate_with_registers`` finds them.

    ``rows``: inst, up (the instance whose register feeds this one, null: none) and what ``output`` needs, which adds a column ``q`` (activity, duty) from these and from ``up_q``,
    the register's before it (null: none). A register is evaluated once, when the one before it is known; a round joins only what became known in
    the round before, which Spark broadcasts while it is small. What is left lies on loops of registers or behind them and is repeated from 0 until nothing moves by more than
    the tolerance; behind a register that does not exist nothing is known.
    """
    kind = "struct<activity:double,duty:double>"

    def q_of(df: DataFrame) -> DataFrame:
        return output(df).select("inst", F.col("q").cast(kind).alias("q"))

    def before(q: DataFrame) -> DataFrame:
        return q.select(F.col("inst").alias("up"), F.col("q").alias("up_q"))
    waiting = cut(rows.filter("up is not null"))
    fresh, n = cut_watch(q_of(rows.filter("up is null").withColumn("up_q", F.lit(None).cast(kind))), F.lit(True))
    known = [fresh]
    while n:
        fresh, n = cut_watch(q_of(waiting.join(before(fresh), "up")), F.lit(True))
        known.append(fresh)
    done = union_all(known)
    rest, n = cut_watch(waiting.join(done.select("inst"), "inst", "left_anti"), F.lit(True))
    if n:
        fixed = cut(before(done).join(rest.select("up").distinct(), "up", "left_semi"))
        q = rest.select("inst", F.struct(F.lit(0.0).alias("activity"), F.lit(0.0).alias("duty")).cast(kind).alias("q"))
        for _ in range(max_passes):
            new = q_of(rest.join(before(q).unionByName(fixed), "up")).join(q.withColumnRenamed("q", "_q"), "inst")
            moved = (F.abs(F.col("q.activity") - F.col("_q.activity")) > TOLERANCE) | (F.abs(F.col("q.duty") - F.col("_q.duty")) > TOLERANCE)
            new, n = cut_watch(new, moved)
            q = new.select("inst", "q")
            if not n:
                break
        done = done.unionByName(q)
    return done.select("inst", "q.activity", "q.duty")
