"""Sweeps whose keys are few: the rows of a vertex are the columns of one row.

Where transitions and tags have few values in all and the numbers are whole, a vertex has a slot for each of them. A step then ships one row per pair
of vertices and merges it into one row per end; nothing is taken apart, sorted or packed again. Other sweeps keep rows (``graph.Levelled.sweep``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from . import graph as gr

#: Slots of a vertex; a mask of one long says which are there.
MAX_SLOTS = 40
PLAIN = ("int", "bigint", "string")
HALF = 1 << 15
AGG = {"max": F.max, "min": F.min}


class Slots:
    """``table``: v, level, mask and ``<name>_<i>`` for each value and key; ``keys`` are (rf, *tags), transition by transition."""

    def __init__(self, table: DataFrame, keys: Sequence[tuple], names: Sequence[str], tags: Mapping[str, str]):
        self.table, self.keys, self.names, self.tags = table, list(keys), list(names), dict(tags)

    def key(self, i: int) -> list[Column]:
        rf, *rest = self.keys[i]
        return [F.lit(rf).alias("rf"), *[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(rest, self.tags.items())]]

    def rows(self) -> DataFrame:
        """v, rf, tags, values and level, one row for each slot that is there."""
        each = F.array(*[F.struct(on(F.col("mask"), i).alias("_on"), *self.key(i), *[F.col(f"{n}_{i}").alias(n) for n in self.names]) for i in range(len(self.keys))])
        return self.table.select("v", "level", F.inline(each)).filter("_on").select("v", "rf", *self.tags, *self.names, "level")


def on(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def keys_of(g: "gr.Levelled", seeds: DataFrame, tags: Sequence[str], edge_columns: Sequence[str], names: Sequence[str]) -> list[tuple] | None:
    """The slots of a sweep, or None if it must keep rows."""
    if g.source is None or g.rfs is None or g.marks is not None:
        return None
    kinds, of_edge = dict(seeds.dtypes), g.columns()
    if any(kinds[t] not in PLAIN for t in tags) or any(kinds[n] != "bigint" for n in names) or any(of_edge[c] not in ("int", "bigint") for c in edge_columns):
        return None
    most = MAX_SLOTS // len(g.rfs)
    found = seeds.select("rf", *tags).distinct().limit(MAX_SLOTS + 1).collect()
    rest = sorted({tuple(r)[1:] for r in found if None not in tuple(r)[1:]})
    if len(found) > MAX_SLOTS or len(rest) > most or any(None in tuple(r) or r[0] not in g.rfs for r in found):
        return None
    return [(rf, *t) for rf in g.rfs for t in rest]


def _merged(rows: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    return rows.groupBy("v", "level").agg(F.bit_or("mask").alias("mask"), *[AGG[a](c).alias(c) for c, a in cols.items()])


def sweep(g: "gr.Levelled", seeds: DataFrame, tags: Sequence[str], values: Mapping[str, tuple[str, int, str]]) -> Slots | None:
    """Carry ``values`` (name: edge column, 1 to add or -1 to take it away, max or min) forward from ``seeds`` (v, rf, tags, names). None if the keys are not few."""
    names = list(values)
    keys = keys_of(g, seeds, tags, [c for c, _, _ in values.values()], names)
    if not keys:
        return None
    n_tag, kinds = len(keys) // len(g.rfs), dict(seeds.dtypes)
    out_of = Slots(seeds, keys, names, {t: kinds[t] for t in tags})
    cols = {f"{n}_{i}": values[n][2] for n in names for i in range(len(keys))}
    here, out = None, []

    def mine(i: int) -> Column:
        hit = F.lit(True)
        for c, x in zip(("rf", *tags), out_of.key(i)):
            hit = hit & (F.col(c) == x)
        return hit
    s = g.place(seeds.select("v", "rf", *tags, *names))
    bits = [F.when(mine(i), F.lit(1 << i).cast("bigint")) for i in range(len(keys))]
    s = s.select("v", "level", F.coalesce(*bits).alias("mask"), *[F.when(mine(i), F.col(n)).alias(f"{n}_{i}") for n in names for i in range(len(keys))])
    start = cut(_merged(s, cols))
    at = {r[0] for r in start.select("level").distinct().collect()}
    for k in range(g.depth + 1):
        if k in at:
            new = start.filter(F.col("level") == k)
            here = new if here is None else cut(_merged(here.unionByName(new), cols))
        if here is None:
            continue
        out.append(here)
        if k < g.depth:
            here = cut(_step(g, here, k, keys, n_tag, values, cols))
    return Slots(gr.union_all(out), keys, names, out_of.tags) if out else None


def _step(g: "gr.Levelled", here: DataFrame, k: int, keys: Sequence[tuple], n_tag: int, values: Mapping[str, tuple[str, int, str]], cols: Mapping[str, str]) -> DataFrame:
    e = g.source("from_v").filter(F.col("from_level") == k).drop("from_level")
    every, size = [F.col(c) for c in cols], len(keys)
    low, high = (every[0], every[0]) if len(every) == 1 else (F.least(*every), F.greatest(*every))
    sent = here.select(F.col("v").alias("from_v"), "mask", low.alias("low"), F.coalesce(F.try_subtract(high, low) < 2 * HALF, F.lit(False)).alias("fits"), *cols)
    near = F.array(*[(x - F.col("low") - HALF).cast("smallint") for x in every])
    sent = sent.select("from_v", "mask", "low", F.when(F.col("fits"), near).alias("near"), F.when(~F.col("fits"), F.array(*every)).alias("far"))
    # Both sides grow with the data, and the edges lie by this end already; a written table may be much larger than its file.
    j = sent.hint("merge").join(e, "from_v")
    if k < g.few_ends:
        j = j.repartition("to_v")
    j = j.select("to_v", "to_level", "mask", "low", "near", "far", F.explode(g.arcs("from_v", "to_v")).alias("_e"))
    base = F.coalesce(*[F.when(F.col("_e.from_rf") == rf, F.lit(r * n_tag)) for r, rf in enumerate(g.rfs)])
    j = j.select(F.col("to_v").alias("v"), F.col("to_level").cast("int").alias("level"), "mask", "low", "near", "far", base.alias("base"), F.col("_e.to_rf").alias("to_rf"), *[F.col(f"_e.{c}").cast("bigint").alias(f"_{n}") for n, (c, _, _) in values.items()])
    moved = {}
    for at, (n, (_, sign, _)) in enumerate(values.items()):
        for t in range(n_tag):
            i = F.col("base") + (at * size + t)
            x = F.coalesce(F.get("near", i).cast("bigint") + (F.col("low") + HALF), F.get("far", i))
            moved[f"{n}_t{t}"] = x + F.col(f"_{n}") if sign > 0 else x - F.col(f"_{n}")
    there = F.call_function("shiftright", F.col("mask"), F.col("base")).bitwiseAND(F.lit((1 << n_tag) - 1))
    j = j.select("v", "level", "to_rf", there.alias("there"), *[x.alias(c) for c, x in moved.items()])
    to = [F.col("to_rf") == rf for rf in g.rfs]
    mask = F.coalesce(*[F.when(hit, F.call_function("shiftleft", F.col("there"), F.lit(r * n_tag))) for r, hit in enumerate(to)])
    aggs = [AGG[values[n][2]](F.when(to[r], F.col(f"{n}_t{t}"))).alias(f"{n}_{r * n_tag + t}") for n in values for r in range(len(g.rfs)) for t in range(n_tag)]
    return j.groupBy("v", "level").agg(F.bit_or(mask).alias("mask"), *aggs).filter("mask <> 0")


def slack(arr: Slots, req: Slots) -> DataFrame:
    """``graph.slack`` of two sweeps by slots: v, rf, tags, slack_max, slack_min."""
    same = [(i, req.keys.index(key)) for i, key in enumerate(arr.keys) if key in req.keys]
    r = req.table.select("v", F.col("mask").alias("r_mask"), *[c for c in req.table.columns if c not in ("v", "level", "mask")])
    j = arr.table.hint("merge").join(r, "v")
    each = F.array(*[F.struct((on(F.col("mask"), a) & on(F.col("r_mask"), b)).alias("_on"), *arr.key(a), (F.col(f"r_max_{b}") - F.col(f"a_max_{a}")).alias("slack_max"), (F.col(f"a_min_{a}") - F.col(f"r_min_{b}")).alias("slack_min")) for a, b in same])
    return j.select("v", F.inline(each)).filter("_on").select("v", "rf", *arr.tags, "slack_max", "slack_min")
