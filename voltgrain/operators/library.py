"""Cell library, hierarchy and what-if edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, cut_watch
from .graph import union_all
from .ordered import ordered


def signature(*parts: str) -> Column:
    """Hash of what makes two cells interchangeable."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]), 256)


def equivalent_cells(cells: DataFrame, parts: list[str], drive: str = "drive", block: Column | None = None) -> DataFrame:
    """Cells of equal signature ranked by falling drive resistance; unusable cells are skipped.

    The rank is a prefix count in blocks of drive, so a group of any size stays spread.
    """
    c = cells.filter(~F.col("dont_use")).withColumns({"sig": signature(*parts), "_neg": -F.col(drive)})
    c = c.withColumn("_blk", block if block is not None else F.floor(F.col("_neg") / 64).cast("bigint"))
    r = ordered(c, ["sig"], ["_neg", "cell_name"], "_blk", sum_before={"rank": F.lit(1).cast("bigint")})
    return r.withColumn("rank", F.col("rank") + 1).drop("_neg", "_blk")


def buffer_kind(tt: Column) -> Column:
    """buffer / inverter / none for a one-input truth table."""
    return F.when(tt == F.array(F.lit(0), F.lit(1)), "buffer").when(tt == F.array(F.lit(1), F.lit(0)), "inverter").otherwise("none")


def apply_edits(base: DataFrame, deletes: DataFrame, inserts: DataFrame, swaps: DataFrame, key: str, field: str) -> DataFrame:
    """Base rows less deletions, with swapped fields, plus insertions."""
    kept = base.join(deletes.select(key), key, "left_anti")
    s = swaps.select(key, F.col(field).alias("_new"))
    kept = kept.join(s, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")
    return kept.unionByName(inserts.select(*kept.columns))


def drive_resistance(d_lo: Column, d_hi: Column, c_lo: Column, c_hi: Column) -> Column:
    """Delay per load between the first and last load of a table."""
    return (d_hi - d_lo) / (c_hi - c_lo)


def flatten_nets(nets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(net, root): nets joined through hierarchy ports share the smallest net as root.

    Only nets whose root changed in a round hand it on in the next.
    """
    e = cut(pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*").distinct())
    state = cut(nets.select("net", F.col("net").alias("root"), F.lit(True).alias("moved")))
    while True:
        hot = state.filter("moved").select(F.col("net").alias("x"), "root")
        low = hot.join(e, "x").groupBy(F.col("y").alias("net")).agg(F.min("root").alias("_r"))
        nxt = state.join(low, "net", "left").select(
            "net", F.least("root", "_r").alias("root"), F.coalesce(F.col("_r") < F.col("root"), F.lit(False)).alias("moved"))
        state, n = cut_watch(nxt, F.col("moved"))
        if not n:
            return state.select("net", "root")


def elaborate(templates: DataFrame, leaves: DataFrame, top: Column, black_boxes: bool = True) -> DataFrame:
    """Expand module bodies from the top down to leaf instances: (path, module, kind).

    ``templates``: module, inst, child. ``leaves``: module of every known leaf cell. A child that
    is neither a module nor a leaf is a black box, or an error when they are not allowed.
    """
    bodies = cut(templates.select("module", "inst", "child"))
    known = bodies.select("module").distinct().withColumn("_body", F.lit(True))
    leaf = leaves.select("module").distinct().withColumn("_leaf", F.lit(True))
    start = bodies.filter(F.col("module") == top).select(F.col("inst").alias("path"), F.col("child").alias("module"))
    level, n = cut_watch(start, F.lit(True))
    out = []
    while n:
        kinds = level.join(leaf, "module", "left").join(known, "module", "left").select(
            "path", "module", F.when(F.col("_leaf"), "leaf").when(F.col("_body"), "module").otherwise("black_box").alias("kind"))
        kinds = cut(kinds)
        out.append(kinds.filter("kind <> 'module'"))
        nxt = kinds.filter("kind = 'module'").select("path", "module").join(bodies, "module").select(
            F.concat_ws("/", "path", "inst").alias("path"), F.col("child").alias("module"))
        level, n = cut_watch(nxt, F.lit(True))
    res = union_all(out)
    if not black_boxes and not res.filter("kind = 'black_box'").isEmpty():
        raise ValueError("design has instances of unknown modules")
    return res
