"""Interchangeable cells within some libraries, and cells of other libraries mapped to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import truth_table
from ..session import cut
from .ordered import ordered

CELL = ["lib", "cell"]


def _tables(rows: DataFrame, inputs: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Text functions replaced by truth tables over the cell's sorted inputs; every distinct (text, inputs) is parsed once."""
    rows = rows.join(inputs, CELL, "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<string>")))
    for t in texts:
        tt = rows.filter(F.col(t).isNotNull()).select(t, "_in").distinct().withColumn("_tt", truth_table(F.col(t), F.col("_in")))
        # A text that is no function of the inputs (an internal state, say) is compared as it stands.
        rows = rows.join(tt, [t, "_in"], "left").withColumn(t, F.coalesce(F.col("_tt").cast("string"), F.col(t))).drop("_tt")
    return rows.drop("_in")


def described_cells(cells: DataFrame, ports: DataFrame, sequentials: DataFrame) -> DataFrame:
    """(lib, cell, drive, sig, description) of the cells that may be used.

    ``cells``: lib, cell, drive, dont_use. ``ports``: lib, cell, port, dir, function, enable (texts or null; power ports have their kind as dir).
    ``sequentials``: lib, cell, is_register, clock, data, clear, preset, out, out_inv. Ports match by name whatever their order; functions
    match by truth table, so other spellings of one function are equal. The description holds all of it; ``sig`` is its hash.
    """
    inputs = ports.filter("dir = 'input'").groupBy(CELL).agg(F.array_sort(F.collect_list("port")).alias("_in"))
    p = _tables(ports.select(*CELL, "port", "dir", "function", "enable"), inputs, ["function", "enable"])
    p = p.groupBy(CELL).agg(F.array_sort(F.collect_list(F.struct("port", "dir", "function", "enable"))).alias("_p"))
    s = _tables(sequentials.select(*CELL, "is_register", "clock", "data", "clear", "preset", "out", "out_inv"), inputs, ["clock", "data", "clear", "preset"])
    s = s.groupBy(CELL).agg(F.array_sort(F.collect_list(F.struct("out", "out_inv", "is_register", "clock", "data", "clear", "preset"))).alias("_s"))
    c = cells.filter(~F.coalesce("dont_use", F.lit(False))).select(*CELL, "drive").join(p, CELL, "left").join(s, CELL, "left")
    c = c.withColumn("description", F.to_json(F.struct("_p", "_s")))
    return c.select(*CELL, "drive", F.sha2("description", 256).alias("sig"), "description")


def equivalent_across(described: DataFrame, equiv_libs: Sequence[str], map_libs: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """(lib, cell, class_id, n_members, rank, mapped): classes of at least two equal cells of ``equiv_libs``, and the cells of ``map_libs`` that have one.

    Classes are grouped by the hash and then by the whole description, so a collision joins nothing. Members are ranked by falling drive
    resistance, ties by library and cell, as prefix counts in blocks of drive (``block``), so one class may hold most cells; mapped cells have no rank
    and are no members. ``class_id`` is the first member by name. A library named in both lists is not mapped.
    """
    d = cut(described)
    own = d.filter(F.col("lib").isin(*equiv_libs))
    name = F.concat_ws("/", F.col("lib"), F.col("cell").cast("string"))
    cls = own.groupBy("sig", "description").agg(F.min(name).alias("class_id"), F.count("*").alias("n_members")).filter("n_members > 1")
    cls = cut(cls)
    m = own.join(cls, ["sig", "description"]).withColumn("_neg", -F.col("drive"))
    m = m.withColumn("_blk", block if block is not None else F.floor(F.col("_neg") / 64).cast("bigint")).drop("sig", "description")
    r = ordered(m, ["class_id"], ["_neg", *CELL], "_blk", sum_before={"rank": F.lit(1).cast("bigint")})
    members = r.select(*CELL, "class_id", "n_members", (F.col("rank") + 1).alias("rank"), F.lit(False).alias("mapped"))
    other = d.filter(F.col("lib").isin(*[x for x in map_libs if x not in equiv_libs])).join(cls, ["sig", "description"])
    return members.unionByName(other.select(*CELL, "class_id", "n_members", F.lit(None).cast("bigint").alias("rank"), F.lit(True).alias("mapped")))
