"""Embedding near-duplicates by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from voltgrain.llm.components import components
from voltgrain.llm.store import Scratch

COSINE = 0.95
#: Vectors that a cell should hold, and rows of a block of a tile; pivots are drawn from a bounded sample.
CELL, TILE, MAX_PIVOTS = 4096, 4096, 1024


def _rows(column: pa.Array) -> np.ndarray:
    """Binary cells of equal or unequal length to a matrix of doubles, padded by zeros (which keeps all distances)."""
    cells = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    out = np.zeros((len(cells), max(map(len, cells), default=0)))
    for row, x in zip(out, cells):
        row[: len(x)] = x
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (the unit vector's doubles as binary; null for a vector that is null, empty, zero or has a null or non-finite component)."""

    def unit(x: list | None) -> bytes | None:
        if not x or None in x:
            return None
        x = np.asarray(x, np.float64)
        if not np.isfinite(x).all() or not (most := np.abs(x).max()):
            return None
        x = x / most
        return (x / np.sqrt(x @ x)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unit(x) for x in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v binary")


def choose_pivots(classes: DataFrame, n: int, radius: float) -> np.ndarray:
    """Pivots from a bounded sample (by hash of the vector), each over two radii from those before it, so that a group of near copies has one."""
    want = min(MAX_PIVOTS, max(1, ceil(n / CELL)))
    sample = _rows(classes.select("v").orderBy(F.xxhash64("v"), "v").limit(4 * want).toArrow()["v"].combine_chunks())
    picked: list[int] = []
    for i in range(len(sample)):
        if len(picked) < want and (not picked or ((sample[picked] - sample[i]) ** 2).sum(1).min() > (2 * radius) ** 2):
            picked.append(i)
    return sample[picked]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (x, pivots))
    return np.maximum(2 - 2 * x @ p.T, 0)  # squared


def range_links(classes: DataFrame, n: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(rep, links, up): for each tile a class has links in, the rows it is linked with there and the smallest class it is connected to there.

    The nearest pivot partitions the classes (rep, m, v). For x of cell p and y of cell q at distance r or less, y lies no farther from q
    than from p, so x is within r of the plane halfway between p and q, and within r of the reach of q: only then x is also sent to q (for each two cells in
    one direction). A cell joins its own rows and those sent to it, in tiles of two blocks.
    """
    radius = sqrt(2 - 2 * cosine) + 1e-9
    pivots = choose_pivots(classes, n, radius)
    between = np.sqrt(_distances(pivots, pivots))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_rows(b.column(2)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], names=["rep", "m", "v", "cell", "away"])

    homes = scratch.save(classes.select("rep", "m", "v").mapInArrow(home, "rep long, m long, v binary, cell int, away double"))
    reach = np.full(len(pivots), -np.inf)
    for r in homes.groupBy("cell").agg(F.max("away").alias("reach")).collect():  # one row for each pivot
        reach[r["cell"]] = r["reach"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                d, p = _distances(_rows(b.column(2)), pivots), b.column(3).to_numpy()
                own = d[np.arange(len(d)), p][:, None]
                q = np.arange(len(pivots))
                gap = between[p]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (d - own) / (2 * gap), 0)
                receives = np.where((p[:, None] + q) % 2 == 0, np.maximum(p[:, None], q), np.minimum(p[:, None], q)) == q
                i, c = np.nonzero(receives & (q != p[:, None]) & (plane <= radius + 1e-9) & (np.sqrt(d) <= reach + radius + 1e-9))
                i, c = np.concatenate([np.arange(len(d)), i]), np.concatenate([p, c])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(i)) for k in range(3)), pa.array(c.astype(np.int32)), pa.array(np.arange(len(i)) < len(d))], names=["rep", "m", "v", "cell", "own"])

    rows = homes.mapInArrow(spread, "rep long, m long, v binary, cell int, own boolean")
    counts = scratch.save(rows.groupBy("cell").agg(F.ceil(F.count_if("own") / TILE).cast("int").alias("h"), F.ceil(F.count_if(~F.col("own")) / TILE).cast("int").alias("s")))
    mixed = F.xxhash64("rep", "v")
    rows = rows.join(counts, "cell").withColumn("block", F.when(F.col("own"), F.pmod(mixed, "h")).otherwise(F.col("h") + F.pmod(mixed, "s")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("own"), F.col("h") + F.col("s")).otherwise(F.col("h")) - 1)
    rows = rows.where("h > 0").withColumn("other", F.explode(others)).select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "m", "v")

    def tile(t: pa.Table) -> pa.Table:
        from voltgrain.llm.simhash_pivots import forest

        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        v, block, m, rep = t["v"].combine_chunks(), t["block"].to_numpy(), t["m"].to_numpy(), t["rep"].to_numpy()
        x, size = _rows(v), np.asarray(pa.compute.binary_length(v))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(rep), np.int64)
        by_rep = np.argsort(rep, kind="stable")
        label = np.arange(len(rep))  # places in the order of rep
        place = np.empty(len(rep), np.int64)
        place[by_rep] = np.arange(len(rep))
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            hit = (x[part] @ x[b].T >= cosine) & (size[part][:, None] == size[b])
            if i == j:
                hit[np.arange(len(part)), np.arange(lo, lo + len(part))] = False
            if hit.any():
                links[part] += hit @ m[b]
                if i != j:
                    links[b] += hit.T @ m[part]
                k, l = np.nonzero(hit)
                moved = np.flatnonzero(label != np.arange(len(label)))
                label = forest(len(label), np.concatenate([place[part][k], moved]), np.concatenate([place[b][l], label[moved]]))
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "up": rep[by_rep][label[place[some]]]})

    return rows.groupBy("cell", "i", "j").applyInArrow(tile, "rep long, links long, up long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Equal unit vectors collapse to one class with a multiplicity before the join. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing (n_links 0, a component of their own), nor do vectors of different length. Rows that share a vec_id are one node of
    the components; each counts as a vector in n_links. A row without vec_id links with nothing and has neither component nor place. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "metric")
    units = scratch.save(unit_vectors(vectors))
    valid = units.where("vec_id is not null and v is not null")
    classes = scratch.save(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    n = classes.count()
    if n:
        found = scratch.save(range_links(classes, n, cosine, scratch))
    else:
        found = vectors.sparkSession.createDataFrame([], "rep long, links long, up long")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    shared = valid.join(classes, "v").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    several = valid.groupBy(F.col("vec_id").alias("a")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi")
    groups = components(found.where("up <> rep").select(F.col("up").alias("a"), F.col("rep").alias("b")).union(shared.join(several, "a", "left_semi")), scratch)
    known = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = units.withColumn("key", F.expr("if(vec_id is null, null, v)")).drop("v").join(known.withColumnRenamed("v", "key"), "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))
