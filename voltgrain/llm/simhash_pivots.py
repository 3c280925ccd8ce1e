"""SimHash fingerprints and their near-duplicate groups, filtered by distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voltgrain.llm.components import components
from voltgrain.llm.store import Scratch, give_back

WORDS, SEED, MAX_BITS = 4, 42, 4
#: Reference fingerprints of the distance table, besides zero and the 64 single bits that give the cells.
REFERENCES = 24
#: Rows of a cell beyond which its comparisons are dealt out over tiles, and the mean cell size aimed at.
TILE, CELL = 2048, 128


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the word shingles of a text; fewer words than a shingle has give one, none give none."""
    import xxhash

    words = (text or "").encode().lower().split()
    joined, n, x = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= WORDS:
        return np.array([x(joined, SEED)] if n else [], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return np.array([x(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :])], np.uint64)


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if over half of the shingle hashes have it. No words: zero."""
    h = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        part = h[lo : lo + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def cell_masks(n: int) -> list[int]:
    """Bit masks of the cells for n fingerprints.

    A fingerprint's distance to the single-bit reference e_b less that to zero is 1 - 2 * bit b, and two linked
    fingerprints differ in 4 of these 64 coordinates at most. With the coordinates in m > 4 bands, m - 4 bands agree; so
    linked fingerprints meet in a cell of some m - 4 bands. m grows until cells of evenly spread fingerprints are small.
    """
    for m in range(MAX_BITS + 1, 17):
        edges = [round(64 * i / m) for i in range(m + 1)]
        bands = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(bands, m - MAX_BITS)]
        if n <= CELL << min(x.bit_count() for x in masks) or m == 16:
            return masks
    raise AssertionError


def references() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, REFERENCES, np.uint64)


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of two arrays of fingerprints (of one array if ``same``).

    Both get a table of distances to the references; a pair whose distances to some reference
    differ by more than 4 cannot be linked (triangle inequality); survivors are verified.
    """
    refs = references()
    ta, tb = (np.bitwise_count(x[:, None] ^ refs).astype(np.int8) for x in (a, b))
    out = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), step):
        near = np.abs(ta[lo : lo + step, None, 0] - tb[None, :, 0]) <= MAX_BITS
        if same:
            near &= np.arange(lo, min(lo + step, len(a)))[:, None] < np.arange(len(b))
        i, j = np.nonzero(near)
        i += lo
        for k in range(1, REFERENCES):
            if not len(i):
                break
            ok = np.abs(ta[i, k] - tb[j, k]) <= MAX_BITS
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(a[i] ^ b[j]) <= MAX_BITS
        out.append((i[ok], j[ok]))
    return np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64), np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, cell, i, j), each tile whole in one partition, to links that connect what a tile connects."""
    held: list[pa.RecordBatch] = []

    def tiles(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        key = np.stack([t[c].to_numpy() for c in ("mask", "cell", "i", "j")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cut, t.num_rows] if last else [0, *cut]
        fp, rep, side = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy(), t["side"].to_numpy()
        xs, ys = [], []
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo < 2:
                continue
            f, r, s = fp[lo:hi], rep[lo:hi], side[lo:hi]
            if key[2, lo] == key[3, lo]:
                i, j = close_pairs(f, f, True)
            else:
                left, right = np.flatnonzero(s == key[2, lo]), np.flatnonzero(s == key[3, lo])
                i, j = close_pairs(f[left], f[right], False)
                i, j = left[i], right[j]
            if len(i):
                label = forest(hi - lo, i, j)
                moved = np.flatnonzero(label != np.arange(hi - lo))
                xs.append(r[label[moved]])
                ys.append(r[moved])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs or [none])), pa.array(np.concatenate(ys or [none]))], names=["a", "b"]), t.slice(bounds[-1])

    for batch in batches:
        held.append(batch)
        out, rest = tiles(pa.Table.from_batches(held), False)
        held = rest.to_batches()
        yield out
    if held and sum(b.num_rows for b in held):
        yield tiles(pa.Table.from_batches(held), True)[0]


def fingerprint_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints (fp, rep): enough of them to connect every linked pair.

    A cell with over ``TILE`` fingerprints is dealt out over tiles of two of its blocks, so that no task compares more than
    two blocks; a tile returns at most one link for each of its rows.
    """
    masks = F.explode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in cell_masks(n)]))
    rows = fps.select("fp", "rep", masks.alias("mask")).withColumn("cell", F.expr("fp & mask"))
    sizes = rows.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["mask", "cell"]).withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.withColumn("side", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    rows = rows.select("mask", "cell", "fp", "rep", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("mask", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "fp", "rep", "side")
    keys = ["mask", "cell", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most 4 differing bits) of every row.

    Rows with equal fingerprints collapse to one before any comparison, so a group of copies costs one row. Null and empty
    texts have fingerprint zero, linked like any other. Rows with one doc_id are one document. A row
    without doc_id links nothing and has no component. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs).withColumn("doc_id", F.col("doc_id").cast("long")))
    distinct = scratch.save(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = fingerprint_links(distinct, distinct.count())
    again = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    several = fps.join(again.select("doc_id"), "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.union(several), scratch)
    reps = distinct.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(reps, "fp", "left").select("doc_id", "fp", F.expr("if(doc_id is null, null, component)").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document (the smallest doc_id) of each near-duplicate group; rows without doc_id stay.

    Of rows that share the kept doc_id the one with the smallest hash over all its columns (but maps) stays, so a rerun keeps the same. Null and
    empty texts are one group; an empty table stays empty; columns may have any name.
    """
    groups = near_duplicates(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = named.groupBy("doc_id").agg(F.min_by(row, hashed).alias("x")).select(*[F.col(f"x.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return one.union(docs.where("doc_id is null"))
