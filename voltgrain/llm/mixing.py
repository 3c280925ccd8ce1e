"""Mixing sources to target weights by systematic sampling, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltgrain.llm.store import Scratch

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
POSITION_BITS = 33  # of a row in its partition, in monotonically_increasing_id


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), a row for each source.

    Sources by code point, null last, get the weights in turn. Targets share ``share`` times all sizes by weight; one above ``most`` times
    its source's size stops there and the excess is shared anew. The fixed point is reached by one sort: with sources by
    size/weight, a source is stopped exactly if the rate left when all before it are stopped would exceed its limit.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("rate", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    ranked = ranked.withColumn("stopped", F.col("limit") <= F.col("w") * F.col("rate"))
    free = F.min(F.when(~F.col("stopped"), F.struct(F.col("limit") / F.col("w"), F.col("source").isNull(), "source", "rate"))).over(everything)["rate"]
    return ranked.select("source", "source_size", F.when(F.col("stopped"), F.col("limit")).otherwise(F.col("w") * free).alias("target"))


def numbered(rows: DataFrame, keys: list, groups: list[str], n_parts: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... in the order of ``keys`` inside each group; ``keys`` start with the group columns.

    Rows are range-partitioned and sorted; monotonically_increasing_id then holds the partition and the place in it. A
    prefix sum over (group, partition) counts, a small table, turns both into a place in the group.
    """
    ordered = scratch.save(rows.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftrightunsigned("__id", POSITION_BITS))
    counts = ordered.groupBy(*groups, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    w = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    placed = ordered.join(starts, same).withColumn("place", F.col("__before") + F.col("__id") - F.col("__first") + 1)
    return placed.drop("__id", "__part", "__p", "__first", "__before", *[f"__g{i}" for i in range(len(groups))])


def partitions(n_rows: int, rows_each: int = 200_000) -> int:
    return max(2, -(-n_rows // rows_each))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    Each document of a source expects rate = target / source_size copies. Documents are laid in the order of size (then of a seeded
    hash, doc_id), expected copies are summed up in that order, one random offset in [0, 1) for each source is added, and a document is
    emitted once for each integer that its stretch crosses. In order of size the error of the taken words is at most about one largest
    document. Copies are at most ``most`` as the rate is. Sizes are read before the sort, so texts are not shuffled.

    Null or empty texts have size 0 and copies like any other; a null source is a source of its own; a source of size 0 has target 0
    and no copies; rows repeated in all columns are interchangeable; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size")))
    n = sized.count()
    sources = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    order = ["source", "size", F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    rows = numbered(sized, order, ["source"], partitions(n), scratch)
    s = sources.select(F.col("source").alias("__s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\u0000"))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("__s"))).withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(F.col("offset") + F.col("rate") * F.col("place")) - F.floor(F.col("offset") + F.col("rate") * (F.col("place") - 1))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows that share doc_id, source and size share their copies in turn."""
    size = words_in("text")
    keys = ["__d", "__s", "__z"]
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z")).agg(F.sum("copies").alias("__c"), F.count("*").alias("__m"))
    mine = docs.withColumns({"__d2": F.col("doc_id").cast("long"), "__s2": F.col("source").cast("string"), "__z2": size})
    both = mine.join(taken, F.col("__d2").eqNullSafe(F.col("__d")) & F.col("__s2").eqNullSafe(F.col("__s")) & (F.col("__z2") == F.col("__z")))
    each = F.when(F.col("__m") == 1, F.col("__c")).otherwise(F.floor(F.col("__c") / F.col("__m")) + F.when(F.row_number().over(Window.partitionBy(*keys).orderBy("text")) <= F.pmod("__c", "__m"), 1).otherwise(0))
    return both.withColumn("__copies", each).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
