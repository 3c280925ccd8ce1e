"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltgrain.llm.mixing import numbered, partitions
from voltgrain.llm.store import Scratch


def interleave(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row; law ``rows``: shard counts differ by one at most.

    Rows of a source are ranked in the order of a seeded hash; the fractional rank (rank - 1/2) / rows of the source orders all rows, so any
    stretch of that order has each source in proportion; it is cut into ``shards`` stretches of equal count. Both ranks come from a range
    partitioning with prefix sums of partition counts, so a source with a third of all rows, or rows that repeat, spread like any other.

    Null texts have size 8 and the CRC of no bytes; a null source is a source; repeated rows get slots of their own; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    n = rows.count()
    parts = partitions(n)
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    rows = numbered(rows, ["source", mixed, "doc_id", "text_crc32", "size"], ["source"], parts, scratch)
    counts = rows.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("__rows"))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("__s"))).withColumn("fraction", (F.col("place") - 0.5) / F.col("__rows")).drop("__s", "__rows").withColumnRenamed("place", "rank")
    rows = numbered(rows.withColumn("one", F.lit(1)), ["fraction", "source", "rank"], ["one"], parts, scratch)
    at = F.col("place") - 1
    # shard s holds the places from ceil(s * n / shards) on
    shard = F.expr(f"(place - 1) * {shards}L div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long"))
    return rows.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
