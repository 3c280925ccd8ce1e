"""Session settings and the lineage cut used by every iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("voltgrain")
    for k, v in RECOMMENDED.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from the written table.

    Lineage ends here, lost executors cost nothing but a re-read, and the reader
    knows the size, so later joins broadcast only what is really small.
    ``by`` writes one sub-folder per value, which later filters on it prune.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").option("compression", "zstd")
    schema = df.schema
    if by is not None:
        w = w.partitionBy(by)
        rest = [f for f in schema if f.name != by]
        schema = type(schema)([*rest, schema[by]])
    w.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*df.columns)


def cut_watch(df: DataFrame, watch: Column) -> tuple[DataFrame, int]:
    """``cut`` that also counts the rows where ``watch`` holds, in the same job."""
    seen = Observation()
    table = cut(df.observe(seen, F.count_if(watch).alias("n")))
    return table, seen.get["n"]


def bounded_broadcast(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Mark a table for broadcast only after counting that it is small.

    The count stops at the bound. A larger table is returned as it is, and the
    join then shuffles (and AQE splits skewed keys) as usual.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def sized(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A side of a join that is broadcast if a count, which stops at the bound, finds it small, and else never broadcast, nor the other side.

    For joins in which both sides may grow with the data: Spark judges a table by its file, which may be a hundredth of its rows in memory.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")
