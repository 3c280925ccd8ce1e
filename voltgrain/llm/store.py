"""Tables written to the shared checkpoint folder, and small helpers on them."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from voltgrain.session import checkpoint_dir


class Scratch:
    """Tables of one operator run, in one folder below the shared checkpoint folder.

    ``save`` writes a table and returns the table read back, so lineage ends there and a lost
    executor costs a re-read. ``drop`` removes what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.folder}/t{self.n}"

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``by``: one sub-folder for each value of this last column, so that a filter on it reads only those."""
        path = self.path()
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def release(self) -> None:
        """Have the driver collect its garbage, so that Spark removes the shuffle files that no table needs any longer."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if (path := self.paths.pop(id(t), None)) is not None:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the queries planned inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns named like one of ``names`` (in any case) renamed, and how to name them back."""
    taken = {n.lower() for n in names}
    back = {f"__own_{i}": c for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
