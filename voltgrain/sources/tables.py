"""Domain tables in and out: declared schemas on load, text and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SCHEMAS


def load(spark: SparkSession, path: str, name: str | None = None, schema=None, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table with a declared schema (by table name, or given)."""
    return spark.read.format(fmt).options(**options).schema(schema if schema is not None else SCHEMAS[name]).load(path)


# Columns of the per-cell power file, in order.
CELL_COLUMNS = ["cell", "internal", "glitch_internal", "switching", "glitch_switching", "leakage", "total", "class"]


def write_cell_power(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "tsv") -> None:
    out = df.select(*[c for c in CELL_COLUMNS if c in df.columns])
    if fmt == "tsv":
        out.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


# Components of the per-cycle table.
COMPONENTS = ["internal", "glitch_internal", "switching", "glitch_switching", "leakage"]


def wide_cycles(long: DataFrame) -> DataFrame:
    """One row per cycle with a column per component (0 where a component has no row)."""
    return long.groupBy("cycle").pivot("component", COMPONENTS).agg(F.sum("power")).na.fill(0.0, COMPONENTS)


def redirect(df: DataFrame, path: str, append: bool = False, fmt: str = "parquet") -> None:
    """Send a report to a folder instead of the screen, replacing or extending it."""
    df.write.mode("append" if append else "overwrite").format(fmt).save(path)
