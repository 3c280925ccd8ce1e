"""Parasitic text: one record per net, read with the section end as line separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Unit words and their SI factor.
UNITS = {"FF": 1e-15, "PF": 1e-12, "OHM": 1.0, "KOHM": 1e3, "NS": 1e-9, "PS": 1e-12}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(text) per net; the first record also carries the header and the name map."""
    return spark.read.option("lineSep", "*END").text(path).select(F.col("value").alias("text"))


def name_map(records: DataFrame) -> DataFrame:
    """(short, name) rows of the name map section."""
    body = F.regexp_extract("text", r"(?s)\*NAME_MAP\s*\n(.*?)(?=\n\s*\*(?:PORTS|D_NET|POWER_NETS)|\z)", 1)
    row = records.filter(F.col("text").contains("*NAME_MAP")).select(F.explode(F.split(body, r"\n")).alias("r"))
    pat = r"^\s*(\*\d+)\s+(\S+)"
    return row.filter(F.col("r").rlike(pat)).select(F.regexp_extract("r", pat, 1).alias("short"), F.regexp_extract("r", pat, 2).alias("name"))


def unit_factor(records: DataFrame, what: str) -> DataFrame:
    """One row (factor): the unit of C, R or T in SI."""
    pat = rf"\*{what}_UNIT\s+([0-9.eE+-]+)\s+(\w+)"
    t = records.filter(F.col("text").rlike(pat))
    unit = F.coalesce(*[F.when(F.upper(F.regexp_extract("text", pat, 2)) == u, s) for u, s in UNITS.items()])
    return t.select((F.regexp_extract("text", pat, 1).cast("double") * unit).alias("factor"))


def _section(name: str) -> Column:
    return F.regexp_extract("text", rf"(?s)\*{name}\s*\n(.*?)(?=\n\*(?:CONN|CAP|RES)\b|\z)", 1)


def _rows(records: DataFrame, name: str) -> DataFrame:
    net = F.regexp_extract("text", r"\*D_NET\s+(\S+)", 1)
    r = records.filter(F.col("text").contains("*D_NET")).select(net.alias("net_id"), F.explode(F.split(_section(name), r"\n")).alias("r"))
    return r.select("net_id", F.split(F.trim("r"), r"\s+").alias("f"))


def caps(records: DataFrame) -> DataFrame:
    """Ground capacitors: net_id, node, gnd_cap."""
    return _rows(records, "CAP").filter(F.size("f") == 3).select("net_id", F.col("f")[1].alias("node"), F.col("f")[2].cast("double").alias("gnd_cap"))


def coupling(records: DataFrame) -> DataFrame:
    return _rows(records, "CAP").filter(F.size("f") == 4).select("net_id", F.col("f")[1].alias("n1"), F.col("f")[2].alias("n2_other"), F.col("f")[3].cast("double").alias("farad"))


def resistors(records: DataFrame) -> DataFrame:
    return _rows(records, "RES").filter(F.size("f") == 4).select("net_id", F.col("f")[1].alias("n1"), F.col("f")[2].alias("n2"), F.col("f")[3].cast("double").alias("ohm"))


def connections(records: DataFrame) -> DataFrame:
    """Pins (*I) and ports (*P) of a net: net_id, kind, pin, dir."""
    return _rows(records, "CONN").filter(F.size("f") >= 3).select("net_id", F.substr(F.col("f")[0], F.lit(2)).alias("kind"), F.col("f")[1].alias("pin"), F.col("f")[2].alias("dir"))


def expand_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace a leading ``*n`` by its full name; the rest of the text stays."""
    short, rest = F.regexp_extract(column, r"^(\*\d+)", 1), F.regexp_replace(column, r"^\*\d+", "")
    j = df.withColumns({"short": short, "_rest": rest}).join(names, "short", "left")
    return j.withColumn(column, F.when(F.col("name").isNotNull(), F.concat("name", "_rest")).otherwise(F.col(column))).drop("short", "_rest", "name")
