"""Selecting, filtering and comparing design objects."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import matches


def _concat(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def by_levels(df: DataFrame, parts: str, patterns: Sequence[str], divider: str = "/", regexp=False, nocase=False) -> DataFrame:
    """One glob per hierarchy level; several patterns concatenate and keep duplicates."""
    out = []
    for p in patterns:
        levels = re.split(r"(?<!\\)" + re.escape(divider), p)
        cond = F.size(parts) == len(levels)
        for i, g in enumerate(levels):
            cond = cond & matches(F.get(F.col(parts), F.lit(i)), g, regexp, nocase)
        out.append(df.filter(cond))
    return _concat(out)


def by_leaf(df: DataFrame, parts: str, patterns: Sequence[str], regexp=False, nocase=False) -> DataFrame:
    """Glob on the last level at any depth."""
    return _concat([df.filter(matches(F.element_at(parts, -1), p, regexp, nocase)) for p in patterns])


def by_name(df: DataFrame, name: str, patterns: Sequence[str], regexp=False, nocase=False) -> DataFrame:
    return _concat([df.filter(matches(F.col(name), p, regexp, nocase)) for p in patterns])


def of_objects(df: DataFrame, objects: DataFrame, on: Sequence[str]) -> DataFrame:
    """Objects attached to others, one row per attachment."""
    return df.join(objects, list(on))


_TERM = re.compile(r"^\s*(\w+)\s*(==|!=|=~|!~)\s*(.*?)\s*$")


def _term(expr: str) -> Column:
    m = _TERM.match(expr)
    if not m:
        raise ValueError(f"not a filter term: {expr!r}")
    prop, op, pat = m.groups()
    val = F.col(prop).cast("string")
    hit = (val == pat) if op in ("==", "!=") else matches(val, pat)
    return val.isNotNull() & (hit if op in ("==", "=~") else ~hit)


def property_filter(df: DataFrame, expr: str) -> DataFrame:
    """``a==b``, ``a=~glob``, their negations, and two terms with && or ||.

    Values compare as text, a missing property never matches, and an OR lists an
    object once per matching term.
    """
    if "||" in expr:
        return _concat([df.filter(_term(t)) for t in expr.split("||")])
    for t in expr.split("&&"):
        df = df.filter(_term(t))
    return df


def in_scope(signals: DataFrame, name: str, scope: str) -> DataFrame:
    """Signals below a scope, with the scope and its divider taken off."""
    if not scope:
        return signals
    return signals.filter(F.col(name).startswith(scope)).withColumn(
        name, F.substr(F.col(name), F.lit(len(scope) + 2)))


# Variable kinds used for activities and for statistics.
ACTIVITY_TYPES = ["wire", "reg"]
STATISTIC_TYPES = ["wire", "reg", "tri", "tri0", "tri1", "triand", "trior", "trireg", "wand", "wor"]


def of_types(signals: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return signals.filter(F.col("type").isin(list(kinds)))


def subtract(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on), list(on), "left_anti")


def intersects(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b.select(*on), list(on), "left_semi")


def compare_sets(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Size of each side, of both, and whether they are the same set."""
    tag = a.select(*on, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(*on, F.lit(0), F.lit(1)))
    one = tag.groupBy(*on).agg(F.max("_a").alias("a"), F.max("_b").alias("b"))
    return one.agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.col("a") * F.col("b")).alias("n_both"),
                   (F.sum(F.abs(F.col("a") - F.col("b"))) == 0).alias("equal"))


def annotate_signals(signals: DataFrame, nets: DataFrame, pins: DataFrame, name: str = "name") -> DataFrame:
    """Match signal names: net, else pin, else the name with its last ``\\/`` turned into ``/`` as a net.

    Adds ``net_id`` and ``match`` (net / pin / alias); unmatched signals keep nulls.
    """
    from ..functions.names import replace_last
    s = signals.withColumn("_alias", replace_last(F.col(name), "\\/", "/"))
    n1 = nets.select(F.col("path").alias(name), F.col("net_id").alias("_n1"))
    p1 = pins.select(F.col("path").alias(name), F.col("net_id").alias("_n2"))
    n3 = nets.select(F.col("path").alias("_alias"), F.col("net_id").alias("_n3"))
    j = s.join(n1, name, "left").join(p1, name, "left").join(n3, "_alias", "left")
    return j.withColumns({
        "net_id": F.coalesce("_n1", "_n2", "_n3"),
        "match": F.when(F.col("_n1").isNotNull(), "net").when(F.col("_n2").isNotNull(), "pin").when(F.col("_n3").isNotNull(), "alias"),
    }).drop("_alias", "_n1", "_n2", "_n3")


def override(df: DataFrame, chain: Sequence[tuple[DataFrame, Sequence[str]]], value: str, default: Column) -> DataFrame:
    """First value found along a chain of (table, keys), else the default."""
    cols = []
    for k, (t, on) in enumerate(chain):
        df = df.join(t.select(*on, F.col(value).alias(f"_o{k}")), list(on), "left")
        cols.append(F.col(f"_o{k}"))
    return df.withColumn(value, F.coalesce(*cols, default)).drop(*[f"_o{k}" for k in range(len(cols))])
