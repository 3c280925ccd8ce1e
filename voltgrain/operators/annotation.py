"""Annotated delays on conditional arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def same_condition(a: Column, b: Column) -> Column:
    """Conditions are equal when their texts are, blanks aside."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    return bare(a) == bare(b)


def annotate_arcs(arcs: DataFrame, notes: DataFrame, keys: list[str], cond_use: str | None = None) -> DataFrame:
    """``arcs`` (keys, arc, when, d_min, d_max) with the delays that ``notes`` (keys, seq, cond, condelse, a_min, a_max) give them.

    A note replaces the delays of arcs of its keys whose ``when`` equals its ``cond``; one without a condition those of all; one with ``condelse`` those of the arc
    without ``when``. The latest by ``seq`` holds. With ``cond_use`` notes with a condition also reach the arc without ``when``: there each one after the latest
    replacement is merged, by the smaller values (``min``), the larger ones (``max``) or the smaller minimum and larger maximum (``both``). ``keys`` and ``arc`` name an arc;
    rows of equal ``seq`` are merged as ``cond_use`` says (as ``both`` where it is not given). Null keys match nothing; a null ``condelse`` is false.
    """
    if cond_use not in (None, "min", "max", "both"):
        raise ValueError(f"cond_use is min, max or both, not {cond_use}")
    by = [*keys, "arc"]
    other = F.coalesce("condelse", F.lit(False))
    used = ~other & F.col("cond").isNotNull() & F.col("when").isNull() & F.lit(cond_use is not None)
    plain = F.when(other, F.col("when").isNull()).otherwise(F.col("cond").isNull() | F.coalesce(same_condition(F.col("cond"), F.col("when")), F.lit(False)))
    found = arcs.select(*by, "when").join(notes.select(*keys, "seq", "cond", "condelse", "a_min", "a_max"), keys).where(plain | used).select(*by, "seq", used.alias("used"), "a_min", "a_max")
    last = found.groupBy(*by).agg(F.max(F.when(~F.col("used"), F.col("seq"))).alias("last"))
    holds = found.join(last, by).where(F.col("last").isNull() | (F.col("seq") >= F.col("last")))
    low, high = {"min": (F.min, F.min), "max": (F.max, F.max)}.get(cond_use, (F.min, F.max))
    merged = holds.groupBy(*by).agg(low("a_min").alias("n_min"), high("a_max").alias("n_max"))
    out = arcs.join(merged, by, "left")
    return out.select(*by, "when", F.coalesce("n_min", "d_min").alias("d_min"), F.coalesce("n_max", "d_max").alias("d_max"), F.col("n_max").isNotNull().alias("annotated"))
