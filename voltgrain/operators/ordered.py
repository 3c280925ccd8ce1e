"""Ordered computations over keys of any size.

A plain window over a hot key sorts the whole key in one task. Here each key is
cut into time blocks: a small partial aggregate per (key, block) yields what the
earlier or later blocks hand over, and the row-level window runs inside one
(key, block). The row data is shuffled once, by (key, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

Exprs = Mapping[str, Column]


def time_block(t: str, block_ticks: int) -> Column:
    return F.expr(f"{t} div {int(block_ticks)}")


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str,
    *,
    lag: Exprs | None = None,
    lead: Exprs | None = None,
    sum_before: Exprs | None = None,
    last_before: Exprs | None = None,
) -> DataFrame:
    """Add previous / next / prefix-sum / last-seen columns, exact across blocks.

    ``lag`` and ``lead`` read the neighbouring row of the key, ``sum_before`` adds
    up all earlier rows, ``last_before`` is the last non-null value of an earlier row.
    ``block`` must not decrease along ``order``.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    sums, lasts = dict(sum_before or {}), dict(last_before or {})
    part = [*keys, block]
    # Plain values and a plain position keep the block summary a hash aggregate.
    pos = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    aggs = [F.max_by(e, pos).alias(f"_c_{n}") for n, e in lag.items()]
    aggs += [F.min_by(e, pos).alias(f"_c_{n}") for n, e in lead.items()]
    aggs += [F.sum(e).alias(f"_c_{n}") for n, e in sums.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), pos)).alias(f"_c_{n}") for n, e in lasts.items()]
    across = W.partitionBy(*keys).orderBy(block)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*part).agg(*aggs).select(
        *part,
        *[F.lag(F.struct(F.col(f"_c_{n}").alias("x"))).over(across).alias(f"_c_{n}") for n in lag],
        *[F.lead(F.struct(F.col(f"_c_{n}").alias("x"))).over(across).alias(f"_c_{n}") for n in lead],
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
    )

    inside = W.partitionBy(*part).orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for n, e in lag.items():
        out[n] = F.coalesce(F.lag(F.struct(e.alias("x"))).over(inside), F.col(f"_c_{n}"))["x"]
    for n, e in lead.items():
        out[n] = F.coalesce(F.lead(F.struct(e.alias("x"))).over(inside), F.col(f"_c_{n}"))["x"]
    for n, e in sums.items():
        out[n] = F.coalesce(F.sum(e).over(before), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
    for n, e in lasts.items():
        out[n] = F.coalesce(F.last(e, ignorenulls=True).over(before), F.col(f"_c_{n}"))
    joined = df.join(carry, part)
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def equal_event_slices(counts: DataFrame, cycle: str, n: str, budget: int, block_cycles: int = 4096) -> DataFrame:
    """Cut consecutive cycles into slices of about ``budget`` events each.

    ``counts`` has one row per cycle; a slice id is the number of whole budgets
    used up before the cycle starts, so slices are contiguous and cycle aligned.
    """
    b = counts.withColumn("_blk", time_block(cycle, block_cycles))
    cum = ordered(b, [], [cycle], "_blk", sum_before={"cum_before": F.col(n)})
    return cum.select(
        cycle, n, F.col("cum_before").cast("bigint").alias("cum_before"),
        F.expr(f"cum_before div {int(budget)}").alias("slice_id"),
    )


def plan_block_ticks(df: DataFrame, keys: Sequence[str], t: str, cycle_ticks: int, budget: int = 2_000_000) -> int:
    """Block length in ticks so that the densest (key, block) stays near ``budget`` rows.

    One partial aggregate over (key, cycle); only the largest count reaches the driver. Where a cycle
    alone is denser than the budget, blocks get shorter than a cycle, down to one tick.
    """
    def densest(ticks: int) -> int:
        return df.groupBy(*keys, F.expr(f"{t} div {ticks}").alias("_c")).count().agg(F.max("count")).first()[0] or 1

    ticks = int(cycle_ticks)
    top = densest(ticks)
    if top <= budget:
        return ticks * max(1, min(65536, budget // top))
    while top > budget and ticks > 1:
        ticks = max(1, min(ticks // 2, ticks * budget // top))
        top = densest(ticks)
    return ticks
