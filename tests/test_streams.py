"""Streams against one run over the whole log, for any cut into batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltgrain.plans import bindings as b, power_plans
from voltgrain.plans.event_plans import SLEW_TICKS
from voltgrain.streaming.cycle_power import CyclePower, PowerModel, TumblingTable


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Thirty-odd cycles of six hours; some signals start late, some pause for many cycles, one signal has a third of all rows."""
    r = random.Random(4)
    start, rows = datetime(2024, 1, 1), []
    for i in range(420):
        user = 4 if r.random() < 0.33 else r.randrange(15)
        hour = r.uniform(0, 190) if user != 9 else r.choice([r.uniform(100, 104), r.uniform(170, 174)])
        rows.append((i, start + timedelta(seconds=round(hour * 3600)), user, r.choice(["click", "view", "view", "purchase", "error", "signup"]), 1.0, "{}"))
    path = str(tmp_path_factory.mktemp("log"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("cuts", [[50.5, 120, 121]])
def test_cycle_power_over_batches_equals_one_run(spark, folder, tmp_path, cuts):
    log = b.raw_events(spark, folder).cache()
    model = PowerModel(log.select("sig_id", "gate", "pin_idx").distinct(), b.gates(spark, folder).select("gate", "cell_name"), power_plans.leak_table(spark), b.int_power_rows(spark), b.arc_rows(spark),
                       b.pin_env, F.col("gate") % 5 == 2, 2, b.N_PIN, SLEW_TICKS)
    run = CyclePower(spark, str(tmp_path), b.T6, 4 * b.T6, model)
    edges = [-1, *cuts, 1000]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = log.filter((F.col("t") >= int(lo * b.HOUR)) & (F.col("t") < int(hi * b.HOUR)))
        run.process(part, k)
        if k == 2:
            run.process(part, k)  # a repeated batch counts once
    got = {(r.cycle, r.component): r.power for r in run.totals().collect()}
    want = {(r.cycle, r.component): r.power for r in power_plans.d15(spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)
    assert sum(v for (_, c), v in want.items() if c == "glitch_internal") > 0
    assert run.late_events().count() == 0
    late = log.filter(f"t < {b.T6}").limit(1)
    run.process(late, len(edges) - 1)
    assert run.late_events().count() == 1
    again = {(r.cycle, r.component): r.power for r in run.totals().collect()}
    assert again.keys() == got.keys() and all(again[k] == pytest.approx(got[k]) for k in got)


def test_tumbling_table_takes_rows_in_any_order(spark, tmp_path):
    r = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=r.randrange(6000)), r.randrange(100)) for _ in range(300)]
    run = TumblingTable(spark, str(tmp_path), "6 hours", merge_every=3)
    want: dict[datetime, list[int]] = {}
    for batch in range(8):
        part = spark.createDataFrame(rows[batch * 30 : batch * 30 + 30], "at timestamp_ntz, value long").withColumn("at", F.col("at").cast("timestamp"))
        for at, value in rows[batch * 30 : batch * 30 + 30]:
            w = want.setdefault(start + timedelta(hours=(at - start) // timedelta(hours=6) * 6), [0, 0])
            w[0] += 1
            w[1] += value
        for _ in range(2 if batch in (4, 5) else 1):
            run.process(part, batch)
        got = {x.start: [x.n, x.total] for x in run.totals().withColumn("start", F.col("start").cast("timestamp_ntz")).collect()}
        assert got == want
    assert sorted(p.name for p in (tmp_path / "merged").iterdir()) == ["upto=2", "upto=5"]
    assert sorted(p.name for p in (tmp_path / "part").iterdir()) == [f"batch={i}" for i in range(3, 8)]
