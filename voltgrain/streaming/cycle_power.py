"""Per-cycle power of an endless trace: open states, unfinished cycles and pending glitches are carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import events as ev, power as pw
from ..operators.events import SIG
from ..operators.ordered import ordered, time_block
from ..session import cut
from .power_stream import slice_changes


@dataclass
class PowerModel:
    """What the trace's gates are: the signals its header declares (sig_id, gate, pin_idx), cells, library tables, and the rules for pins and clocks."""

    signals: DataFrame
    gates: DataFrame
    leakage: DataFrame
    internal: DataFrame
    arcs: DataFrame
    pin_env: Callable[[DataFrame], DataFrame]
    is_clock: Column
    n_inputs: int
    n_pin: int
    ticks_per_slew: float


class CyclePower:
    """Five power components per cycle, one micro-batch at a time; equal to one run over the whole log.

    Cycles are closed when a later cycle has begun; rows of the newest cycle wait as a table, so glitch flags and causes are always decided on whole
    cycles. Carried besides: the last value of each signal, from which the open hold interval of each gate goes on, and the last two changes of each signal
    with their energies, as the glitch width of a signal's last change is known only at its next change. State is one version of tables a batch; a
    repeated batch overwrites its own. Rows of closed cycles are kept as late rows. Each batch runs the operators of the whole log, so a busy gate spreads over tasks.
    """

    TABLES = ("values", "tails", "open", "bounds")

    def __init__(self, spark: SparkSession, folder: str, cycle_ticks: int, block_ticks: int, model: PowerModel):
        self.spark, self.folder, self.T, self.block, self.m = spark, folder, int(cycle_ticks), int(block_ticks), model

    def _path(self, batch: int, name: str) -> str:
        return f"{self.folder}/state/b{batch}/{name}"

    def _state(self, batch: int) -> dict[str, DataFrame | None]:
        if batch < 0:
            return dict.fromkeys(self.TABLES)
        return {n: self.spark.read.parquet(self._path(batch, n)) for n in self.TABLES}

    @staticmethod
    def _bounds(state: dict[str, DataFrame | None]) -> tuple[int, int]:
        """(first tick not closed, largest tick seen)."""
        return (0, -1) if state["bounds"] is None else tuple(state["bounds"].first())

    def process(self, events: DataFrame, batch: int) -> None:
        old = self._state(batch - 1)
        lo, seen = self._bounds(old)
        rows = events.select(*SIG, "t", "seq", "v")
        rows = cut(rows if old["open"] is None else rows.unionByName(old["open"]))
        seen = max(seen, rows.agg(F.max("t")).first()[0] or 0)
        hi = max(lo, seen // self.T * self.T)
        late, now = rows.filter(F.col("t") < lo), rows.filter((F.col("t") >= lo) & (F.col("t") < hi))
        out, values, tails = self._slice(now, old, lo, hi, False) if hi > lo else (self._nothing(), old["values"], old["tails"])
        out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")
        late.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
        new = {"values": values, "tails": tails, "open": rows.filter(F.col("t") >= hi), "bounds": self.spark.createDataFrame([(hi, seen)], "closed long, seen long")}
        for name, table in new.items():
            table = table if table is not None else self.spark.createDataFrame([], "none int")
            table.write.mode("overwrite").parquet(self._path(batch, name))
        self.last = batch
        if batch > 1:  # a repeated batch reads the version before it, nothing older
            stale = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/b{batch - 2}")
            stale.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(stale, True)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "cycle long, component string, power double")

    def _slice(self, events: DataFrame, old: dict[str, DataFrame | None], lo: int, hi: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(power by cycle and component, last values, last changes) of the cycles from ``lo`` to ``hi``; with ``last`` nothing stays pending."""
        m, T = self.m, self.T
        first = lo == 0  # nothing was closed before: every declared signal starts unknown
        if first:
            start = m.signals.select(*SIG, F.lit(0).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("seq"), F.lit(2).alias("v"))
            events = events.unionByName(start)
        ch, values, _ = slice_changes(events, None if first else old["values"], self.block)
        ch, values = cut(ch), cut(values)
        # each gate's state at the start of the slice enters as a tick just before it
        moves = ch if first else ch.unionByName(old["values"].select(*SIG, F.lit(lo - 1).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("seq"), "v", F.lit(None).cast("int").alias("pv")).withColumn("blk", time_block("t", self.block)))
        ticks = cut(ev.gate_ticks(moves))
        holds = pw.hold_intervals(ticks, F.lit(hi).cast("bigint")).withColumn("t0", F.greatest("t0", F.lit(lo).cast("bigint")))
        leak = pw.leakage_per_cycle(pw.leakage_intervals(holds, m.gates, m.leakage), T, 16).select("cycle", F.lit("leakage").alias("component"), F.col("leakage").alias("power"))

        flagged = ev.glitch_flags(ch.withColumn("is_clock", m.is_clock), T)
        energy = pw.energy_per_change(flagged.withColumn("pulse", F.lit(None).cast("bigint")), ticks, m.gates, m.pin_env, m.internal, m.arcs, m.n_inputs, m.n_pin, T, F.lit(2**62), m.ticks_per_slew, pins=m.signals)
        keep = [*SIG, "t", "blk", "cycle", "glitch", "internal", "switching", "done"]
        rows = flagged.join(energy.select("sig_id", "t", "internal", "switching"), ["sig_id", "t"], "left").withColumn("done", F.col("internal").isNull()).select(*keep)
        rows = rows if first else rows.unionByName(old["tails"])
        nb = cut(ordered(ev.glitch_width(rows), SIG, ["t"], "blk", lag={"_before": F.struct(*keep[3:])}, lead={"_after": F.col("t")}))
        ready = ~F.col("done") & (F.col("_after").isNotNull() | ~F.col("glitch") | F.lit(last))
        slews = (F.col("slew_rise") + F.col("slew_fall")) * m.ticks_per_slew
        split = pw.split_glitch(m.pin_env(nb.filter(ready)).withColumn("ratio", ev.glitch_ratio(F.col("pulse"), slews)))
        out = pw.cycle_power(split, leak.limit(0).select("cycle", F.col("power").alias("leakage")), 1.0).unionByName(leak)
        two = nb.groupBy(*SIG).agg(F.max_by(F.struct(F.struct(*[F.col(c) for c in keep[3:-1]], (F.col("done") | ready).alias("done")).alias("own"), F.col("_before")), "t").alias("x"))
        before = F.struct(*[F.col(f"x._before.{c}") for c in keep[3:-1]], F.lit(True).alias("done"))
        tails = two.select(*SIG, F.explode(F.when(F.col("x._before").isNull(), F.array("x.own")).otherwise(F.array("x.own", before))).alias("y")).select(*SIG, "y.*")
        return out, values, tails

    def run(self, stream: DataFrame) -> None:
        """Drain what the stream has now; a later call goes on from there."""
        stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def late_events(self) -> DataFrame:
        """The rows that came after their cycle was closed."""
        return self.spark.read.parquet(f"{self.folder}/late")

    def totals(self, closing: bool = True) -> DataFrame:
        """(cycle, component, power) of all closed cycles; with ``closing`` also of the newest one and of pending glitches, as if the trace ended at its last tick."""
        parts = self.spark.read.parquet(f"{self.folder}/out").drop("batch")
        if closing:
            old = self._state(self.last)
            lo, seen = self._bounds(old)
            parts = parts.unionByName(self._slice(old["open"], old, lo, seen, True)[0])
            parts = parts.filter((F.col("component") != "leakage") | (F.col("cycle") <= F.lit(max(seen - 1, 0) // self.T)))
        return parts.groupBy("cycle", "component").agg(F.sum("power").alias("power"))


class TumblingTable:
    """Count and sum per tumbling window for a stream of any order: windows are a versioned table of partial sums, so no row comes too late.

    Each batch writes its own partial sums (a repeated batch overwrites them). Every ``merge_every`` batches they are added to the
    last version, and what that version replaces is deleted one merge later. Work per batch follows the batch; only a merge reads the window table.
    """

    def __init__(self, spark: SparkSession, folder: str, window: str, merge_every: int = 16):
        self.spark, self.folder, self.window, self.every = spark, folder, window, merge_every

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def _parts(self, upto: int) -> DataFrame:
        """The last version and the partial sums after it, of the batches up to ``upto``; merges end at batches every - 1, 2 every - 1, …"""
        merged = upto // self.every * self.every  # batches below are in the version
        paths = [f"{self.folder}/part/batch={b}" for b in range(merged, upto + 1)]
        if merged:
            paths.append(f"{self.folder}/merged/upto={merged - 1}")
        return self.spark.read.schema("start timestamp, n long, total long").parquet(*paths)

    def process(self, rows: DataFrame, batch: int) -> None:
        """``rows``: at (timestamp), value (whole number)."""
        one = rows.groupBy(F.window("at", self.window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", F.col("total").cast("bigint").alias("total"))
        one.write.mode("overwrite").parquet(f"{self.folder}/part/batch={batch}")
        if (batch + 1) % self.every == 0:
            low = batch + 1 - self.every
            paths = [f"{self.folder}/part/batch={b}" for b in range(low, batch + 1)] + ([f"{self.folder}/merged/upto={low - 1}"] if low else [])
            self._sums(self.spark.read.schema("start timestamp, n long, total long").parquet(*paths)).write.mode("overwrite").parquet(f"{self.folder}/merged/upto={batch}")
            # the batches of the merge before can no longer be repeated
            for b in range(max(low - self.every, 0), low):
                self._delete(f"{self.folder}/part/batch={b}")
            if low > self.every:
                self._delete(f"{self.folder}/merged/upto={low - self.every - 1}")
        self.last = batch

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def run(self, stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def totals(self) -> DataFrame:
        """(start, n, total) of every window so far."""
        return self._sums(self._parts(self.last))
