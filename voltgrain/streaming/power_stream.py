"""Time slices with carried state, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.events import SIG
from ..operators.ordered import ordered, time_block


def align_slice(t: Column, cycle_ticks: int) -> Column:
    """First cycle boundary at or after ``t``."""
    return F.ceil(t / int(cycle_ticks)).cast("bigint") * int(cycle_ticks)


def slice_changes(events: DataFrame, state: DataFrame | None, block_ticks: int, initial: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean changes of one slice, the state to carry on, and the events that came too late.

    ``state``: the last (t, v) of every signal so far. It enters the slice as one row per
    signal, so the slice is de-duplicated and compared exactly as inside one long trace.
    """
    one = events.groupBy(*SIG, "t").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))
    late = one.limit(0)
    if state is not None:
        st = state.select(*SIG, F.col("t").alias("_st"))
        j = one.join(st, SIG, "left")
        old = F.coalesce(F.col("t") <= F.col("_st"), F.lit(False))
        late, one = j.filter(old).drop("_st"), j.filter(~old).drop("_st")
        known = state.select(*SIG, "t", F.lit(-1).cast("bigint").alias("seq"), "v", F.lit(True).alias("carried"))
        seen = state.select(*SIG)
        fresh = one.join(seen, SIG, "left_anti")
    else:
        known, fresh = None, one
    zero = fresh.groupBy(*SIG).agg(F.min("t").alias("t0")).filter("t0 > 0").select(
        *SIG, F.lit(0).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("seq"), F.lit(initial).alias("v"), F.lit(False).alias("carried"))
    rows = one.withColumn("carried", F.lit(False)).unionByName(zero)
    rows = rows.unionByName(known) if known is not None else rows
    rows = rows.withColumn("blk", time_block("t", block_ticks))
    lagged = ordered(rows, SIG, ["t"], "blk", lag={"pv": F.col("v")})
    ch = lagged.filter(~F.col("carried") & (F.col("pv").isNull() | (F.col("pv") != F.col("v")))).drop("carried")
    nxt = rows.groupBy(*SIG).agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))
    return ch, nxt, late


def cycle_toggles(changes: DataFrame, cycle_ticks: int) -> DataFrame:
    """Half-weighted toggles and switching rises per cycle: whole numbers, so slices simply add."""
    from ..functions.logic import n_rise, n_toggle
    p, v = F.col("pv"), F.col("v")
    c = changes.filter("pv is not null")
    return c.groupBy(F.expr(f"t div {int(cycle_ticks)}").alias("cycle")).agg(
        F.sum(n_toggle(p, v) * 2).cast("bigint").alias("toggles2"), F.sum(n_rise(p, v) * 2).cast("bigint").alias("rises2"))


def add_slices(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


class SlicedTrace:
    """Per-cycle activity of an endless trace, one micro-batch at a time.

    The state is a written table of last values per signal, one version per batch id, so a
    repeated batch overwrites its own output and nothing counts twice. Each batch runs the
    same blocked operators as a full trace: a busy gate spreads over many tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, cycle_ticks: int, block_ticks: int):
        self.spark, self.folder, self.cycle, self.block = spark, folder, cycle_ticks, block_ticks

    def state_path(self, batch: int) -> str:
        return f"{self.folder}/state/b{batch}"

    def process(self, events: DataFrame, batch: int) -> None:
        state = self.spark.read.parquet(self.state_path(batch - 1)) if batch > 0 else None
        ch, nxt, late = slice_changes(events, state, self.block)
        out = cycle_toggles(ch, self.cycle).withColumn("late", F.lit(0).cast("bigint"))
        n_late = late.groupBy(F.expr(f"t div {int(self.cycle)}").alias("cycle")).agg(F.count("*").alias("late")).select(
            "cycle", F.lit(0).cast("bigint").alias("toggles2"), F.lit(0).cast("bigint").alias("rises2"), "late")
        out.unionByName(n_late).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")
        late.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
        nxt.write.mode("overwrite").parquet(self.state_path(batch))
        if batch > 1:  # a repeated batch reads the version before it, nothing older
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.state_path(batch - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def run(self, stream: DataFrame) -> None:
        """Drain what the stream has now; a later call goes on from there."""
        q = (stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/progress")
             .trigger(availableNow=True).start())
        q.awaitTermination()

    def late_events(self) -> DataFrame:
        """The rows that came too late to count."""
        return self.spark.read.parquet(f"{self.folder}/late")

    def totals(self) -> DataFrame:
        return add_slices(self.spark.read.parquet(f"{self.folder}/out"), ["cycle"], ["toggles2", "rises2", "late"])


def tumbling_counts(stream: DataFrame, time: str, window: str, watermark: str, value: str) -> DataFrame:
    """Event count and value sum per tumbling window, for a stream with bounded lateness."""
    return stream.withWatermark(time, watermark).groupBy(F.window(time, window)).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), "n", "total")


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Run an update-mode stream over what is there and return the last row of every start."""
    def save(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    q = (df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out")
    rest = [c for c in df.columns if c != "start"]
    return out.groupBy("start").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("start", "x.*")


