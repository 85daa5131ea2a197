"""Reports over live measurements: tumbling windows with a watermark, by event time or by arrival, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.stats import WINDOW_SECONDS, quantile_columns
from sluice.sources.sinks import write_stats

#: Fixed value: seconds that a report waits for late rows.
BUFFER_SECONDS = 8


def event_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder's files as a stream of rows with a zoned ts."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, seconds: int = WINDOW_SECONDS, offset: int = 0, buffer: int = BUFFER_SECONDS, quantiles: str = "sketch") -> DataFrame:
    """(window_start, id, period_ops, mean, quantiles); rows later than the buffer are dropped. State is one sketch a window and id."""
    w = F.window("ts", f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds").alias("w")
    g = stream.withWatermark("ts", f"{buffer} seconds").groupBy(w, "id").agg(F.count("*").alias("period_ops"), F.avg("latency").alias("mean"), *quantile_columns("latency", quantiles))
    return g.withColumn("window_start", F.col("w.start")).drop("w").withColumn("period_ops_s", F.expr(f"period_ops div {seconds}"))


def late_to_arrival(stream: DataFrame, arrival: str, buffer: int = BUFFER_SECONDS) -> DataFrame:
    """Rows that arrive later than the buffer take their arrival as ts, so that they count in the window then open instead of being dropped."""
    late = F.unix_micros(F.col(arrival)) - F.unix_micros("ts") > buffer * 1_000_000
    return stream.withColumn("ts", F.when(late, F.col(arrival)).otherwise(F.col("ts")))


def run_updates(report: DataFrame, path: str, checkpoint: str):
    """Every change of a window to path, once for each batch id; the last change of a window that is still open when the run ends is among them."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    return report.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of run_updates as they last were."""
    rows = spark.read.parquet(path).drop("part")
    rest = [c for c in rows.columns if c not in ("window_start", "id", "batch")]
    last = rows.groupBy("window_start", "id").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select("window_start", "id", "r.*")


def to_console(report: DataFrame, checkpoint: str, seconds: int = WINDOW_SECONDS):
    """The report on the console, anew each period."""
    return report.writeStream.outputMode("update").format("console").option("truncate", False).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def by_arrival(batch: DataFrame, arrival: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The other policy for late rows: none is dropped, each counts in the window in which it arrived."""
    w = F.window(F.greatest(F.col("ts"), F.col(arrival)), f"{seconds} seconds").alias("w")
    return batch.groupBy(w, "id").agg(F.count("*").alias("period_ops"), F.avg("latency").alias("mean")).withColumn("window_start", F.col("w.start")).drop("w")


def run_to_csv(report: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append closed windows to statistics files; exactly once for each batch id."""
    def put(batch: DataFrame, batch_id: int) -> None:
        write_stats(batch, f"{path}/batch={batch_id}", mode="overwrite")

    w = report.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Into a table in memory, for tests and consoles."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(rows: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Sessions that end where a key is silent for the gap; batch or stream."""
    g = rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
