"""Audit log as an unbounded source (E3).

New JSON-lines files under a folder are picked up by the file source; events
are counted per tenant and action in tumbling event-time windows. The watermark
bounds the state: a window is emitted once (append mode) when the watermark
passes its end, and rows arriving later than the watermark are dropped. Windows still
open are read from the query's state (``open_counts``), so ``all_counts`` covers every
event that was accepted so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

STREAM_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("user", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("target", T.StringType(), True),
    T.StructField("ip", T.StringType(), True),
])


def audit_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(STREAM_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.json(path)
    tenant = F.regexp_extract(F.col("_metadata.file_path"), r"tenant=([^/]+)/", 1)
    return s.select(F.when(tenant != "", tenant).alias("tenant"), F.col("timestamp").alias("ts"),
                    "user", "action")


def windowed_action_counts(events: DataFrame, window: str = "1 hour",
                           watermark: str = "10 minutes") -> DataFrame:
    return (events.withWatermark("ts", watermark)
                  .groupBy(F.window("ts", window).alias("w"), "tenant", "action")
                  .agg(F.count(F.lit(1)).alias("events"))
                  .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                          "tenant", "action", "events"))


def start_counts(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 window: str = "1 hour", watermark: str = "10 minutes",
                 available_now: bool = True) -> StreamingQuery:
    """Run the windowed counts into a parquet sink (append: each window once).
    The checkpoint folder (shared storage on a cluster) makes the query
    restartable with exactly-once output after a failure."""
    counts = windowed_action_counts(audit_source(spark, source), window, watermark)
    w = (counts.writeStream.outputMode("append").format("parquet")
               .option("path", sink).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


COUNTS_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, tenant string, action string, events long"


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Counts so far of the windows the watermark has not closed, from the state store.

    A window leaves the state in the batch that emits it, so these and the sink's rows
    never overlap."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(*[F.col(f"key.{c}").alias(f"_{i}") for i, c in enumerate(state.schema["key"].dataType.names)],
                        F.col("value.count").alias("events")).select(
        F.col("_0.start").cast("timestamp_ntz").alias("window_start"),
        F.col("_0.end").cast("timestamp_ntz").alias("window_end"),
        F.col("_1").alias("tenant"), F.col("_2").alias("action"), "events")


def all_counts(spark: SparkSession, sink: str, checkpoint: str) -> DataFrame:
    """Closed windows from the sink and open ones from the state. Read it while no batch
    runs (after an ``availableNow`` pass), or a window may close between the two reads."""
    closed = spark.read.schema(COUNTS_SCHEMA).parquet(sink)
    return closed.unionByName(open_counts(spark, checkpoint))


def batch_counts(spark: SparkSession, source: str, window: str = "1 hour",
                 watermark_minutes: int = 10) -> DataFrame:
    """The same counts computed as a batch job, restricted to windows a single
    streaming pass closes (end <= max event time - watermark delay)."""
    from claimlens.streaming.audit_stream import STREAM_SCHEMA as schema
    df = spark.read.schema(schema).json(source)
    tenant = F.regexp_extract(F.col("_metadata.file_path"), r"tenant=([^/]+)/", 1)
    ev = df.select(F.when(tenant != "", tenant).alias("tenant"), F.col("timestamp").alias("ts"), "action")
    mx = ev.agg(F.max("ts").alias("_mx"))
    counts = (ev.groupBy(F.window("ts", window).alias("w"), "tenant", "action")
                .agg(F.count(F.lit(1)).alias("events")))
    return (counts.crossJoin(F.broadcast(mx))
                  .filter(F.col("w.end") <= F.col("_mx") - F.expr(f"INTERVAL {watermark_minutes} MINUTES"))
                  .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                          "tenant", "action", "events"))
