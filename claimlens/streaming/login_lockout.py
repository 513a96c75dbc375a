"""Login lockout as a stream of bounded micro-batches (the online form of E2).

Each micro-batch counts failures since the user's last success with the same prefix sums as
the batch form (``audit.failed_login_burst``), so a user with a third of all events is split
over tasks; only the first run of a user in a batch goes on from an earlier one. What it
needs, the open failures of each user after a batch, is the carry table: every batch appends
the users it saw, and every ``COMPACT`` batches the table is written whole, so reading it
costs one table and a few small ones.

Results and carry of batch n are written to folders of their own (``batch=n``) and
overwritten if the batch is run again, so a restart or a failed batch repeats nothing; a
batch reads carries of earlier batches only.

The source decides the size of a batch (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
Batches count in the order they arrive; within a batch events are ordered by (time, id). So
the result is that of the batch form if no event arrives in a later batch than an event of
the same user that is newer. A run lasts until a success, however long it pauses. Events
without a user or of another action are left out; an empty batch writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlens.operators.audit import failed_login_burst
from claimlens.session import cut_lineage

COMPACT = 16
OUT_SCHEMA = "event_id long, user string, timestamp timestamp, action string, failures_in_run long, locked boolean"
_CARRY = "user string, failures long, at long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_carry(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """(user, failures): the open failures of each user before ``batch``."""
    whole = (batch - 1) // COMPACT * COMPACT                 # the last batch that was written whole
    found = [p for n in range(max(0, whole), batch) for p in [f"{path}/batch={n}"] if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "user string, failures long")
    rows = spark.read.schema(_CARRY).parquet(*found)
    return rows.groupBy("user").agg(F.max_by("failures", "at").alias("failures"))


def lockout_batch(events: DataFrame, batch: int, sink: str, carry: str, k: int = 3, failure: str = "error",
                  success: str = "signup") -> None:
    """Count one micro-batch and write its events and its carry."""
    spark = events.sparkSession
    before = cut_lineage(read_carry(spark, carry, batch))
    runs = cut_lineage(failed_login_burst(events, k, failure=failure, success=success, carry=before))
    if runs.isEmpty() and batch % COMPACT:
        return
    runs.write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    seen = runs.groupBy("user").agg(F.max_by("failures_in_run", F.struct("timestamp", "event_id")).alias("failures"))
    seen = seen.withColumn("at", F.lit(batch).cast("long"))
    if batch % COMPACT == 0:
        seen = before.withColumn("at", F.lit(-1).cast("long")).unionByName(seen).groupBy("user").agg(
            F.max_by("failures", "at").alias("failures"), F.lit(batch).cast("long").alias("at"))
    seen.write.mode("overwrite").parquet(f"{carry}/batch={batch}")


def start_lockout(events: DataFrame, folder: str, k: int = 3, failure: str = "error", success: str = "signup",
                  available_now: bool = True) -> StreamingQuery:
    """``events``: streaming frame with event_id, user, timestamp, action. Results, carry and
    checkpoint live under ``folder``."""
    writer = events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(
        lambda df, n: lockout_batch(df, n, f"{folder}/sink", f"{folder}/carry", k, failure, success))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_lockouts(spark: SparkSession, folder: str) -> DataFrame:
    """All events counted so far."""
    if not _exists(spark, f"{folder}/sink"):
        return spark.createDataFrame([], OUT_SCHEMA)
    return spark.read.schema(OUT_SCHEMA).parquet(f"{folder}/sink").select("event_id", "user", "timestamp", "action", "failures_in_run", "locked")
