"""Writers: per-client shares, report documents and their index, prediction
exports, and the report workbook tables.

All writes go through the DataFrame writer into a folder the caller names
(on a cluster: a shared file system or object store), never the driver's disk.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.functions.exprs import money_mean, money_sum

# ---------------------------------------------------------------- I9


def share_by_client(df: DataFrame, path: str, employer: str = "employer",
                    mode: str = "overwrite") -> None:
    """Publish one folder per client (``employer=<name>``). Overwriting replaces only
    the clients that ``df`` holds (dynamic partition overwrite); others stay.

    The REBALANCE hint clusters rows by client so each task writes few files,
    and lets AQE split a client that holds a large share of the rows over
    several tasks (and merge small clients) instead of one task per client."""
    (df.filter(F.col(employer).isNotNull())
       .hint("rebalance", employer)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(employer).parquet(path))


def read_client(spark: SparkSession, path: str, client: str,
                employer: str = "employer") -> DataFrame:
    """One client's rows; the equality on the partition column prunes the other
    clients' folders at planning time."""
    return spark.read.parquet(path).filter(F.col(employer) == F.lit(client))


# ---------------------------------------------------------------- I10

INDEX_SCHEMA = "client string, type string, generated_at timestamp, filename string, status string"


def write_report(docs: DataFrame, path: str, report_type: str,
                 generated_at: _dt.datetime | None = None,
                 employer: str = "employer") -> DataFrame:
    """Write one JSON report per client under ``path/reports`` and return the
    index rows to append (status 'unread'). ``docs`` is ``report_json`` output."""
    ts = generated_at or _dt.datetime.now()
    fname = f"{report_type}_{ts.strftime('%Y%m%d_%H%M%S')}.json"
    out = docs.select(F.col(employer).alias("client"), F.lit(fname).alias("filename"), "report")
    (out.select("client", "filename", "report").write.mode("append")
        .partitionBy("client", "filename").json(f"{path}/reports"))
    idx = out.select("client", F.lit(report_type).alias("type"),
                     F.lit(ts).cast("timestamp").alias("generated_at"),
                     "filename", F.lit("unread").alias("status"))
    idx.write.mode("append").json(f"{path}/index")
    return idx


def mark_read(spark: SparkSession, path: str, client: str, filename: str,
              at: _dt.datetime | None = None) -> None:
    """Append a 'read' event; the index is append-only, latest event wins."""
    ts = at or _dt.datetime.now()
    spark.createDataFrame([(client, None, ts, filename, "read")], INDEX_SCHEMA) \
        .write.mode("append").json(f"{path}/index")


def report_index(spark: SparkSession, path: str, latest: int = 5) -> DataFrame:
    """Current status of every report (latest event per client and file), and the
    ``latest`` most recent reports per client."""
    ev = spark.read.schema(INDEX_SCHEMA).json(f"{path}/index")
    state = ev.groupBy("client", "filename").agg(
        F.max("type").alias("type"),  # only the 'unread' event carries the type
        F.min(F.when(F.col("status") == "unread", F.col("generated_at"))).alias("generated_at"),
        F.max_by("status", F.struct("generated_at", F.col("status") == "read")).alias("status"))
    w = Window.partitionBy("client").orderBy(F.col("generated_at").desc(), F.col("filename").desc())
    return (state.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= latest)
                 .drop("_r"))


# ---------------------------------------------------------------- I11 / I12


def export_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored claims as CSV files with a header (one folder, many part files)."""
    df.write.mode(mode).option("header", True).csv(path)


def report_workbook_tables(df: DataFrame, provider: str = "provider_id",
                           amount: str = "amount", flag: str = "fraud_flag") -> dict[str, DataFrame]:
    """The three workbook sheets as DataFrames: Summary (metric, value), the
    claims themselves, and the per-provider analysis."""
    has_flag = flag in df.columns
    s = df.agg(F.count(F.lit(1)).cast("double").alias("Total Claims"),
               F.coalesce(money_sum(amount), F.lit(0.0)).alias("Total Amount"),
               money_mean(amount).alias("Average Claim"),
               (F.coalesce(F.sum(flag), F.lit(0)) if has_flag else F.lit(0)).cast("double")
               .alias("Potential Fraud Cases"))
    summary = s.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in s.columns
    ])).alias("kv")).select("kv.metric", "kv.value")
    providers = (df.filter(F.col(provider).isNotNull()).groupBy(provider)
                   .agg(F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
                        F.count(F.col(amount)).alias("claim_count"),
                        (F.coalesce(F.sum(flag), F.lit(0)) if has_flag else F.lit(0))
                        .cast("long").alias("fraud_count")))
    return {"summary": summary, "claims_data": df, "provider_analysis": providers}


def write_workbook(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, t in tables.items():
        w = t.write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{path}/{name}")
