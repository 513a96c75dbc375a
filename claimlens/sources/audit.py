"""Audit logs: append-only JSON lines, one folder per tenant.

Each line is ``{"timestamp", "user", "action", "target", "ip"}``; the
timestamp is ISO text without a zone. The schema is given explicitly so no
inference pass runs over the logs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("user", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("target", T.StringType(), True),
    T.StructField("ip", T.StringType(), True),
])

# tenant name is taken from a file called <tenant>_audit.log or a folder tenant=<name>
_TENANT_FILE = r"([^/]+)_audit\.log$"
_TENANT_DIR = r"tenant=([^/]+)/"


def _tenant_of(path_col):
    from_dir = F.regexp_extract(path_col, _TENANT_DIR, 1)
    from_file = F.regexp_extract(path_col, _TENANT_FILE, 1)
    return F.when(from_dir != "", from_dir).when(from_file != "", from_file).otherwise(F.lit(None))


def audit_read(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows with the tenant taken from the file path and a parsed timestamp."""
    raw = spark.read.schema(AUDIT_SCHEMA).json(path)
    return raw.select(
        _tenant_of(F.col("_metadata.file_path")).alias("tenant"),
        F.try_to_timestamp(F.col("timestamp")).alias("ts"),
        "user", "action", "target", "ip")


def audit_append(df: DataFrame, path: str) -> None:
    """Append audit rows (columns tenant, ts, user, action, target, ip) under
    ``path/tenant=<name>/`` as JSON lines."""
    out = df.select(
        "tenant",
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "user", "action", "target", "ip")
    out.write.mode("append").partitionBy("tenant").option("ignoreNullFields", False).json(path)


def audit_event(spark: SparkSession, tenant: str, user: str, action: str,
                target: str | None = None, ip: str = "",
                at: _dt.datetime | None = None) -> DataFrame:
    """A one-row audit frame for ``audit_append`` (UTC time, like the original)."""
    ts = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame(
        [(tenant, ts, user, action, target, ip)],
        "tenant string, ts timestamp_ntz, user string, action string, target string, ip string")
