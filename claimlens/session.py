"""Session helpers: a local session for tests/bench and a shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MERGED_SIZE = "8m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "claimlens") -> SparkSession:
    """Session used by tests and bench.py; on a cluster use the cluster's session.

    ``$CLAIMLENS_CHECKPOINT_DIR`` names its ``spark.checkpoint.dir``; without it a scratch
    folder is used, which is deleted when the process ends."""
    folder = os.environ.get("CLAIMLENS_CHECKPOINT_DIR")
    if not folder:
        folder = tempfile.mkdtemp(prefix="claimlens-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there; only when it is
    unset (local tests) do we create a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store): "
                           "intermediate tables must survive executor loss")
    path = tempfile.mkdtemp(prefix="claimlens-ckpt-")  # local mode only: nothing configured
    sc.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A fresh folder under the shared checkpoint location for intermediate
    tables (never a machine-local folder when the cluster names one)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/claimlens-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int) -> Iterator[int]:
    """At least ``least`` shuffle partitions for what runs inside, so that a task's share does
    not grow with the input. Spark still merges partitions that turn out small, up to
    ``MERGED_SIZE``: short rows take many times their shuffled size once they are hashed or sorted."""
    number, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: spark.conf.get(key) for key in (number, merged)}
    n = max(int(before[number]), int(least))
    spark.conf.set(number, n)
    spark.conf.set(merged, MERGED_SIZE)
    try:
        yield n
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    return a fresh scan of it.

    Reliable like ``checkpoint()`` (a lost executor recomputes nothing before
    this point) but one job instead of two (``checkpoint`` recomputes its input
    to write the files unless it is cached) and columnar on disk."""
    spark = df.sparkSession
    path = work_dir(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(spark, sf_dir, name))
