"""Helpers that several operators share: splits by checksum, shared files, components."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import cut_lineage, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (null keys: null)."""
    return F.crc32(F.col(key).cast("string")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    import sys
    import types
    name = "claimlens_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold Arrow batches to ``rows`` rows, so long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def store(uri: str):
    """(file system, path) of a folder named by a Hadoop-style URI, for use inside tasks.

    pyarrow opens file, hdfs, s3 and gs URIs alike, so the folder may lie on any
    store that driver and executors share."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:].replace("///", "/", 1)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextlib.contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Write a file under a name no other attempt uses; yields (name, stream).

    A retried or speculative task writes another file. Readers open only the names
    in the manifest, which Spark's own commit makes final, so orphans do no harm."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield name, out


def components(edges: DataFrame, spark: SparkSession, max_rounds: int = 40) -> DataFrame:
    """Connected components: (node, root), root the smallest node reachable.

    ``edges`` has long columns a, b. Alternates large-star and small-star steps
    (Kiveris et al., 2014), each two aggregations over the edges, until no edge
    changes. A hub's edges are never gathered: every step needs only the minimum of
    a node's neighbours, which is aggregated before the shuffle, and joins it back
    by node (skewed sides are split by AQE). Rounds grow with the logarithm of the
    size; reaching ``max_rounds`` raises instead of returning a partial answer."""
    e = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("s"))
            .select("s.*").filter("a <> b").distinct())
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.count_distinct("a")).first()
        if now == before or now[0] == now[2] and not _chained(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _chained(e: DataFrame) -> bool:
    """Whether some parent is itself a child (then the forest is not yet flat)."""
    return not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


__all__ = ["bounded_batches", "components", "cut_lineage", "fold", "new_file", "partitions", "store", "table", "work_dir", "worker_cache"]
