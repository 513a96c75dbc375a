"""Column profiles from stored partial states, one per day and column, that merge.

A day's state holds counts, mean and squared deviations, extremes, zeros, a KLL sketch of
the values and an HLL sketch of their hashes. States of any days merge into the profile of
those days, so a new or corrected day costs a scan of that day alone: ``add`` replaces the
days it is given and leaves the others. Counts, extremes and zeros are exact, mean and
deviation equal up to rounding; quantiles are within ``RANK_ERROR`` of their rank and
distinct counts within ``DISTINCT_ERROR`` of their number (99 % bounds of the sketch sizes).

Defined cases: a null date is a day of its own; a column without values has null statistics
and 0 distinct values; NaN counts as missing; adding an empty table changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.exprs import rounded

KLL_K, HLL_LG = 400, 14
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.03
NO_DAY = "none"

_STATE = ("column_name string, kind string, n_rows long, n long, mean double, m2 double, lo double, hi double, zeros long, "
          "kll binary, hll binary, day string")


def day_states(df: DataFrame, date: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row per (day, column), from one map-side combined aggregate."""
    day = F.coalesce(F.date_format(F.col(date).cast("date"), "yyyy-MM-dd"), F.lit(NO_DAY))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate([*numeric, *categorical]):
        if i < len(numeric):
            x = F.col(c).cast("double")
            x = F.when(~F.isnan(x), x)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"),
                     F.max(x).alias(f"h{i}"), F.count_if(x == 0).alias(f"z{i}"), F.kll_sketch_agg_double(x, KLL_K).alias(f"k{i}")]
        else:
            x = F.col(c).cast("string")
            aggs.append(F.count(x).alias(f"n{i}"))
        aggs.append(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), HLL_LG).alias(f"d{i}"))
    wide = df.groupBy(day.alias("day")).agg(*aggs)
    parts = []
    for i, c in enumerate([*numeric, *categorical]):
        number = i < len(numeric)

        def own(name: str, cast: str, i=i, number=number):
            return (F.col(f"{name}{i}") if number else F.lit(None)).cast(cast)

        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.lit("numeric" if number else "categorical").alias("kind"), F.col("rows").alias("n_rows"),
            F.col(f"n{i}").alias("n"), own("a", "double").alias("mean"), (own("v", "double") * F.col(f"n{i}")).alias("m2"),
            own("l", "double").alias("lo"), own("h", "double").alias("hi"), own("z", "long").alias("zeros"),
            own("k", "binary").alias("kll"), F.col(f"d{i}").alias("hll")))
    return wide.select("day", F.explode(F.array(*parts)).alias("s")).select("s.*", "day")


def merged_profile(states: DataFrame) -> DataFrame:
    """The profile of all days in ``states``, one row per column."""
    whole = states.groupBy("column_name").agg(F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mu"))
    j = states.join(F.broadcast(whole), "column_name")          # one row per column
    quantiles = F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])
    got = j.groupBy("column_name").agg(
        F.first("kind").alias("kind"), F.sum("n").alias("n_count"), F.sum(F.col("n_rows") - F.col("n")).alias("n_missing"),
        F.first("mu").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))).alias("m2"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("zeros").alias("n_zeros"),
        F.kll_merge_agg_double(F.when((F.col("n") > 0) & F.col("kll").isNotNull(), F.col("kll"))).alias("kll"),
        F.hll_union_agg(F.col("hll"), True).alias("hll"))
    some = (F.col("n_count") > 0) & (F.col("kind") == "numeric")
    q = F.when(some, F.kll_sketch_get_quantile_double("kll", quantiles))
    return got.select(
        "column_name", "kind", "n_count", "n_missing", rounded(F.when(some, F.col("mean"))).alias("mean"),
        rounded(F.when(some & (F.col("n_count") > 1), F.sqrt(F.try_divide("m2", F.col("n_count") - 1)))).alias("std"),
        "min", q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "max", "n_zeros",
        F.when(F.col("n_count") > 0, F.hll_sketch_estimate("hll")).otherwise(F.lit(0)).cast("long").alias("n_distinct"))


class ProfileStore:
    """States of a table's days under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, numeric: Sequence[str], categorical: Sequence[str]):
        self.spark, self.folder = spark, folder
        self.numeric, self.categorical = list(numeric), list(categorical)

    def add(self, df: DataFrame, date: str) -> None:
        """Replace the states of the days that occur in ``df``."""
        (day_states(df, date, self.numeric, self.categorical).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(self.folder))

    def states(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The states of the days from ``first`` to ``last`` (yyyy-MM-dd; partitions are pruned)."""
        got = self.spark.read.schema(_STATE).parquet(self.folder)
        for bound, keep in ((first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
            if bound is not None:
                got = got.filter(keep & (F.col("day") != NO_DAY))
        return got

    def profile(self, first: str | None = None, last: str | None = None) -> DataFrame:
        return merged_profile(self.states(first, last))
