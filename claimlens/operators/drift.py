"""Data drift between a reference and a current sample (D1 - D3).

KS statistics are computed from the distinct-value table of both samples
(counts per value and side), turned into the two empirical CDFs by
``prefix_sums`` (range partitions, no single-partition window), and reduced
with ``max``. PSI joins the category shares of both sides (inner join: a
category seen on one side only contributes nothing) and sums.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.common import prefix_sums

KS_TERMS = 100
KS_EXACT = 10_000           # samples up to this size get the exact p-value


def ks_exact(d: float, n1: int, n2: int) -> float:
    """P(D >= d) for two samples of one continuous distribution.

    The pooled order is a uniformly random lattice path from (0, 0) to (n1, n2); D < d as long
    as it stays where |i / n1 - j / n2| < d. The probability of being at (i, s - i) after s
    steps without having left is carried on from s to s + 1, one vector over i."""
    h = round(d * n1 * n2)
    if h <= 0:
        return 1.0
    i = np.arange(n1 + 1, dtype=np.int64)
    at = np.zeros(n1 + 1)
    at[0] = 1.0
    for s in range(n1 + n2):
        left = n1 + n2 - s
        across = at * (n1 - i) / left
        at *= np.maximum(n2 - (s - i), 0) / left
        at[1:] += across[:-1]
        j = s + 1 - i
        at[(np.abs(i * n2 - j * n1) >= h) | (j < 0) | (j > n2)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - at[n1])))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample KS p-value: Q(lambda) with
    lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * D, ne = n1 n2 / (n1 + n2),
    Q(l) = 2 sum_k (-1)^(k-1) exp(-2 k^2 l^2); 1 for very small lambda."""
    ne = n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double")
    en = F.sqrt(ne)
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    q = F.lit(2.0) * series
    return F.round(F.when(lam < 0.05, F.lit(1.0))
                    .otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))), 6)


@F.pandas_udf(T.DoubleType())
def _ks_exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([ks_exact(*t) if max(t[1:]) <= KS_EXACT else np.nan for t in zip(d, n1.astype(int), n2.astype(int))], dtype="float64")


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sample p-value: exact up to ``KS_EXACT`` values a side, else the asymptotic series
    (null where a side is empty)."""
    exact = F.round(_ks_exact(F.coalesce(d, F.lit(0.0)), n1, n2), 6)
    return F.when((n1 > 0) & (n2 > 0), F.when(F.greatest(n1, n2) <= KS_EXACT, exact).otherwise(ks_pvalue(d, n1, n2)))


def _long_values(df: DataFrame, cols: Sequence[str], side: int) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("kv")).select("kv.*", F.lit(side).alias("is_ref")).filter(
        F.col("v").isNotNull() & ~F.isnan("v"))


def drift_ks_many(cur: DataFrame, ref: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric column: KS statistic, sample sizes and p-value (``ks_p``)."""
    both = _long_values(ref, cols, 1).unionByName(_long_values(cur, cols, 0))
    counts = both.groupBy("column_name", "v").agg(
        F.sum("is_ref").cast("double").alias("r"),
        F.sum(1 - F.col("is_ref")).cast("double").alias("c"))
    cum = prefix_sums(counts, ["column_name", "v"], ["r", "c"])
    # cumulative sums run across columns; subtract each column's starting offset
    per_col = cum.groupBy("column_name").agg(
        F.min(F.col("cum_r") - F.col("r")).alias("_r0"), F.min(F.col("cum_c") - F.col("c")).alias("_c0"),
        F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    j = cum.join(per_col, "column_name")
    diff = F.abs((F.col("cum_r") - F.col("_r0")) / F.col("n_ref") - (F.col("cum_c") - F.col("_c0")) / F.col("n_cur"))
    stat = j.groupBy("column_name", "n_ref", "n_cur").agg(F.max(diff).alias("ks_stat"))
    return stat.select("column_name", F.col("n_ref").cast("long").alias("n_ref"),
                       F.col("n_cur").cast("long").alias("n_cur"), "ks_stat",
                       ks_p(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur")).alias("ks_p"))


def drift_ks(cur: DataFrame, ref: DataFrame, col: str) -> DataFrame:
    return drift_ks_many(cur, ref, [col])


def _shares(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in cols
    ])).alias("kv")).select("kv.*").filter(F.col("category").isNotNull())
    cnt = long.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy("column_name").agg(F.sum("n").alias("t"))
    return cnt.join(tot, "column_name").select(
        "column_name", "category", (F.col("n") / F.col("t")).alias(name))


def drift_psi_many(cur: DataFrame, ref: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per categorical column: PSI = sum over shared categories of (c - r) ln(c / r)."""
    j = _shares(cur, cols, "c").join(_shares(ref, cols, "r"), ["column_name", "category"])
    return j.groupBy("column_name").agg(
        F.round(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))), 6).alias("psi"))


def drift_psi(cur: DataFrame, ref: DataFrame, col: str) -> DataFrame:
    return drift_psi_many(cur, ref, [col])


def drift_report(cur: DataFrame, ref: DataFrame, numeric: Sequence[str] | None = None,
                 categorical: Sequence[str] | None = None,
                 at: _dt.datetime | None = None) -> DataFrame:
    """Long table (column_name, metric, value): ks_stat and ks_p for numeric
    columns, psi for categorical ones; stamped with ``at`` when given."""
    num_types = ("integer", "long", "double", "float", "short")
    numeric = list(numeric if numeric is not None else
                   [f.name for f in cur.schema.fields if f.dataType.typeName() in num_types])
    categorical = list(categorical if categorical is not None else
                       [f.name for f in cur.schema.fields if f.dataType.typeName() == "string"])
    parts = []
    if numeric:
        ks = drift_ks_many(cur, ref, numeric)
        both = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("ks_stat", "ks_p")]
        parts.append(ks.select("column_name", F.explode(F.array(*both)).alias("m")).select("column_name", "m.*"))
    if categorical:
        psi = drift_psi_many(cur, ref, categorical)
        parts.append(psi.select("column_name", F.lit("psi").alias("metric"), F.col("psi").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if at is not None:
        out = out.withColumn("checked_at", F.lit(at))
    return out
