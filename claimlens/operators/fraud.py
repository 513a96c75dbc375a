"""Fraud roll-ups over a claims table that carries a 0/1 ``fraud_flag``
(from the isolation forest in :mod:`claimlens.operators.iforest`, or given).
A missing flag column counts as all zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exprs import money_sum, safe_div
from claimlens.operators.common import monthly, top_n


def ensure_flag(df: DataFrame, flag: str = "fraud_flag") -> DataFrame:
    if flag in df.columns:
        return df.withColumn(flag, F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    return df.withColumn(flag, F.lit(0))


def provider_fraud_rate_join(df: DataFrame, provider: str = "provider_id",
                             flag: str = "fraud_flag") -> DataFrame:
    """Each claim with its provider's fraud rate (left join; a claim without a
    provider gets NULL). The per-provider table is aggregated map-side first, so
    a provider holding a third of the claims costs one partial row per task;
    AQE broadcasts it when its measured size is small, else sort-merge joins."""
    rates = (df.filter(F.col(provider).isNotNull())
               .groupBy(provider)
               .agg((F.sum(F.col(flag)) / F.count(F.col(flag))).alias("provider_fraud_rate")))
    return df.join(rates, provider, "left")


def fraud_summary(df: DataFrame, flag: str = "fraud_flag", amount: str = "amount") -> DataFrame:
    """Flagged count, fraud rate and amount at risk (one row)."""
    f = F.col(flag)
    return df.agg(
        F.coalesce(F.sum(f), F.lit(0)).cast("long").alias("fraud_count"),
        F.count(F.lit(1)).alias("total_claims"),
        safe_div(F.coalesce(F.sum(f), F.lit(0)), F.count(F.lit(1))).alias("fraud_rate"),
        F.coalesce(money_sum(F.when(f == 1, F.col(amount))), F.lit(0.0)).alias("amount_at_risk"))


def _fraud_by(df: DataFrame, key: str, flag: str, amount: str) -> DataFrame:
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
                   F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias("fraud_count"),
                   F.count(F.col(flag)).alias("total_claims"))
              .withColumn("fraud_rate", safe_div(F.col("fraud_count"), F.col("total_claims"))))


def fraud_by_provider(df: DataFrame, n: int = 10, provider: str = "provider_id",
                      flag: str = "fraud_flag", amount: str = "amount") -> DataFrame:
    """Top ``n`` providers by fraud count (ties by provider)."""
    return top_n(_fraud_by(df, provider, flag, amount),
                 [F.col("fraud_count").desc(), F.col(provider).asc()], n)


def fraud_by_diagnosis(df: DataFrame, n: int = 10, min_claims: int = 10,
                       diagnosis: str = "diagnosis", flag: str = "fraud_flag",
                       amount: str = "amount") -> DataFrame:
    """Top ``n`` diagnoses by fraud rate among those with strictly more than
    ``min_claims`` claims (ties by diagnosis)."""
    t = _fraud_by(df, diagnosis, flag, amount).filter(F.col("total_claims") > min_claims)
    return top_n(t, [F.col("fraud_rate").desc(), F.col(diagnosis).asc()], n)


def fraud_over_time(df: DataFrame, date: str = "date", flag: str = "fraud_flag") -> DataFrame:
    """Monthly fraud count labelled by month end; months without claims are 0."""
    return monthly(df, [F.sum(F.col(flag)).cast("long").alias("fraud_count")], date,
                   fill={"fraud_count": 0})


def fraud_cases(df: DataFrame, n: int = 100, flag: str = "fraud_flag",
                columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` flagged claims, ordered by all projected columns."""
    cols = columns or ["date", "amount", "provider_id", "diagnosis"]
    flagged = df.filter(F.col(flag) == 1).select(*cols)
    return top_n(flagged, cols, n)
