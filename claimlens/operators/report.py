"""Client slices and report tables.

A report for one client is a handful of small tables (summary, monthly trend,
top providers, fraud breakdowns). ``client_report`` builds them for every client
in one pass each, with the employer as an extra grouping key and the per-client
top-n taken on the aggregated (small) table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exprs import money_mean, money_sum, safe_div
from claimlens.operators.common import monthly, top_n


def client_claims(df: DataFrame, client: str, employer: str = "employer") -> DataFrame:
    """Rows of one client. On data written by ``share_by_client`` this becomes a
    partition filter and only that client's files are read."""
    return df.filter(F.col(employer) == F.lit(client))


def period_bounds(kind: str, year: int, month: int | None = None,
                  quarter: int | None = None) -> tuple[_dt.date, _dt.date]:
    """Half-open [start, end) of a month, quarter or year (December and Q4 roll
    into the next January)."""
    kind = kind.lower()
    if kind == "month":
        start = _dt.date(year, month, 1)
        end = _dt.date(year + 1, 1, 1) if month == 12 else _dt.date(year, month + 1, 1)
    elif kind == "quarter":
        sm = (quarter - 1) * 3 + 1
        start = _dt.date(year, sm, 1)
        end = _dt.date(year + 1, 1, 1) if sm + 3 > 12 else _dt.date(year, sm + 3, 1)
    elif kind == "year":
        start, end = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    else:
        raise ValueError(f"unknown period kind {kind!r}")
    return start, end


def period_filter(df: DataFrame, kind: str, year: int, month: int | None = None,
                  quarter: int | None = None, date: str = "date") -> DataFrame:
    """Literal bounds, so the predicate is pushed into the parquet scan."""
    start, end = period_bounds(kind, year, month, quarter)
    return df.filter((F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end)))


def client_overview(df: DataFrame, client: str | None = None, employer: str = "employer",
                    amount: str = "amount") -> DataFrame:
    """Count, total and mean amount (of one client, or per client when ``client`` is None)."""
    aggs = [F.count(F.lit(1)).alias("total_claims"),
            F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
            money_mean(amount).alias("average_amount")]
    if client is None:
        return df.filter(F.col(employer).isNotNull()).groupBy(employer).agg(*aggs)
    return client_claims(df, client, employer).agg(*aggs)


def monthly_trend(df: DataFrame, per: list[str] | None = None, date: str = "date",
                  amount: str = "amount") -> DataFrame:
    """Month-end label, total amount and claim count; empty months are 0 / 0."""
    return monthly(df, [F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
                        F.count(F.col(amount)).alias("claim_count")],
                   date, per, fill={"total_amount": 0.0, "claim_count": 0})


def category_distribution(df: DataFrame, category: str = "category",
                          per: list[str] | None = None) -> DataFrame:
    per = list(per or [])
    return (df.filter(F.col(category).isNotNull()).groupBy(*per, category)
              .agg(F.count(F.lit(1)).alias("count")))


def report_summary(df: DataFrame, per: list[str] | None = None, amount: str = "amount",
                   flag: str = "fraud_flag") -> DataFrame:
    """total_claims, total_amount, average_amount (mean of non-null amounts),
    average_amount_all (total divided by all rows), fraud_count, fraud_amount."""
    per = list(per or [])
    src = df.filter(F.col(per[0]).isNotNull()) if per else df
    f = F.col(flag)
    return src.groupBy(*per).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
        money_mean(amount).alias("average_amount"),
        safe_div(F.coalesce(money_sum(amount), F.lit(0.0)), F.count(F.lit(1))).alias("average_amount_all"),
        F.coalesce(F.sum(f), F.lit(0)).cast("long").alias("fraud_count"),
        F.coalesce(money_sum(F.when(f == 1, F.col(amount))), F.lit(0.0)).alias("fraud_amount"))


def _provider_table(df: DataFrame, per: list[str], provider: str, amount: str,
                    flag: str) -> DataFrame:
    return (df.filter(F.col(provider).isNotNull()).groupBy(*per, provider)
              .agg(F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
                   F.count(F.col(amount)).alias("claim_count"),
                   F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias("fraud_count")))


def top_providers_by_amount(df: DataFrame, n: int = 5, per: list[str] | None = None,
                            provider: str = "provider_id", amount: str = "amount",
                            flag: str = "fraud_flag") -> DataFrame:
    per = list(per or [])
    t = _provider_table(df, per, provider, amount, flag)
    return top_n(t, [F.col("total_amount").desc(), F.col(provider).asc()], n, per or None)


def top_providers_by_fraud(df: DataFrame, n: int = 5, per: list[str] | None = None,
                           provider: str = "provider_id", amount: str = "amount",
                           flag: str = "fraud_flag") -> DataFrame:
    per = list(per or [])
    t = _provider_table(df, per, provider, amount, flag).filter(F.col("fraud_count") > 0)
    return top_n(t, [F.col("fraud_count").desc(), F.col(provider).asc()], n, per or None)


def top_fraud_amount(df: DataFrame, n: int = 5, per: list[str] | None = None,
                     provider: str = "provider_id", amount: str = "amount",
                     flag: str = "fraud_flag") -> DataFrame:
    """Flagged amount per provider, the ``n`` largest."""
    per = list(per or [])
    t = (df.filter((F.col(flag) == 1) & F.col(provider).isNotNull()).groupBy(*per, provider)
           .agg(F.coalesce(money_sum(amount), F.lit(0.0)).alias("fraud_amount")))
    return top_n(t, [F.col("fraud_amount").desc(), F.col(provider).asc()], n, per or None)


def flagged_counts(df: DataFrame, col: str, n: int = 5, per: list[str] | None = None,
                   flag: str = "fraud_flag") -> DataFrame:
    """Top ``n`` values of ``col`` among flagged claims (fraud by category / diagnosis)."""
    per = list(per or [])
    t = (df.filter((F.col(flag) == 1) & F.col(col).isNotNull()).groupBy(*per, col)
           .agg(F.count(F.lit(1)).alias("fraud_count")))
    return top_n(t, [F.col("fraud_count").desc(), F.col(col).asc()], n, per or None)


def fraud_by_category(df: DataFrame, n: int = 5, per: list[str] | None = None) -> DataFrame:
    return flagged_counts(df, "category", n, per)


def fraud_by_diagnosis_count(df: DataFrame, n: int = 5, per: list[str] | None = None) -> DataFrame:
    return flagged_counts(df, "diagnosis", n, per)


def client_report(df: DataFrame, n: int = 5, employer: str = "employer") -> dict[str, DataFrame]:
    """All report tables for every client at once, keyed by table name.

    Each table carries the employer column; top-n lists are ranked per client
    over the aggregated table (one row per client x provider)."""
    per = [employer]
    src = df.filter(F.col(employer).isNotNull())
    return {
        "summary": report_summary(src, per),
        "monthly": monthly_trend(src, per),
        "top_by_amount": top_providers_by_amount(src, n, per),
        "top_by_fraud": top_providers_by_fraud(src, n, per),
        "fraud_by_category": fraud_by_category(src, n, per),
        "fraud_by_diagnosis": fraud_by_diagnosis_count(src, n, per),
    }


#: descending column of each ranked table; ties by its key column, as in the ranking
RANKED_BY = {"top_by_amount": ("total_amount", "provider_id"), "top_by_fraud": ("fraud_count", "provider_id"),
             "fraud_by_category": ("fraud_count", "category"), "fraud_by_diagnosis": ("fraud_count", "diagnosis")}


def report_json(tables: dict[str, DataFrame], employer: str = "employer") -> DataFrame:
    """One JSON document per client: ``{table: [rows...]}``; nested arrays are
    built per client with ``collect_list`` over report tables that are small by
    construction (top-n lists, one row per month), in the order of their ranking or month."""
    docs = None
    for name, t in tables.items():
        others = [c for c in t.columns if c != employer]
        down, key = RANKED_BY.get(name, (None, None))
        lead = [-F.col(down), F.col(key)] if down in others else [F.col(c) for c in ("month",) if c in others]
        keyed = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(lead)], F.struct(*others).alias("_row"))
        part = t.groupBy(employer).agg(
            F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["_row"]).alias(name))
        docs = part if docs is None else docs.join(part, employer, "full")
    cols = [c for c in docs.columns if c != employer]
    return docs.select(employer, F.to_json(F.struct(*cols)).alias("report"))


def year_over_year(df: DataFrame, per: list[str] | None = None, date: str = "date",
                   amount: str = "amount") -> DataFrame:
    """Monthly totals next to the same month one year earlier (a self-join of
    the monthly table on ``add_months(month, -12)``; the monthly table has one
    row per group and month, so the join is small whatever the claim count)."""
    per = list(per or [])
    m = monthly_trend(df, per, date, amount)
    prev = m.select(*per, F.last_day(F.add_months(F.col("month"), 12)).alias("month"),
                    F.col("total_amount").alias("prev_year_amount"),
                    F.col("claim_count").alias("prev_year_count"))
    out = m.join(prev, per + ["month"], "left")
    return out.withColumn("yoy_change", F.round(safe_div(
        F.col("total_amount") - F.col("prev_year_amount"), F.col("prev_year_amount")), 6))
