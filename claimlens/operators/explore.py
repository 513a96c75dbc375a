"""Exploratory aggregates over canonical claims (distribution, time trend,
provider efficiency, crosstabs, histograms, frequency tables, profile).

Semantics kept from the dataframe original: null group keys are dropped,
an all-null sum is 0, standard deviations are sample deviations, weeks start
on Monday, and only observed periods appear in a time trend.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.exprs import money, money_mean, money_sum, rounded, safe_div
from claimlens.operators.common import exact_percentiles, grouped_percentile, top_n

# ---------------------------------------------------------------- A1 / A2

def claim_distribution(df: DataFrame, by: str, metric: str = "all",
                       amount: str = "amount") -> DataFrame:
    """Count / total / mean of the amount per value of ``by`` (null keys dropped)."""
    aggs = {
        "count": F.count(F.lit(1)).alias("claim_count"),
        "sum": F.coalesce(money_sum(amount), F.lit(0.0)).alias("total_amount"),
        "mean": money_mean(amount).alias("average_amount"),
    }
    chosen = list(aggs.values()) if metric == "all" else [aggs[metric]]
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*chosen)


def distribution_baseline(df: DataFrame, by: str, metric: str = "sum",
                          amount: str = "amount") -> DataFrame:
    """Reference line drawn under the distribution: the overall mean amount
    (metric ``mean``) or the total amount divided by the number of categories
    (metric ``sum``). One row per category, with the baseline alongside."""
    dist = claim_distribution(df, by, "all", amount)
    overall = df.agg(
        money_mean(amount).alias("_mean"),
        F.coalesce(money_sum(amount), F.lit(0.0)).alias("_total"),
        F.count_distinct(F.col(by)).alias("_ncat"))
    base = (F.col("_mean") if metric == "mean"
            else safe_div(F.col("_total"), F.col("_ncat")))
    # ``overall`` is a single row: broadcasting it is bounded by construction.
    return (dist.crossJoin(F.broadcast(overall.select(base.alias("baseline"))))
                .withColumn("baseline", rounded(F.col("baseline"))))


# ---------------------------------------------------------------- A3 / A4

_UNITS = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def temporal_trend(df: DataFrame, unit: str = "month", date: str = "date",
                   amount: str = "amount") -> DataFrame:
    """Sum, count, mean and sample std of the amount per period, with a 95 % CI."""
    unit = _UNITS[unit.lower()]
    x = money(amount)
    n = F.count(F.col(amount)).cast("double")
    sx = F.sum(x).cast("double")
    sxx = F.sum(x * x).cast("double")
    out = (df.filter(F.col(date).isNotNull())
             .groupBy(F.date_trunc(unit, F.col(date)).cast("date").alias("time_period"))
             .agg(F.coalesce(sx, F.lit(0.0)).alias("total_amount"),
                  F.count(F.col(amount)).alias("claim_count"),
                  F.try_divide(sx, n).alias("avg_amount"),
                  F.try_divide(sxx - sx * sx / n, n - F.lit(1.0)).alias("_var")))
    std = F.sqrt(F.when(F.col("_var") < 0, F.lit(0.0)).otherwise(F.col("_var")))
    half = F.lit(1.96) * std / F.sqrt(F.col("claim_count").cast("double"))
    return out.select(
        "time_period", "total_amount", "claim_count", "avg_amount",
        rounded(std).alias("std_amount"),
        rounded(F.col("avg_amount") - half).alias("ci_lower"),
        rounded(F.col("avg_amount") + half).alias("ci_upper"))


def temporal_ci(df: DataFrame, unit: str = "week", date: str = "date",
                amount: str = "amount") -> DataFrame:
    """Only the confidence band of ``temporal_trend`` (NULL for one-claim periods)."""
    return temporal_trend(df, unit, date, amount).select(
        "time_period", "avg_amount", "ci_lower", "ci_upper")


# ---------------------------------------------------------------- A5 – A9

def provider_stats(df: DataFrame, provider: str = "provider_id", amount: str = "amount",
                   flag: str = "fraud_flag", approx_median: bool = False,
                   median: str = "distributed") -> DataFrame:
    """Per provider: total, count, mean, median amount and mean fraud flag.

    A bad amount counts as 0 and a missing flag as 0. Median strategies:
    ``distributed`` (default): ``grouped_percentile``, radix selection whatever a
    group's size. ``merge``: Spark's exact percentile, a
    value->count map per group that is merged in one task (for groups known to have
    few distinct values). ``approx_median``: a fixed-size sketch.
    """
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    flg = (F.coalesce(F.col(flag).cast("double"), F.lit(0.0)) if flag in df.columns
           else F.lit(0.0))
    src = (df.filter(F.col(provider).isNotNull())
             .select(F.col(provider), amt.alias("_amt"), flg.alias("_flg")))
    sums = {"_total": F.sum(money("_amt")), "total_claims": F.count(F.lit(1)), "_flags": F.sum("_flg")}
    if median == "distributed" and not approx_median:
        out = grouped_percentile(src, [provider], "_amt", 0.5, out_col="_median", sums=sums)
    else:
        med = F.percentile_approx("_amt", 0.5, 10000) if approx_median else F.median("_amt")
        out = src.groupBy(provider).agg(*[c.alias(n) for n, c in sums.items()], med.cast("double").alias("_median"))
    total = F.col("_total").cast("double")
    return out.select(provider, total.alias("total_amount"), "total_claims", (total / F.col("total_claims")).alias("avg_amount"),
                      rounded(F.col("_median")).alias("median_amount"), (F.col("_flags") / F.col("total_claims")).alias("fraud_rate"))


def _overall_mean(df: DataFrame, amount: str) -> DataFrame:
    amt = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    return df.select(amt.alias("_a")).agg(
        (F.sum(money("_a")).cast("double") / F.count(F.lit(1))).alias("_overall"))


def provider_efficiency(df: DataFrame, provider: str = "provider_id",
                        amount: str = "amount", flag: str = "fraud_flag") -> DataFrame:
    """``provider_stats`` plus efficiency_ratio (provider mean / overall mean)
    and cost_per_claim (total / count)."""
    stats = provider_stats(df, provider, amount, flag)
    overall = _overall_mean(df, amount)  # one row, broadcast is bounded
    return (stats.crossJoin(F.broadcast(overall))
                 .withColumn("efficiency_ratio", rounded(safe_div(F.col("avg_amount"), F.col("_overall"))))
                 .withColumn("cost_per_claim", F.col("total_amount") / F.col("total_claims"))
                 .drop("_overall"))


def break_even(df: DataFrame, fixed_costs: float = 50000.0, variable_rate: float = 0.6,
               provider: str = "provider_id", amount: str = "amount",
               flag: str = "fraud_flag") -> DataFrame:
    """Claims needed to cover fixed costs, ``ceil(fixed / (mean * (1 - rate)))``,
    and a Profitable/Unprofitable label. A zero mean gives NULL (no break-even)
    and the provider is Unprofitable."""
    margin = 1.0 - variable_rate
    eff = provider_efficiency(df, provider, amount, flag)
    be = F.ceil(F.try_divide(F.lit(float(fixed_costs)), F.col("avg_amount") * F.lit(margin)))
    return (eff.withColumn("break_even_claims", be.cast("long"))
               .withColumn("profitability",
                           F.when(F.col("total_claims") > F.col("break_even_claims"), "Profitable")
                            .otherwise("Unprofitable")))


def break_even_curve(df: DataFrame, fixed_costs: float = 50000.0, variable_rate: float = 0.6,
                     points: int = 100, provider: str = "provider_id") -> DataFrame:
    """``points`` evenly spaced claim counts from 1 to the largest provider
    count, with the break-even mean amount at each."""
    margin = 1.0 - variable_rate
    mx = (df.filter(F.col(provider).isNotNull()).groupBy(provider).count()
            .agg(F.max("count").cast("double").alias("_max")))
    step = (F.col("_max") - F.lit(1.0)) / F.lit(float(points - 1))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "point")
    x = F.when(F.col("point") == points - 1, F.col("_max")).otherwise(
        F.lit(1.0) + F.col("point").cast("double") * step)
    return (grid.crossJoin(F.broadcast(mx))  # one-row side
                .select(F.col("point"), rounded(x).alias("claims"),
                        rounded(F.lit(float(fixed_costs)) / (x * F.lit(margin))).alias("break_even_amount")))


def provider_ranking(df: DataFrame, n: int = 5, provider: str = "provider_id",
                     amount: str = "amount", flag: str = "fraud_flag") -> DataFrame:
    """The ``n`` most and ``n`` least efficient providers (ratio, ties by id)."""
    eff = provider_efficiency(df, provider, amount, flag).select(
        provider, "efficiency_ratio", "avg_amount", "fraud_rate")
    most = top_n(eff, [F.col("efficiency_ratio").asc(), F.col(provider).asc()], n, rank_col="rank")
    least = top_n(eff, [F.col("efficiency_ratio").desc(), F.col(provider).asc()], n, rank_col="rank")
    return (most.withColumn("side", F.lit("most_efficient"))
                .unionByName(least.withColumn("side", F.lit("least_efficient"))))


# ---------------------------------------------------------------- A10 / A11

def _row_shares(df: DataFrame, row: Column, colm: Column, row_name: str, col_name: str) -> DataFrame:
    pairs = (df.select(row.alias(row_name), colm.alias(col_name))
               .filter(F.col(row_name).isNotNull() & F.col(col_name).isNotNull())
               .groupBy(row_name, col_name).agg(F.count(F.lit(1)).alias("cell")))
    totals = pairs.groupBy(row_name).agg(F.sum("cell").alias("row_total"))
    return pairs, totals


def diagnosis_treatment(df: DataFrame, k: int = 20, diagnosis: str = "diagnosis",
                        treatment: str = "treatment") -> DataFrame:
    """Row-normalised diagnosis x treatment crosstab cut to the top-k diagnoses
    and top-k treatments (by frequency, ties by value); zero cells included.

    Shares are over *all* treatments of a diagnosis, so a cut row need not sum
    to 1. The zero-filled grid is at most k x k rows.
    """
    pairs, totals = _row_shares(df, F.col(diagnosis), F.col(treatment), diagnosis, treatment)
    top_d = top_n(df.filter(F.col(diagnosis).isNotNull()).groupBy(diagnosis).count(),
                  [F.col("count").desc(), F.col(diagnosis).asc()], k).select(diagnosis)
    top_t = top_n(df.filter(F.col(treatment).isNotNull()).groupBy(treatment).count(),
                  [F.col("count").desc(), F.col(treatment).asc()], k).select(treatment)
    grid = top_d.crossJoin(F.broadcast(top_t))  # bounded: k x k rows
    return (grid.join(totals, diagnosis)  # rows absent from the crosstab have no shares
                .join(pairs, [diagnosis, treatment], "left")
                .select(diagnosis, treatment,
                        rounded(F.coalesce(F.col("cell"), F.lit(0)) / F.col("row_total")).alias("share")))


def icd_chapter_treatment(df: DataFrame, code: str = "icd_code",
                          treatment: str = "treatment") -> DataFrame:
    """Share of each treatment within an ICD chapter (first character of the code).

    Returned in long (sparse) form: cells with no claims are implied zeros, so the
    output grows with the observed pairs rather than chapters x treatments.
    """
    pairs, totals = _row_shares(df, F.substring(F.col(code), 1, 1), F.col(treatment),
                                "icd_chapter", treatment)
    return (pairs.join(totals, "icd_chapter")
                 .select("icd_chapter", treatment,
                         rounded(F.col("cell") / F.col("row_total")).alias("share")))


# ---------------------------------------------------------------- A12 – A14, Q1

def histogram(df: DataFrame, col: str = "amount", bins: int = 20) -> DataFrame:
    """Equal-width histogram between the column min and max (the last bin is closed)."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), w)), F.lit(0)),
                F.lit(bins - 1)).cast("int")
    return (df.filter(x.isNotNull()).select(x.alias(col)).crossJoin(F.broadcast(rng))
              .groupBy(b.alias("bucket"), F.col("_lo"), F.col("_hi"))
              .agg(F.count(F.lit(1)).alias("count"))
              .select("bucket",
                      rounded(F.col("_lo") + F.col("bucket") * w).alias("bin_lower"),
                      rounded(F.col("_lo") + (F.col("bucket") + 1) * w).alias("bin_upper"),
                      "count"))


def value_counts(df: DataFrame, col: str, ordered: bool = False) -> DataFrame:
    """Frequency table, nulls dropped; with ``ordered`` sorted by descending count,
    ties by value (a range-partitioned sort of the aggregated table)."""
    out = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
             .agg(F.count(F.lit(1)).alias("count")))
    return out.orderBy(F.col("count").desc(), F.col("value").asc()) if ordered else out


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values of several columns in one pass (filter choices)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    return long.filter(F.col("value").isNotNull()).distinct()


def data_profile(df: DataFrame, numeric: Sequence[str] | None = None,
                 categorical: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Minimal profile: per column count, missing, distinct; for numeric columns
    also mean, sample std, min, quartiles, max and zero count.

    Numeric statistics come from one wide aggregate; distinct counts from a long
    (column, value) form grouped twice, which scales with the data instead of
    expanding rows once per distinct aggregate.
    """
    numeric = list(numeric if numeric is not None else
                   [f.name for f in df.schema.fields
                    if f.dataType.typeName() in ("integer", "long", "double", "float", "short")])
    categorical = list(categorical if categorical is not None else
                       [f.name for f in df.schema.fields if f.dataType.typeName() == "string"])
    cols = numeric + categorical
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"{c}__count"))
    exact_q = {} if approx or not numeric else exact_percentiles(
        df, [(c, q) for c in numeric for q in (0.25, 0.5, 0.75)])
    for c in numeric:
        x = F.col(c).cast("double")
        q = (F.percentile_approx(x, [0.25, 0.5, 0.75], 10000) if approx
             else F.array(*[F.lit(exact_q[(c, p)]).cast("double") for p in (0.25, 0.5, 0.75)]))
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 (F.first(q) if not approx else q).alias(f"{c}__q"),
                 F.count_if(x == 0).alias(f"{c}__zeros")]
    wide = df.agg(*aggs)
    dbl = "double"
    rows = []
    for c in cols:
        isnum = c in numeric
        def g(s, cast=dbl, _c=c, _n=isnum):
            return F.col(f"{_c}__{s}").cast(cast) if _n else F.lit(None).cast(cast)
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit("numeric" if isnum else "categorical").alias("kind"),
            F.col(f"{c}__count").alias("n_count"),
            (F.col("_rows") - F.col(f"{c}__count")).alias("n_missing"),
            rounded(g("mean")).alias("mean"), rounded(g("std")).alias("std"),
            g("min").alias("min"),
            rounded(F.col(f"{c}__q")[0] if isnum else F.lit(None).cast(dbl)).alias("p25"),
            rounded(F.col(f"{c}__q")[1] if isnum else F.lit(None).cast(dbl)).alias("p50"),
            rounded(F.col(f"{c}__q")[2] if isnum else F.lit(None).cast(dbl)).alias("p75"),
            g("max").alias("max"), g("zeros", "long").alias("n_zeros")))
    stats = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # distinct counts from typed long forms (numbers as double, text as is):
    # grouped twice, partially aggregated, no per-value text formatting
    def long_of(names, cast):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("v")) for c in names
        ])).alias("kv")).select("kv.*").filter(F.col("v").isNotNull())

    parts = []
    for names, cast in ((numeric, "double"), (categorical, "string")):
        if not names:
            continue
        lf = long_of(names, cast)
        parts.append(lf.groupBy("column_name").agg(F.approx_count_distinct("v").alias("n_distinct"))
                     if approx else
                     lf.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct")))
    distinct = parts[0]
    for p_ in parts[1:]:
        distinct = distinct.unionByName(p_)
    return (stats.join(distinct, "column_name", "left")
                 .withColumn("n_distinct", F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long")))
