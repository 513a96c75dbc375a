"""Cleaning and feature derivation for canonical claims (C1 - C14).

Every statistic the cleaning needs (missing shares, medians, amount quartiles)
is computed in at most two aggregate passes; the per-row work is one
projection. ``as_of`` replaces "now" so results are reproducible.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.exprs import right_closed_bins
from claimlens.operators.common import exact_percentiles

# ---------------------------------------------------------------- fixed values
# Bins and labels of the original feature engineering.
TENURE_EDGES = [0, 1, 5, 100]
TENURE_LABELS = ["<1yr", "1-5yrs", "5+yrs"]
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-35", "35-45", "45-55", "55-65", "65+"]
SIZE_LABELS = ["Small", "Medium", "Large", "Very Large"]
AGE_MIN, AGE_MAX = 18, 100
SPARSE_PCT = 70.0
DEFAULT_DEPARTMENT = "General"
UNKNOWN = "Unknown"
MASK_MULTIPLIER, MASK_MODULUS = 7919, 999999

# canonical column -> coercion kind
COERCE_SPEC = {"employee_age": "int", "amount": "float", "co_payment": "float",
               "submission_date": "date", "date": "date", "hire_date": "date"}

NUMERIC_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType,
                 T.DecimalType)


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


# ---------------------------------------------------------------- C1


def coerce_types(df: DataFrame, spec: dict[str, str] | None = None) -> DataFrame:
    """int: parsed as a number and truncated, bad -> 0; float: digits and dots
    only (so the sign is dropped), bad -> NULL; date: bad -> NULL. Absent
    columns are skipped."""
    spec = spec or COERCE_SPEC
    exprs = []
    for c in df.columns:
        kind = spec.get(c)
        x = F.col(c)
        if kind == "int":
            num = x.cast("double") if _is_numeric(df, c) else F.trim(x.cast("string")).try_cast("double")
            e = F.coalesce(num.try_cast("long").try_cast("int"), F.lit(0))
        elif kind == "float":
            e = (F.abs(x.cast("double")) if _is_numeric(df, c)
                 else F.regexp_replace(x.cast("string"), r"[^\d.]", "").try_cast("double"))
        elif kind == "date":
            dt = df.schema[c].dataType
            e = x.cast("date") if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) \
                else F.to_date(F.try_to_timestamp(x.cast("string")))
        else:
            e = x
        exprs.append(e.alias(c))
    return df.select(*exprs)


# ---------------------------------------------------------------- C2 / C3


def _missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x.isNull()


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: missing count (NULL or NaN) and percentage of rows (one aggregate pass)."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"))
                     for i, c in enumerate(df.columns)])
    return (wide.select("_n", F.explode(rows).alias("r"))
                .select("r.column_name", "r.missing",
                        F.round(F.try_divide(F.col("r.missing") * F.lit(100.0), F.col("_n")), 6)
                        .alias("pct_missing")))


def sparse_columns(df: DataFrame, threshold: float = SPARSE_PCT) -> list[str]:
    """Columns with strictly more than ``threshold`` percent missing (one small
    collect: one row per column)."""
    rep = missing_report(df).filter(F.col("pct_missing") > threshold)
    return [r["column_name"] for r in rep.collect()]


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_PCT) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


# ---------------------------------------------------------------- C4 / C5 / C6


def medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, float]:
    """Medians of several columns: exact and interpolated (``exact_percentiles``:
    shared passes, no column gathered in one task), or sketches with ``approx``."""
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(c)
                       for c in cols]).first()
        return {c: row[c] for c in cols}
    got = exact_percentiles(df, [(c, 0.5) for c in cols])
    return {c: got[(c, 0.5)] for c in cols}


def impute(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Missing strings -> 'Unknown'; missing numbers (NULL or NaN) -> the column's median.

    Integer columns become double, whether or not a value is missing: a median may lie
    between two integers, and the schema does not depend on the data."""
    strings = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name not in skip]
    nums = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip]
    med = medians(df, nums)
    out = df.fillna(UNKNOWN, subset=strings) if strings else df
    exprs = []
    for c in out.columns:
        if c in med and med[c] is not None:
            exprs.append(F.when(_missing(df, c), F.lit(med[c])).otherwise(F.col(c).cast("double")).alias(c))
        elif c in nums:
            exprs.append(F.col(c).cast("double").alias(c))
        else:
            exprs.append(F.col(c))
    return out.select(*exprs)


def fix_amount(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Absolute value; non-positive amounts become the median of the absolute
    amounts (zeros included in that median)."""
    a = F.abs(F.col(amount).cast("double"))
    med = exact_percentiles(df.select(a.alias("_a")), [("_a", 0.5)])[("_a", 0.5)]
    return df.withColumn(amount, F.when(a <= 0, F.lit(med)).otherwise(a))


def clip_age(df: DataFrame, age: str = "employee_age", lo: int = AGE_MIN,
             hi: int = AGE_MAX) -> DataFrame:
    """Clamp to [lo, hi]; NULL stays NULL."""
    x = F.col(age)
    return df.withColumn(age, F.when(x.isNull(), x).when(x < lo, F.lit(lo))
                              .when(x > hi, F.lit(hi)).otherwise(x).cast(df.schema[age].dataType))


# ---------------------------------------------------------------- C7 – C10


def tenure_group(df: DataFrame, as_of: _dt.date, hire: str = "hire_date") -> DataFrame:
    tenure = F.datediff(F.lit(as_of), F.col(hire)) / F.lit(365.0)
    return (df.withColumn("tenure", tenure)
              .withColumn("tenure_group", right_closed_bins(F.col("tenure"), TENURE_EDGES, TENURE_LABELS)))


def age_group(df: DataFrame, age: str = "employee_age") -> DataFrame:
    return df.withColumn("age_group", right_closed_bins(F.col(age), AGE_EDGES, AGE_LABELS))


def quartile_edges(df: DataFrame, amount: str = "amount") -> list[float]:
    """Exact linear-interpolated quartiles plus min and max (one aggregate)."""
    q = exact_percentiles(df, [(amount, 0.0), (amount, 0.25), (amount, 0.5), (amount, 0.75),
                               (amount, 1.0)])
    return [q[(amount, p)] for p in (0.0, 0.25, 0.5, 0.75, 1.0)]


def size_label(x: Column, edges: list[float]) -> Column:
    """Quartile label by value: first bin includes its lower edge, the rest are
    right-closed; equal edges merge into the lower label."""
    lo, q1, q2, q3, hi = edges
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when((x >= lo) & (x <= q1), SIZE_LABELS[0])
             .when((x > q1) & (x <= q2), SIZE_LABELS[1])
             .when((x > q2) & (x <= q3), SIZE_LABELS[2])
             .when((x > q3) & (x <= hi), SIZE_LABELS[3]))


def claim_size(df: DataFrame, amount: str = "amount", edges: list[float] | None = None) -> DataFrame:
    edges = edges or quartile_edges(df, amount)
    return df.withColumn("claim_size", size_label(F.col(amount).cast("double"), edges))


def calendar_features(df: DataFrame, date: str = "submission_date") -> DataFrame:
    d = F.col(date)
    return (df.withColumn("claim_weekday", F.date_format(d, "EEEE"))
              .withColumn("claim_month", F.date_format(d, "MMMM"))
              .withColumn("claim_quarter", F.quarter(d)))


# ---------------------------------------------------------------- C11


def clean_claims(df: DataFrame, as_of: _dt.date = _dt.date(2002, 1, 1),
                 sparse_pct: float = SPARSE_PCT) -> DataFrame:
    """C1 -> C10 composed. Statistics: missing shares, medians of the coerced
    numeric columns, then one shared pass for the amount's median and quartile
    edges (recomputed only if some amount needed fixing)."""
    x = coerce_types(df)
    x = drop_sparse_columns(x, sparse_pct)
    x = impute(x)
    edges = None
    if "amount" in x.columns:
        # |amount|; its median and quartile edges come from one shared percentile
        # pass. Only when some amount is non-positive (an early-exit probe) is the
        # median substituted and the edges recomputed on the fixed column.
        x = x.withColumn("amount", F.abs(F.col("amount").cast("double")))
        probs = (0.5, 0.0, 0.25, 0.75, 1.0)
        q = exact_percentiles(x, [("amount", p) for p in probs])
        if x.filter(F.col("amount") <= 0).take(1):
            x = x.withColumn("amount", F.when(F.col("amount") <= 0, F.lit(q[("amount", 0.5)]))
                                        .otherwise(F.col("amount")))
        else:
            edges = [q[("amount", p)] for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    if "employee_age" in x.columns:
        x = clip_age(x)
    if "department" not in x.columns:
        x = x.withColumn("department", F.lit(DEFAULT_DEPARTMENT))
    if "hire_date" in x.columns:
        x = tenure_group(x, as_of)
    if "employee_age" in x.columns:
        x = age_group(x)
    if "amount" in x.columns:
        x = claim_size(x, edges=edges)
    if "submission_date" in x.columns:
        x = calendar_features(x)
    return x


# ---------------------------------------------------------------- C12 / C13 / C14


def _hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    block = 64
    if len(key) > block:
        key = hashlib.sha256(key).digest()
    key = key.ljust(block, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(col: Column, key: str) -> Column:
    """HMAC-SHA256 of a string column as lower-case hex, from ``sha2`` alone:
    H((K ^ opad) || H((K ^ ipad) || m)). The pads are computed once here."""
    ipad, opad = _hmac_pads(key.encode())
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(col, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def mask_amount_expr(col: Column) -> Column:
    """``(int(v * 100) * 7919) mod 999999`` as text (lossy masking, not encryption)."""
    cents = (col.cast("double") * F.lit(100.0)).cast("long")
    return F.pmod(cents * F.lit(MASK_MULTIPLIER), F.lit(MASK_MODULUS)).cast("string")


def mask_amount(df: DataFrame, amount: str = "amount") -> DataFrame:
    return df.withColumn(amount, mask_amount_expr(F.col(amount)))


def pseudonymize(df: DataFrame, key: str, id_col: str = "employee_id",
                 amount: str | None = "amount", length: int = 12) -> DataFrame:
    """Replace the member id by the first ``length`` hex digits of its HMAC
    (integer ids are hashed as their decimal text) and mask the amount."""
    out = df.withColumn(id_col, F.substring(hmac_sha256_hex(F.col(id_col).cast("string"), key), 1, length))
    if amount and amount in df.columns:
        out = mask_amount(out, amount)
    return out


def isin_filter(df: DataFrame, selections: dict[str, Sequence]) -> DataFrame:
    """AND of ``col IN (values)`` for every non-empty selection (pushed into the scan)."""
    cond = F.lit(True)
    for c, vals in selections.items():
        if vals:
            cond = cond & F.col(c).isin(list(vals))
    return df.filter(cond)
