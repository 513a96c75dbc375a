"""Stored day states merge into the profile of all days."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import explore
from claimlens.operators import profile_store as P
from claimlens.plans import sql as S

EXACT = ["kind", "n_count", "n_missing", "min", "max", "n_zeros"]


def _by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def _check(got, want, sorted_values):
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert [g[k] for k in EXACT] == [w[k] for k in EXACT], c
        assert abs(g["n_distinct"] - w["n_distinct"]) <= max(1, P.DISTINCT_ERROR * w["n_distinct"]), c
        if w["kind"] == "numeric":
            assert g["mean"] == pytest.approx(w["mean"], rel=1e-9) and g["std"] == pytest.approx(w["std"], rel=1e-9)
            x = sorted_values[c]
            for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
                lo, hi = np.searchsorted(x, g[name], "left") / len(x), np.searchsorted(x, g[name], "right") / len(x)
                assert lo - P.RANK_ERROR <= q <= hi + P.RANK_ERROR, (c, name)


def test_merged_days_equal_the_whole_profile(spark, claims_small, tmp_path):
    num, cat = S.PROFILE_NUMERIC, S.PROFILE_CATEGORICAL
    store = P.ProfileStore(spark, f"{tmp_path}/p", num, cat)
    early = F.coalesce(F.col("date") < F.lit(dt.date(1995, 1, 1)), F.lit(True))
    store.add(claims_small.filter(early), "date")
    store.add(claims_small.filter(~early), "date")
    values = {c: np.sort(claims_small.select(F.col(c).cast("double").alias("v")).filter("v is not null").toPandas()["v"].to_numpy()) for c in num}
    want = _by_column(explore.data_profile(claims_small, num, cat))
    _check(_by_column(store.profile()), want, values)
    # a day that comes again replaces itself, and an empty addition changes nothing
    day = claims_small.agg(F.max("date")).first()[0]
    store.add(claims_small.filter(F.col("date") == F.lit(day)), "date")
    store.add(claims_small.limit(0), "date")
    again = _by_column(store.profile())
    assert all(again[c]["n_count"] == want[c]["n_count"] for c in want)
    part = claims_small.filter((F.col("date") >= "1996-01-01") & (F.col("date") <= "1996-12-31"))
    year = _by_column(store.profile("1996-01-01", "1996-12-31"))
    assert all(year[c]["n_count"] == r["n_count"] and year[c]["max"] == r["max"] for c, r in _by_column(explore.data_profile(part, num, cat)).items())


def test_profile_store_cases(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1), 1.0, "a", None), (None, 0.0, None, None), (dt.date(2024, 1, 2), float("nan"), "a", None), (None, None, "b", None)]
    df = spark.createDataFrame(rows, "day date, x double, c string, e double").withColumnRenamed("day", "d")
    store = P.ProfileStore(spark, f"{tmp_path}/p", ["x", "e"], ["c"])
    store.add(df, "d")
    got = _by_column(store.profile())
    assert (got["x"]["n_count"], got["x"]["n_missing"], got["x"]["n_zeros"], got["x"]["mean"]) == (2, 2, 1, 0.5)
    assert (got["e"]["n_count"], got["e"]["mean"], got["e"]["p50"], got["e"]["n_distinct"]) == (0, None, None, 0)
    assert (got["c"]["n_count"], got["c"]["n_distinct"], got["c"]["mean"]) == (3, 2, None)
    assert _by_column(store.profile("2024-01-01"))["x"]["n_count"] == 1
