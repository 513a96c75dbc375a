"""Hypothesis property tests for the numeric building blocks."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.functions.exprs import right_closed_bins
from claimlens.operators import common

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False),
                  min_size=1, max_size=300)


@SETTINGS
@given(vals=values, q=st.floats(min_value=0.0, max_value=1.0))
def test_exact_percentile_equals_numpy(spark, vals, q):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = common.exact_percentiles(df, [("x", q)], accuracy=100)[("x", q)]
    assert got == pytest.approx(float(np.percentile(vals, q * 100)), rel=1e-9, abs=1e-9)


@SETTINGS
@given(vals=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300),
       parts=st.integers(min_value=1, max_value=9))
def test_prefix_sums_equal_cumsum(spark, vals, parts):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, v double")
    got = common.prefix_sums(df, ["i"], ["v"], n_parts=parts).orderBy("i").toPandas()
    assert got["cum_v"].tolist() == pd.Series(vals, dtype=float).cumsum().tolist()


@SETTINGS
@given(vals=st.lists(st.integers(min_value=-5, max_value=110), min_size=1, max_size=100))
def test_right_closed_bins_equal_pandas_cut(spark, vals):
    edges, labels = [0, 25, 35, 45, 55, 65, 100], ["<25", "25-35", "35-45", "45-55", "55-65", "65+"]
    df = spark.createDataFrame([(v,) for v in vals], "a int")
    got = [r[0] for r in df.select(right_closed_bins(F.col("a"), edges, labels)).collect()]
    exp = pd.cut(pd.Series(vals), edges, labels=labels).astype(object).where(lambda s: s.notna(), None)
    assert got == list(exp)
