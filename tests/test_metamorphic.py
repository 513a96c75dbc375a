"""Metamorphic checks: shuffling the input's partitioning leaves every result
unchanged, bit for bit (exact decimal sums, value-based sampling and ranks)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.operators import audit, clean, drift, explore, fraud, iforest, report
from claimlens.operators import model as M
from tools.oracle_check import digest


def same(a, b):
    ra = [tuple(r) for r in a.collect()]
    rb = [tuple(r) for r in b.collect()]
    return digest(a.columns, ra)[0] == digest(b.columns, rb)[0]


OPS = {
    "provider_stats": lambda c: explore.provider_stats(c),
    "temporal_trend": lambda c: explore.temporal_trend(c, "week"),
    "diagnosis_treatment": lambda c: explore.diagnosis_treatment(c, 5),
    "data_profile": lambda c: explore.data_profile(c, ["amount", "employee_age"], ["employer"]),
    "fraud_over_time": lambda c: fraud.fraud_over_time(c),
    "client_report_top": lambda c: report.client_report(c, 3)["top_by_amount"],
    "drift": lambda c: drift.drift_report(c.filter(F.col("date") >= "1998-01-01"),
                                          c.filter(F.col("date") < "1998-01-01"),
                                          ["amount"], ["category"]),
    "split": lambda c: M.temporal_split(c, 0.2).select("claim_id", "line_no", "amount", "split"),
    "clean": lambda c: clean.clean_claims(c, dt.date(2002, 1, 1)),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_partitioning_does_not_change_results(claims_small, name):
    a = OPS[name](claims_small)
    b = OPS[name](claims_small.repartition(7, "amount"))
    assert same(a, b)


def test_iforest_scores_independent_of_partitioning(claims_small):
    f1 = iforest.iforest_fit(claims_small, ["amount", "co_payment"], n_trees=20, seed=3)
    f2 = iforest.iforest_fit(claims_small.repartition(5), ["amount", "co_payment"], n_trees=20, seed=3)
    assert f1.nodes.equals(f2.nodes)


def test_login_burst_independent_of_partitioning(spark):
    from claimlens.sources.fixtures import audit_events
    ev = audit_events(spark, "/root/testdata/sf0.001")
    assert same(audit.failed_login_burst(ev), audit.failed_login_burst(ev.repartition(9)))
