"""Hand-made frames for the edge semantics named in the survey."""

import datetime as dt
import hashlib
import hmac
import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlens.operators import audit, clean, common, drift, explore, fraud, report
from claimlens.sources import ingest, sinks
from claimlens.sources import audit as audit_src

D = dt.date
SCHEMA = ("provider_id string, diagnosis string, treatment string, category string, "
          "employer string, amount double, fraud_flag int, date date")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_single_row_period_has_null_std_and_ci(spark):
    df = frame(spark, [("p", "d", "t", "c", "e", 10.0, 0, D(2020, 1, 5)),
                       ("p", "d", "t", "c", "e", 20.0, 0, D(2020, 2, 5)),
                       ("p", "d", "t", "c", "e", 40.0, 0, D(2020, 2, 6))])
    out = {r["time_period"]: r for r in explore.temporal_trend(df, "month").collect()}
    jan, feb = out[D(2020, 1, 1)], out[D(2020, 2, 1)]
    assert jan["std_amount"] is None and jan["ci_lower"] is None
    assert feb["std_amount"] == pytest.approx(np.std([20, 40], ddof=1), abs=1e-6)
    assert feb["avg_amount"] == 30.0


def test_week_starts_monday(spark):
    df = frame(spark, [("p", "d", "t", "c", "e", 1.0, 0, D(2024, 1, 7))])  # a Sunday
    r = explore.temporal_trend(df, "week").first()
    assert r["time_period"] == D(2024, 1, 1)


def test_empty_month_between_two_months_is_zero(spark):
    df = frame(spark, [("p", "d", "t", "c", "e", 1.0, 1, D(2020, 1, 31)),
                       ("p", "d", "t", "c", "e", 1.0, 1, D(2020, 3, 1))])
    out = {r["month"]: r["fraud_count"] for r in fraud.fraud_over_time(df).collect()}
    assert out == {D(2020, 1, 31): 1, D(2020, 2, 29): 0, D(2020, 3, 31): 1}
    mt = {r["month"]: (r["total_amount"], r["claim_count"]) for r in report.monthly_trend(df).collect()}
    assert mt[D(2020, 2, 29)] == (0.0, 0)


def test_zero_mean_provider_is_unprofitable(spark):
    df = frame(spark, [("zero", "d", "t", "c", "e", 0.0, 0, D(2020, 1, 1)),
                       ("big", "d", "t", "c", "e", 1e9, 0, D(2020, 1, 1))])
    out = {r["provider_id"]: r for r in explore.break_even(df).collect()}
    assert out["zero"]["break_even_claims"] is None
    assert out["zero"]["profitability"] == "Unprofitable"
    assert out["big"]["break_even_claims"] == 1


def test_null_group_keys_are_dropped(spark):
    df = frame(spark, [(None, None, "t", None, "e", 5.0, 1, D(2020, 1, 1)),
                       ("p", "d", "t", "c", "e", 7.0, 0, D(2020, 1, 1))])
    assert [r["provider_id"] for r in explore.provider_stats(df).collect()] == ["p"]
    assert explore.value_counts(df, "category").count() == 1
    assert explore.claim_distribution(df, "diagnosis").count() == 1
    # overall mean still uses every row
    eff = explore.provider_efficiency(df).first()
    assert eff["efficiency_ratio"] == pytest.approx(7.0 / 6.0, abs=1e-6)


def test_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "employer string, amount double")
    r = explore.claim_distribution(df, "employer").first()
    assert r["total_amount"] == 0.0 and r["average_amount"] is None


def test_tied_top_k_breaks_ties_by_key(spark):
    rows = [(p, "d", "t", "c", "e", 100.0, 1, D(2020, 1, 1)) for p in ["b", "a", "c"]]
    out = report.top_providers_by_amount(frame(spark, rows), 2).collect()
    assert [r["provider_id"] for r in out] == ["a", "b"]


def test_strictly_more_than_ten_claims(spark):
    rows = [("p", "ten", "t", "c", "e", 1.0, 1, D(2020, 1, 1))] * 10
    rows += [("p", "eleven", "t", "c", "e", 1.0, 0, D(2020, 1, 1))] * 11
    out = [r["diagnosis"] for r in fraud.fraud_by_diagnosis(frame(spark, rows)).collect()]
    assert out == ["eleven"]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(25,), (26,), (0,), (100,), (101,)], "employee_age int")
    out = {r["employee_age"]: r["age_group"] for r in clean.age_group(df).collect()}
    assert out == {25: "<25", 26: "25-35", 0: None, 100: "65+", 101: None}


def test_claim_size_quartiles_by_value(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([(v,) for v in vals], "amount double")
    edges = np.percentile(vals, [25, 50, 75])
    got = {r["amount"]: r["claim_size"] for r in clean.claim_size(df).collect()}
    exp = pd.qcut(pd.Series(vals), 4, labels=clean.SIZE_LABELS)
    assert [got[v] for v in vals] == list(exp.astype(str))
    assert clean.quartile_edges(df)[1:4] == pytest.approx(list(edges))


def test_clip_age_keeps_null(spark):
    df = spark.createDataFrame([(10,), (None,), (150,), (40,)], "employee_age int")
    assert [r[0] for r in clean.clip_age(df).collect()] == [18, None, 100, 40]


def test_mask_amount_equals_python(spark):
    vals = [68423.46, 0.01, 1234.5, 99999.99, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "amount double")
    got = [r[0] for r in clean.mask_amount(df).collect()]
    assert got == [str((int(float(v) * 100) * 7919) % 999999) for v in vals]


def test_pseudonymize_integer_ids_equals_hmac(spark):
    df = spark.createDataFrame([(12345,), (7,)], "employee_id bigint")
    got = [r[0] for r in clean.pseudonymize(df, "k3y", amount=None).collect()]
    exp = [hmac.new(b"k3y", str(i).encode(), hashlib.sha256).hexdigest()[:12] for i in (12345, 7)]
    assert got == exp
    long_key = "x" * 100  # keys longer than a block are hashed first
    got = clean.pseudonymize(df, long_key, amount=None).first()[0]
    assert got == hmac.new(long_key.encode(), b"12345", hashlib.sha256).hexdigest()[:12]


def test_coerce_types_and_fix_amount(spark):
    df = spark.createDataFrame([("12.7", "KES -1,000.50", "2020-01-02"), ("x", "n/a", "bad")],
                               "employee_age string, amount string, hire_date string")
    out = clean.coerce_types(df).collect()
    assert out[0]["employee_age"] == 12 and out[1]["employee_age"] == 0
    assert out[0]["amount"] == 1000.5 and out[1]["amount"] is None
    assert out[0]["hire_date"] == D(2020, 1, 2) and out[1]["hire_date"] is None
    fixed = clean.fix_amount(spark.createDataFrame([(-4.0,), (0.0,), (2.0,)], "amount double"))
    assert sorted(r[0] for r in fixed.collect()) == [2.0, 2.0, 4.0]  # median of |x| = 2


def test_missing_report_and_sparse_drop(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "x")], "a int, b string")
    rep = {r["column_name"]: r["pct_missing"] for r in clean.missing_report(df).collect()}
    assert rep == {"a": 0.0, "b": 75.0}
    assert clean.drop_sparse_columns(df).columns == ["a"]


def test_impute_fills_median_and_unknown(spark):
    df = spark.createDataFrame([(1.0, None), (None, "x"), (3.0, "y")], "v double, s string")
    out = clean.impute(df).collect()
    assert [r["v"] for r in out] == [1.0, 2.0, 3.0]
    assert [r["s"] for r in out] == ["Unknown", "x", "y"]


def test_clean_claims_adds_department_when_absent(spark):
    df = spark.createDataFrame([(30, 100.0, D(2021, 6, 1), D(2021, 1, 1))],
                               "employee_age int, amount double, hire_date date, submission_date date")
    r = clean.clean_claims(df, D(2022, 1, 1)).first()
    assert r["department"] == "General" and r["tenure_group"] == "<1yr"
    assert r["claim_weekday"] == "Friday" and r["claim_month"] == "January" and r["claim_quarter"] == 1


def test_schema_map_eight_renames_and_format(spark):
    cols = ["CLAIM_CENTRAL_ID", "CLAIM_MEMBER_NUMBER", "CLAIM_PROV_DATE", "PROV_NAME", "POL_NAME",
            "Ailment", "Department", "SERVICE_DESCRIPTION", "AMOUNT", "Gender", "DOB"]
    df = spark.createDataFrame([tuple("v" for _ in cols)], ", ".join(f"`{c}` string" for c in cols))
    out = ingest.schema_map(df).columns
    assert out == ["CLAIM_CENTRAL_ID", "employee_id", "date", "provider_id", "employer", "diagnosis",
                   "department", "treatment", "amount", "Gender", "DOB"]
    # fuzzy matching only when asked
    df2 = spark.createDataFrame([(1.0,)], "`Total Claimed Amount` double")
    assert ingest.schema_map(df2).columns == ["Total Claimed Amount"]
    assert ingest.schema_map(df2, fuzzy=True).columns == ["amount"]


def test_date_format_first_with_a_hit_wins(spark):
    df = spark.createDataFrame([("2020-01-31",), ("2020-02-01",), ("garbage",)], "date string")
    out = ingest.parse_dates(df, "date").collect()
    assert [r[0] for r in out] == [D(2020, 1, 31), D(2020, 2, 1)]
    df2 = spark.createDataFrame([("5/3/2020",), ("13/01/2020",)], "date string")
    assert [r[0] for r in ingest.parse_dates(df2).collect()] == [D(2020, 3, 5), D(2020, 1, 13)]


def test_parse_amount_invalid_to_zero(spark):
    df = spark.createDataFrame([("1,234.50",), ("",), ("1.2.3",), (None,)], "amount string")
    out = ingest.parse_amount(df).collect()
    assert [r["amount"] for r in out] == [1234.5, 0.0, 0.0, 0.0]
    assert sum(r["amount_invalid"] for r in out) == 3


def test_lines_to_claims_null_dob_and_keys(spark):
    rows = [("c1", "m1", D(2020, 1, 1), "p", "e", "d", "dep", "t2", 10.0, "F", None),
            ("c1", "m1", D(2020, 1, 1), "p", "e", "d", "dep", "t1", 5.0, "F", None),
            ("c2", "m2", D(2020, 1, 1), "p", "e", "d", None, "t1", 5.0, "M", "1990-01-01")]
    df = spark.createDataFrame(rows, "CLAIM_CENTRAL_ID string, employee_id string, date date, "
                               "provider_id string, employer string, diagnosis string, department string, "
                               "treatment string, amount double, Gender string, DOB string")
    out = ingest.lines_to_claims(df, D(2002, 1, 1)).collect()
    assert len(out) == 1  # null department key dropped
    r = out[0]
    assert r["treatment"] == "t1|t2" and r["amount"] == 15.0 and r["employee_age"] is None
    assert r["co_payment"] == pytest.approx(1.5) and r["status"] == "Paid"


def test_load_gate_reports_without_throwing(spark):
    df = spark.createDataFrame([(1.0, "x")], "TotalAmt double, MemberNo string")
    rules = {r["rule"]: r for r in ingest.load_gate(df).collect()}
    assert not rules["required:amount"]["passed"] and "TotalAmt" in rules["required:amount"]["detail"]
    assert not rules["required:date"]["passed"]
    assert not rules["min_rows"]["passed"]


def test_icd10_pattern(spark):
    df = spark.createDataFrame([("A01",), ("U99",), ("Z9B",), ("1AB",), (None,)], "icd_code string")
    assert [r["icd_valid"] for r in ingest.icd10_validate(df).collect()] == [True, False, True, False, False]


def test_read_claims_ragged_rows_and_latin1(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write("AMOUNT,PROV_NAME\n1,Ñairobi\n2\n3,x,extra\n")
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("AMOUNT,PROV_NAME\n4,Mombasa Caf\xe9\n".encode("latin-1"))
    df = ingest.read_claims(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")])
    rows = {r["AMOUNT"]: r for r in df.collect()}
    assert rows["1"]["PROV_NAME"] == "Ñairobi"
    assert rows["4"]["PROV_NAME"] == "Mombasa Café"
    assert rows["2"]["PROV_NAME"] is None
    assert rows["3"]["_corrupt_record"] is not None


def test_audit_read_append_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="audit-")
    with open(os.path.join(d, "acme_audit.log"), "w") as f:
        f.write('{"timestamp": "2024-01-01T10:00:00.5", "user": "u", "action": "login", "target": null, "ip": ""}\n')
    df = audit_src.audit_read(spark, d)
    r = df.first()
    assert r["tenant"] == "acme" and r["target"] is None and r["ts"].year == 2024
    out = tempfile.mkdtemp(prefix="audit2-") + "/log"
    audit_src.audit_append(audit_src.audit_event(spark, "t1", "u", "report_generated", None), out)
    back = audit_src.audit_read(spark, out).first()
    assert back["tenant"] == "t1" and back["action"] == "report_generated" and back["target"] is None


def test_audit_tail_and_login_burst_bruteforce(spark):
    rows, rng = [], np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    for i in range(400):
        user = "hot" if i % 3 else f"u{i % 7}"   # one user owns most events
        rows.append((i, t0 + dt.timedelta(minutes=int(rng.integers(0, 5000))), user,
                     str(rng.choice(["error", "signup", "click"]))))
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, user string, action string")
    got = {r["event_id"]: (r["failures_in_run"], r["locked"]) for r in audit.failed_login_burst(df, 3).collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "timestamp", "user", "action"])
    pdf = pdf[pdf.action.isin(["error", "signup"])].sort_values(["user", "timestamp", "event_id"])
    exp = {}
    for _, g in pdf.groupby("user"):
        run = 0
        for _, r in g.iterrows():
            run = 0 if r.action == "signup" else run + 1
            exp[r.event_id] = (run, run >= 3)
    assert got == exp
    tail = audit.audit_tail(df, 5).collect()
    every = pd.DataFrame(rows, columns=["event_id", "timestamp", "user", "action"])
    assert [r["event_id"] for r in tail] == list(
        every.sort_values(["timestamp", "event_id"], ascending=False).event_id[:5])


def test_prefix_sums_and_rank_with_hot_key(spark):
    rows = [(0 if i % 3 else i, float(i % 5)) for i in range(3000)]  # key 0 holds 2/3 of rows
    df = spark.createDataFrame(rows, "k long, v double").withColumn("id", F.monotonically_increasing_id())
    got = common.prefix_sums(df, ["k", "id"], ["v"], n_parts=7).toPandas().sort_values(["k", "id"])
    exp = got["v"].cumsum()
    assert np.allclose(got["cum_v"].to_numpy(), exp.to_numpy())
    r = common.global_rank(df, ["k", "id"], n_parts=5).toPandas().sort_values(["k", "id"])
    assert list(r["rank"]) == list(range(1, 3001))


def test_exact_percentile_matches_numpy(spark):
    vals = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for q in (0.01, 0.05, 0.5, 0.99):
        assert common.exact_percentile(df, "x", q) == pytest.approx(np.percentile(vals, q * 100), abs=0, rel=1e-12)
    # the distributed ranking path (band larger than the in-task bound) agrees
    got = common.exact_percentiles(df, [("x", 0.3), ("x", 0.0), ("x", 1.0)])
    assert got[("x", 0.3)] == pytest.approx(np.percentile(vals, 30), abs=0, rel=1e-12)
    assert got[("x", 0.0)] == vals.min() and got[("x", 1.0)] == vals.max()


def test_exact_ks_p_equals_enumeration():
    import itertools
    for n1, n2 in [(1, 1), (2, 3), (5, 5), (4, 7), (8, 8)]:
        peaks = []
        for ones in itertools.combinations(range(n1 + n2), n1):
            i = j = peak = 0
            for s in range(n1 + n2):
                i, j = (i + 1, j) if s in ones else (i, j + 1)
                peak = max(peak, abs(i * n2 - j * n1))
            peaks.append(peak)
        for h in sorted(set(peaks)):
            assert drift.ks_exact(h / (n1 * n2), n1, n2) == pytest.approx(np.mean(np.array(peaks) >= h), abs=1e-12)
    assert drift.ks_exact(0.0, 5, 5) == 1.0 and drift.ks_exact(1.0, 500, 500) < 1e-12


def test_ks_p_by_sample_size(spark, monkeypatch):
    a, b = [float(i) for i in range(40)], [float(i) + 6.5 for i in range(30)]
    ref, cur = (spark.createDataFrame([(v,) for v in x], "x double") for x in (a, b))
    exact = drift.drift_ks(cur, ref, "x").first()
    assert exact["ks_p"] == round(drift.ks_exact(exact["ks_stat"], 40, 30), 6)
    monkeypatch.setattr(drift, "KS_EXACT", 39)
    series = drift.drift_ks(cur, ref, "x").first()
    assert series["ks_stat"] == exact["ks_stat"] and series["ks_p"] != exact["ks_p"] and abs(series["ks_p"] - exact["ks_p"]) < 0.1


def test_ks_and_psi_against_bruteforce(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(0, 1, 300), 2)
    b = np.round(rng.normal(0.3, 1, 200), 2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    r = drift.drift_ks(cur, ref, "x").first()
    allv = np.sort(np.concatenate([a, b]))
    cdf = lambda s: np.searchsorted(np.sort(s), allv, side="right") / len(s)
    assert r["ks_stat"] == pytest.approx(np.max(np.abs(cdf(a) - cdf(b))), abs=1e-12)
    assert 0.0 <= r["ks_p"] <= 0.05 and r["ks_p"] == round(drift.ks_exact(r["ks_stat"], 300, 200), 6)
    ref_c = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "c string")
    cur_c = spark.createDataFrame([("a",), ("b",), ("b",), ("y",)], "c string")
    psi = drift.drift_psi(cur_c, ref_c, "c").first()["psi"]
    exp = (0.25 - 0.5) * math.log(0.25 / 0.5) + (0.5 - 0.25) * math.log(0.5 / 0.25)
    assert psi == pytest.approx(exp, abs=1e-6)


def test_period_bounds_roll_over_year():
    assert report.period_bounds("month", 2020, month=12) == (D(2020, 12, 1), D(2021, 1, 1))
    assert report.period_bounds("quarter", 2020, quarter=4) == (D(2020, 10, 1), D(2021, 1, 1))
    assert report.period_bounds("quarter", 2020, quarter=2) == (D(2020, 4, 1), D(2020, 7, 1))


def test_period_filter_pushes_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn(
        "date", F.col("l_shipdate").cast("date"))
    plan = report.period_filter(df, "year", 1996)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" in plan


def test_share_by_client_prunes_partitions(spark, claims_small):
    path = tempfile.mkdtemp(prefix="share-") + "/claims"
    sinks.share_by_client(claims_small, path)
    one = sinks.read_client(spark, path, "BUILDING")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "BUILDING" in plan
    assert one.count() == claims_small.filter(F.col("employer") == "BUILDING").count()


def test_report_index_latest_status(spark, claims_small):
    base = tempfile.mkdtemp(prefix="rep-")
    docs = report.report_json(report.client_report(claims_small, 5))
    sinks.write_report(docs, base, "monthly_summary", dt.datetime(2024, 1, 1, 9, 0, 0))
    sinks.write_report(docs, base, "fraud_analysis", dt.datetime(2024, 1, 2, 9, 0, 0))
    sinks.mark_read(spark, base, "BUILDING", "fraud_analysis_20240102_090000.json", dt.datetime(2024, 1, 3))
    idx = {(r["client"], r["filename"]): r["status"] for r in sinks.report_index(spark, base).collect()}
    assert idx[("BUILDING", "fraud_analysis_20240102_090000.json")] == "read"
    assert idx[("BUILDING", "monthly_summary_20240101_090000.json")] == "unread"
    assert len(idx) == 2 * docs.count()
    import json
    doc = json.loads(docs.filter(F.col("employer") == "BUILDING").first()["report"])
    assert set(doc) == {"summary", "monthly", "top_by_amount", "top_by_fraud",
                        "fraud_by_category", "fraud_by_diagnosis"}


def test_export_predictions_and_workbook(spark, claims_small):
    base = tempfile.mkdtemp(prefix="wb-")
    sinks.export_predictions(claims_small.select("claim_id", "amount"), base + "/pred")
    back = spark.read.option("header", True).csv(base + "/pred")
    assert back.count() == claims_small.count()
    t = sinks.report_workbook_tables(claims_small)
    sinks.write_workbook(t, base + "/wb")
    assert {r["metric"] for r in t["summary"].collect()} == {
        "Total Claims", "Total Amount", "Average Claim", "Potential Fraud Cases"}


def test_isin_filter_and_distinct_values(spark, claims_small):
    out = clean.isin_filter(claims_small, {"employer": ["BUILDING"], "category": []})
    assert {r[0] for r in out.select("employer").distinct().collect()} == {"BUILDING"}
    dv = explore.distinct_values(claims_small, ["employer"]).count()
    assert dv == claims_small.select("employer").distinct().count()


def test_per_group_top_n_with_hot_group_is_exact(spark):
    rng = np.random.default_rng(11)
    rows = [("hot" if i % 4 else f"g{i % 9}", int(rng.integers(0, 50)), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = common.top_n(df, [F.col("v").desc(), F.col("id").asc()], 3, per=["g"], rank_col="r")
    got = {(r["g"], r["r"]): r["id"] for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    exp = {}
    for g, grp in pdf.groupby("g"):
        for i, rid in enumerate(grp.id.head(3)):
            exp[(g, i + 1)] = rid
    assert got == exp


def test_label_files_per_file(spark):
    d = tempfile.mkdtemp(prefix="lbl-")
    files = {"c.csv": "CLAIM_CENTRAL_ID,AMOUNT\n1,2\n", "t.csv": "Claim_ID,Employee_ID\n1,2\n",
             "w.csv": ",".join(f"c{i}" for i in range(16)) + "\n" + ",".join("1" * 16) + "\n",
             "u.csv": "a,b\n1,2\n"}
    for name, body in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    out = {os.path.basename(r["file_path"]): r["format"] for r in ingest.label_files(spark, d).collect()}
    assert out == {"c.csv": "client", "t.csv": "test", "w.csv": "client", "u.csv": "unknown"}


def test_grouped_percentile_hot_group_matches_numpy(spark):
    rng = np.random.default_rng(21)
    rows = [("hot" if i % 3 else f"g{i % 5}", float(np.round(rng.normal(100, 30), 2))) for i in range(6000)]
    rows += [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["p"] for r in common.grouped_percentile(df, ["g"], "x", 0.5, out_col="p").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, grp in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.percentile(grp.x, 50), rel=1e-12, abs=0)
    # the distributed strategy gives the same provider table as the default
    claims = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        (F.col("l_suppkey") % 7).cast("string").alias("provider_id"),
        F.col("l_extendedprice").alias("amount"), F.lit(0).alias("fraud_flag"))
    a = explore.provider_stats(claims).orderBy("provider_id").collect()
    b = explore.provider_stats(claims, median="distributed").orderBy("provider_id").collect()
    assert a == b


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.731, 1.0])
def test_radix_percentiles_match_numpy(spark, q):
    rng = np.random.default_rng(4)
    rows = [(None if i % 11 == 0 else i % 4, float(v)) for i, v in enumerate(np.concatenate([
        rng.normal(0, 1, 300), rng.normal(0, 1e9, 300), np.round(rng.normal(500, 90, 300), 2), np.full(300, 7.25), rng.exponential(1e-4, 300)]))]
    rows += [(9, float("nan")), (9, None), (8, 5.0), (8, None), (7, -1e300), (7, 1e300), (7, 0.0)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    out = common.grouped_percentile(df, ["g"], "x", q, sums={"n": F.count(F.lit(1)), "s": F.sum(F.lit(2))}).collect()
    got = {r["g"]: r for r in out}
    assert len(out) == len(got) == 8 and got[9]["percentile"] is None and got[9]["n"] == 2
    for g in {r[0] for r in rows}:
        x = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g]["n"] == sum(k == g for k, _ in rows) and got[g]["s"] == 2 * got[g]["n"]
        if x:
            assert got[g]["percentile"] == pytest.approx(np.percentile(x, 100 * q), rel=1e-9, abs=1e-12)
    assert common.grouped_percentile(df.limit(0), ["g"], "x", q).count() == 0


def test_value_buckets_keep_the_order(spark):
    xs = sorted([0.0, -0.0, 1e-9, -1e-9, 0.5, 1.0, 1.01, 99.99, 100.0, -3.0, -2.99, 1e308, -1e308, float("inf"), float("-inf")])
    got = [r["b"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select(
        "i", common.value_bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_clean_claims_fixes_non_positive_amounts(spark):
    rows = [(30, a, D(2021, 6, 1), D(2021, 1, 1)) for a in (0.0, -4.0, 2.0, 6.0)]
    df = spark.createDataFrame(rows, "employee_age int, amount double, hire_date date, submission_date date")
    out = clean.clean_claims(df, D(2022, 1, 1)).select("amount", "claim_size").collect()
    fixed = [r["amount"] for r in out]
    assert fixed == [3.0, 4.0, 2.0, 6.0]  # |x| median (0, 2, 4, 6) = 3 replaces the zero
    exp = pd.qcut(pd.Series(fixed), 4, labels=clean.SIZE_LABELS).astype(str).tolist()
    assert [r["claim_size"] for r in out] == exp


def test_value_counts_ordered(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "t string")
    assert [tuple(r) for r in explore.value_counts(df, "t", ordered=True).collect()] == [
        ("a", 2), ("b", 2), ("c", 1)]


def test_percentiles_of_a_value_most_rows_share(spark):
    import numpy as np

    from claimlens.operators import common
    vals = [0.0] * 9500 + [float(i) for i in range(1, 501)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, x double").repartition(8)
    got = common.exact_percentiles(df, [("x", q) for q in (0.1, 0.5, 0.949, 0.95, 0.951, 0.99)], accuracy=100)
    for (_, q), v in got.items():
        assert abs(v - np.percentile(vals, q * 100)) < 1e-9
    per = {r["g"]: r["percentile"] for r in common.grouped_percentile(df, ["g"], "x", 0.96).collect()}
    for g in range(3):
        assert abs(per[g] - np.percentile(vals[g::3], 96)) < 1e-9
    counted = common.running_counts(df.groupBy("x").count().withColumnRenamed("count", "_c"), ["x"])
    assert counted.count() == 501 and counted.filter("x = 1").first()["_before"] == 9500


def test_share_keeps_other_clients(spark, tmp_path):
    from claimlens.sources import sinks
    path = str(tmp_path / "share")
    sinks.share_by_client(spark.createDataFrame([("A", 1), ("B", 2)], "employer string, x int"), path)
    sinks.share_by_client(spark.createDataFrame([("A", 3)], "employer string, x int"), path)
    assert sorted((r["employer"], r["x"]) for r in spark.read.parquet(path).collect()) == [("A", 3), ("B", 2)]


def test_nan_is_missing_and_large_ints_are_bad(spark):
    from claimlens.functions.exprs import money_mean
    from claimlens.operators import clean
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None), (4, 3.0)], "k int, x double")
    assert {r["column_name"]: r["missing"] for r in clean.missing_report(df).collect()} == {"k": 0, "x": 2}
    assert sorted(r["x"] for r in clean.impute(df).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert df.agg(money_mean("x").alias("m")).first()["m"] == 2.0
    big = spark.createDataFrame([("3000000000",), ("7.9",), ("x",)], "employee_age string")
    got = [r[0] for r in clean.coerce_types(big, {"employee_age": "int"}).collect()]
    assert got == [0, 7, 0]


def test_files_with_other_column_orders_and_encodings(spark, tmp_path):
    from claimlens.sources import ingest
    (tmp_path / "a.csv").write_bytes("AMOUNT,PROV_NAME\n1,p1\n".encode())
    (tmp_path / "b.csv").write_bytes("PROV_NAME,AMOUNT\nCaf\xe9,2\n".encode("latin-1"))
    (tmp_path / "c c.csv").write_bytes("PROV_NAME,AMOUNT,Extra\np3,3,x\n".encode())
    (tmp_path / "d.csv").write_bytes("AMOUNT,PROV_NAME\n4,p4\n".encode())
    got = ingest.read_claims(spark, str(tmp_path))
    rows = sorted((r["AMOUNT"], r["PROV_NAME"], r["Extra"], r["_corrupt_record"]) for r in got.collect())
    assert rows == [("1", "p1", None, None), ("2", "Caf\xe9", None, None), ("3", "p3", "x", None), ("4", "p4", None, None)]
    assert got.select("_source_file").distinct().count() == 4
