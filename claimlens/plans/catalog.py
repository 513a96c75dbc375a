"""Registry of named analyses: key -> (Spark plan builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables. Parameters (client, period, k, bins) are fixed here so the
Spark result and the oracle SQL answer the same question.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import audit, clean, drift, explore, fraud, report
from claimlens.operators import iforest as IF
from claimlens.operators import model as M
from claimlens.operators import shapley as SH
from claimlens.operators.profile_store import ProfileStore
from claimlens.plans import sql as S
from claimlens.session import cut_lineage, work_dir
from claimlens.sources import fixtures as fx
from claimlens.sources import ingest, sinks
from claimlens.sources.audit import audit_append, audit_read
from claimlens.streaming import audit_stream as ST

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    oracle: str | None
    note: str = ""


CATALOG: dict[str, Entry] = {}


def register(key: str, oracle: str | None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        CATALOG[key] = Entry(fn, oracle, note)
        return fn
    return deco


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return fx.claims(spark, d)


# ------------------------------------------------------------------ explore

@register("claim_distribution", S.CLAIM_DISTRIBUTION)
def _q(spark, d):
    return explore.claim_distribution(_claims(spark, d), "department")


@register("distribution_baseline", S.DISTRIBUTION_BASELINE)
def _q(spark, d):
    return explore.distribution_baseline(_claims(spark, d), "employer", "sum")


@register("temporal_trend", S.TEMPORAL_TREND)
def _q(spark, d):
    return explore.temporal_trend(_claims(spark, d), "month")


@register("temporal_ci", S.TEMPORAL_CI)
def _q(spark, d):
    return explore.temporal_ci(_claims(spark, d), "week")


@register("provider_stats", S.PROVIDER_STATS)
def _q(spark, d):
    return explore.provider_stats(_claims(spark, d))


@register("provider_stats_distributed", S.PROVIDER_STATS)
def _q(spark, d):
    """Same table, exact medians ranked across tasks (no group merged in one task)."""
    return explore.provider_stats(_claims(spark, d), median="distributed")


@register("provider_efficiency", S.PROVIDER_EFFICIENCY)
def _q(spark, d):
    return explore.provider_efficiency(_claims(spark, d))


@register("break_even", S.BREAK_EVEN)
def _q(spark, d):
    return explore.break_even(_claims(spark, d))


@register("break_even_curve", S.BREAK_EVEN_CURVE)
def _q(spark, d):
    return explore.break_even_curve(_claims(spark, d))


@register("provider_ranking", S.PROVIDER_RANKING)
def _q(spark, d):
    return explore.provider_ranking(_claims(spark, d), 5)


@register("diagnosis_treatment", S.DIAGNOSIS_TREATMENT)
def _q(spark, d):
    return explore.diagnosis_treatment(_claims(spark, d), 20)


@register("icd_chapter_treatment", S.ICD_CHAPTER_TREATMENT)
def _q(spark, d):
    return explore.icd_chapter_treatment(_claims(spark, d))


@register("histogram", S.HISTOGRAM)
def _q(spark, d):
    return explore.histogram(_claims(spark, d), "amount", 20)


@register("value_counts", S.VALUE_COUNTS)
def _q(spark, d):
    return explore.value_counts(_claims(spark, d), "treatment")


@register("distinct_values", S.DISTINCT_VALUES)
def _q(spark, d):
    return explore.distinct_values(_claims(spark, d), ["employer", "department", "category"])


@register("data_profile", S.DATA_PROFILE)
def _q(spark, d):
    return explore.data_profile(_claims(spark, d), S.PROFILE_NUMERIC, S.PROFILE_CATEGORICAL)


@register("data_profile_merged", S.DATA_PROFILE_MERGED)
def _q(spark, d):
    """Q1 from stored day states: the columns that merge exactly."""
    store = ProfileStore(spark, work_dir(spark, "profile"), S.PROFILE_NUMERIC, S.PROFILE_CATEGORICAL)
    store.add(_claims(spark, d), "date")
    return store.profile().drop("p25", "p50", "p75", "n_distinct")


# ------------------------------------------------------------------ fraud roll-ups

@register("provider_fraud_rate_join", S.PROVIDER_FRAUD_RATE_JOIN)
def _q(spark, d):
    return fraud.provider_fraud_rate_join(_claims(spark, d))


@register("fraud_summary", S.FRAUD_SUMMARY)
def _q(spark, d):
    return fraud.fraud_summary(_claims(spark, d))


@register("fraud_by_provider", S.FRAUD_BY_PROVIDER)
def _q(spark, d):
    return fraud.fraud_by_provider(_claims(spark, d), 10)


@register("fraud_by_diagnosis", S.FRAUD_BY_DIAGNOSIS)
def _q(spark, d):
    return fraud.fraud_by_diagnosis(_claims(spark, d), 10, 10)


@register("fraud_over_time", S.FRAUD_OVER_TIME)
def _q(spark, d):
    return fraud.fraud_over_time(_claims(spark, d))


@register("fraud_cases", S.FRAUD_CASES)
def _q(spark, d):
    return fraud.fraud_cases(_claims(spark, d), 100)


# ------------------------------------------------------------------ client reports

def _client(spark, d):
    return report.client_claims(_claims(spark, d), S.CLIENT)


@register("client_claims", S.CLIENT_CLAIMS)
def _q(spark, d):
    return _client(spark, d)


@register("period_filter", S.PERIOD_FILTER)
def _q(spark, d):
    return report.period_filter(_claims(spark, d), "quarter", 1996, quarter=4)


@register("period_filter_month", S.PERIOD_FILTER_MONTH)
def _q(spark, d):
    return report.period_filter(_claims(spark, d), "month", 1999, month=12)


@register("client_overview", S.CLIENT_OVERVIEW)
def _q(spark, d):
    return report.client_overview(_claims(spark, d), S.CLIENT)


@register("monthly_trend", S.MONTHLY_TREND)
def _q(spark, d):
    return report.monthly_trend(_client(spark, d))


@register("category_distribution", S.CATEGORY_DISTRIBUTION)
def _q(spark, d):
    return report.category_distribution(_client(spark, d))


@register("report_summary", S.REPORT_SUMMARY)
def _q(spark, d):
    return report.report_summary(_client(spark, d))


@register("top_providers_by_amount", S.TOP_PROVIDERS_BY_AMOUNT)
def _q(spark, d):
    return report.top_providers_by_amount(_client(spark, d), 5)


@register("top_providers_by_fraud", S.TOP_PROVIDERS_BY_FRAUD)
def _q(spark, d):
    return report.top_providers_by_fraud(_client(spark, d), 5)


@register("top_fraud_amount", S.TOP_FRAUD_AMOUNT)
def _q(spark, d):
    return report.top_fraud_amount(_client(spark, d), 5)


@register("fraud_by_category", S.FRAUD_BY_CATEGORY)
def _q(spark, d):
    return report.fraud_by_category(_client(spark, d), 5)


@register("fraud_by_diagnosis_count", S.FRAUD_BY_DIAGNOSIS_COUNT)
def _q(spark, d):
    return report.fraud_by_diagnosis_count(_client(spark, d), 5)


@register("year_over_year", S.YEAR_OVER_YEAR)
def _q(spark, d):
    return report.year_over_year(_client(spark, d))


def _cr(table: str) -> Builder:
    def build(spark, d):
        return report.client_report(_claims(spark, d), 5)[table]
    return build


for _t, _sql in [("summary", S.CR_SUMMARY), ("monthly", S.CR_MONTHLY),
                 ("top_by_amount", S.CR_TOP_AMOUNT), ("top_by_fraud", S.CR_TOP_FRAUD),
                 ("fraud_by_category", S.CR_FRAUD_CATEGORY),
                 ("fraud_by_diagnosis", S.CR_FRAUD_DIAGNOSIS)]:
    register(f"client_report_{_t}", _sql)(_cr(_t))


# ------------------------------------------------------------------ ingest

AS_OF = _dt.date(2002, 1, 1)


def _raw(spark, d):
    return fx.raw_claims(spark, d)


def _loaded(spark, d):
    return ingest.load_claims(_raw(spark, d))


@register("schema_map", S.SCHEMA_MAP)
def _q(spark, d):
    return ingest.schema_map(_raw(spark, d))


@register("parse_dates", S.PARSE_DATES)
def _q(spark, d):
    return ingest.parse_dates(ingest.schema_map(_raw(spark, d)), "date")


@register("parse_amount", S.PARSE_AMOUNT)
def _q(spark, d):
    return ingest.parse_amount(ingest.schema_map(_raw(spark, d)), "amount")


@register("load_claims", S.LOAD_CLAIMS)
def _q(spark, d):
    return _loaded(spark, d)


@register("load_validation", S.LOAD_VALIDATION)
def _q(spark, d):
    return ingest.load_gate(_loaded(spark, d))


@register("lines_to_claims", S.LINES_TO_CLAIMS)
def _q(spark, d):
    return ingest.lines_to_claims(_loaded(spark, d), AS_OF)


@register("icd10_validate", S.ICD10_VALIDATE)
def _q(spark, d):
    return ingest.icd10_validate(_claims(spark, d))


@register("icd10_summary", S.ICD10_SUMMARY)
def _q(spark, d):
    return ingest.icd10_summary(_claims(spark, d))


# ------------------------------------------------------------------ cleaning

@register("coerce_types", S.COERCE_TYPES)
def _q(spark, d):
    return clean.coerce_types(ingest.schema_map(_raw(spark, d)), {"amount": "float", "DOB": "date"})


@register("missing_report", S.MISSING_REPORT)
def _q(spark, d):
    return clean.missing_report(_claims(spark, d))


@register("impute", S.IMPUTE)
def _q(spark, d):
    return clean.impute(_claims(spark, d))


@register("fix_amount", S.FIX_AMOUNT)
def _q(spark, d):
    return clean.fix_amount(_loaded(spark, d))


@register("clip_age", S.CLIP_AGE)
def _q(spark, d):
    return clean.clip_age(_claims(spark, d).select("claim_id", "line_no", "employee_age"))


@register("tenure_group", S.TENURE_GROUP)
def _q(spark, d):
    return clean.tenure_group(_claims(spark, d).select("claim_id", "line_no", "hire_date"), AS_OF)


@register("age_group", S.AGE_GROUP)
def _q(spark, d):
    return clean.age_group(_claims(spark, d).select("claim_id", "line_no", "employee_age"))


@register("claim_size", S.CLAIM_SIZE)
def _q(spark, d):
    return clean.claim_size(_claims(spark, d).select("claim_id", "line_no", "amount"))


@register("calendar_features", S.CALENDAR_FEATURES)
def _q(spark, d):
    return clean.calendar_features(_claims(spark, d).select("claim_id", "line_no", "submission_date"))


@register("clean_claims", S.CLEAN_CLAIMS)
def _q(spark, d):
    return clean.clean_claims(_claims(spark, d), AS_OF)


@register("pseudonymize", S.PSEUDONYMIZE)
def _q(spark, d):
    return clean.pseudonymize(_claims(spark, d).select("claim_id", "line_no", "employee_id", "amount"),
                              S.PSEUDO_KEY)


@register("isin_filter", S.ISIN_FILTER)
def _q(spark, d):
    return clean.isin_filter(_claims(spark, d), {"employer": ["BUILDING", "MACHINERY"],
                                                 "category": ["1-URGENT", "2-HIGH"]})


# ------------------------------------------------------------------ audit events

def _audit(spark, d):
    return fx.audit_events(spark, d)


@register("audit_tail", S.AUDIT_TAIL)
def _q(spark, d):
    return audit.audit_tail(_audit(spark, d), 20)


@register("failed_login_burst", S.FAILED_LOGIN_BURST)
def _q(spark, d):
    return audit.failed_login_burst(_audit(spark, d), 3)


# ------------------------------------------------------------------ sources and sinks

@register("read_claims", S.READ_CLAIMS)
def _q(spark, d):
    """Write the dirty client lines as CSV, read them back as text columns."""
    path = work_dir(spark, "csv")
    _raw(spark, d).write.option("header", True).csv(path)
    df = ingest.read_claims(spark, path)
    return df.drop("_corrupt_record", "_source_file")


@register("share_by_client", S.SHARE_BY_CLIENT)
def _q(spark, d):
    path = work_dir(spark, "share")
    sinks.share_by_client(_claims(spark, d), path)
    return sinks.read_client(spark, path, S.CLIENT)


@register("workbook_summary", S.WORKBOOK_SUMMARY)
def _q(spark, d):
    return sinks.report_workbook_tables(_claims(spark, d))["summary"]


@register("workbook_provider_analysis", S.WORKBOOK_PROVIDERS)
def _q(spark, d):
    return sinks.report_workbook_tables(_claims(spark, d))["provider_analysis"]


@register("client_report_json", None, "one JSON document per client; rows-only check")
def _q(spark, d):
    return report.report_json(report.client_report(_claims(spark, d), 5))


@register("audit_stream", S.AUDIT_STREAM)
def _q(spark, d):
    """Events written as audit JSON files, counted by a Structured Streaming
    query (availableNow) into a parquet sink that is read back."""
    base = work_dir(spark, "stream")
    ev = fx.audit_events(spark, d).select(
        F.lit("events").alias("tenant"), F.col("timestamp").alias("ts"), "user", "action", "target",
        F.lit("").alias("ip"))
    audit_append(ev, f"{base}/source")
    q = ST.start_counts(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint")
    q.awaitTermination()
    return ST.all_counts(spark, f"{base}/sink", f"{base}/checkpoint")


@register("login_lockout_stream", S.FAILED_LOGIN_BURST)
def _q(spark, d):
    """E2 as a stream: audit JSON files arrive in the order of time, slice by slice; each
    arrival is a micro-batch of at most ``LOCKOUT_FILES`` files, runs carried on."""
    from claimlens.streaming import login_lockout as LL
    base = work_dir(spark, "lockout")
    ev = fx.audit_events(spark, d).select(
        F.lit("events").alias("tenant"), F.col("timestamp").alias("ts"), "user", "action",
        F.col("event_id").cast("string").alias("target"), F.lit("").alias("ip"))
    src = (spark.readStream.schema(ST.STREAM_SCHEMA).option("maxFilesPerTrigger", LOCKOUT_FILES).json(f"{base}/source/*")
                .select(F.col("target").cast("long").alias("event_id"), "user", "timestamp", "action"))
    for part in _time_slices(ev, "ts", LOCKOUT_SLICES):
        audit_append(part.coalesce(LOCKOUT_FILES), f"{base}/source")
        LL.start_lockout(src, base, 3).awaitTermination()
    return LL.read_lockouts(spark, base).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


LOCKOUT_SLICES, LOCKOUT_FILES = 6, 8


def _time_slices(df, ts: str, n: int) -> list:
    """``n`` consecutive slices of equal duration; null times are in the first."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return [df]
    cuts = [lo + (hi - lo) * i / n for i in range(1, n)]
    slot = sum((F.coalesce(F.col(ts) >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return [df.filter(slot == i) for i in range(n)]


_AT = _dt.datetime(2002, 1, 1, 12)


def _reports(spark, d):
    """Every client's document."""
    return report.report_json(report.client_report(_claims(spark, d), 5))


@register("report_documents", S.REPORT_DOCUMENTS)
def _q(spark, d):
    """Report documents written, read back, and their ranked list taken apart."""
    path = work_dir(spark, "reports")
    sinks.write_report(_reports(spark, d), path, "monthly", _AT)
    back = spark.read.schema("report string, client string, filename string").json(f"{path}/reports")
    doc = F.from_json("report", "top_by_amount array<struct<provider_id:string,total_amount:double,"
                                "claim_count:long,fraud_count:long>>")
    return (back.select(F.col("client").alias("employer"), F.posexplode(doc["top_by_amount"]).alias("pos", "r"))
            .select("employer", "r.*", (F.col("pos") + 1).alias("rank")))


@register("report_index", S.REPORT_INDEX)
def _q(spark, d):
    """Two reports per client, one of them read by one client."""
    path = work_dir(spark, "reports")
    docs = cut_lineage(_reports(spark, d))
    sinks.write_report(docs, path, "monthly", _AT)
    sinks.write_report(docs, path, "fraud", _AT + _dt.timedelta(days=1))
    sinks.mark_read(spark, path, S.CLIENT, "monthly_20020101_120000.json", _AT + _dt.timedelta(days=2))
    return sinks.report_index(spark, path).select("client", "filename", "type", "status")


def _baseline(spark, d):
    """Claims with their diagnosis's mean as the prediction and the known flag."""
    c = _claims(spark, d)
    means = explore.claim_distribution(c, "diagnosis", "mean").withColumnRenamed("average_amount", "predicted_amount")
    return c.join(means, "diagnosis").select("claim_id", "line_no", "amount", "predicted_amount",
                                             (F.col("fraud_flag") == 1).alias("is_potential_fraud"))


@register("export_predictions", S.EXPORT_PREDICTIONS)
def _q(spark, d):
    path = work_dir(spark, "export")
    scored = _baseline(spark, d)
    sinks.export_predictions(scored, path)
    return spark.read.option("header", True).schema(scored.schema).csv(path)


@register("prediction_summary_baseline", S.PREDICTION_SUMMARY_BASELINE)
def _q(spark, d):
    return M.prediction_summary(_baseline(spark, d))


@register("audit_read", S.AUDIT_READ)
def _q(spark, d):
    path = work_dir(spark, "audit")
    audit_append(fx.audit_events(spark, d).select(
        F.lit("events").alias("tenant"), F.col("timestamp").alias("ts"), "user", "action", "target",
        F.lit("").alias("ip")), path)
    return audit_read(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("label_files", S.LABEL_FILES)
def _q(spark, d):
    """Client lines and a table of other columns as CSV files; the labels found."""
    path = work_dir(spark, "labels")
    _raw(spark, d).write.option("header", True).csv(f"{path}/a")
    _claims(spark, d).select("claim_id", "line_no", "fraud_flag").write.option("header", True).csv(f"{path}/b")
    return ingest.label_files(spark, [f"{path}/a", f"{path}/b"]).select("format", "header").distinct()


@register("missing_report_gappy", S.MISSING_REPORT_GAPPY)
def _q(spark, d):
    return clean.missing_report(fx.gappy_claims(spark, d))


@register("drop_sparse_columns", S.DROP_SPARSE_COLUMNS)
def _q(spark, d):
    return clean.drop_sparse_columns(fx.gappy_claims(spark, d))


@register("impute_gappy", S.IMPUTE_GAPPY)
def _q(spark, d):
    return clean.impute(fx.gappy_claims(spark, d))


@register("claim_distribution_gappy", S.CLAIM_DISTRIBUTION_GAPPY)
def _q(spark, d):
    return explore.claim_distribution(fx.gappy_claims(spark, d), "department")


# ------------------------------------------------------------------ drift

def _ref_cur(spark, d):
    c = _claims(spark, d)
    return c.filter(F.col("date") >= F.lit(_dt.date(1998, 1, 1))), c.filter(F.col("date") < F.lit(_dt.date(1998, 1, 1)))


@register("drift_ks", S.DRIFT_KS)
def _q(spark, d):
    cur, ref = _ref_cur(spark, d)
    return drift.drift_ks(cur, ref, "amount")


@register("drift_psi", S.DRIFT_PSI)
def _q(spark, d):
    cur, ref = _ref_cur(spark, d)
    return drift.drift_psi(cur, ref, "treatment")


@register("drift_report", S.DRIFT_REPORT)
def _q(spark, d):
    cur, ref = _ref_cur(spark, d)
    return drift.drift_report(cur, ref, S.DRIFT_NUMERIC, S.DRIFT_CATEGORICAL)


# ------------------------------------------------------------------ modelling

@register("temporal_split", S.TEMPORAL_SPLIT)
def _q(spark, d):
    return M.temporal_split(_claims(spark, d), 0.2)


@register("feature_scaling", S.FEATURE_SCALING)
def _q(spark, d):
    return M.scaled_columns(_claims(spark, d), ["employee_age", "co_payment"], ["claim_id", "line_no"])


@register("evaluate_baseline", S.EVALUATE_BASELINE)
def _q(spark, d):
    c = _claims(spark, d)
    means = explore.claim_distribution(c, "diagnosis", "mean").withColumnRenamed("average_amount", "prediction")
    return M.evaluate(c.join(means, "diagnosis"), "amount", "prediction")


@register("model_history", S.MODEL_HISTORY)
def _q(spark, d):
    path = work_dir(spark, "history")
    M.log_metrics(spark, path, "baseline", CATALOG["evaluate_baseline"].build(spark, d).first().asDict(), _AT)
    return M.model_history(spark, path).drop("timestamp")


@register("fill_defaults", S.FILL_DEFAULTS)
def _q(spark, d):
    req = ["employee_age", "co_payment", "inpatient_cap_utilization", "employer", "department",
           "claim_weekday", "claim_month", "age_group", "tenure_group", "same_day_claims"]
    num = ["employee_age", "co_payment", "inpatient_cap_utilization", "same_day_claims"]
    src = _claims(spark, d).select("employee_age", "co_payment", "employer", "department")
    return M.fill_defaults(src, req, AS_OF, num)


_MODELS: dict = {}


def _memo(spark, d, name, make):
    """Trained artefacts kept per session and input version (a small model
    registry), so analyses that share a model train it once."""
    key = (spark.sparkContext.applicationId, fx._stamp(spark, d), name)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def _split(spark, d):
    """Cleaned claims with the temporal split, materialised once in the shared
    checkpoint folder so feature fitting, training and evaluation do not
    recompute the joins and statistics passes."""
    return _memo(spark, d, "split", lambda: cut_lineage(
        M.temporal_split(clean.clean_claims(_claims(spark, d), AS_OF), 0.2)))


def _trained(spark, d, name):
    return _memo(spark, d, name, lambda: M.train_and_evaluate(_split(spark, d), name, M.default_estimators()[name]))


def _gbt(spark, d):
    return _trained(spark, d, "GradientBoosting")


def _metrics_row(spark, d, name):
    m = _trained(spark, d, name).metrics
    return spark.createDataFrame([(name, m["mae"], m["rmse"], m["r2"])], "model string, mae double, rmse double, r2 double")


@register("train_gbt", None, "randomised model; property-tested")
def _q(spark, d):
    return _metrics_row(spark, d, "GradientBoosting")


@register("train_rf", None, "randomised model; property-tested")
def _q(spark, d):
    return _metrics_row(spark, d, "RandomForest")


@register("train_boosted", None, "randomised model; property-tested")
def _q(spark, d):
    return _metrics_row(spark, d, "BoostedSubsampled")


@register("train_mlp", None, "randomised model; property-tested")
def _q(spark, d):
    return _metrics_row(spark, d, "NeuralNetwork")


@register("auto_select", None, "leaderboard of randomised models")
def _q(spark, d):
    """Leaderboard by R^2 over the four models; those that other entries trained are reused."""
    return M.auto_select(_split(spark, d), train=lambda n: _trained(spark, d, n))[0]


@register("random_search", None, "cross-validated search, 20 draws x 5 folds")
def _q(spark, d):
    est = M.random_forest()
    train = _split(spark, d).filter(F.col("split") == "train")
    return M.random_search(train, est, M.sample_param_maps(est, M.RF_GRID, 20), folds=5)[1]


@register("feature_importance", None, "importances of a randomised model")
def _q(spark, d):
    return M.feature_importance(_gbt(spark, d).model, _split(spark, d))


def _scored(spark, d):
    sp = _split(spark, d)
    t = _gbt(spark, d)
    fm = _memo(spark, d, "fraud", lambda: M.fit_fraud_model(
        sp.filter(F.col("split") == "train"), t.model.stages[0], n_trees=100, contamination=0.01))
    return M.score_claims(sp.filter(F.col("split") == "test"), t.model, fm)


@register("score_claims", None, "predictions and isolation-forest flags")
def _q(spark, d):
    return _scored(spark, d).select("claim_id", "line_no", "amount", "predicted_amount",
                                    "is_potential_fraud", "fraud_confidence")


@register("prediction_summary", None, "summary of randomised predictions")
def _q(spark, d):
    return M.prediction_summary(_scored(spark, d))


@register("shapley_contributions", None, "exact tree Shapley values of every test claim; held against subset enumeration")
def _q(spark, d):
    t = _gbt(spark, d)
    test = _split(spark, d).filter(F.col("split") == "test").withColumn(
        "row_id", F.xxhash64("claim_id", "line_no", "amount", "date"))
    return SH.explain_gbt(test, t.model, t.numeric, t.categorical, ["row_id"])[0]


# ------------------------------------------------------------------ isolation forest

def _iforest_flags(spark, d):
    c = _claims(spark, d).drop("fraud_flag")
    return IF.detect_fraud_anomalies(c, ["amount", "co_payment"], contamination=0.05, n_trees=100)


@register("iforest_scores", None, "isolation-forest scores; property-tested")
def _q(spark, d):
    c = _claims(spark, d)
    forest = IF.iforest_fit(c, ["amount", "co_payment"], n_trees=100, seed=42)
    return IF.iforest_score(c, forest).select("claim_id", "line_no", "amount", "co_payment", "anomaly_score")


@register("iforest_fraud_summary", None, "fraud roll-up over isolation-forest flags")
def _q(spark, d):
    return fraud.fraud_summary(_iforest_flags(spark, d))


@register("iforest_fraud_by_provider", None, "fraud roll-up over isolation-forest flags")
def _q(spark, d):
    return fraud.fraud_by_provider(_iforest_flags(spark, d), 10)


# ------------------------------------------------------------------ public views

def queries() -> dict[str, Builder]:
    return {k: e.build for k, e in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.oracle for k, e in CATALOG.items() if e.oracle is not None}
