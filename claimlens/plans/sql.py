"""Oracle SQL text (DuckDB dialect) for the registered analyses.

Each statement is written from the operator's specification, independently of
the DataFrame code, over the same parquet tables. Money is summed as
DECIMAL(24,6); means are exact sums divided by counts; derived ratios and
deviations are rounded to 6 places on both sides.
"""

from __future__ import annotations

from claimlens.sources.fixtures import AUDIT_SQL, CLAIMS_SQL, GAPPY_SQL, RAW_SQL


def with_claims(body: str) -> str:
    return f"WITH claims AS ({CLAIMS_SQL})\n{body}"


def with_raw(body: str) -> str:
    return f"WITH claims AS ({CLAIMS_SQL}),\nraw AS ({RAW_SQL})\n{body}"


def with_gappy(body: str) -> str:
    return f"WITH claims AS ({CLAIMS_SQL}),\ngappy AS ({GAPPY_SQL})\n{body}"


def with_audit(body: str) -> str:
    return f"WITH audit AS ({AUDIT_SQL})\n{body}"


MSUM = "CAST(SUM(CAST({x} AS DECIMAL(24,6))) AS DOUBLE)"


def msum(x: str) -> str:
    return MSUM.format(x=x)


def mmean(x: str) -> str:
    return f"({msum(x)} / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0))"


def mvar(x: str) -> str:
    n = f"CAST(COUNT({x}) AS DOUBLE)"
    sx = msum(x)
    sxx = f"CAST(SUM(CAST({x} AS DECIMAL(18,2)) * CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
    return f"(({sxx} - {sx} * {sx} / {n}) / NULLIF({n} - 1.0, 0))"


def sqrt0(v: str) -> str:
    return f"sqrt(CASE WHEN {v} < 0 THEN 0.0 ELSE {v} END)"


# ----------------------------------------------------------------- explore

CLAIM_DISTRIBUTION = with_claims(f"""
SELECT department, COUNT(*) AS claim_count,
       COALESCE({msum('amount')}, 0.0) AS total_amount,
       {mmean('amount')} AS average_amount
FROM claims WHERE department IS NOT NULL GROUP BY department
""")

DISTRIBUTION_BASELINE = with_claims(f"""
, d AS (
  SELECT employer, COUNT(*) AS claim_count,
         COALESCE({msum('amount')}, 0.0) AS total_amount,
         {mmean('amount')} AS average_amount
  FROM claims WHERE employer IS NOT NULL GROUP BY employer),
o AS (SELECT COALESCE({msum('amount')}, 0.0) / NULLIF(CAST(COUNT(DISTINCT employer) AS DOUBLE), 0) AS b FROM claims)
SELECT d.*, round(o.b, 6) AS baseline FROM d CROSS JOIN o
""")


def _temporal(unit: str) -> str:
    return with_claims(f"""
, t AS (
  SELECT CAST(date_trunc('{unit}', date) AS DATE) AS time_period,
         COALESCE({msum('amount')}, 0.0) AS total_amount,
         COUNT(amount) AS claim_count,
         {mmean('amount')} AS avg_amount,
         {mvar('amount')} AS v
  FROM claims WHERE date IS NOT NULL GROUP BY 1)
SELECT time_period, total_amount, claim_count, avg_amount,
       round({sqrt0('v')}, 6) AS std_amount,
       round(avg_amount - 1.96 * {sqrt0('v')} / sqrt(CAST(claim_count AS DOUBLE)), 6) AS ci_lower,
       round(avg_amount + 1.96 * {sqrt0('v')} / sqrt(CAST(claim_count AS DOUBLE)), 6) AS ci_upper
FROM t
""")


TEMPORAL_TREND = _temporal("month")
TEMPORAL_CI = f"SELECT time_period, avg_amount, ci_lower, ci_upper FROM ({_temporal('week')}) x"

PROVIDER_STATS_CTE = """
, ps AS (
  SELECT provider_id,
         CAST(SUM(CAST(COALESCE(amount, 0.0) AS DECIMAL(24,6))) AS DOUBLE) AS total_amount,
         COUNT(*) AS total_claims,
         CAST(SUM(CAST(COALESCE(amount, 0.0) AS DECIMAL(24,6))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_amount,
         round(median(COALESCE(amount, 0.0)), 6) AS median_amount,
         avg(CAST(COALESCE(fraud_flag, 0) AS DOUBLE)) AS fraud_rate
  FROM claims WHERE provider_id IS NOT NULL GROUP BY provider_id),
ov AS (SELECT CAST(SUM(CAST(COALESCE(amount, 0.0) AS DECIMAL(24,6))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS overall FROM claims),
pe AS (
  SELECT ps.*, round(ps.avg_amount / NULLIF(ov.overall, 0), 6) AS efficiency_ratio,
         ps.total_amount / CAST(ps.total_claims AS DOUBLE) AS cost_per_claim
  FROM ps CROSS JOIN ov)
"""

PROVIDER_STATS = with_claims(PROVIDER_STATS_CTE + "SELECT provider_id, total_amount, total_claims, avg_amount, median_amount, fraud_rate FROM ps")
PROVIDER_EFFICIENCY = with_claims(PROVIDER_STATS_CTE + "SELECT * FROM pe")
BREAK_EVEN = with_claims(PROVIDER_STATS_CTE + """
, be AS (SELECT pe.*, CAST(ceil(CAST(50000.0 AS DOUBLE) / NULLIF(avg_amount * CAST(0.4 AS DOUBLE), 0)) AS BIGINT) AS break_even_claims FROM pe)
SELECT be.*, CASE WHEN total_claims > break_even_claims THEN 'Profitable' ELSE 'Unprofitable' END AS profitability FROM be
""")
BREAK_EVEN_CURVE = with_claims("""
, mx AS (SELECT CAST(max(n) AS DOUBLE) AS m FROM (SELECT provider_id, COUNT(*) AS n FROM claims WHERE provider_id IS NOT NULL GROUP BY provider_id) z),
g AS (SELECT range AS point FROM range(100)),
x AS (SELECT point, CASE WHEN point = 99 THEN m ELSE 1.0 + CAST(point AS DOUBLE) * ((m - 1.0) / 99.0) END AS x FROM g CROSS JOIN mx)
SELECT point, round(x, 6) AS claims, round(CAST(50000.0 AS DOUBLE) / (x * CAST(0.4 AS DOUBLE)), 6) AS break_even_amount FROM x
""")
PROVIDER_RANKING = with_claims(PROVIDER_STATS_CTE + """
, a AS (SELECT provider_id, efficiency_ratio, avg_amount, fraud_rate,
               row_number() OVER (ORDER BY efficiency_ratio ASC, provider_id ASC) AS r1,
               row_number() OVER (ORDER BY efficiency_ratio DESC, provider_id ASC) AS r2 FROM pe)
SELECT provider_id, efficiency_ratio, avg_amount, fraud_rate, CAST(r1 AS INTEGER) AS rank, 'most_efficient' AS side FROM a WHERE r1 <= 5
UNION ALL
SELECT provider_id, efficiency_ratio, avg_amount, fraud_rate, CAST(r2 AS INTEGER) AS rank, 'least_efficient' AS side FROM a WHERE r2 <= 5
""")

DIAGNOSIS_TREATMENT = with_claims("""
, pairs AS (SELECT diagnosis, treatment, COUNT(*) AS cell FROM claims
            WHERE diagnosis IS NOT NULL AND treatment IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT diagnosis, SUM(cell) AS row_total FROM pairs GROUP BY 1),
td AS (SELECT diagnosis FROM claims WHERE diagnosis IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, diagnosis LIMIT 20),
tt AS (SELECT treatment FROM claims WHERE treatment IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, treatment LIMIT 20)
SELECT td.diagnosis, tt.treatment,
       round(CAST(COALESCE(p.cell, 0) AS DOUBLE) / CAST(tot.row_total AS DOUBLE), 6) AS share
FROM td CROSS JOIN tt
JOIN tot ON tot.diagnosis = td.diagnosis
LEFT JOIN pairs p ON p.diagnosis = td.diagnosis AND p.treatment = tt.treatment
""")

ICD_CHAPTER_TREATMENT = with_claims("""
, pairs AS (SELECT substr(icd_code, 1, 1) AS icd_chapter, treatment, COUNT(*) AS cell FROM claims
            WHERE icd_code IS NOT NULL AND treatment IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT icd_chapter, SUM(cell) AS row_total FROM pairs GROUP BY 1)
SELECT p.icd_chapter, p.treatment, round(CAST(p.cell AS DOUBLE) / CAST(tot.row_total AS DOUBLE), 6) AS share
FROM pairs p JOIN tot USING (icd_chapter)
""")

HISTOGRAM = with_claims("""
, r AS (SELECT min(amount) AS lo, max(amount) AS hi FROM claims),
b AS (SELECT LEAST(COALESCE(CAST(floor((amount - lo) / NULLIF((hi - lo) / 20.0, 0)) AS INTEGER), 0), 19) AS bucket,
             lo, (hi - lo) / 20.0 AS w
      FROM claims CROSS JOIN r WHERE amount IS NOT NULL)
SELECT bucket, round(lo + bucket * w, 6) AS bin_lower, round(lo + (bucket + 1) * w, 6) AS bin_upper,
       COUNT(*) AS count
FROM b GROUP BY bucket, lo, w
""")

VALUE_COUNTS = with_claims("""
SELECT treatment AS value, COUNT(*) AS count FROM claims WHERE treatment IS NOT NULL GROUP BY 1
""")

DISTINCT_VALUES = with_claims("""
SELECT DISTINCT * FROM (
  SELECT 'employer' AS "column", CAST(employer AS VARCHAR) AS value FROM claims
  UNION ALL SELECT 'department', CAST(department AS VARCHAR) FROM claims
  UNION ALL SELECT 'category', CAST(category AS VARCHAR) FROM claims) u
WHERE value IS NOT NULL
""")

PROFILE_NUMERIC = ["line_no", "employee_age", "amount", "co_payment", "fraud_flag"]
PROFILE_CATEGORICAL = ["employer", "department", "provider_id", "diagnosis", "treatment",
                       "category", "visit_type", "status", "employee_gender"]


def _profile_sql(columns: str = "*") -> str:
    parts = []
    for c in PROFILE_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS column_name, 'numeric' AS kind, COUNT({c}) AS n_count, COUNT(*) - COUNT({c}) AS n_missing,
       round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min,
       round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
       round(quantile_cont({x}, 0.75), 6) AS p75, max({x}) AS max,
       CAST(COUNT(*) FILTER (WHERE {x} = 0) AS BIGINT) AS n_zeros,
       COUNT(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct FROM claims""")
    for c in PROFILE_CATEGORICAL:
        parts.append(f"""
SELECT '{c}', 'categorical', COUNT({c}), COUNT(*) - COUNT({c}),
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT),
       COUNT(DISTINCT {c}) FROM claims""")
    return with_claims(f"\nSELECT {columns} FROM (" + "\nUNION ALL".join(parts) + ") p")


DATA_PROFILE = _profile_sql()
# what merged day states give exactly (quantiles and distinct counts are sketches there)
DATA_PROFILE_MERGED = _profile_sql("column_name, kind, n_count, n_missing, mean, std, min, max, n_zeros")

# ----------------------------------------------------------------- fraud

PROVIDER_FRAUD_RATE_JOIN = with_claims("""
SELECT c.*, r.provider_fraud_rate FROM claims c LEFT JOIN (
  SELECT provider_id, CAST(SUM(fraud_flag) AS DOUBLE) / CAST(COUNT(fraud_flag) AS DOUBLE) AS provider_fraud_rate
  FROM claims WHERE provider_id IS NOT NULL GROUP BY provider_id) r ON c.provider_id = r.provider_id
""")

FRAUD_SUMMARY = with_claims(f"""
SELECT CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count, COUNT(*) AS total_claims,
       CAST(COALESCE(SUM(fraud_flag), 0) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS fraud_rate,
       COALESCE({msum('CASE WHEN fraud_flag = 1 THEN amount END')}, 0.0) AS amount_at_risk
FROM claims
""")


def _fraud_by(key: str) -> str:
    return f"""
  SELECT {key}, COALESCE({msum('amount')}, 0.0) AS total_amount,
         CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count,
         COUNT(fraud_flag) AS total_claims,
         CAST(COALESCE(SUM(fraud_flag), 0) AS DOUBLE) / NULLIF(CAST(COUNT(fraud_flag) AS DOUBLE), 0) AS fraud_rate
  FROM claims WHERE {key} IS NOT NULL GROUP BY {key}"""


FRAUD_BY_PROVIDER = with_claims(f"""
SELECT * FROM ({_fraud_by('provider_id')}) t ORDER BY fraud_count DESC, provider_id LIMIT 10
""")
FRAUD_BY_DIAGNOSIS = with_claims(f"""
SELECT * FROM ({_fraud_by('diagnosis')}) t WHERE total_claims > 10 ORDER BY fraud_rate DESC, diagnosis LIMIT 10
""")


def _monthly_sql(aggs: str, fills: str, src: str = "claims", per: str | None = None) -> str:
    """Month-end resample with empty months, optionally per group ``per``."""
    pk = f"{per}, " if per else ""
    join_per = f"s.{per} = a.{per} AND " if per else ""
    return f"""
, base AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month_start FROM {src} WHERE date IS NOT NULL{f' AND {per} IS NOT NULL' if per else ''}),
agg AS (SELECT {pk}month_start, {aggs} FROM base GROUP BY {pk}month_start),
bounds AS (SELECT {pk}min(month_start) AS lo, max(month_start) AS hi FROM base{' GROUP BY ' + per if per else ''}),
spine AS (SELECT {'b.' + per + ', ' if per else ''}CAST(gs AS DATE) AS month_start FROM bounds b, LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 1 MONTH)) AS gs) x)
SELECT {'s.' + per + ', ' if per else ''}last_day(s.month_start) AS month, {fills}
FROM spine s LEFT JOIN agg a ON {join_per}s.month_start = a.month_start
"""


FRAUD_OVER_TIME = with_claims(_monthly_sql(
    "CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count", "COALESCE(a.fraud_count, 0) AS fraud_count"))

FRAUD_CASES = with_claims("""
SELECT date, amount, provider_id, diagnosis FROM claims WHERE fraud_flag = 1
ORDER BY date, amount, provider_id, diagnosis LIMIT 100
""")

# ----------------------------------------------------------------- reports

CLIENT = "BUILDING"

CLIENT_CLAIMS = with_claims(f"SELECT * FROM claims WHERE employer = '{CLIENT}'")

PERIOD_FILTER = with_claims(
    "SELECT * FROM claims WHERE date >= DATE '1996-10-01' AND date < DATE '1997-01-01'")

PERIOD_FILTER_MONTH = with_claims(
    "SELECT * FROM claims WHERE date >= DATE '1999-12-01' AND date < DATE '2000-01-01'")

CLIENT_OVERVIEW = with_claims(f"""
SELECT COUNT(*) AS total_claims, COALESCE({msum('amount')}, 0.0) AS total_amount,
       {mmean('amount')} AS average_amount FROM claims WHERE employer = '{CLIENT}'
""")

MONTHLY_TREND = with_claims(_monthly_sql(
    f"COALESCE({msum('amount')}, 0.0) AS total_amount, COUNT(amount) AS claim_count",
    "COALESCE(a.total_amount, 0.0) AS total_amount, COALESCE(a.claim_count, 0) AS claim_count",
    src=f"(SELECT * FROM claims WHERE employer = '{CLIENT}')"))

CATEGORY_DISTRIBUTION = with_claims(f"""
SELECT category, COUNT(*) AS count FROM claims WHERE employer = '{CLIENT}' AND category IS NOT NULL GROUP BY 1
""")

_SUMMARY_COLS = f"""COUNT(*) AS total_claims, COALESCE({msum('amount')}, 0.0) AS total_amount,
       {mmean('amount')} AS average_amount,
       COALESCE({msum('amount')}, 0.0) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS average_amount_all,
       CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count,
       COALESCE({msum('CASE WHEN fraud_flag = 1 THEN amount END')}, 0.0) AS fraud_amount"""

REPORT_SUMMARY = with_claims(f"SELECT {_SUMMARY_COLS} FROM claims WHERE employer = '{CLIENT}'")

_PROV = f"""SELECT provider_id, COALESCE({msum('amount')}, 0.0) AS total_amount, COUNT(amount) AS claim_count,
       CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count FROM claims
       WHERE employer = '{CLIENT}' AND provider_id IS NOT NULL GROUP BY provider_id"""

TOP_PROVIDERS_BY_AMOUNT = with_claims(f"SELECT * FROM ({_PROV}) t ORDER BY total_amount DESC, provider_id LIMIT 5")
TOP_PROVIDERS_BY_FRAUD = with_claims(
    f"SELECT * FROM ({_PROV}) t WHERE fraud_count > 0 ORDER BY fraud_count DESC, provider_id LIMIT 5")
TOP_FRAUD_AMOUNT = with_claims(f"""
SELECT provider_id, COALESCE({msum('amount')}, 0.0) AS fraud_amount FROM claims
WHERE employer = '{CLIENT}' AND fraud_flag = 1 AND provider_id IS NOT NULL GROUP BY 1
ORDER BY fraud_amount DESC, provider_id LIMIT 5
""")


def _flagged(col: str, where: str = f"employer = '{CLIENT}'") -> str:
    return with_claims(f"""
SELECT {col}, COUNT(*) AS fraud_count FROM claims WHERE {where} AND fraud_flag = 1 AND {col} IS NOT NULL
GROUP BY 1 ORDER BY fraud_count DESC, {col} LIMIT 5""")


FRAUD_BY_CATEGORY = _flagged("category")
FRAUD_BY_DIAGNOSIS_COUNT = _flagged("diagnosis")

# client_report: every client at once
CR_SUMMARY = with_claims(f"SELECT employer, {_SUMMARY_COLS} FROM claims WHERE employer IS NOT NULL GROUP BY employer")
CR_MONTHLY = with_claims(_monthly_sql(
    f"COALESCE({msum('amount')}, 0.0) AS total_amount, COUNT(amount) AS claim_count",
    "COALESCE(a.total_amount, 0.0) AS total_amount, COALESCE(a.claim_count, 0) AS claim_count",
    per="employer"))
_PROV_ALL = f"""SELECT employer, provider_id, COALESCE({msum('amount')}, 0.0) AS total_amount,
       COUNT(amount) AS claim_count, CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count
       FROM claims WHERE employer IS NOT NULL AND provider_id IS NOT NULL GROUP BY employer, provider_id"""
CR_TOP_AMOUNT = with_claims(f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY total_amount DESC, provider_id) AS rn
FROM ({_PROV_ALL}) t) z WHERE rn <= 5""")
CR_TOP_FRAUD = with_claims(f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY fraud_count DESC, provider_id) AS rn
FROM ({_PROV_ALL}) t WHERE fraud_count > 0) z WHERE rn <= 5""")


def _cr_flagged(col: str) -> str:
    return with_claims(f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY fraud_count DESC, {col}) AS rn
FROM (SELECT employer, {col}, COUNT(*) AS fraud_count FROM claims
      WHERE employer IS NOT NULL AND fraud_flag = 1 AND {col} IS NOT NULL GROUP BY 1, 2) t) z WHERE rn <= 5""")


CR_FRAUD_CATEGORY = _cr_flagged("category")
CR_FRAUD_DIAGNOSIS = _cr_flagged("diagnosis")

# the written documents: their list of top providers, in order
REPORT_DOCUMENTS = with_claims(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY total_amount DESC, provider_id) AS rank
FROM ({_PROV_ALL}) t) z WHERE rank <= 5""")
REPORT_INDEX = with_claims(f"""
, c AS (SELECT DISTINCT employer AS client FROM claims WHERE employer IS NOT NULL)
SELECT client, 'monthly_20020101_120000.json' AS filename, 'monthly' AS type,
       CASE WHEN client = '{CLIENT}' THEN 'read' ELSE 'unread' END AS status FROM c
UNION ALL SELECT client, 'fraud_20020102_120000.json', 'fraud', 'unread' FROM c""")

# ----------------------------------------------------------------- ingest

MAPPED = """, mapped AS (
  SELECT CLAIM_CENTRAL_ID, CLAIM_MEMBER_NUMBER AS employee_id, CLAIM_PROV_DATE AS date,
         PROV_NAME AS provider_id, POL_NAME AS employer, Ailment AS diagnosis,
         Department AS department, SERVICE_DESCRIPTION AS treatment, Gender, DOB, AMOUNT AS amount
  FROM raw)"""

_FMTS = ["%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d"]
_HITS = ", hits AS (SELECT " + ", ".join(
    f"count(try_strptime(date, '{f}')) AS h{i}" for i, f in enumerate(_FMTS)) + " FROM mapped)"
_PARSED = ("CAST(CASE " + " ".join(
    f"WHEN h{i} > 0 THEN try_strptime(date, '{f}')" for i, f in enumerate(_FMTS)) + " END AS DATE)")
_DATED = f""", dated AS (
  SELECT * REPLACE ({_PARSED} AS date) FROM mapped CROSS JOIN hits
  WHERE {_PARSED} IS NOT NULL)"""
_AMT = "TRY_CAST(regexp_replace(CAST(amount AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE)"
_LOADED = f""", loaded AS (
  SELECT CLAIM_CENTRAL_ID, employee_id, date, provider_id, employer, diagnosis, department,
         treatment, Gender, DOB, COALESCE({_AMT}, 0.0) AS amount,
         CAST({_AMT} IS NULL AS INTEGER) AS amount_invalid
  FROM dated)"""

SCHEMA_MAP = with_raw(MAPPED + " SELECT * FROM mapped")
PARSE_DATES = with_raw(MAPPED + _HITS + _DATED + """
SELECT CLAIM_CENTRAL_ID, employee_id, date, provider_id, employer, diagnosis, department,
       treatment, Gender, DOB, amount FROM dated""")
PARSE_AMOUNT = with_raw(MAPPED + f"""
SELECT * REPLACE (COALESCE({_AMT}, 0.0) AS amount), CAST({_AMT} IS NULL AS INTEGER) AS amount_invalid
FROM mapped""")
LOAD_CLAIMS = with_raw(MAPPED + _HITS + _DATED + _LOADED + " SELECT * FROM loaded")
LOAD_VALIDATION = with_raw(MAPPED + _HITS + _DATED + _LOADED + """
SELECT * FROM (VALUES ('required:amount', true, 'present'), ('required:date', true, 'present'),
                      ('required:employee_id', true, 'present')) v(rule, passed, detail)
UNION ALL
SELECT 'min_rows', COUNT(*) >= 100, CAST(COUNT(*) AS VARCHAR) || ' rows (need >= 100)' FROM loaded
""")
LINES_TO_CLAIMS = with_raw(MAPPED + _HITS + _DATED + _LOADED + f"""
, g AS (
  SELECT CLAIM_CENTRAL_ID AS claim_id, employee_id, date, provider_id, employer, diagnosis, department,
         COALESCE({msum('amount')}, 0.0) AS amount,
         array_to_string(list_sort(list_distinct(list(treatment))), '|') AS treatment,
         min(Gender) AS employee_gender, min(CAST(DOB AS DATE)) AS dob
  FROM loaded
  WHERE CLAIM_CENTRAL_ID IS NOT NULL AND employee_id IS NOT NULL AND date IS NOT NULL
    AND provider_id IS NOT NULL AND employer IS NOT NULL AND diagnosis IS NOT NULL AND department IS NOT NULL
  GROUP BY ALL)
SELECT *, CAST(floor(datediff('day', dob, DATE '2002-01-01') / 365) AS INTEGER) AS employee_age,
       amount * CAST(0.1 AS DOUBLE) AS co_payment, 'Paid' AS status, 'Standard' AS category
FROM g""")
ICD10_SUMMARY = with_claims("""
SELECT COUNT(*) FILTER (WHERE COALESCE(regexp_matches(icd_code, '^[A-TV-Z][0-9][0-9AB]'), false)) AS n_valid,
       COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(icd_code, '^[A-TV-Z][0-9][0-9AB]'), false)) AS n_invalid
FROM claims""")
ICD10_VALIDATE = with_claims("""
SELECT *, COALESCE(regexp_matches(icd_code, '^[A-TV-Z][0-9][0-9AB]'), false) AS icd_valid FROM claims""")

# ----------------------------------------------------------------- cleaning

COERCE_TYPES = with_raw(MAPPED + f"""
SELECT * REPLACE ({_AMT} AS amount, CAST(TRY_CAST(DOB AS TIMESTAMP) AS DATE) AS DOB) FROM mapped""")

CLAIM_COLUMNS = ["claim_id", "line_no", "employee_id", "employee_gender", "employee_age", "dob",
                 "hire_date", "employer", "department", "provider_id", "diagnosis", "icd_code",
                 "treatment", "category", "visit_type", "status", "amount", "co_payment", "date",
                 "submission_date", "fraud_flag"]

MISSING_REPORT = with_claims("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"round(CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100.0 / COUNT(*), 6) AS pct_missing FROM claims"
    for c in CLAIM_COLUMNS))

_STRING_COLS = ["claim_id", "employee_id", "employee_gender", "employer", "department", "provider_id",
                "diagnosis", "icd_code", "treatment", "category", "visit_type", "status"]
_NUM_COLS = ["line_no", "employee_age", "amount", "co_payment", "fraud_flag"]

IMPUTE = with_claims(
    ", med AS (SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _NUM_COLS) + " FROM claims)\n"
    "SELECT " + ", ".join(
        (f"COALESCE({c}, 'Unknown') AS {c}" if c in _STRING_COLS else
         f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS {c}" if c in _NUM_COLS else c)
        for c in CLAIM_COLUMNS) + " FROM claims CROSS JOIN med")

FIX_AMOUNT = with_raw(MAPPED + _HITS + _DATED + _LOADED + """
, m AS (SELECT median(abs(amount)) AS med FROM loaded)
SELECT loaded.* REPLACE (CASE WHEN abs(amount) <= 0 THEN m.med ELSE abs(amount) END AS amount)
FROM loaded CROSS JOIN m""")

_NUM = "CASE WHEN NOT isnan(amount) THEN amount END"
MISSING_REPORT_GAPPY = with_gappy("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {w}) AS missing, "
    f"round(CAST(COUNT(*) FILTER (WHERE {w}) AS DOUBLE) * 100.0 / COUNT(*), 6) AS pct_missing FROM gappy"
    for c, w in [(c, f"{c} IS NULL") for c in ("claim_id", "line_no", "employee_age", "department", "note")]
    + [("amount", "amount IS NULL OR isnan(amount)")]))
DROP_SPARSE_COLUMNS = with_gappy("SELECT claim_id, line_no, employee_age, amount, department FROM gappy")
IMPUTE_GAPPY = with_gappy(f"""
, med AS (SELECT median(CAST(line_no AS DOUBLE)) AS l, median(CAST(employee_age AS DOUBLE)) AS e, median({_NUM}) AS a FROM gappy)
SELECT claim_id, COALESCE(CAST(line_no AS DOUBLE), l) AS line_no, COALESCE(CAST(employee_age AS DOUBLE), e) AS employee_age,
       COALESCE({_NUM}, a) AS amount, COALESCE(department, 'Unknown') AS department, COALESCE(note, 'Unknown') AS note
FROM gappy CROSS JOIN med""")
CLAIM_DISTRIBUTION_GAPPY = with_gappy(f"""
SELECT department, COUNT(*) AS claim_count, COALESCE({msum(_NUM)}, 0.0) AS total_amount, {mmean(_NUM)} AS average_amount
FROM gappy WHERE department IS NOT NULL GROUP BY department""")

CLIP_AGE = with_claims("""
SELECT claim_id, line_no, CAST(CASE WHEN employee_age < 18 THEN 18 WHEN employee_age > 100 THEN 100
       ELSE employee_age END AS INTEGER) AS employee_age FROM claims""")

_TENURE = "CAST(datediff('day', hire_date, DATE '2002-01-01') AS DOUBLE) / CAST(365.0 AS DOUBLE)"


def _bins(x: str, edges, labels) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                              for lo, hi, lab in zip(edges[:-1], edges[1:], labels)) + " END"


TENURE_GROUP = with_claims(f"""
SELECT claim_id, line_no, hire_date, {_TENURE} AS tenure,
       {_bins(_TENURE, [0, 1, 5, 100], ['<1yr', '1-5yrs', '5+yrs'])} AS tenure_group FROM claims""")
AGE_GROUP = with_claims(f"""
SELECT claim_id, line_no, employee_age,
       {_bins('employee_age', [0, 25, 35, 45, 55, 65, 100], ['<25', '25-35', '35-45', '45-55', '55-65', '65+'])} AS age_group
FROM claims""")
_SIZE = """CASE WHEN amount IS NULL THEN NULL
  WHEN amount >= q.lo AND amount <= q.q1 THEN 'Small' WHEN amount > q.q1 AND amount <= q.q2 THEN 'Medium'
  WHEN amount > q.q2 AND amount <= q.q3 THEN 'Large' WHEN amount > q.q3 AND amount <= q.hi THEN 'Very Large' END"""
_Q = """, q AS (SELECT min(amount) AS lo, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
              quantile_cont(amount, 0.75) AS q3, max(amount) AS hi FROM claims)"""
CLAIM_SIZE = with_claims(_Q + f"\nSELECT claim_id, line_no, amount, {_SIZE} AS claim_size FROM claims CROSS JOIN q")
CALENDAR_FEATURES = with_claims("""
SELECT claim_id, line_no, submission_date, dayname(submission_date) AS claim_weekday,
       monthname(submission_date) AS claim_month, CAST(quarter(submission_date) AS INTEGER) AS claim_quarter
FROM claims""")

CLEAN_CLAIMS = with_claims("""
, c1 AS (SELECT * REPLACE (abs(amount) AS amount, abs(co_payment) AS co_payment) FROM claims),
med AS (SELECT """ + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _NUM_COLS) + """ FROM c1),
c2 AS (SELECT """ + ", ".join(
    (f"COALESCE({c}, 'Unknown') AS {c}" if c in _STRING_COLS else
     f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS {c}" if c in _NUM_COLS else c)
    for c in CLAIM_COLUMNS) + """ FROM c1 CROSS JOIN med),
am AS (SELECT median(abs(amount)) AS med FROM c2),
c3 AS (SELECT c2.* REPLACE (CASE WHEN abs(amount) <= 0 THEN am.med ELSE abs(amount) END AS amount,
        CAST(CASE WHEN employee_age < 18 THEN 18 WHEN employee_age > 100 THEN 100 ELSE employee_age END AS DOUBLE) AS employee_age)
       FROM c2 CROSS JOIN am),
q AS (SELECT min(amount) AS lo, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2,
             quantile_cont(amount, 0.75) AS q3, max(amount) AS hi FROM c3)
SELECT c3.*, """ + _TENURE + """ AS tenure,
       """ + _bins(_TENURE, [0, 1, 5, 100], ['<1yr', '1-5yrs', '5+yrs']) + """ AS tenure_group,
       """ + _bins('employee_age', [0, 25, 35, 45, 55, 65, 100], ['<25', '25-35', '35-45', '45-55', '55-65', '65+']) + """ AS age_group,
       """ + _SIZE + """ AS claim_size,
       dayname(submission_date) AS claim_weekday, monthname(submission_date) AS claim_month,
       CAST(quarter(submission_date) AS INTEGER) AS claim_quarter
FROM c3 CROSS JOIN q""")


def _blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


def _pseudo_sql(key: str) -> str:
    k = key.encode().ljust(64, b"\x00")
    ipad = bytes(x ^ 0x36 for x in k)
    opad = bytes(x ^ 0x5C for x in k)
    h = (f"substr(sha256({_blob(opad)} || unhex(sha256({_blob(ipad)} || encode(CAST(employee_id AS VARCHAR))))), 1, 12)")
    mask = "CAST((CAST(trunc(amount * CAST(100.0 AS DOUBLE)) AS BIGINT) * 7919) % 999999 AS VARCHAR)"
    return with_claims(f"SELECT claim_id, line_no, {h} AS employee_id, {mask} AS amount FROM claims")


PSEUDO_KEY = "tenant-key"
PSEUDONYMIZE = _pseudo_sql(PSEUDO_KEY)

ISIN_FILTER = with_claims("""
SELECT * FROM claims WHERE employer IN ('BUILDING', 'MACHINERY') AND category IN ('1-URGENT', '2-HIGH')""")

# ----------------------------------------------------------------- audit events

AUDIT_TAIL = with_audit("""SELECT * FROM audit ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""")

FAILED_LOGIN_BURST = with_audit("""
, ev AS (SELECT event_id, "user", "timestamp", action FROM audit
         WHERE action IN ('error', 'signup') AND "user" IS NOT NULL),
r AS (SELECT *, SUM(CASE WHEN action = 'signup' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY "user" ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev),
f AS (SELECT *, SUM(CASE WHEN action = 'error' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY "user", run ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT event_id, "user", "timestamp", action, CAST(n AS BIGINT) AS failures_in_run, n >= 3 AS locked FROM f""")

# ----------------------------------------------------------------- drift

DRIFT_CUT = "DATE '1998-01-01'"


def _ks_block(col: str) -> str:
    return f"""SELECT '{col}' AS column_name, CAST(nr AS BIGINT) AS n_ref, CAST(nc AS BIGINT) AS n_cur,
       max(abs(CAST(cr AS DOUBLE) / CAST(nr AS DOUBLE) - CAST(cc AS DOUBLE) / CAST(nc AS DOUBLE))) AS ks_stat
FROM (SELECT v, SUM(r) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cr,
             SUM(c) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cc
      FROM (SELECT v, SUM(is_ref) AS r, SUM(1 - is_ref) AS c FROM (
              SELECT CAST({col} AS DOUBLE) AS v, 1 AS is_ref FROM claims WHERE date < {DRIFT_CUT} AND {col} IS NOT NULL
              UNION ALL
              SELECT CAST({col} AS DOUBLE), 0 FROM claims WHERE date >= {DRIFT_CUT} AND {col} IS NOT NULL) b
            GROUP BY v) cnt) cum,
     (SELECT SUM(CASE WHEN date < {DRIFT_CUT} THEN 1 ELSE 0 END) AS nr,
             SUM(CASE WHEN date >= {DRIFT_CUT} THEN 1 ELSE 0 END) AS nc FROM claims WHERE {col} IS NOT NULL) tot
GROUP BY nr, nc"""


_KS_P = """round(CASE WHEN lam < 0.05 THEN 1.0 ELSE least(greatest(2.0 * (
    SELECT SUM(pow(-1.0, k - 1) * exp(CAST(-2.0 AS DOUBLE) * k * k * lam * lam)) FROM range(1, 101) t(k)), 0.0), 1.0) END, 6)"""


def _ks_sql(cols) -> str:
    blocks = "\nUNION ALL\n".join(_ks_block(c) for c in cols)
    return f"""
, ks AS ({blocks}),
ks2 AS (SELECT *, (sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) + CAST(0.12 AS DOUBLE)
                   + CAST(0.11 AS DOUBLE) / sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur))) * ks_stat AS lam FROM ks)
"""


def _psi_block(col: str) -> str:
    def shares(cond):
        return f"""(SELECT {col} AS category, CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS s
           FROM claims WHERE {cond} AND {col} IS NOT NULL GROUP BY {col})"""
    return f"""SELECT '{col}' AS column_name, round(SUM((c.s - r.s) * ln(c.s / r.s)), 6) AS psi
FROM {shares(f'date >= {DRIFT_CUT}')} c JOIN {shares(f'date < {DRIFT_CUT}')} r USING (category)"""


DRIFT_KS = with_claims(_ks_sql(["amount"]) + f"SELECT column_name, n_ref, n_cur, ks_stat, {_KS_P} AS ks_p FROM ks2")
DRIFT_PSI = with_claims("\n" + _psi_block("treatment").replace("SELECT", "SELECT", 1))

DRIFT_NUMERIC = ["amount", "co_payment", "employee_age"]
DRIFT_CATEGORICAL = ["employer", "category", "treatment", "visit_type"]
DRIFT_REPORT = with_claims(_ks_sql(DRIFT_NUMERIC) + f""", psi AS ({' UNION ALL '.join(_psi_block(c) for c in DRIFT_CATEGORICAL)})
SELECT column_name, 'ks_stat' AS metric, ks_stat AS value FROM ks2
UNION ALL SELECT column_name, 'ks_p', {_KS_P} FROM ks2
UNION ALL SELECT column_name, 'psi', psi FROM psi""")

# ----------------------------------------------------------------- modelling (value-checkable parts)

_SPLIT_ORDER = ", ".join(["submission_date"] + [c for c in CLAIM_COLUMNS if c != "submission_date"])
TEMPORAL_SPLIT = with_claims(f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY {_SPLIT_ORDER} NULLS LAST)
                    <= (SELECT CAST(floor(COUNT(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM claims)
               THEN 'train' ELSE 'test' END AS split
FROM claims""")

FEATURE_SCALING = with_claims("""
SELECT claim_id, line_no,
  round((CAST(employee_age AS DOUBLE) - avg(CAST(employee_age AS DOUBLE)) OVER ()) / stddev_pop(CAST(employee_age AS DOUBLE)) OVER (), 6) AS employee_age_scaled,
  round((CAST(co_payment AS DOUBLE) - avg(CAST(co_payment AS DOUBLE)) OVER ()) / stddev_pop(CAST(co_payment AS DOUBLE)) OVER (), 6) AS co_payment_scaled
FROM claims""")

EVALUATE_BASELINE = with_claims(f"""
, m AS (SELECT diagnosis, {mmean('amount')} AS prediction FROM claims WHERE diagnosis IS NOT NULL GROUP BY diagnosis),
e AS (SELECT CAST(c.amount AS DOUBLE) AS y, m.prediction AS p FROM claims c JOIN m USING (diagnosis)
      WHERE c.amount IS NOT NULL AND m.prediction IS NOT NULL),
yb AS (SELECT avg(y) AS ybar FROM e)
SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       round(1.0 - SUM((y - p) * (y - p)) / NULLIF(SUM((y - ybar) * (y - ybar)), 0), 6) AS r2
FROM e CROSS JOIN yb""")
MODEL_HISTORY = f"SELECT 'baseline' AS model, e.* FROM ({EVALUATE_BASELINE}) e"


FILL_DEFAULTS = with_claims("""
SELECT COALESCE(CAST(employee_age AS DOUBLE), 0.0) AS employee_age,
       COALESCE(CAST(co_payment AS DOUBLE), 0.0) AS co_payment,
       CAST(0.5 AS DOUBLE) AS inpatient_cap_utilization,
       CAST(employer AS VARCHAR) AS employer, CAST(department AS VARCHAR) AS department,
       'Tuesday' AS claim_weekday, 'January' AS claim_month, '35-45' AS age_group,
       '1-5yrs' AS tenure_group, CAST(0.0 AS DOUBLE) AS same_day_claims
FROM claims""")

# ----------------------------------------------------------------- sinks / stream

READ_CLAIMS = with_raw("SELECT * FROM raw")
SHARE_BY_CLIENT = CLIENT_CLAIMS

WORKBOOK_SUMMARY = with_claims(f"""
SELECT 'Total Claims' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM claims
UNION ALL SELECT 'Total Amount', COALESCE({msum('amount')}, 0.0) FROM claims
UNION ALL SELECT 'Average Claim', {mmean('amount')} FROM claims
UNION ALL SELECT 'Potential Fraud Cases', CAST(COALESCE(SUM(fraud_flag), 0) AS DOUBLE) FROM claims""")
WORKBOOK_PROVIDERS = with_claims(f"""
SELECT provider_id, COALESCE({msum('amount')}, 0.0) AS total_amount, COUNT(amount) AS claim_count,
       CAST(COALESCE(SUM(fraud_flag), 0) AS BIGINT) AS fraud_count
FROM claims WHERE provider_id IS NOT NULL GROUP BY provider_id""")

AUDIT_STREAM = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       'events' AS tenant, event_type AS action, COUNT(*) AS events
FROM events WHERE ts IS NOT NULL GROUP BY ALL"""

AUDIT_READ = """
SELECT 'events' AS tenant, ts, CAST(user_id AS VARCHAR) AS "user", event_type AS action, props AS target, '' AS ip
FROM events"""

LABEL_FILES = """
SELECT 'client' AS format, 'CLAIM_CENTRAL_ID,CLAIM_MEMBER_NUMBER,CLAIM_PROV_DATE,PROV_NAME,POL_NAME,Ailment,Department,SERVICE_DESCRIPTION,Gender,DOB,AMOUNT' AS header
UNION ALL SELECT 'unknown', 'claim_id,line_no,fraud_flag'"""

_BASELINE = f"""
, m AS (SELECT diagnosis, {mmean('amount')} AS predicted_amount FROM claims WHERE diagnosis IS NOT NULL GROUP BY diagnosis),
s AS (SELECT claim_id, line_no, amount, predicted_amount, fraud_flag = 1 AS is_potential_fraud FROM claims JOIN m USING (diagnosis))"""
EXPORT_PREDICTIONS = with_claims(_BASELINE + "\nSELECT * FROM s")
PREDICTION_SUMMARY_BASELINE = with_claims(_BASELINE + f"""
SELECT {msum('predicted_amount')} AS total_predicted, {mmean('predicted_amount')} AS mean_predicted,
       COUNT(*) FILTER (WHERE is_potential_fraud) AS fraud_count FROM s""")

YEAR_OVER_YEAR = with_claims(_monthly_sql(
    f"COALESCE({msum('amount')}, 0.0) AS total_amount, COUNT(amount) AS claim_count",
    "COALESCE(a.total_amount, 0.0) AS total_amount, COALESCE(a.claim_count, 0) AS claim_count",
    src=f"(SELECT * FROM claims WHERE employer = '{CLIENT}')").replace(
    "SELECT last_day(s.month_start) AS month,", ", m AS (SELECT last_day(s.month_start) AS month,", 1)
    + """)
SELECT m.*, p.total_amount AS prev_year_amount, p.claim_count AS prev_year_count,
       round((m.total_amount - p.total_amount) / NULLIF(p.total_amount, 0), 6) AS yoy_change
FROM m LEFT JOIN m p ON p.month = last_day(m.month - INTERVAL 12 MONTH)""")
