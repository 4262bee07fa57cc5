"""Oracle SQL: each analysis written independently as plain SQL for DuckDB.

Every statement starts from the canonical fixture view (the five driver
tables joined as in FIXTURES.md) and applies the fixture parameters
(billing cuts 20,000 / 50,000 / 80,000, slicer year 1996).  Rounding and
averaging follow the same numeric rules as the Spark side: exact DECIMAL sums,
``CAST(SUM(x) AS DOUBLE) / COUNT(x)`` averages, and ``R()`` = round half away
from zero after fixing 6 decimals.
"""

from __future__ import annotations

from ..functions.exprs import AGE_GROUP_LABELS as AGE_LABELS
from ..sources.fixture import ADMISSIONS_SQL
from ..sources.schema import COLUMNS

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def R(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,6)), {n}) AS DOUBLE)"


def P(part: str, whole: str, n: int = 1) -> str:
    return R(f"CAST(({part}) AS DOUBLE) * 100.0 / NULLIF(CAST(({whole}) AS DOUBLE), 0)", n)


def AVG(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0)"


def CNT(cond: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond})"


def TILE(place: str, tiles: int = 4) -> str:
    """NTILE from a 0-based place and the count ``total``, by its definition."""
    small, extra = f"(total // {tiles})", f"(total % {tiles})"
    return (f"CAST(CASE WHEN {place} < {extra} * ({small} + 1) THEN {place} // ({small} + 1) "
            f"ELSE {extra} + ({place} - {extra} * ({small} + 1)) // GREATEST({small}, 1) END + 1 AS BIGINT)")


def TAIL(x: str, df: str) -> str:
    """Upper tail of chi-square: a finite sum for an even number of degrees of
    freedom, one less the series of the lower tail for an odd one."""
    even = (f"list_sum(list_transform(range(CAST(({df}) // 2 AS BIGINT)), "
            f"lambda k: exp(k * ln(greatest(({x}) / 2, 1e-300)) - lgamma(k + 1) - ({x}) / 2)))")
    odd = (f"1.0 - list_sum(list_transform(range(2000), lambda k: exp((({df}) / 2.0 + k) * "
           f"ln(greatest(({x}) / 2, 1e-300)) - ({x}) / 2 - lgamma(({df}) / 2.0 + k + 1))))")
    return (f"CASE WHEN ({df}) > 0 THEN {R(f'greatest(0.0, least(1.0, CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END))', 4)} END")


AGE_GROUP = ("CASE " + " ".join(
    f"WHEN age BETWEEN {lo} AND {hi} THEN '{name}'" for (lo, hi), name in zip(
        ((0, 17), (18, 35), (36, 55), (56, 70)), AGE_LABELS)) + f" ELSE '{AGE_LABELS[-1]}' END")

MONTH = "make_date(year(date_of_admission), month(date_of_admission), 1)"

RISK = """SELECT *,
  CASE WHEN age BETWEEN 0 AND 17 THEN 0 WHEN age BETWEEN 18 AND 35 THEN 1
       WHEN age BETWEEN 36 AND 55 THEN 2 WHEN age BETWEEN 56 AND 70 THEN 3 ELSE 4 END AS age_points,
  CASE WHEN admission_type = 'Emergency' THEN 3 WHEN admission_type = 'Elective' THEN 1 ELSE 2 END AS type_points,
  CASE WHEN test_results = 'Abnormal' THEN 3 WHEN test_results = 'Inconclusive' THEN 1 ELSE 0 END AS result_points,
  CASE WHEN billing_amount > 80000 THEN 3 WHEN billing_amount > 50000 THEN 2
       WHEN billing_amount > 20000 THEN 1 ELSE 0 END AS billing_points
FROM adm"""

RISK_TIER = """CASE WHEN risk_score >= 10 THEN 'Critical' WHEN risk_score >= 8 THEN 'High'
     WHEN risk_score >= 5 THEN 'Medium' ELSE 'Low' END"""


def dist(expr: str, name: str, extra: str = "") -> str:
    return f"""SELECT {expr} AS {name}, COUNT(*) AS total_patients,
  {P('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total{extra}
FROM adm GROUP BY 1"""


def rates(expr: str, name: str) -> str:
    return f"""SELECT {expr} AS {name}, COUNT(*) AS total_patients,
  {P(CNT("test_results = 'Normal'"), 'COUNT(*)')} AS normal_rate,
  {P(CNT("test_results = 'Abnormal'"), 'COUNT(*)')} AS abnormal_rate,
  {P(CNT("test_results = 'Inconclusive'"), 'COUNT(*)')} AS inconclusive_rate
FROM adm GROUP BY 1"""


def r11_sql() -> str:
    names = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    quoted = ", ".join(f"'{n}'" for n in names)
    money = ", ".join(f"MAX(rev) FILTER (WHERE c = '{n}') AS \"{n}\"" for n in (*names, "other"))
    bucket = ", ".join(
        f"CASE WHEN \"{n}\" IS NULL THEN NULL WHEN CAST(\"{n}\" AS DOUBLE) * cells / CAST(everything AS DOUBLE) >= 1.1 "
        f"THEN 'High' WHEN CAST(\"{n}\" AS DOUBLE) * cells / CAST(everything AS DOUBLE) <= 0.9 THEN 'Low' "
        f"ELSE 'Mid' END AS \"{n}_bucket\"" for n in names)
    shown = ", ".join(R(f'"{n}"', 2) + f' AS "{n}"' for n in (*names, "other"))
    return f"""WITH g AS (SELECT insurance_provider AS i, IF(medical_condition IN ({quoted}), medical_condition, 'other') AS c,
  SUM(billing_amount) AS rev FROM adm GROUP BY 1, 2),
w AS (SELECT i, {money}, SUM(rev) AS total FROM g GROUP BY 1),
t AS (SELECT SUM(rev) AS everything, COUNT(rev) AS cells FROM g)
SELECT i AS insurance_provider, {shown}, {R('total', 2)} AS insurer_total, {bucket} FROM w, t"""


def _null_audit() -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({CNT(f'{c} IS NULL')} AS BIGINT) AS null_count, "
             f"{P(CNT(f'{c} IS NULL'), 'COUNT(*)', 2)} AS null_pct FROM adm" for c in COLUMNS]
    return "\nUNION ALL\n".join(parts)


def _range_audit() -> str:
    rules = [("discharge_before_admission", "discharge_date < date_of_admission"),
             ("zero_length_stay", "length_of_stay = 0"),
             ("non_positive_billing", "billing_amount <= 0"),
             ("age_out_of_range", "age < 0 OR age > 120"),
             ("missing_admission_date", "date_of_admission IS NULL")]
    return "\nUNION ALL\n".join(
        f"SELECT '{k}' AS rule, CAST({CNT(c)} AS BIGINT) AS violations FROM adm" for k, c in rules)


HOSP_Q = """h AS (SELECT hospital, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
q AS (SELECT hospital, rev, NTILE(4) OVER (ORDER BY rev DESC, hospital) AS revenue_quartile FROM h)"""

MEASURES_BY_YEAR = f"""SELECT year(date_of_admission) AS year,
  {R('SUM(billing_amount)', 2)} AS total_revenue,
  COUNT(*) AS total_patients,
  {R(AVG('billing_amount'), 2)} AS avg_billing,
  {R(AVG('length_of_stay'), 1)} AS avg_length_of_stay,
  {R('CAST(SUM(billing_amount) AS DOUBLE) / NULLIF(CAST(SUM(length_of_stay) AS DOUBLE), 0)', 2)} AS revenue_per_day,
  {P(CNT("admission_type = 'Emergency'"), 'COUNT(*)')} AS emergency_rate_pct,
  {P(CNT("admission_type = 'Elective'"), 'COUNT(*)')} AS elective_rate_pct,
  {P(CNT("test_results = 'Normal'"), 'COUNT(*)')} AS normal_rate_pct,
  {P(CNT("test_results = 'Abnormal'"), 'COUNT(*)')} AS abnormal_rate_pct,
  {P(CNT("test_results = 'Inconclusive'"), 'COUNT(*)')} AS inconclusive_rate_pct,
  {P(CNT("admission_type = 'Urgent'"), 'COUNT(*)')} AS urgent_rate_pct,
  {CNT("admission_type = 'Urgent'")} AS urgent_admissions,
  {R("SUM(billing_amount) FILTER (WHERE admission_type = 'Urgent')", 2)} AS urgent_revenue,
  {CNT("admission_type = 'Emergency'")} AS emergency_admissions,
  {CNT("admission_type = 'Elective'")} AS elective_admissions,
  {R("SUM(billing_amount) FILTER (WHERE admission_type = 'Emergency')", 2)} AS emergency_revenue,
  {R("SUM(billing_amount) FILTER (WHERE admission_type = 'Elective')", 2)} AS elective_revenue,
  CAST(SUM(length_of_stay) AS BIGINT) AS total_los_days
FROM adm GROUP BY 1"""

BODIES: dict[str, str] = {
    # ------------------------------------------------------------ explore
    "e01_row_audit": """SELECT COUNT(*) AS total_rows, MIN(date_of_admission) AS min_date,
  MAX(date_of_admission) AS max_date, COUNT(DISTINCT hospital) AS distinct_hospitals,
  COUNT(DISTINCT doctor) AS distinct_doctors, COUNT(DISTINCT medical_condition) AS distinct_conditions,
  COUNT(DISTINCT insurance_provider) AS distinct_insurers FROM adm""",
    "e02_null_audit": _null_audit(),
    "e03_duplicate_audit": """SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM adm
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "e04_range_audit": _range_audit(),
    "e05_age_groups": f"""SELECT a AS age_group, n AS total_patients, {P('n', 'everyone')} AS pct_of_total
FROM (SELECT {AGE_GROUP} AS a, COUNT(*) AS n FROM adm GROUP BY 1)
JOIN (SELECT COUNT(*) AS everyone FROM adm) ON TRUE""",
    "e06_gender_dist": dist("gender", "gender"),
    "e07_blood_type_dist": dist("blood_type", "blood_type"),
    "e08_condition_counts": dist("medical_condition", "medical_condition"),
    "e09_medication_overview": dist("medication", "medication"),
    "e10_admission_type_dist": dist("admission_type", "admission_type"),
    # ------------------------------------------------------------ revenue
    "r01_billing_kpis": f"""SELECT {R('SUM(billing_amount)', 2)} AS total_revenue,
  {R(AVG('billing_amount'), 2)} AS avg_billing,
  {R('quantile_cont(CAST(billing_amount AS DOUBLE), 0.5)', 2)} AS median_billing,
  {R('quantile_cont(CAST(billing_amount AS DOUBLE), 0.25)', 2)} AS p25_billing,
  {R('quantile_cont(CAST(billing_amount AS DOUBLE), 0.75)', 2)} AS p75_billing
FROM adm""",
    "r02_condition_share": f"""WITH g AS (SELECT medical_condition, SUM(billing_amount) AS rev FROM adm GROUP BY 1)
SELECT medical_condition, {R('rev', 2)} AS revenue, {P('rev', 'SUM(rev) OVER ()')} AS share_pct,
  CAST(RANK() OVER (ORDER BY rev DESC) AS BIGINT) AS revenue_rank FROM g""",
    "r03_insurer_ranking": f"""WITH g AS (SELECT insurance_provider, SUM(billing_amount) AS rev, COUNT(*) AS n
  FROM adm GROUP BY 1)
SELECT insurance_provider, {R('rev', 2)} AS revenue, {R('CAST(rev AS DOUBLE) / n', 2)} AS avg_billing,
  n AS total_patients, CAST(RANK() OVER (ORDER BY rev DESC) AS BIGINT) AS revenue_rank FROM g""",
    "r04_hospital_top10": f"""WITH g AS (SELECT hospital, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
r AS (SELECT hospital, rev, RANK() OVER (ORDER BY rev DESC) AS rk FROM g)
SELECT hospital, {R('rev', 2)} AS revenue, CAST(rk AS BIGINT) AS revenue_rank FROM r
ORDER BY rev DESC, hospital LIMIT 10""",
    "r05_monthly_trend": f"""WITH t AS (SELECT {MONTH} AS mon, ROUND(SUM(billing_amount), 2) AS rev,
  COUNT(*) AS c FROM adm GROUP BY 1),
before AS (SELECT t.mon, MAX(p.mon) AS pmon, COUNT(p.c) AS k, COALESCE(SUM(p.rev), 0) AS earlier FROM t
  LEFT JOIN t p ON p.mon < t.mon OR (p.mon IS NULL AND t.mon IS NOT NULL) GROUP BY 1)
SELECT t.mon AS month, CAST(t.rev AS DOUBLE) AS monthly_revenue,
  CAST(before.earlier + t.rev AS DOUBLE) AS running_total,
  {R('CAST(t.rev - q.rev AS DOUBLE) * 100.0 / CAST(NULLIF(q.rev, 0) AS DOUBLE)', 1)} AS mom_growth_pct
FROM t JOIN before ON before.mon IS NOT DISTINCT FROM t.mon LEFT JOIN t q ON before.k > 0 AND q.mon IS NOT DISTINCT FROM before.pmon""",
    "r06_billing_tiers": f"""WITH t AS (SELECT CASE WHEN billing_amount IS NULL THEN 'Unknown'
    WHEN billing_amount > 80000 THEN '4-Premium' WHEN billing_amount > 50000 THEN '3-High'
    WHEN billing_amount > 20000 THEN '2-Medium' ELSE '1-Low' END AS billing_tier, billing_amount FROM adm),
g AS (SELECT billing_tier, COUNT(*) AS total_patients, SUM(billing_amount) AS rev FROM t GROUP BY 1)
SELECT billing_tier, total_patients, {R('rev', 2)} AS revenue,
  {P('total_patients', 'SUM(total_patients) OVER ()')} AS pct_patients,
  {P('rev', 'SUM(rev) OVER ()')} AS pct_revenue FROM g""",
    "r07_high_value_cohort": f"""SELECT CAST(80000 AS DOUBLE) AS billing_cut,
  {CNT('billing_amount > 80000')} AS cohort_patients,
  {P(CNT('billing_amount > 80000'), 'COUNT(*)')} AS pct_patients,
  {R('COALESCE(SUM(billing_amount) FILTER (WHERE billing_amount > 80000), 0)', 2)} AS cohort_revenue,
  {P('COALESCE(SUM(billing_amount) FILTER (WHERE billing_amount > 80000), 0)', 'SUM(billing_amount)')} AS pct_revenue
FROM adm""",
    "r08_hospital_quartiles": f"""WITH {HOSP_Q},
g AS (SELECT revenue_quartile, COUNT(*) AS hospitals, SUM(rev) AS rev FROM q GROUP BY 1)
SELECT CAST(revenue_quartile AS BIGINT) AS revenue_quartile, hospitals, {R('rev', 2)} AS revenue,
  {P('rev', 'SUM(rev) OVER ()')} AS share_pct FROM g""",
    "r09_quartile_ratio": f"""WITH {HOSP_Q},
a AS (SELECT SUM(rev) FILTER (WHERE revenue_quartile = 1) AS top,
             SUM(rev) FILTER (WHERE revenue_quartile = 4) AS bot FROM q)
SELECT {R('top', 2)} AS top_quartile_revenue, {R('bot', 2)} AS bottom_quartile_revenue,
  {R('CAST(top AS DOUBLE) / NULLIF(CAST(bot AS DOUBLE), 0)', 2)} AS top_to_bottom_ratio FROM a""",
    "r10_condition_admission_matrix": f"""WITH g AS (SELECT medical_condition, admission_type,
  COUNT(*) AS total_patients, SUM(billing_amount) AS rev FROM adm GROUP BY 1, 2),
x AS (SELECT *, SUM(rev) OVER () AS tot, COUNT(*) OVER () AS cells FROM g),
y AS (SELECT *, CAST(rev AS DOUBLE) * cells / CAST(tot AS DOUBLE) AS ratio FROM x)
SELECT medical_condition, admission_type, total_patients, {R('rev', 2)} AS revenue,
  {P('rev', 'tot')} AS share_pct, {R('ratio', 3)} AS heat_ratio,
  CASE WHEN ratio >= 1.1 THEN 'High' WHEN ratio <= 0.9 THEN 'Low' ELSE 'Mid' END AS cell_bucket
FROM y""",
    "r11_insurer_condition_matrix": r11_sql(),
    "r12_monthly_calendar_mom": f"""WITH m AS (SELECT {MONTH} AS month, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
b AS (SELECT MIN(month) AS lo, MAX(month) AS hi FROM m),
s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM b),
d AS (SELECT s.month, m.rev, COALESCE(m.rev, 0) AS r0 FROM s LEFT JOIN m ON s.month = m.month),
x AS (SELECT month, rev, r0, LAG(rev) OVER (ORDER BY month) AS last FROM d)
SELECT month, {R('r0', 2)} AS revenue, {R('last', 2)} AS revenue_last_month,
  {R('CAST(r0 - last AS DOUBLE) * 100.0 / CAST(NULLIF(last, 0) AS DOUBLE)', 1)} AS mom_growth_pct,
  {R('SUM(r0) OVER (PARTITION BY year(month) ORDER BY month ROWS UNBOUNDED PRECEDING)', 2)} AS revenue_ytd
FROM x""",
    "r13_matrix_totals": f"""SELECT insurance_provider, medical_condition, {R('SUM(billing_amount)', 2)} AS revenue,
  COUNT(*) AS total_patients, CAST(GROUPING(insurance_provider) AS BIGINT) AS is_insurer_total,
  CAST(GROUPING(medical_condition) AS BIGINT) AS is_condition_total
FROM adm GROUP BY CUBE (insurance_provider, medical_condition)""",
    # ------------------------------------------------------------ behaviour
    "b01_los_overall": f"""SELECT {R(AVG('length_of_stay'), 2)} AS avg_los,
  CAST(MIN(length_of_stay) AS BIGINT) AS min_los, CAST(MAX(length_of_stay) AS BIGINT) AS max_los,
  {R('quantile_cont(CAST(length_of_stay AS DOUBLE), 0.5)', 2)} AS median_los FROM adm""",
    "b02_los_by_condition": f"""SELECT medical_condition, COUNT(*) AS total_patients,
  {R(AVG('length_of_stay'), 2)} AS avg_los FROM adm GROUP BY 1""",
    "b03_los_by_admission_type": f"""SELECT admission_type, COUNT(*) AS total_patients,
  {R(AVG('length_of_stay'), 2)} AS avg_los, {R(AVG('billing_amount'), 2)} AS avg_billing
FROM adm GROUP BY 1""",
    "b04_los_tiers": dist("""CASE WHEN length_of_stay IS NULL OR length_of_stay < 0 THEN 'Unknown'
    WHEN length_of_stay <= 3 THEN '1-Short' WHEN length_of_stay <= 7 THEN '2-Medium'
    WHEN length_of_stay <= 14 THEN '3-Long' ELSE '4-Extended' END""", "los_tier",
                          f",\n  {R(AVG('billing_amount'), 2)} AS avg_billing"),
    "b05_seasonal": f"""WITH s AS ({dist('''CASE WHEN month(date_of_admission) IN (12, 1, 2) THEN 'Winter'
    WHEN month(date_of_admission) IN (3, 4, 5) THEN 'Spring'
    WHEN month(date_of_admission) IN (6, 7, 8) THEN 'Summer'
    WHEN month(date_of_admission) IN (9, 10, 11) THEN 'Autumn' ELSE 'Unknown' END''', 'season',
    ", COUNT(DISTINCT year(date_of_admission)) AS years_present")})
SELECT *, {R('CAST(total_patients AS DOUBLE) / NULLIF(CAST(years_present AS DOUBLE), 0)', 1)} AS avg_per_year FROM s""",
    "b06_month_of_year": f"""WITH g AS (SELECT year(date_of_admission) AS admission_year,
  month(date_of_admission) AS admission_month, COUNT(*) AS total_patients FROM adm GROUP BY 1, 2)
SELECT admission_year, admission_month, total_patients,
  {R('CAST(SUM(total_patients) OVER w AS DOUBLE) / COUNT(total_patients) OVER w', 2)} AS rolling_avg_3m
FROM g WINDOW w AS (ORDER BY admission_year NULLS FIRST, admission_month NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "b07_day_of_week": dist("dayname(date_of_admission)", "day_of_week",
                            ",\n  CAST(MIN(dayofweek(date_of_admission)) + 1 AS BIGINT) AS day_number"
                            f",\n  {R(AVG('billing_amount'), 2)} AS avg_billing"),
    "b08_medication_by_condition": f"""WITH c AS (SELECT medical_condition, medication, COUNT(*) AS total_patients
  FROM adm GROUP BY 1, 2)
SELECT *, {P('total_patients', 'SUM(total_patients) OVER (PARTITION BY medical_condition)')} AS pct_in_condition
FROM c""",
    "b09_medication_dominance": f"""WITH c AS (SELECT medical_condition, medication, COUNT(*) AS n FROM adm GROUP BY 1, 2),
s AS (SELECT *, CAST(n AS DOUBLE) * 100.0 / CAST(SUM(n) OVER (PARTITION BY medical_condition) AS DOUBLE) AS share,
  ROW_NUMBER() OVER (PARTITION BY medical_condition ORDER BY n DESC, medication) AS rn FROM c)
SELECT medical_condition, medication AS top_medication, {R('share', 1)} AS top_share_pct,
  share > 22.0 AS over_limit FROM s WHERE rn = 1""",
    "b10_medication_independence": f"""WITH c AS (SELECT medical_condition AS r, medication AS k, COUNT(*) AS o FROM adm GROUP BY 1, 2),
t AS (SELECT o, SUM(o) OVER (PARTITION BY r) AS rt, SUM(o) OVER (PARTITION BY k) AS ct,
             SUM(o) OVER () AS n FROM c),
a AS (SELECT SUM(CAST(o AS DOUBLE) * o * n / (CAST(rt AS DOUBLE) * ct)) - MAX(n) AS chi2, MAX(n) AS n FROM t),
d AS (SELECT COUNT(DISTINCT medical_condition) AS nr, COUNT(DISTINCT medication) AS nc FROM adm)
SELECT {R('chi2', 4)} AS chi2_stat, CAST((nr - 1) * (nc - 1) AS BIGINT) AS degrees_of_freedom,
  {TAIL('chi2', '(nr - 1) * (nc - 1)')} AS p_value,
  CAST(n AS BIGINT) AS total_observations,
  {R('SQRT(chi2 / (n * (LEAST(nr, nc) - 1)))', 4)} AS cramers_v FROM a, d""",
    "b11_outcome_by_age_group": rates(AGE_GROUP, "age_group"),
    "b12_medication_outcomes": f"""WITH c AS (SELECT medication, test_results, COUNT(*) AS o FROM adm GROUP BY 1, 2),
t AS (SELECT *, SUM(o) OVER (PARTITION BY medication) AS rt, SUM(o) OVER (PARTITION BY test_results) AS ct,
             SUM(o) OVER () AS n FROM c),
g AS (SELECT medication, MAX(rt) AS tp, MAX(n) AS n,
        COALESCE(SUM(o) FILTER (WHERE test_results = 'Normal'), 0) AS nm,
        SUM(CAST(o AS DOUBLE) * o * n / (CAST(rt AS DOUBLE) * ct)) AS s FROM t GROUP BY 1),
k AS (SELECT COUNT(DISTINCT test_results) AS outcomes FROM adm),
x AS (SELECT *, SUM(nm) OVER () AS na FROM g, k)
SELECT medication, CAST(tp AS BIGINT) AS total_patients,
  {R('CAST(nm AS DOUBLE) * 100.0 / tp', 1)} AS normal_rate,
  {R('CAST(nm AS DOUBLE) * 100.0 / tp - CAST(na AS DOUBLE) * 100.0 / n', 2)} AS diff_vs_overall,
  {R('s - tp', 4)} AS chi2_part, {TAIL('s - tp', 'outcomes - 1')} AS p_value FROM x""",
    "b16_medication_normal_test": f"""WITH g AS (SELECT medication, COUNT(*) AS n, {CNT("test_results = 'Normal'")} AS nm FROM adm GROUP BY 1),
t AS (SELECT *, CAST(SUM(n) OVER () AS DOUBLE) AS an, CAST(SUM(nm) OVER () AS DOUBLE) AS am FROM g),
x AS (SELECT *, an * power(nm * (an - n - am + nm) - (n - nm) * (am - nm), 2)
    / nullif(CAST(n AS DOUBLE) * (an - n) * am * (an - am), 0) AS chi2 FROM t)
SELECT medication, CAST(n AS BIGINT) AS total_patients, {P('nm', 'n')} AS normal_rate,
  {R('(am - nm) * 100.0 / nullif(an - n, 0)', 1)} AS other_normal_rate, {R('chi2', 4)} AS chi2_stat,
  {TAIL('chi2', '1')} AS p_value, COALESCE({TAIL('chi2', '1')} < 0.05, FALSE) AS significant FROM x""",
    "d08_sliced_stays": f"""SELECT medical_condition, {R('quantile_cont(CAST(length_of_stay AS DOUBLE), 0.25)', 2)} AS p25_los,
  {R('quantile_cont(CAST(length_of_stay AS DOUBLE), 0.5)', 2)} AS median_los,
  {R('quantile_cont(CAST(length_of_stay AS DOUBLE), 0.75)', 2)} AS p75_los,
  COUNT(DISTINCT hospital) AS distinct_hospitals
FROM adm WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency' GROUP BY 1""",
    "b13_condition_outcomes": f"""WITH r AS ({rates('medical_condition', 'medical_condition')})
SELECT *, normal_rate > 35.0 AS normal_above_limit FROM r""",
    "b14_abnormal_billing": f"""SELECT medical_condition,
  {R("CAST(SUM(billing_amount) FILTER (WHERE test_results = 'Abnormal') AS DOUBLE) / NULLIF(COUNT(billing_amount) FILTER (WHERE test_results = 'Abnormal'), 0)", 2)} AS avg_billing_abnormal,
  {R("CAST(SUM(billing_amount) FILTER (WHERE test_results <> 'Abnormal' OR test_results IS NULL) AS DOUBLE) / NULLIF(COUNT(billing_amount) FILTER (WHERE test_results <> 'Abnormal' OR test_results IS NULL), 0)", 2)} AS avg_billing_other,
  {R("CORR(CASE WHEN test_results = 'Abnormal' THEN 1.0 ELSE 0.0 END, CAST(billing_amount AS DOUBLE))", 4)} AS abnormal_billing_corr
FROM adm GROUP BY 1""",
    "b15_outcome_mix": dist("test_results", "test_results"),
    # ------------------------------------------------------------ operations
    "o01_doctor_benchmark": f"""WITH m AS (SELECT doctor, COUNT(*) AS n, SUM(billing_amount) AS rev,
  SUM(length_of_stay) AS los, COUNT(length_of_stay) AS nlos, COUNT(billing_amount) AS nb,
  {CNT("test_results = 'Normal'")} AS normal FROM adm GROUP BY 1),
x AS (SELECT *, {R('CAST(rev AS DOUBLE) / NULLIF(nb, 0)', 2)} AS avg_billing,
  {R('CAST(SUM(rev) OVER () AS DOUBLE) / SUM(nb) OVER ()', 2)} AS net FROM m)
SELECT doctor, n AS total_patients, {R('rev', 2)} AS revenue, avg_billing,
  {R('CAST(los AS DOUBLE) / NULLIF(nlos, 0)', 2)} AS avg_los, {P('normal', 'n')} AS normal_rate,
  {R('avg_billing - net', 2)} AS billing_diff_vs_network FROM x""",
    "o02_hospital_vs_network": f"""WITH s AS (SELECT hospital, SUM(billing_amount) AS amount, COUNT(billing_amount) AS k
  FROM adm GROUP BY 1),
v AS (SELECT hospital, {R('CAST(amount AS DOUBLE) / NULLIF(k, 0)', 2)} AS own,
  {R('CAST(SUM(amount) OVER () AS DOUBLE) / NULLIF(SUM(k) OVER (), 0)', 2)} AS net FROM s)
SELECT hospital, own AS avg_billing, net AS network_avg_billing, {R('own - net', 2)} AS diff_from_network_avg,
  IF(own > net, 'Above Average', 'Below Average') AS flag FROM v""",
    "o03_room_utilization": f"""WITH r AS (SELECT room_number, COUNT(*) AS admissions, SUM(length_of_stay) AS days
  FROM adm GROUP BY 1),
x AS (SELECT *, SUM(days) OVER () AS alld, COUNT(*) OVER () AS rooms FROM r),
y AS (SELECT room_number, admissions, CAST(days AS BIGINT) AS occupied_days,
  {R('CAST(days * rooms AS DOUBLE) / NULLIF(CAST(alld AS DOUBLE), 0)', 2)} AS utilization_ratio FROM x)
SELECT *, CASE WHEN utilization_ratio IS NULL THEN 'Unknown' WHEN utilization_ratio >= 1.2 THEN 'High' WHEN utilization_ratio >= 0.8 THEN 'Moderate'
  ELSE 'Low' END AS utilization_tier FROM y""",
    "o04_revenue_per_day_hospital": f"""WITH m AS (SELECT hospital, SUM(billing_amount) AS rev,
  SUM(length_of_stay) AS los FROM adm GROUP BY 1),
x AS (SELECT *, CAST(rev AS DOUBLE) / NULLIF(CAST(los AS DOUBLE), 0) AS rpd FROM m),
y AS (SELECT *, RANK() OVER (ORDER BY rpd DESC NULLS LAST) AS rk FROM x)
SELECT hospital, {R('rev', 2)} AS revenue, CAST(los AS BIGINT) AS total_los_days,
  {R('rpd', 2)} AS revenue_per_day, CAST(rk AS BIGINT) AS rpd_rank,
  (SELECT {R('CAST(SUM(billing_amount) AS DOUBLE) / NULLIF(CAST(SUM(length_of_stay) AS DOUBLE), 0)', 2)} FROM adm)
    AS network_revenue_per_day FROM y
ORDER BY rpd DESC NULLS LAST, hospital NULLS FIRST LIMIT 10""",
    "o05_revenue_per_day_admission_type": dist(
        "admission_type", "admission_type",
        f",\n  {R(AVG('billing_amount'), 2)} AS avg_billing, {R(AVG('length_of_stay'), 2)} AS avg_los,"
        f"\n  {R('CAST(SUM(billing_amount) AS DOUBLE) / NULLIF(CAST(SUM(length_of_stay) AS DOUBLE), 0)', 2)} AS revenue_per_day"),
    "o06_long_stay_patients": f"""WITH a AS (SELECT medical_condition, {AVG('length_of_stay')} AS av FROM adm GROUP BY 1)
SELECT {KEYS}, x.medical_condition, hospital, CAST(billing_amount AS DOUBLE) AS billing_amount,
  CAST(length_of_stay AS BIGINT) AS length_of_stay, {R('av', 2)} AS condition_avg_los,
  {R('length_of_stay / av', 2)} AS los_ratio
FROM adm x JOIN a ON x.medical_condition = a.medical_condition WHERE length_of_stay > av * 2.0""",
    "o07_emergency_rate": f"""SELECT 'network' AS scope_type, 'All' AS scope, COUNT(*) AS total_patients,
  {P(CNT("admission_type = 'Emergency'"), 'COUNT(*)')} AS emergency_pct, CAST(35.0 AS DOUBLE) AS target_pct,
  {R(P(CNT("admission_type = 'Emergency'"), 'COUNT(*)') + ' - 35.0', 1)} AS gap_pct FROM adm
UNION ALL
SELECT 'hospital', hospital, COUNT(*), {P(CNT("admission_type = 'Emergency'"), 'COUNT(*)')}, 35.0,
  {R(P(CNT("admission_type = 'Emergency'"), 'COUNT(*)') + ' - 35.0', 1)} FROM adm GROUP BY hospital""",
    "o08_test_outcome_stack": f"""WITH g AS (
  SELECT 'hospital' AS dimension, hospital AS member, test_results, COUNT(*) AS total_patients
  FROM adm GROUP BY 2, 3
  UNION ALL
  SELECT 'condition', medical_condition, test_results, COUNT(*) FROM adm GROUP BY 2, 3)
SELECT *, {P('total_patients', 'SUM(total_patients) OVER (PARTITION BY dimension, member)')} AS pct_within
FROM g""",
    "o09_doctor_bar": f"""WITH m AS (SELECT doctor, SUM(billing_amount) AS rev, COUNT(*) AS n FROM adm GROUP BY 1),
y AS (SELECT *, RANK() OVER (ORDER BY rev DESC) AS rk FROM m)
SELECT doctor, {R('rev', 2)} AS revenue, n AS total_patients, CAST(rk AS BIGINT) AS revenue_rank FROM y
ORDER BY rev DESC, doctor LIMIT 10""",
    "o10_top_bottom_performers": f"""WITH h AS (SELECT hospital AS e, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
d AS (SELECT doctor AS e, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
u AS (SELECT 'hospital' AS entity_type, e, rev, NTILE(4) OVER (ORDER BY rev DESC, e) AS q FROM h
      UNION ALL
      SELECT 'doctor', e, rev, NTILE(4) OVER (ORDER BY rev DESC, e) FROM d)
SELECT entity_type, e AS entity, {R('rev', 2)} AS revenue, CAST(q AS BIGINT) AS revenue_quartile,
  CASE WHEN q = 1 THEN 'Top' ELSE 'Bottom' END AS performer FROM u WHERE q IN (1, 4)""",
    "o11_gap_to_network": f"""WITH h AS (SELECT hospital, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
x AS (SELECT *, SUM(rev) OVER () AS alls, COUNT(*) OVER () AS k FROM h),
y AS (SELECT *, CAST(rev AS DOUBLE) * 100.0 * k / NULLIF(CAST(alls AS DOUBLE), 0) AS p FROM x)
SELECT hospital, {R('rev', 2)} AS revenue, {R('CAST(alls AS DOUBLE) / k', 2)} AS network_avg_revenue,
  {R('p', 1)} AS pct_of_network_avg, ABS(p - 100.0) <= 20.0 AS within_band FROM y""",
    "o12_day_mix_shift": f"""WITH a AS (SELECT COUNT(*) AS n, SUM(billing_amount) AS rev, SUM(length_of_stay) AS los,
  {CNT("admission_type = 'Emergency'")} AS ne,
  SUM(billing_amount) FILTER (WHERE admission_type = 'Emergency') AS be,
  SUM(length_of_stay) FILTER (WHERE admission_type = 'Emergency') AS le,
  {CNT("admission_type = 'Elective'")} AS nl,
  SUM(billing_amount) FILTER (WHERE admission_type = 'Elective') AS bl,
  SUM(length_of_stay) FILTER (WHERE admission_type = 'Elective') AS ll FROM adm),
b AS (SELECT CAST(rev AS DOUBLE) / n AS bb, CAST(los AS DOUBLE) / n AS bl0,
  CAST(rev AS DOUBLE) / NULLIF(CAST(los AS DOUBLE), 0) AS brpd,
  CAST(rev AS DOUBLE) / n + 0.05 * (CAST(bl AS DOUBLE) / nl - CAST(be AS DOUBLE) / ne) AS sb,
  CAST(los AS DOUBLE) / n + 0.05 * (CAST(ll AS DOUBLE) / nl - CAST(le AS DOUBLE) / ne) AS sl FROM a)
SELECT {R('bb', 2)} AS base_avg_billing, {R('bl0', 2)} AS base_avg_los,
  {R('brpd', 2)} AS base_revenue_per_day, {R('sb', 2)} AS shifted_avg_billing,
  {R('sl', 2)} AS shifted_avg_los, {R('sb / NULLIF(sl, 0)', 2)} AS shifted_revenue_per_day FROM b""",
    # ------------------------------------------------------------ advanced
    "a01_mom_rolling_trend": f"""WITH m AS (SELECT {MONTH} AS month, ROUND(SUM(billing_amount), 2) AS mr FROM adm GROUP BY 1),
x AS (SELECT month, mr, LAG(mr) OVER (ORDER BY month NULLS FIRST) AS prev,
  CAST(SUM(mr) OVER w3 AS DOUBLE) / COUNT(mr) OVER w3 AS ravg FROM m
  WINDOW w3 AS (ORDER BY month NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
y AS (SELECT month, CAST(mr AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue,
  {R('CAST(mr - prev AS DOUBLE) * 100.0 / CAST(NULLIF(prev, 0) AS DOUBLE)', 1)} AS mom_growth_pct,
  {R('ravg', 2)} AS rolling_avg_3m, ROW_NUMBER() OVER (ORDER BY month NULLS FIRST) AS nth FROM x)
SELECT * EXCLUDE (nth), CASE WHEN nth = 1 THEN 'Baseline' WHEN mom_growth_pct IS NULL THEN 'Unknown'
  WHEN mom_growth_pct > 0 THEN 'Growth' WHEN mom_growth_pct < 0 THEN 'Decline' ELSE 'Flat' END AS trend_label FROM y""",
    "a02_hospital_tiers": f"""WITH h AS (SELECT hospital, SUM(billing_amount) AS rev FROM adm GROUP BY 1),
r AS (SELECT hospital, rev, RANK() OVER (ORDER BY rev DESC) AS rk,
  NTILE(4) OVER (ORDER BY rev DESC, hospital) AS q, PERCENT_RANK() OVER (ORDER BY rev DESC) AS pr FROM h)
SELECT hospital, {R('rev', 2)} AS revenue, CAST(rk AS BIGINT) AS revenue_rank, CAST(q AS BIGINT) AS revenue_quartile,
  {R('pr', 4)} AS pct_rank,
  CASE q WHEN 1 THEN 'Top Performer' WHEN 2 THEN 'Above Average' WHEN 3 THEN 'Below Average'
         WHEN 4 THEN 'Needs Improvement' END AS performance_tier FROM r""",
    "a03_doctor_scorecard": f"""WITH d AS (SELECT doctor AS who, COUNT(*) AS n, SUM(billing_amount) AS money,
    100.0 * CAST({CNT("test_results = 'Normal'")} AS DOUBLE) / COUNT(*) AS fine, {AVG('length_of_stay')} AS days
  FROM adm GROUP BY 1),
place AS (SELECT *, COUNT(*) OVER () AS total,
    ROW_NUMBER() OVER (ORDER BY n, who NULLS FIRST) - 1 AS p1,
    ROW_NUMBER() OVER (ORDER BY money NULLS FIRST, who NULLS FIRST) - 1 AS p2,
    ROW_NUMBER() OVER (ORDER BY fine, who NULLS FIRST) - 1 AS p3,
    ROW_NUMBER() OVER (ORDER BY days DESC NULLS LAST, who NULLS FIRST) - 1 AS p4 FROM d),
tile AS (SELECT *, {TILE('p1')} AS t1, {TILE('p2')} AS t2, {TILE('p3')} AS t3, {TILE('p4')} AS t4 FROM place),
sum100 AS (SELECT *, t1 * 25 + t2 * 35 + t3 * 25 + t4 * 15 AS points FROM tile),
better AS (SELECT points, SUM(COUNT(*)) OVER (ORDER BY points DESC) - COUNT(*) + 1 AS rk FROM sum100 GROUP BY points)
SELECT who AS doctor, n AS total_patients, {R('money', 2)} AS total_revenue, {R('fine', 2)} AS normal_outcome_rate,
  {R('days', 2)} AS avg_los, t1 AS volume_score, t2 AS revenue_score, t3 AS outcome_score, t4 AS efficiency_score,
  {R('points / 100.0', 2)} AS composite_score, CAST(rk AS BIGINT) AS overall_rank
FROM sum100 JOIN better USING (points)""",
    "a04_condition_insurer_cohorts": f"""WITH g AS (SELECT medical_condition, insurance_provider, COUNT(*) AS total_patients,
  SUM(billing_amount) AS rev FROM adm GROUP BY 1, 2)
SELECT medical_condition, insurance_provider, total_patients, {R('rev', 2)} AS revenue,
  {R('CAST(rev AS DOUBLE) / total_patients', 2)} AS avg_billing,
  {P('rev', 'SUM(rev) OVER (PARTITION BY medical_condition)')} AS share_of_condition_pct,
  CAST(RANK() OVER (PARTITION BY medical_condition ORDER BY rev DESC) AS BIGINT) AS rank_in_condition FROM g""",
    "a05_patient_risk": f"""WITH r AS ({RISK}),
s AS (SELECT {KEYS}, age_points, type_points, result_points, billing_points,
  age_points + type_points + result_points + billing_points AS risk_score FROM r)
SELECT *, {RISK_TIER} AS risk_tier, CAST(RANK() OVER (ORDER BY risk_score DESC) AS BIGINT) AS risk_rank FROM s""",
    "a06_executive_summary": f"""WITH k AS (SELECT {R('SUM(billing_amount)', 2)} AS total_revenue, COUNT(*) AS total_patients,
  {R(AVG('billing_amount'), 2)} AS avg_billing, {R(AVG('length_of_stay'), 1)} AS avg_los,
  {R('CAST(SUM(billing_amount) AS DOUBLE) / NULLIF(CAST(SUM(length_of_stay) AS DOUBLE), 0)', 2)} AS revenue_per_day,
  {P(CNT("admission_type = 'Emergency'"), 'COUNT(*)')} AS emergency_pct,
  {P(CNT("test_results = 'Normal'"), 'COUNT(*)')} AS normal_pct FROM adm),
tc AS (SELECT medical_condition AS top_condition FROM adm GROUP BY 1
       ORDER BY SUM(billing_amount) DESC, medical_condition LIMIT 1),
th AS (SELECT hospital AS top_hospital FROM adm GROUP BY 1 ORDER BY SUM(billing_amount) DESC, hospital LIMIT 1),
ti AS (SELECT insurance_provider AS top_insurer FROM adm GROUP BY 1
       ORDER BY SUM(billing_amount) DESC, insurance_provider LIMIT 1)
SELECT * FROM k CROSS JOIN tc CROSS JOIN th CROSS JOIN ti""",
    "a07_risk_distribution": f"""WITH r AS ({RISK}),
s AS (SELECT *, age_points + type_points + result_points + billing_points AS risk_score FROM r)
SELECT {RISK_TIER} AS risk_tier, COUNT(*) AS total_patients,
  {P('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total,
  {R(AVG('billing_amount'), 2)} AS avg_billing, {R(AVG('length_of_stay'), 2)} AS avg_los
FROM s GROUP BY 1""",
    "a08_review_queue": f"""WITH r AS ({RISK}),
s AS (SELECT *, age_points + type_points + result_points + billing_points AS risk_score FROM r)
SELECT {KEYS}, date_of_admission, hospital, doctor, risk_score, {RISK_TIER} AS risk_tier
FROM s WHERE risk_score >= 8""",
    "a09_topk_insurer_per_condition": f"""WITH g AS (SELECT medical_condition, insurance_provider, SUM(billing_amount) AS rev
  FROM adm GROUP BY 1, 2),
r AS (SELECT *, RANK() OVER (PARTITION BY medical_condition ORDER BY rev DESC) AS rk FROM g)
SELECT medical_condition, insurance_provider, {R('rev', 2)} AS revenue, CAST(rk AS BIGINT) AS insurer_rank
FROM r WHERE rk <= 3""",
    # ------------------------------------------------------------ dashboard
    "d01_monthly_admissions": f"SELECT {MONTH} AS month, COUNT(*) AS total_patients FROM adm GROUP BY 1",
    "d02_condition_scatter": f"""SELECT medical_condition, COUNT(*) AS total_patients,
  {R(AVG('length_of_stay'), 2)} AS avg_los, {R(AVG('billing_amount'), 2)} AS avg_billing
FROM adm GROUP BY 1""",
    "d03_sliced_cards": f"""SELECT {R('SUM(billing_amount)', 2)} AS total_revenue, COUNT(*) AS total_patients,
  {R(AVG('billing_amount'), 2)} AS avg_billing, {R(AVG('length_of_stay'), 1)} AS avg_length_of_stay
FROM adm WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency'""",
    "d04_variance_vs_network": f"""WITH h AS (SELECT hospital, {R(AVG('billing_amount'), 2)} AS sliced_avg_billing FROM adm
  WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency' GROUP BY 1),
n AS (SELECT {R(AVG('billing_amount'), 2)} AS network_avg_billing FROM adm)
SELECT hospital, sliced_avg_billing, network_avg_billing,
  {R('sliced_avg_billing - network_avg_billing', 2)} AS variance_vs_network FROM h CROSS JOIN n""",
    "d05_hospital_rank_sliced": f"""WITH h AS (SELECT hospital, SUM(billing_amount) AS rev FROM adm
  WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency' GROUP BY 1)
SELECT hospital, {R('rev', 2)} AS revenue, CAST(RANK() OVER (ORDER BY rev DESC) AS BIGINT) AS revenue_rank,
  CAST(DENSE_RANK() OVER (ORDER BY rev DESC) AS BIGINT) AS revenue_dense_rank,
  CAST(NTILE(4) OVER (ORDER BY rev DESC, hospital) AS BIGINT) AS revenue_quartile FROM h""",
    "d06_doctor_rank_sliced": f"""WITH h AS (SELECT doctor, SUM(billing_amount) AS rev FROM adm
  WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency' GROUP BY 1)
SELECT doctor, {R('rev', 2)} AS revenue, CAST(RANK() OVER (ORDER BY rev DESC NULLS LAST) AS BIGINT) AS revenue_rank,
  CAST(DENSE_RANK() OVER (ORDER BY rev DESC NULLS LAST) AS BIGINT) AS revenue_dense_rank,
  CAST(NTILE(4) OVER (ORDER BY rev DESC NULLS LAST, doctor NULLS FIRST) AS BIGINT) AS revenue_quartile FROM h""",
    "d07_sliced_conditions": f"""SELECT medical_condition, COUNT(*) AS total_patients,
  {R('SUM(billing_amount)', 2)} AS total_revenue, {R(AVG('billing_amount'), 2)} AS avg_billing,
  {R(AVG('length_of_stay'), 1)} AS avg_length_of_stay,
  {R('CAST(SUM(billing_amount) AS DOUBLE) / NULLIF(CAST(SUM(length_of_stay) AS DOUBLE), 0)', 2)} AS revenue_per_day
FROM adm WHERE year(date_of_admission) = 1996 AND admission_type = 'Emergency' GROUP BY 1""",
    "e11_full_duplicate_audit": f"""SELECT {', '.join(c for c in COLUMNS if c != 'billing_amount')},
  CAST(billing_amount AS DOUBLE) AS billing_amount, COUNT(*) AS copies FROM adm
GROUP BY {', '.join(COLUMNS)} HAVING COUNT(*) > 1""",
    "o13_hospital_risk_profile": f"""WITH r AS ({RISK}),
s AS (SELECT *, age_points + type_points + result_points + billing_points AS score FROM r)
SELECT hospital, COUNT(*) AS total_patients, {R('SUM(billing_amount)', 2)} AS revenue,
  {R('CAST(SUM(score) AS DOUBLE) / COUNT(*)', 2)} AS avg_risk_score, {CNT('score >= 8')} AS review_patients,
  {P(CNT('score >= 8'), 'COUNT(*)')} AS review_pct FROM s GROUP BY 1""",
    "a10_elderly_emergency_cohort": f"""WITH r AS ({RISK}),
s AS (SELECT *, age_points + type_points + result_points + billing_points AS score FROM r
      WHERE age_points = 4 AND admission_type = 'Emergency' AND test_results = 'Abnormal')
SELECT COUNT(*) AS cohort_patients, CAST(MIN(score) AS BIGINT) AS min_risk_score,
  CAST(MAX(score) AS BIGINT) AS max_risk_score, {CNT('billing_amount > 70000')} AS patients_above_cut,
  {P(CNT('billing_amount > 70000'), 'COUNT(*)')} AS pct_above_cut, {R(AVG('billing_amount'), 2)} AS avg_billing FROM s""",
    "m01_measures_by_year": MEASURES_BY_YEAR,
}


def full_sql(body: str) -> str:
    """Prefix the fixture view (and the DAX DATEDIFF length of stay) as CTEs."""
    head = (f"WITH adm0 AS ({ADMISSIONS_SQL}),\n"
            "adm AS (SELECT *, CAST(date_diff('day', date_of_admission, discharge_date) AS INTEGER)"
            " AS length_of_stay FROM adm0)")
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return head + ",\n" + b[5:]
    return head + "\n" + b


# Over the events table directly (brute force: every signup x view pair of a
# user, fine for an oracle on the small fixture).
EVENT_BODIES = {
    "x2_review_deadline_check": f"""SELECT s.event_id, s.user_id, COUNT(v.event_id) > 0 AS reviewed,
  {R('MIN(epoch_us(v.ts) - epoch_us(s.ts)) / 60000000.0', 2)} AS minutes_to_review
FROM events s LEFT JOIN events v
  ON v.user_id = s.user_id AND v.event_type = 'view'
 AND v.ts BETWEEN s.ts AND s.ts + INTERVAL 4 HOUR
WHERE s.event_type = 'signup'
GROUP BY s.event_id, s.user_id""",
}


def oracle_sql() -> dict[str, str]:
    out = {k: full_sql(v) for k, v in BODIES.items()}
    out.update(EVENT_BODIES)
    return out


# Output columns of DATE type.  The driver contract compares pandas frames, in
# which Spark DATEs arrive as ``datetime.date`` and DuckDB DATEs as
# ``Timestamp``; both sides therefore render them as ISO text.
DATE_OUTPUTS = {
    "e01_row_audit": ("min_date", "max_date"),
    "r05_monthly_trend": ("month",),
    "r12_monthly_calendar_mom": ("month",),
    "a01_mom_rolling_trend": ("month",),
    "a08_review_queue": ("date_of_admission",),
    "d01_monthly_admissions": ("month",),
    "e11_full_duplicate_audit": ("date_of_admission", "discharge_date"),
}


def with_text_dates(key: str, sql: str) -> str:
    cols = DATE_OUTPUTS.get(key)
    if not cols:
        return sql
    rep = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


# what the jobs leave behind equals the analyses over the same rows
BODIES["s5_published_trend"] = BODIES["s6_refreshed_trend"] = BODIES["r05_monthly_trend"]
BODIES["x1_risk_flags"] = BODIES["a08_review_queue"]
BODIES["s1_csv_import"] = f"""SELECT CAST(year(date_of_admission) AS BIGINT) AS admission_year,
  COUNT(*) AS total_patients, {R('SUM(billing_amount)', 2)} AS revenue, CAST(SUM(length_of_stay) AS BIGINT) AS days,
  COUNT(DISTINCT doctor) AS doctors, COUNT(medical_condition) AS with_condition, CAST(0 AS BIGINT) AS rejected_values
FROM adm GROUP BY 1"""
DATE_OUTPUTS |= {"s5_published_trend": ("month",), "s6_refreshed_trend": ("month",),
                 "x1_risk_flags": ("date_of_admission",)}
