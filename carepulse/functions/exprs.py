"""Column functions (projections, bands, tiers, scores).

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen; none of them is a Python UDF.

Numeric conventions (shared with the DuckDB oracles):
* money stays DECIMAL until the final projection, so sums are exact;
* an average is ``CAST(SUM(x) AS DOUBLE) / COUNT(x)``;
* displayed values are rounded with :func:`rhu` (half away from zero after
  fixing the value to 6 decimals), which both engines evaluate identically.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config, DEFAULTS

# ---------------------------------------------------------------- fixed values
# Labels that must read exactly as in the reference's age-group query.
AGE_GROUP_LABELS = (
    "0-17  Pediatric",
    "18-35 Young Adult",
    "36-55 Middle-Aged",
    "56-70 Senior",
    "71+ Elderly",
)
# Inclusive age band bounds used by that query (the last band is the ELSE).
AGE_BANDS = ((0, 17), (18, 35), (36, 55), (56, 70))

ABOVE_AVERAGE = "Above Average"
BELOW_AVERAGE = "Below Average"

# Our own labels (not given by the reference).
BILLING_TIER_LABELS = ("1-Low", "2-Medium", "3-High", "4-Premium")
LOS_TIER_LABELS = ("1-Short", "2-Medium", "3-Long", "4-Extended")
ROOM_TIER_LABELS = ("High", "Moderate", "Low")
RISK_TIER_LABELS = ("Critical", "High", "Medium", "Low")
SEASONS = (("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)),
           ("Summer", (6, 7, 8)), ("Autumn", (9, 10, 11)))
TREND_LABELS = ("Baseline", "Growth", "Decline", "Flat")
CELL_BUCKET_LABELS = ("High", "Mid", "Low")
QUARTILE_TIER_LABELS = ("Top Performer", "Above Average", "Below Average",
                        "Needs Improvement")
UNKNOWN = "Unknown"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------- numerics
def rhu(x, digits: int) -> Column:
    """Round half away from zero, after fixing the value to 6 decimals."""
    return F.round(col(x).cast("decimal(38,6)"), digits).cast("double")


def safe_div(num, den) -> Column:
    """A quotient that is NULL (blank) when the divisor is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def avg_exact(x) -> Column:
    """AVG as an aggregate: exact SUM over DECIMAL/INT, one division in DOUBLE."""
    return safe_div(F.sum(col(x)), F.count(col(x)))


def pct(part, whole, digits: int = 1) -> Column:
    """Percentage ``part * 100 / whole`` rounded; NULL when whole is 0."""
    return rhu(F.try_divide(col(part).cast("double") * F.lit(100.0),
                            col(whole).cast("double")), digits)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


# ------------------------------------------------------------ special functions
# fixed values: coefficients of Stirling's series for ln(gamma)
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Terms of the series and steps of the fraction below: enough for 1e-10 up to
#: shape 200; the normal approximation takes over beyond.
GAMMA_STEPS, GAMMA_LARGE = 200, 200


def log_gamma(a: Column) -> Column:
    """ln(gamma(a)) for a > 0: Stirling's series eight places up, and down again
    by gamma(a + 1) = a gamma(a)."""
    z = a + 8
    series = sum(F.lit(c) / F.pow(z, F.lit(2 * k + 1)) for k, c in enumerate(STIRLING))
    down = sum((F.log(a + k) for k in range(1, 8)), F.log(a))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - down


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x), a > 0, as a Column: the
    series of P for x < a + 1, else the continued fraction (Lentz), above
    :data:`GAMMA_LARGE` the cube-root normal approximation (error below 1e-5)."""
    a, x = a.cast("double"), x.cast("double")
    steps = F.sequence(F.lit(1), F.lit(GAMMA_STEPS))
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = F.aggregate(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda acc, k: F.struct(
        (acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s")), lambda acc: acc["s"])
    tiny = F.lit(1e-300)

    def step(acc: Column, k: Column) -> Column:
        an, b = -k * (k - a), x + 1 - a + 2 * k
        d = an * acc["d"] + b
        d = 1 / F.when(F.abs(d) < tiny, tiny).otherwise(d)
        c = b + an / acc["c"]
        c = F.when(F.abs(c) < tiny, tiny).otherwise(c)
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))
    d0 = 1 / (x + 1 - a)
    fraction = F.aggregate(steps, F.struct(F.lit(1e300).alias("c"), d0.alias("d"), d0.alias("h")), step,
                           lambda acc: acc["h"])
    # Wilson and Hilferty: the cube root of chi-square over its degrees is near normal
    u = (F.pow(x / a, F.lit(1 / 3)) - 1 + 1 / (9 * a)) * 3 * F.sqrt(a)
    q = (F.when(x <= 0, F.lit(1.0)).when(a > GAMMA_LARGE, normal_tail(u))
         .when(x < a + 1, 1 - front * series).otherwise(front * fraction))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def normal_tail(u: Column) -> Column:
    """Upper tail of the standard normal distribution (error below 1e-7): a
    polynomial in 1 / (1 + 0.2316419 |u|) times the density."""
    t = 1 / (1 + 0.2316419 * F.abs(u))
    # fixed values: the polynomial's coefficients
    poly = sum(F.lit(c) * F.pow(t, F.lit(k + 1)) for k, c in enumerate(
        (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)))
    tail = F.exp(-u * u / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(u >= 0, tail).otherwise(1 - tail)


# ------------------------------------------------------------------ dates
def length_of_stay(admit="date_of_admission", discharge="discharge_date") -> Column:
    """Days from admission to discharge (Spark's datediff takes the end first)."""
    return F.datediff(col(discharge), col(admit))


def month_start(d="date_of_admission") -> Column:
    """First day of the month as a DATE."""
    return F.trunc(col(d), "month")


def season(d="date_of_admission") -> Column:
    m = F.month(col(d))
    out = None
    for name, months in SEASONS:
        cond = m.isin(*months)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(UNKNOWN)


def day_name(d="date_of_admission") -> Column:
    return F.date_format(col(d), "EEEE")


# ------------------------------------------------------------------ bands
def age_group(age="age") -> Column:
    """Five bands; as in the reference's ``ELSE``, NULL and negative ages fall
    into the last band."""
    a = col(age)
    out = None
    for (lo, hi), label in zip(AGE_BANDS, AGE_GROUP_LABELS):
        cond = a.between(lo, hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(AGE_GROUP_LABELS[-1])


def above_below(value, benchmark) -> Column:
    """Strict ``>``; equal or NULL reads "Below Average"."""
    return F.when(col(value) > col(benchmark), ABOVE_AVERAGE).otherwise(BELOW_AVERAGE)


def billing_tier(billing="billing_amount", cfg: Config = DEFAULTS) -> Column:
    c1, c2, c3 = cfg.billing_cuts
    b = col(billing)
    return (F.when(b.isNull(), UNKNOWN)
            .when(b > c3, BILLING_TIER_LABELS[3])
            .when(b > c2, BILLING_TIER_LABELS[2])
            .when(b > c1, BILLING_TIER_LABELS[1])
            .otherwise(BILLING_TIER_LABELS[0]))


def los_tier(los="length_of_stay", cfg: Config = DEFAULTS) -> Column:
    c1, c2, c3 = cfg.los_cuts
    x = col(los)
    return (F.when(x.isNull() | (x < 0), UNKNOWN)
            .when(x <= c1, LOS_TIER_LABELS[0])
            .when(x <= c2, LOS_TIER_LABELS[1])
            .when(x <= c3, LOS_TIER_LABELS[2])
            .otherwise(LOS_TIER_LABELS[3]))


def room_tier(ratio, cfg: Config = DEFAULTS) -> Column:
    hi, mid = cfg.room_cuts
    r = col(ratio)
    return (F.when(r.isNull(), UNKNOWN).when(r >= hi, ROOM_TIER_LABELS[0])
            .when(r >= mid, ROOM_TIER_LABELS[1])
            .otherwise(ROOM_TIER_LABELS[2]))


def cell_bucket(ratio, cfg: Config = DEFAULTS) -> Column:
    """Conditional-formatting bucket of a matrix cell from its ratio to the
    mean cell (P17)."""
    hi, lo = cfg.cell_bucket_cuts
    r = col(ratio)
    return (F.when(r >= hi, CELL_BUCKET_LABELS[0]).when(r <= lo, CELL_BUCKET_LABELS[2])
            .otherwise(CELL_BUCKET_LABELS[1]))


def trend_label(growth, first) -> Column:
    """Baseline for the ``first`` month, Unknown for a later one without growth
    (the month before has no revenue, or none is known)."""
    g = col(growth)
    return (F.when(col(first), TREND_LABELS[0])
            .when(g.isNull(), UNKNOWN)
            .when(g > 0, TREND_LABELS[1])
            .when(g < 0, TREND_LABELS[2])
            .otherwise(TREND_LABELS[3]))


def quartile_tier(quartile) -> Column:
    q = col(quartile)
    out = None
    for i, label in enumerate(QUARTILE_TIER_LABELS, start=1):
        out = F.when(q == i, label) if out is None else out.when(q == i, label)
    return out


# ------------------------------------------------------------------ risk model
def age_points(age="age", cfg: Config = DEFAULTS) -> Column:
    a = col(age)
    pts = cfg.risk_age_points
    out = None
    for (lo, hi), p in zip(AGE_BANDS, pts):
        cond = a.between(lo, hi)
        out = F.when(cond, p) if out is None else out.when(cond, p)
    return out.otherwise(pts[-1])


def admission_type_points(t="admission_type", cfg: Config = DEFAULTS) -> Column:
    x = col(t)
    out = None
    for name, p in cfg.risk_type_points:
        out = F.when(x == name, p) if out is None else out.when(x == name, p)
    return out.otherwise(cfg.risk_type_other_points)


def result_points(r="test_results", cfg: Config = DEFAULTS) -> Column:
    x = col(r)
    out = None
    for name, p in cfg.risk_result_points:
        out = F.when(x == name, p) if out is None else out.when(x == name, p)
    return out.otherwise(0)


def billing_points(billing="billing_amount", cfg: Config = DEFAULTS) -> Column:
    c1, c2, c3 = cfg.billing_cuts
    p1, p2, p3 = cfg.risk_billing_points
    b = col(billing)
    return (F.when(b > c3, p3).when(b > c2, p2).when(b > c1, p1).otherwise(0))


def risk_tier(score="risk_score", cfg: Config = DEFAULTS) -> Column:
    crit, high, med = cfg.risk_tier_cuts
    s = col(score)
    return (F.when(s >= crit, RISK_TIER_LABELS[0])
            .when(s >= high, RISK_TIER_LABELS[1])
            .when(s >= med, RISK_TIER_LABELS[2])
            .otherwise(RISK_TIER_LABELS[3]))


def with_risk(adm, cfg: Config = DEFAULTS):
    """Add the four component points, the score and the tier to admissions."""
    return (adm.withColumns({
        "age_points": age_points("age", cfg),
        "type_points": admission_type_points("admission_type", cfg),
        "result_points": result_points("test_results", cfg),
        "billing_points": billing_points("billing_amount", cfg),
    }).withColumn("risk_score", F.col("age_points") + F.col("type_points")
                  + F.col("result_points") + F.col("billing_points"))
      .withColumn("risk_tier", risk_tier("risk_score", cfg)))
