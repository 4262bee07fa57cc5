"""Parameters the analyses depend on.

The reference states a few of these (the $40,000 top billing tier, the 22%
medication-dominance limit, the 35% emergency target, the 25/35/25/15 scorecard
weights, the score-8 review threshold); the rest are our own defaults.  Every
analysis takes a ``Config`` so none of them is a literal buried in a query.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # billing tiers: three ascending cuts; the top tier is "billing > last cut"
    billing_cuts: tuple[float, float, float] = (10_000, 25_000, 40_000)
    # length-of-stay tiers, inclusive upper bounds in days: short, medium, long
    los_cuts: tuple[int, int, int] = (3, 7, 14)
    # room-utilisation tiers on the ratio to the mean room: high, moderate
    room_cuts: tuple[float, float] = (1.2, 0.8)
    rolling_months: int = 3
    long_stay_factor: float = 2.0
    dominance_limit_pct: float = 22.0
    normal_rate_limit_pct: float = 35.0
    emergency_target_pct: float = 35.0
    significance: float = 0.05           # b16: p-values below it are marked
    # doctor scorecard weights in percent: volume, revenue, outcome, efficiency
    score_weights: tuple[int, int, int, int] = (25, 35, 25, 15)
    # risk model points
    risk_age_points: tuple[int, int, int, int, int] = (0, 1, 2, 3, 4)
    risk_type_points: tuple[tuple[str, int], ...] = (("Emergency", 3), ("Elective", 1))
    risk_type_other_points: int = 2
    risk_result_points: tuple[tuple[str, int], ...] = (
        ("Abnormal", 3), ("Inconclusive", 1), ("Normal", 0))
    risk_billing_points: tuple[int, int, int] = (1, 2, 3)
    # risk tiers: Critical >= a, High >= b, Medium >= c, else Low
    risk_tier_cuts: tuple[int, int, int] = (10, 8, 5)
    review_threshold: int = 8
    review_within_hours: int = 4
    top_n: int = 10
    top_k_per_group: int = 3
    mix_shift_pct: float = 5.0
    gap_band_pct: float = 20.0
    # values for the insurer x condition matrix columns (explicit pivot list)
    condition_values: tuple[str, ...] = (
        "Arthritis", "Asthma", "Cancer", "Diabetes", "Hypertension", "Obesity")
    # keys that identify one admission row in row-level outputs
    row_keys: tuple[str, ...] = ("admission_id",)
    # keys checked by the duplicate audit
    duplicate_keys: tuple[str, ...] = (
        "name", "age", "gender", "blood_type", "medical_condition", "date_of_admission",
        "doctor", "hospital", "insurance_provider", "billing_amount", "room_number",
        "admission_type", "discharge_date", "medication", "test_results")
    max_valid_age: int = 120
    # a10: billing that the elderly emergency cohort is compared with
    cohort_billing_cut: float = 35_000
    # matrix conditional formatting: cell value over the mean cell, high / low
    cell_bucket_cuts: tuple[float, float] = (1.1, 0.9)
    # approximate variants (off: exact results)
    approx_distinct: bool = False        # e01: approx_count_distinct (HyperLogLog++)
    percentile_accuracy: int = 0         # r01/b01: >0 uses percentile_approx(accuracy)
    # slicer examples used by the dashboard datasets d03/d04
    slice_example: tuple[tuple[str, object], ...] = (
        ("year", 2023), ("admission_type", "Emergency"))

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULTS = Config()

# The canonical fixture over the driver tables: billing runs about twice the
# reference's, so the cuts are doubled-and-rounded (see FIXTURES.md), rows are
# identified by the line-item keys, and conditions are the part types.
FIXTURE = Config(
    billing_cuts=(20_000, 50_000, 80_000),
    cohort_billing_cut=70_000,
    condition_values=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    row_keys=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    duplicate_keys=("l_orderkey", "l_linenumber"),
    slice_example=(("year", 1996), ("admission_type", "Emergency")),
)
