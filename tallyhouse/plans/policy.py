"""What a firm decides rather than computes: multipliers, targets, budgets, scope of adjustments.

Builders take a policy; nothing in them depends on particular place or practice names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, functions as F

from tallyhouse.functions.stable import bucket


@dataclass(frozen=True)
class Adjustment:
    """A multiplier for rows that match every given dimension value inside a date span."""

    factor: str
    first: date
    last: date
    where: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def as_column(self, day: str) -> Column:
        hit = F.col(day).between(F.lit(self.first), F.lit(self.last))
        for column, values in self.where.items():
            hit = hit & F.coalesce(F.col(column).isin(*values), F.lit(False))
        return F.when(hit, F.lit(self.factor).cast("decimal(6,4)")).otherwise(F.lit("1.0000").cast("decimal(6,4)"))


@dataclass(frozen=True)
class Promotion:
    """Members of ``level`` whose stable per-mille bucket is below ``per_mille`` count as ``to`` from a date on."""

    level: str
    to: str
    per_mille: int
    since: date


@dataclass(frozen=True)
class Policy:
    # hours credited per level: lowest share and number of hundredths it spreads over
    level_hours: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    practice_premium: Mapping[str, str] = field(default_factory=dict)
    office_rate: Mapping[str, str] = field(default_factory=dict)
    hour_adjustments: Sequence[Adjustment] = ()
    expense_adjustments: Sequence[Adjustment] = ()
    promotions: Sequence[Promotion] = ()
    bench_days: int = 90
    bench_percent: int = 0
    # upper bounds of the customer bucket for each revenue category, in order
    revenue_mix: Sequence[tuple[str, int]] = (("Products", 9), ("Partnerships", 22), ("Other", 26))
    planned_cost_share: str = "0.68"
    expense_scale: str = "1"
    receivable_scale: str = "1"
    payable_scale: str = "1"
    expense_office_variance: Mapping[str, str] = field(default_factory=dict)
    expense_group_variance: Mapping[str, str] = field(default_factory=dict)
    expense_month_variance: Mapping[int, str] = field(default_factory=dict)
    revenue_office_variance: Mapping[str, str] = field(default_factory=dict)
    revenue_practice_variance: Mapping[str, str] = field(default_factory=dict)
    overhead_region: Mapping[str, str] = field(default_factory=dict)
    overhead_practice: Mapping[str, str] = field(default_factory=dict)
    overhead_default: str = "0.22"
    outlier_contract_range: tuple[int, int] = (2_000_000, 15_000_000)
    outlier_projects: int = 8
    season: Mapping[int, str] = field(default_factory=dict)
    stretch: str = "1.10"
    large_margin_months: int = 6


# Credited share of hours per level (lowest share, spread in hundredths).
LEVEL_HOURS = {
    "Senior Partner": ("0.10", 10),
    "Partner": ("0.18", 12),
    "Associate Partner": ("0.38", 12),
    "Director": ("0.50", 15),
    "Engagement Manager": ("0.60", 12),
    "Associate": ("0.78", 8),
    "Business Analyst": ("0.85", 8),
}
# Seasonal shape of the monthly revenue target.
SEASON = {1: "0.96", 2: "0.96", 3: "1.02", 4: "1.00", 5: "1.02", 6: "1.06",
          7: "0.94", 8: "0.94", 9: "1.04", 10: "1.06", 11: "1.04", 12: "1.08"}

# The sample firm. Names are those of the test tables; the numbers are only examples.
SAMPLE_POLICY = Policy(
    level_hours=LEVEL_HOURS,
    practice_premium={"1-URGENT": "1.20", "2-HIGH": "1.10", "5-LOW": "0.90"},
    office_rate={"NATION_3": "1.30", "NATION_7": "1.05", "NATION_11": "0.92", "NATION_19": "0.85"},
    hour_adjustments=(
        Adjustment("0.78", date(2000, 11, 1), date(2000, 11, 30), {"practice_area": ["1-URGENT"]}),
        Adjustment("0.95", date(2000, 11, 1), date(2000, 11, 30), {"region": ["AMERICA"]}),
        Adjustment("0.60", date(2001, 7, 1), date(2001, 7, 31), {"location": ["NATION_7"], "practice_area": ["2-HIGH", "5-LOW"]}),
    ),
    expense_adjustments=(
        Adjustment("1.60", date(2000, 7, 1), date(2000, 12, 31), {"location": ["NATION_5"], "department_category": ["IT", "ENGINEERING"]}),
        Adjustment("0.50", date(2001, 7, 1), date(2001, 7, 31), {"location": ["NATION_7"], "practice_area": ["2-HIGH"]}),
    ),
    promotions=(Promotion("Director", "Partner", 300, date(2001, 4, 1)), Promotion("Associate Partner", "Partner", 400, date(2001, 4, 1))),
    bench_percent=5,
    expense_office_variance={"NATION_7": "0.060", "NATION_5": "0.040", "NATION_2": "-0.030"},
    expense_group_variance={"Corporate": "0.005", "Marketing": "0.015", "Technology": "-0.010"},
    expense_month_variance={1: "-0.005", 2: "-0.005", 11: "0.010", 12: "0.010"},
    revenue_office_variance={"NATION_7": "-0.080", "NATION_11": "-0.050", "NATION_3": "0.070", "NATION_5": "-0.035"},
    revenue_practice_variance={"1-URGENT": "0.015", "2-HIGH": "0.010", "3-MEDIUM": "-0.015"},
    overhead_region={"EUROPE": "0.20", "ASIA": "0.18"},
    overhead_practice={"1-URGENT": "0.95", "2-HIGH": "0.92"},
    outlier_contract_range=(200_000, 600_000),
    season=SEASON,
)


def jitter(key: Column) -> Column:
    """A stable variance between -1.5% and +1.5%."""
    return (bucket(key, 31) - F.lit(15)).cast("decimal(6,4)") / F.lit(1000).cast("decimal(6,0)")
