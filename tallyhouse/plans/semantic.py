"""Named filters and measures as column expressions, with the columns they need.

A measure applied to a table it does not fit is an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence, Set
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.functions import rules
from tallyhouse.functions.money import dbl, ratio, rounded, share_pct, sum_if
from tallyhouse.operators.aggregates import distinct_profile, text_columns
from tallyhouse.operators.joins import beside, full_outer
from tallyhouse.plans.firm import Firm
from tallyhouse.plans.gold import billable


@dataclass(frozen=True)
class Named:
    needs: tuple[str, ...]
    column: Callable[[Firm], Column]

    def on(self, df: DataFrame, firm: Firm) -> Column:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"table has no {', '.join(missing)}")
        return self.column(firm)


def _f(*needs: str):
    return lambda fn: Named(needs, fn)


# Status, level and type lists used by the named filters and measures.
SENIOR_LEVELS = ("Senior Partner", "Partner", "Associate Partner", "Engagement Manager", "Director")
TRAVEL_TYPES = ("Airfare", "Hotel", "Car Rental", "Ground Transportation", "Meals", "Mileage", "Parking")
OLD_BUCKETS = ("61-90 days", "90+ days")


def strict_partner() -> Column:
    return (F.col("job_level") == "Partner") & (F.col("employment_status") == "Active")


FILTERS: dict[str, Named] = {
    "Active Employees": _f("employment_status", "termination_date")(lambda f: (F.col("employment_status") == "Active") & (
        F.col("termination_date").isNull() | (F.col("termination_date") > F.lit(f.as_of)))),
    "Active Projects": _f("is_active", "project_status")(lambda f: F.col("is_active") & (F.col("project_status") == "Active")),
    "Aging Receivables 60+ Days": _f("days_outstanding", "aging_bucket")(lambda f: (F.col("days_outstanding") >= 60) & F.col("aging_bucket").isin(*OLD_BUCKETS)),
    "Approved Expenses": _f("approval_status")(lambda f: F.col("approval_status") == "Approved"),
    "Billable Time": _f("time_type_clean")(lambda f: billable()),
    "Current Fiscal Year": _f("fiscal_period")(lambda f: F.col("fiscal_period") >= F.lit(f.periods.year_start())),
    "Current Quarter": _f("fiscal_period")(lambda f: (F.col("fiscal_period") >= F.lit(f.periods.quarter(0))) & (F.col("fiscal_period") < F.lit(f.periods.quarter(-1)))),
    "High Value Transactions": _f("amount")(lambda f: F.col("amount") >= 10000),
    "Large Projects": _f("total_contract_value", "planned_revenue")(lambda f: F.coalesce(F.col("total_contract_value") >= 500000, F.lit(False)) | (F.col("planned_revenue") >= 500000)),
    "Overdue Accounts Payable": _f("payment_status", "due_date")(lambda f: (F.col("payment_status") == "Overdue") & (F.col("due_date") < F.lit(f.as_of))),
    "Overdue Invoices": _f("payment_status", "due_date")(lambda f: F.col("payment_status").isin("Open", "Overdue", "Partially Paid") & (F.col("due_date") < F.lit(f.as_of))),
    "Recent Expenses": _f("expense_date")(lambda f: f.periods.trailing_days("expense_date", 30)),
    "Senior Level Staff": _f("job_level")(lambda f: F.col("job_level").isin(*SENIOR_LEVELS)),
    "Strict Partners Only": _f("job_level", "employment_status")(lambda f: strict_partner()),
    "Year to Date": _f("fiscal_period")(lambda f: (F.col("fiscal_period") >= F.lit(f.periods.year_start())) & (F.col("fiscal_period") < F.lit(f.periods.month(0)))),
}

_mean = lambda c: ratio(F.sum(c), F.count(c))
_or_zero = lambda c: F.coalesce(c, F.lit(0.0))

MEASURES: dict[str, Named] = {
    "AP Aging Days": _f("due_date")(lambda f: _mean(F.datediff(F.lit(f.as_of), "due_date"))),
    "Accounts Receivable Total": _f("amount")(lambda f: F.sum("amount")),
    "Active Headcount": _f("employee_id")(lambda f: F.countDistinct("employee_id")),
    "Average Billing Rate": _f("billing_amount", "hours_worked", "time_type_clean")(lambda f: _or_zero(ratio(sum_if(billable(), "billing_amount"), sum_if(billable(), "hours_worked")))),
    "Billable Hours": _f("hours_worked", "time_type_clean")(lambda f: sum_if(billable(), "hours_worked")),
    "Days Sales Outstanding": _f("days_outstanding")(lambda f: _mean("days_outstanding")),
    "Expense Variance Percentage": _f("accrued_expenses", "budgeted_expenses")(lambda f: _or_zero(share_pct(
        F.sum(F.col("accrued_expenses").cast("decimal(28,2)")) - F.sum(F.col("budgeted_expenses").cast("decimal(28,2)")), F.sum(F.col("budgeted_expenses").cast("decimal(28,2)"))))),
    "Gross Margin Percentage": _f("total_revenue", "total_cost_of_delivery")(lambda f: _or_zero(share_pct(F.sum("total_revenue") - F.sum("total_cost_of_delivery"), F.sum("total_revenue")))),
    "Operating Margin Percentage": _f("total_revenue", "operating_income")(lambda f: _or_zero(share_pct(F.sum(F.col("operating_income").cast("decimal(28,4)")), F.sum("total_revenue")))),
    "Pipeline Coverage Ratio": _f("pipeline_revenue", "revenue")(lambda f: _or_zero(ratio(F.sum("pipeline_revenue"), F.sum("revenue")))),
    "Project Budget Variance": _f("actual_revenue", "planned_revenue")(lambda f: _or_zero(share_pct(F.sum("actual_revenue") - F.sum("planned_revenue"), F.sum("planned_revenue")))),
    "Project Margin Percentage": _f("actual_margin", "actual_revenue")(lambda f: _or_zero(share_pct(F.sum("actual_margin"), F.sum("actual_revenue")))),
    "Revenue per Partner": _f("billing_amount", "partners")(lambda f: _or_zero(ratio(F.sum("billing_amount"), F.max("partners")))),
    "Total Expense Amount": _f("total_expenses")(lambda f: F.sum("total_expenses")),
    "Travel Spend": _f("expense_type", "amount")(lambda f: sum_if(F.col("expense_type").isin(*TRAVEL_TYPES), "amount")),
    "Utilization Rate": _f("hours_worked", "time_type_clean")(lambda f: _or_zero(share_pct(sum_if(billable(), "hours_worked"), F.sum("hours_worked")))),
    "WIP Value Total": _f("is_wip", "billing_amount")(lambda f: sum_if(F.col("is_wip"), "billing_amount")),
}


def select_where(firm: Firm, df: DataFrame, name: str) -> DataFrame:
    return df.where(FILTERS[name].on(df, firm))


def measure(firm: Firm, df: DataFrame, by: Sequence[str], names: dict[str, str]) -> DataFrame:
    """``names`` maps output column to measure."""
    return df.groupBy(*by).agg(*[MEASURES[m].on(df, firm).alias(out) for out, m in names.items()])


VIEW_DIMENSIONS = ["fiscal_period", "region", "practice_area", "location", "industry", "job_level"]
UNKNOWN = "Unknown"


def metric_view(firm: Firm, by: Sequence[str]) -> DataFrame:
    """Firm measures by any of the view's dimensions.

    Time, staff and receivables are each totalled on the dimensions they have and then put
    side by side; joining the rows first would count every card once per snapshot and invoice.
    Partner counts and DSO are repeated on dimensions their own table does not carry.
    """
    by = list(by)
    unknown = set(by) - set(VIEW_DIMENSIONS)
    if unknown:
        raise ValueError(f"no dimension {', '.join(sorted(unknown))}")
    places = firm.table("dim_projects").select("project_id", *[F.col(d) for d in ("region", "practice_area", "location", "industry") if d in by])
    cards = firm.table("fact_timecards").select("employee_id", "project_id", "time_type_clean", "hours_worked", "billing_amount", F.col("fiscal_month").alias("fiscal_period"))
    if len(places.columns) > 1:
        cards = cards.join(places, ["project_id"], "left").fillna(UNKNOWN, [c for c in places.columns if c != "project_id"])
    if "job_level" in by:
        cards = cards.join(firm.table("dim_employees").where("is_latest_snapshot").select("employee_id", "job_level"), ["employee_id"], "left")
    time = cards.groupBy(*by).agg(sum_if(billable(), "billing_amount").alias("total_billable_revenue"), sum_if(billable(), "hours_worked").alias("billable_hours"), F.sum("hours_worked").alias("total_hours"))
    staff = firm.table("dim_employees").where(F.col("is_latest_snapshot") & strict_partner())
    staff_by = [d for d in by if d in staff.columns]
    heads = staff.groupBy(*staff_by).agg(F.countDistinct("employee_id").alias("strict_partner_count"))
    owed = firm.table("fact_accounts_receivable").where(rules.is_open())
    owed_by = [d for d in by if d in owed.columns]
    days = owed.groupBy(*owed_by).agg(ratio(F.sum("days_outstanding"), F.count("days_outstanding")).alias("dso"))
    out = time.join(heads, staff_by, "left") if staff_by else beside_all(time, heads)
    out = out.join(days, owed_by, "left") if owed_by else beside_all(out, days)
    return out.select(
        *by, "total_billable_revenue", "billable_hours", "total_hours", F.coalesce("strict_partner_count", F.lit(0).cast("bigint")).alias("strict_partner_count"),
        _or_zero(ratio("total_billable_revenue", "strict_partner_count")).alias("revenue_per_partner"), _or_zero(share_pct("billable_hours", "total_hours")).alias("utilization_rate"),
        "dso", _or_zero(ratio("total_billable_revenue", "billable_hours")).alias("avg_billing_rate"))


def beside_all(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.join(F.broadcast(one_row), F.lit(True), "left")


def realization(firm: Firm, by: Sequence[str]) -> DataFrame:
    """Accrual (revenue over budget), billing (billed over standard) and collection (collected over billed) rates."""
    by = list(by)
    accrual = firm.table("regional_pnl").groupBy(*by).agg(ratio(F.sum("total_revenue"), F.sum("budgeted_revenue")).alias("accrual_rate"))
    standard = (F.col("hours_worked") * F.col("billing_rate")).cast("decimal(28,6)")
    billed = firm.table("fact_timecards").where(billable()).groupBy(*by).agg(ratio(F.sum("billing_amount"), F.sum(standard)).alias("billing_rate"))
    paid = firm.table("fact_accounts_receivable").groupBy(*by).agg(ratio(sum_if(rules.is_paid(), "amount"), F.sum("amount")).alias("collection_rate"))
    return full_outer(full_outer(accrual, billed, by), paid, by)


SMALL_BASE = {"dso": 10.0, "headcount": 5.0, "expense": 10000.0}


def safe_change(cur: Column, base: Column, kind: str) -> tuple[Column, Column, Column]:
    """(absolute change, percent or null on a small base, flag for more than +-100%)."""
    pct = F.when(base >= SMALL_BASE[kind], rounded(F.try_divide(dbl(cur) - dbl(base), dbl(base)) * 100, 2))
    return cur - base, pct, F.coalesce(F.abs(pct) > 100, F.lit(False))


# Columns that hold names, free text or keys, never choices.
NOT_ENUMS = {
    "first_name", "last_name", "full_name", "email", "phone", "website",
    "billing_street", "billing_city", "billing_state", "billing_country",
    "billing_postal_code",
    "project_name", "merchant_name", "report_name", "position_title",
    "vendor_name", "client_name", "customer_name", "counterparty_name",
    "lead_partner_name", "project_manager_name", "account_manager_name",
    "task_id", "vendor_id", "client_id", "customer_id",
    "project_manager_id", "account_manager_id",
    "expense_description", "gl_account",
}
#: twice as far from the limit as a sketch of 2^SKETCH cells is ever off
SKETCH, MARGIN = 12, 1.15


def enum_columns(tables: Mapping[str, DataFrame], low: int = 2, high: int = 1024, excluded: Set[str] = frozenset(NOT_ENUMS)) -> DataFrame:
    """(table_name, column_name, distinct_values) of the text columns that hold between ``low`` and ``high`` values.

    Columns come from the schemas. One job sketches all of them in all tables; its result, one number
    for a column, says which columns cannot be choices. Only the others are counted exactly, and they
    have few values, so the counts are small whatever the number of rows.
    """
    columns = {t: [c for c in text_columns(df) if c not in excluded] for t, df in tables.items()}
    guessed = None
    for t, df in tables.items():
        if not columns[t]:
            continue
        sketches = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, SKETCH)).alias(c) for c in columns[t]])
        part = sketches.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns[t]])).alias("r")).select("r.*")
        guessed = part if guessed is None else guessed.unionByName(part)
    few = {(r.t, r.c) for r in guessed.where(F.col("n") <= high * MARGIN).collect()} if guessed is not None else set()
    out = SparkSession.active().createDataFrame([], "table_name string, column_name string, distinct_values bigint")
    for t, df in tables.items():
        maybe = [c for c in columns[t] if (t, c) in few]
        if maybe:
            out = out.unionByName(distinct_profile(df, maybe).select(F.lit(t).alias("table_name"), "column_name", "distinct_values"))
    return out.where(F.col("distinct_values").between(low, high))
