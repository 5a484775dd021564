"""Range and equality checks on the built tables.

A check is a one-row DataFrame with the column ``actual``. A missing value fails: an empty
table must not pass an upper bound.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions import rules
from tallyhouse.functions.money import dbl, ratio, share_pct, sum_if
from tallyhouse.functions.periods import month_start
from tallyhouse.operators.aggregates import median_of_groups
from tallyhouse.operators.joins import beside, orphans
from tallyhouse.operators.windows import newest_periods
from tallyhouse.plans.firm import Firm
from tallyhouse.plans.gold import billable
from tallyhouse.plans.silver import current_staff

BOUNDS_FILE = Path(__file__).with_name("bounds.json")


class Bounds:
    """Nested ``section -> name -> [low, high]`` limits with lookup by path."""

    def __init__(self, tree: Mapping):
        self.tree = tree

    @classmethod
    def load(cls, path: Path = BOUNDS_FILE) -> "Bounds":
        return cls(json.loads(Path(path).read_text()))

    def at(self, *path: str, default=(None, None)):
        node = self.tree
        for part in path:
            if not isinstance(node, Mapping) or part not in node:
                return tuple(default)
            node = node[part]
        return tuple(node)

    def rows(self, prefix: tuple[str, ...] = (), node: Mapping | None = None) -> list[tuple[str, float | None, float | None]]:
        out = []
        for name, value in (self.tree if node is None else node).items():
            if isinstance(value, Mapping):
                out += self.rows((*prefix, name), value)
            else:
                out.append((".".join((*prefix, name)), *[None if v is None else float(v) for v in value]))
        return out


@dataclass(frozen=True)
class Check:
    """``value`` gives one row; ``column`` says which of its columns is checked."""

    name: str
    value: Callable[[Firm], DataFrame]
    low: float | None = None
    high: float | None = None
    column: str = "actual"


def evaluate(firm: Firm, checks: list[Check]) -> DataFrame:
    """All checks as one table: check, actual, lo, hi, passed. Checks that share a value function share its scan."""
    groups: dict[Callable, list[Check]] = {}
    for c in checks:
        groups.setdefault(c.value, []).append(c)
    limit = lambda b: F.lit(None if b is None else float(b)).cast("double")
    out = None
    for value, members in groups.items():
        rows = F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(c.column).cast("double").alias("actual"), limit(c.low).alias("lo"), limit(c.high).alias("hi")) for c in members])
        part = value(firm).select(F.explode(rows).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    v = F.col("actual")
    ok = v.isNotNull() & F.coalesce(v >= F.col("lo"), F.lit(True)) & F.coalesce(v <= F.col("hi"), F.lit(True))
    return out.withColumn("passed", ok)


def require_all(results: DataFrame) -> None:
    """Strict mode: raise when any check failed (there are only as many rows as checks)."""
    failed = [r["check"] for r in results.where(~F.col("passed")).select("check").collect()]
    if failed:
        raise AssertionError(f"{len(failed)} checks failed: {', '.join(failed)}")


def _one(df: DataFrame, value) -> DataFrame:
    return df.agg(dbl(value).alias("actual"))


def _ar(f: Firm) -> DataFrame:
    return f.table("fact_accounts_receivable")


def _open_ar(f: Firm) -> DataFrame:
    return _ar(f).where(rules.is_open())


def _year(f: Firm, table: str, column: str) -> DataFrame:
    """Trailing 365 days; the month folders outside are not read."""
    since = f.periods.days_ago(365)
    return f.table(table).where(F.col("fiscal_month").between(F.lit(since.replace(day=1)), F.lit(f.as_of)) & f.periods.trailing_days(column, 365))


def trailing_revenue(f: Firm) -> DataFrame:
    return _one(_year(f, "fact_accounts_receivable", "invoice_date"), F.sum("amount"))


def headcount(f: Firm) -> DataFrame:
    active = current_staff(f.table("dim_employees")).where(F.col("employment_status") == "Active")
    return active.agg(F.count(F.when(F.col("job_level") == "Partner", 1)).alias("partners"), F.count(F.lit(1)).alias("everyone"))


def open_receivables(f: Firm) -> DataFrame:
    return _one(_open_ar(f), F.sum("amount"))


def concentration(rows: DataFrame, party: str, amount: str, k: int) -> DataFrame:
    """Share of the k largest parties; ordering and limit run on per-party totals."""
    per = rows.groupBy(party).agg(F.sum(amount).alias("s"))
    top = per.orderBy(F.col("s").desc()).limit(k).agg(F.sum("s").alias("top"))
    return beside(top, rows.agg(F.sum(amount).alias("all"))).select(share_pct("top", "all").alias("actual"))


def largest_invoice(f: Firm) -> DataFrame:
    return _one(_ar(f), F.max("amount"))


def orphan_count(f: Firm, table: str = "fact_accounts_receivable") -> DataFrame:
    return _one(orphans(f.table(table).select("project_id"), "project_id", f.table("dim_projects"), "project_id"), F.count(F.lit(1)))


BUCKET_LABELS = (*[label for _, label in rules.AGING_BUCKETS], rules.OLDEST_BUCKET)


def bucket_shares(f: Firm) -> DataFrame:
    label = rules.aging_bucket(F.col("days_outstanding"))
    return _open_ar(f).agg(*[share_pct(sum_if(label == b, "amount"), F.sum("amount")).alias(b) for b in BUCKET_LABELS])


def dso_swing(f: Firm) -> DataFrame:
    """Largest change between neighbouring month-ends, joined on the shifted date."""
    days = f.table("ar_snapshot_aging").groupBy("snapshot_date").agg(F.max("firmwide_dso_days").alias("d"))
    before = days.select(F.last_day(F.add_months("snapshot_date", 1)).alias("snapshot_date"), F.col("d").alias("p"))
    return days.join(before, ["snapshot_date"]).agg(F.max(F.abs(F.col("d") - F.col("p"))).alias("actual"))


def cohort_spread(f: Firm, k: int = 5) -> DataFrame:
    per = _open_ar(f).groupBy("customer_name").agg(F.sum("amount").alias("b"), F.sum(F.col("amount") * F.col("days_outstanding")).alias("bd"))
    top = per.orderBy(F.col("b").desc(), "customer_name").limit(k).agg(F.sum("b").alias("tb"), F.sum("bd").alias("td"))
    both = beside(top, per.agg(F.sum("b").alias("b"), F.sum("bd").alias("bd")))
    return both.select(F.abs(ratio("td", "tb") - ratio(F.col("bd") - F.col("td"), F.col("b") - F.col("tb"))).alias("actual"))


def vendor_count(f: Firm) -> DataFrame:
    return _one(f.table("fact_accounts_payable"), F.countDistinct("vendor_name"))


def labour_share(f: Firm) -> DataFrame:
    te = f.table("expenses_as_filed").where("is_billable").agg(F.sum("amount").alias("te"))
    labour = f.table("fact_timecards").where(billable()).agg(F.sum("cost_amount").alias("lc"))
    return beside(labour, te).select((F.try_divide(dbl("lc"), dbl("lc") + F.coalesce(dbl("te"), F.lit(0.0))) * 100).alias("actual"))


def partner_hours(f: Firm) -> DataFrame:
    lead = current_staff(f.table("dim_employees")).where(F.col("job_level").isin("Partner", "Senior Partner")).select("employee_id")
    per = f.table("fact_timecards").where(billable()).groupBy("employee_id", "fiscal_month").agg(F.sum("hours_worked").alias("h"))
    return per.join(lead, ["employee_id"], "left_semi").agg(ratio(F.sum("h"), F.count("h")).alias("actual"))


def _last_pnl(f: Firm) -> DataFrame:
    return f.table("regional_pnl").where(F.col("fiscal_period") == F.lit(f.periods.month(1)))


def cell_variance(f: Firm, actual: str, budget: str) -> DataFrame:
    rows = _last_pnl(f).where((F.col(budget) > 0) & (F.col(actual) > 0))
    return rows.agg((F.max(F.abs(ratio(F.col(actual) - F.col(budget), budget))) * 100).alias("actual"))


def office_count(f: Firm) -> DataFrame:
    return _one(current_staff(f.table("dim_employees")), F.countDistinct("location"))


def sparse_cells(f: Firm, table: str, column: str, least: int) -> DataFrame:
    cells = _year(f, table, column).groupBy("location", "fiscal_month").agg(F.count(F.lit(1)).alias("n"))
    return _one(cells, F.count(F.when(F.col("n") < least, 1)))


def volume_ratio(f: Firm) -> DataFrame:
    monthly = _year(f, "expenses_as_filed", "expense_date").groupBy("fiscal_month").agg(F.sum("amount").alias("s"))
    recent = f.periods.trailing_days("fiscal_month", 90)
    mean = lambda t: ratio(F.sum(F.when(t, F.col("s"))), F.count(F.when(t, 1)))
    return monthly.agg(F.try_divide(mean(recent), mean(F.lit(True))).alias("actual"))


def firm_expense_variance(f: Firm) -> DataFrame:
    return _last_pnl(f).agg(share_pct(F.sum("total_expenses") - F.sum("budgeted_expenses"), F.sum("budgeted_expenses")).alias("actual"))


def office_expense_variance(f: Firm) -> DataFrame:
    per = _last_pnl(f).groupBy("location").agg(F.sum("total_expenses").alias("a"), F.sum("budgeted_expenses").alias("b")).where(F.col("b") > 0)
    return per.agg((F.max(F.abs(ratio(F.col("a") - F.col("b"), "b"))) * 100).alias("actual"))


def office_spread(f: Firm, column: str) -> DataFrame:
    per = f.table("regional_pnl").where(f.periods.trailing_days("fiscal_period", 180)).groupBy("location").agg(F.sum(column).alias("s"))
    return beside(per.agg(F.max("s").alias("m")), median_of_groups(per, "s", "med")).select(F.try_divide(dbl("m"), F.col("med")).alias("actual"))


def table_parity(f: Firm) -> DataFrame:
    """One measure from two tables, as percent apart. The department table covers the excluded projects too,
    which only touches the billable category."""
    a = _last_pnl(f).agg(dbl(F.sum("corporate_expenses")).alias("a"))
    b = f.table("department_summary").where((F.col("department") == "Corporate") & (F.col("fiscal_period") == F.lit(f.periods.month(1)))).agg(
        dbl(F.sum(F.col("accrued_expenses").cast("decimal(28,2)"))).alias("b"))
    return beside(a, b).select((F.try_divide(F.abs(F.col("a") - F.col("b")), F.greatest("a", "b")) * 100).alias("actual"))


def ledger_balance(f: Firm) -> DataFrame:
    return _one(f.table("fact_general_ledger"), F.sum("net_amount"))


def cross_region_share(f: Firm) -> DataFrame:
    """Billable hours booked by people of another region than the project's."""
    staff = f.table("dim_employees").where("is_latest_snapshot").select("employee_id", F.col("region").alias("home"))
    per = f.table("fact_timecards").where(billable()).groupBy("employee_id", "region").agg(F.sum("hours_worked").alias("h"))
    return per.join(staff, ["employee_id"]).agg(share_pct(sum_if(F.col("home") != F.col("region"), "h"), F.sum("h")).alias("actual"))


def thinnest_day(f: Firm) -> DataFrame:
    daily = f.raw("events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return _one(daily, F.min("n"))
