"""Row rules: classification, aging, clamps, scores and labels as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tallyhouse.functions.money import dbl, rounded
from tallyhouse.functions.stable import slot

# Category names and the spellings that map to them.
TIME_TYPES = {
    "Billable": ("BILLABLE", "CLIENT BILLABLE", "BILL"),
    "Non-Billable": ("NON-BILLABLE", "NON BILLABLE", "INTERNAL", "ADMIN"),
    "Time Off": ("PTO", "VACATION", "SICK", "LEAVE", "HOLIDAY"),
}
ACCOUNT_CATEGORIES = {
    "Revenue": ("REVENUE", "INCOME", "SALES"),
    "COGS": ("COGS", "COST OF GOODS SOLD", "COST OF SALES", "COST OF REVENUE", "DIRECT COST"),
    "Operating Expense": ("EXPENSE", "OPERATING EXPENSE", "OPEX", "SGA"),
    "Other Income": ("OTHER INCOME", "INTEREST INCOME", "NON-OPERATING INCOME"),
    "Tax": ("TAX", "INCOME TAX", "TAX EXPENSE"),
    "Asset": ("ASSET", "CURRENT ASSET", "FIXED ASSET", "NON-CURRENT ASSET"),
    "Liability": ("LIABILITY", "CURRENT LIABILITY", "NON-CURRENT LIABILITY", "LONG-TERM LIABILITY"),
    "Equity": ("EQUITY", "STOCKHOLDERS EQUITY", "RETAINED EARNINGS"),
}
DEPARTMENT_GROUPS = {
    "Corporate": ("FINANCE", "HR", "LEGAL", "EXECUTIVE"),
    "Marketing": ("MARKETING", "SALES"),
    "Technology": ("IT", "R&D", "TECHNOLOGY", "ENGINEERING"),
}
VENDOR_CLASSES = {
    "Contractors": ("Deloitte", "EY", "PwC", "KPMG"),
    "Marketing & Brand Management": ("Gartner", "Forrester", "IDC"),
    "Professional & Legal Services": ("Oracle", "SAP"),
    "Real Estate & Facilities": ("WeWork", "Regus", "JLL", "CBRE", "Iron Mountain"),
}
DEFAULT_VENDOR_CLASS = "IT & Technology"
AGING_BUCKETS = ((30, "0-30 days"), (60, "31-60 days"), (90, "61-90 days"))
OLDEST_BUCKET = "90+ days"
SETTLED = ("PAID", "CLOSED")
ACTIVE_STATUSES = ("Active", "In Progress", "Open")
COLLECTION_POINTS = {"Client Invoice": 15, "Contractor": 10, "Non-FTE Vendor": 5}


def upper_or_blank(c: Column | str) -> Column:
    return F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def classify(value: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """First group whose members hold ``value``."""
    out = None
    for name, members in groups.items():
        hit = value.isin(*members)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def is_billable_type(c: str = "time_type") -> Column:
    return F.upper(F.col(c)).isin(*TIME_TYPES["Billable"])


def clean_time_type(c: str = "time_type") -> Column:
    return classify(F.upper(F.col(c)), TIME_TYPES, "Other")


def account_category(c: str = "account_type") -> Column:
    return classify(F.upper(F.col(c)), ACCOUNT_CATEGORIES, "Other")


def expense_category(billable: str = "is_billable", department: str = "department_category") -> Column:
    return F.when(F.col(billable), F.lit("Billable")).otherwise(
        classify(upper_or_blank(department), DEPARTMENT_GROUPS, "Other"))


def vendor_class(c: str = "vendor_name") -> Column:
    return classify(F.col(c), VENDOR_CLASSES, DEFAULT_VENDOR_CLASS)


def aging_bucket(days: Column) -> Column:
    out = None
    for limit, label in AGING_BUCKETS:
        out = F.when(days <= limit, label) if out is None else out.when(days <= limit, label)
    return out.otherwise(F.lit(OLDEST_BUCKET))


def is_open(status: str = "payment_status") -> Column:
    """Anything not settled, including a missing status."""
    return ~upper_or_blank(status).isin(*SETTLED)


def is_paid(status: str = "payment_status") -> Column:
    return upper_or_blank(status) == "PAID"


def receivable_age(as_of: Column, issued: str = "invoice_date", paid_on: str = "payment_date",
                   status: str = "payment_status", default_days: int = 45) -> Column:
    """Raw days from issue to payment, or to the as-of date while the invoice is open."""
    settled_on = F.coalesce(F.col(paid_on), F.date_add(F.col(issued), default_days))
    return F.when(is_paid(status), F.datediff(settled_on, F.col(issued))).otherwise(
        F.datediff(as_of, F.col(issued)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def payable_age(hashed_id: str, due: str = "due_date", paid_on: str = "payment_date", status: str = "payment_status") -> Column:
    """Days past due when paid; otherwise a status-typical age spread by the invoice's stable hash."""
    state, spread = upper_or_blank(status), slot(hashed_id, 100)
    late = F.greatest(F.datediff(F.coalesce(F.col(paid_on), F.col(due)), F.col(due)), F.lit(0))
    still_open = (F.when(spread < 70, slot(hashed_id, 31))
                  .when(spread < 95, F.lit(31) + slot(hashed_id, 30))
                  .otherwise(F.lit(61) + slot(hashed_id, 30)))
    return (F.when(state == "PAID", late)
            .when(state == "OVERDUE", F.lit(60) + slot(hashed_id, 35))
            .when(state == "PARTIALLY PAID", F.lit(35) + slot(hashed_id, 25))
            .otherwise(still_open))


def employment_status(snapshot: Column, hired: str = "hire_date", left: str = "termination_date") -> Column:
    return (F.when(F.col(left) <= snapshot, "Terminated")
            .when(F.col(hired) > snapshot, "Pre-Hire")
            .otherwise("Active"))


def in_force(snapshot: Column, hired: str = "hire_date", left: str = "termination_date") -> Column:
    return (F.col(left).isNull() | (F.col(left) > snapshot)) & (F.col(hired) <= snapshot)


def is_active_status(c: str = "project_status") -> Column:
    return F.coalesce(F.col(c).isin(*ACTIVE_STATUSES), F.lit(False))


def is_wip(time_type: str = "time_type_clean", approval: str = "approval_status") -> Column:
    return F.coalesce((F.col(time_type) == "Billable")
                      & upper_or_blank(approval).isin("APPROVED", "SUBMITTED"), F.lit(False))


def receipt_text(c: str = "has_receipt") -> Column:
    return F.when(F.col(c), "Received").otherwise("Missing")


def risk_level(used: Column, contract: Column) -> Column:
    share = F.when(contract > 0, dbl(used) / dbl(contract))
    return F.when(share > 0.9, "High").when(share > 0.75, "Medium").otherwise("Low")


def collection_score(days: Column, amount: Column, category: Column) -> Column:
    """Age, size and kind of a receivable in one number."""
    age = dbl(F.coalesce(days, F.lit(0))) / F.lit(30.0) * F.lit(40.0)
    size = F.log10(F.greatest(dbl(amount), F.lit(1.0))) * F.lit(20.0)
    return rounded(age + size + factor(category, COLLECTION_POINTS, 0.0), 2)


def payment_score(days: Column, amount: Column) -> Column:
    age = dbl(clamp(F.coalesce(days, F.lit(0)), 0, 180)) / F.lit(3.0)
    return rounded(age + F.log10(F.greatest(dbl(amount), F.lit(1.0))) * F.lit(8.0), 2)


def ladder(value: Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first threshold (highest first) that ``value`` exceeds."""
    out = None
    for limit, label in steps:
        out = F.when(value > limit, label) if out is None else out.when(value > limit, label)
    return out.otherwise(F.lit(default))


def collection_action(score: Column) -> Column:
    return ladder(score, ((120, "URGENT: Invoice immediately"), (100, "HIGH: Follow up required")),
                  "MEDIUM: Monitor closely")


def expense_action(pct: Column) -> Column:
    return ladder(pct, ((10, "URGENT: Review expenses immediately"), (8, "HIGH: Expense review required")),
                  "MEDIUM: Monitor expenses")


def capped_age(days: Column, score: Column) -> Column:
    """Outlier ages moved into a credible band by a value that depends only on the score."""
    whole = score.cast("int")
    return F.when(days > 90, F.lit(45) + whole % 45).when(days < 30, F.lit(30) + whole % 20).otherwise(days)


def factor(key: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    """Look a multiplier up in a small policy table; a missing key gives the default."""
    if not table:
        return F.lit(float(default))
    entries = [F.lit(x) for pair in table.items() for x in (pair[0], float(pair[1]))]
    return F.coalesce(F.create_map(*entries)[key], F.lit(float(default)))


def exact_factor(key: Column, table: Mapping[str, str], default: str = "1.0000") -> Column:
    """The same with decimal values, for use on money and hours."""
    if not table:
        return F.lit(default).cast("decimal(6,4)")
    entries = [e for k, v in table.items() for e in (F.lit(k), F.lit(v).cast("decimal(6,4)"))]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default).cast("decimal(6,4)"))
