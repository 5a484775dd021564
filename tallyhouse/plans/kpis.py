"""KPI reports over the stored tables.

Every report takes a firm and an optional five-axis filter. Current and comparison periods
are conditional sums of one scan that reads only the partitions of the months it needs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import rules
from tallyhouse.functions.money import WIDE_MONEY, dbl, ratio, rounded, share_pct, sum_if
from tallyhouse.functions.periods import month_start
from tallyhouse.operators.filters import DIMS, active_filters, axis_filter, snapshot_filter
from tallyhouse.operators.joins import beside, with_totals
from tallyhouse.operators.windows import top_per_group
from tallyhouse.plans.firm import Firm
from tallyhouse.plans.gold import billable, total_of_categories

Filters = Mapping[str, object] | None

# Targets the tiles compare with.
DSO_TARGET_DAYS, DPO_TARGET_DAYS, UTILIZATION_TARGET_PCT = 60, 45, 85
PARTNER_BUDGET, PARTNER_REVENUE_TARGET = 5000, 3_000_000
LOW_UTILIZATION = 0.50
MARGIN_BAND = (10, 50)
DAYS_IN_PERIOD = 30.0


def months(df: DataFrame, firm: Firm, backs: list[int], column: str = "fiscal_period") -> DataFrame:
    """Only the wanted months; on a partitioned table this prunes folders."""
    return df.where(F.col(column).isin(*[F.lit(firm.periods.month(b)) for b in backs]))


def in_month(firm: Firm, back: int, value: Column | str, column: str = "fiscal_period") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(F.col(column) == F.lit(firm.periods.month(back)), v))


def scaled(value: Column | str, divisor: float, digits: int) -> Column:
    return rounded(dbl(value) / F.lit(divisor), digits)


def change_pct(cur: Column | str, base: Column | str) -> Column:
    c, b = dbl(cur), dbl(base)
    return F.try_divide(c - b, b) * F.lit(100.0)


def partners(df: DataFrame) -> DataFrame:
    """Strict partners: the level itself, active."""
    return df.where((F.col("job_level") == "Partner") & (F.col("employment_status") == "Active"))


def snapshot_dates(firm: Firm) -> DataFrame:
    """Newest snapshot, the newest at least a year older, and the newest at least 30 days older (one row)."""
    days = firm.table("dim_employees").select("snapshot_date").distinct()
    newest = days.agg(F.max("snapshot_date").alias("newest"))
    seen = with_totals(days, newest)
    d = F.col("snapshot_date")
    return seen.agg(
        F.max("newest").alias("newest"), F.max(F.when(d <= F.add_months("newest", -12), d)).alias("year_ago"),
        F.max(F.when(d <= F.date_sub("newest", 30), d)).alias("month_ago"))


def partner_counts(firm: Firm, filters: Filters, by: list[str] | None = None) -> DataFrame:
    """Distinct strict partners at the newest, year-ago and month-ago snapshots, in one pass."""
    staff = with_totals(axis_filter(partners(firm.table("dim_employees")), filters), snapshot_dates(firm))
    at = lambda c: F.countDistinct(F.when(F.col("snapshot_date") == F.col(c), F.col("employee_id")))
    wanted = staff.where(F.col("snapshot_date").isin(F.col("newest"), F.col("year_ago"), F.col("month_ago")))
    return wanted.groupBy(*(by or [])).agg(at("newest").alias("cur_n"), at("year_ago").alias("yoy_n"), at("month_ago").alias("prior_n"))


def dso_ratio(firm: Firm, filters: Filters = None) -> DataFrame:
    m = months(axis_filter(firm.table("enterprise_metrics"), filters), firm, [1, 2]).agg(
        *[in_month(firm, b, c).alias(f"{c}_{b}") for b in (1, 2) for c in ("accounts_receivable", "revenue")])
    cur, prev = (ratio(f"accounts_receivable_{b}", f"revenue_{b}") * DAYS_IN_PERIOD for b in (1, 2))
    return m.select(
        rounded(cur, 1).alias("dso_days"), rounded(cur / DSO_TARGET_DAYS * 100, 0).alias("percent_of_target"),
        F.lit(DSO_TARGET_DAYS).alias("target_dso"), rounded(prev - cur, 1).alias("qoq_improvement_days"),
        rounded(F.try_divide(prev - cur, prev) * 100, 2).alias("qoq_improvement_pct"))


def dpo_ratio(firm: Firm, filters: Filters = None) -> DataFrame:
    owed = axis_filter(firm.table("fact_accounts_payable"), filters).where(rules.is_open() & (F.col("amount") > 0)).agg(F.sum("amount").alias("owed"))
    cost = F.col("delivery_cost") + F.col("operating_expenses")
    spent = months(axis_filter(firm.table("enterprise_metrics"), filters), firm, [1, 2]).agg(
        in_month(firm, 1, cost).alias("c1"), in_month(firm, 2, cost).alias("c2"))
    cur, prev = (ratio("owed", c) * DAYS_IN_PERIOD for c in ("c1", "c2"))
    return beside(owed, spent).select(
        rounded(cur, 1).alias("dpo_days"), rounded(cur / DPO_TARGET_DAYS * 100, 0).alias("percent_of_target"),
        F.lit(DPO_TARGET_DAYS).alias("target_dpo"), rounded(prev, 1).alias("prior_quarter_dpo"),
        rounded(F.try_divide(cur - prev, prev) * 100, 2).alias("qoq_change_pct"))


def _largest_open(df: DataFrame, filters: Filters, n: int) -> DataFrame:
    return axis_filter(df, filters).where(rules.is_open() & (F.col("amount") > 0)).orderBy(F.col("amount").desc(), "invoice_id").limit(n)


def _older_balance(df: DataFrame, party: str, top: DataFrame, firm: Firm) -> DataFrame:
    """Open balance older than 90 days of the party that owns the top invoice."""
    old = df.where(rules.is_open() & (F.col("amount") > 0) & (F.col("invoice_date") < F.lit(firm.periods.days_ago(90))))
    return old.join(F.broadcast(top.select(party)), [party], "left_semi").agg(scaled(F.sum("amount"), 1000, 0).alias("prior_k"))


def _vs_prior(cur: str, prior: str) -> Column:
    base = F.coalesce(F.col(prior), F.col(cur))
    return rounded(F.try_divide(F.col(cur) - base, base) * 100, 0)


def top_client_invoice(firm: Firm, filters: Filters = None) -> DataFrame:
    ar = firm.table("fact_accounts_receivable")
    top = _largest_open(ar, filters, 1)
    cur = top.select(F.col("customer_name").alias("top_client"), scaled("amount", 1000, 0).alias("top_amount_k"),
                     F.coalesce("days_outstanding", F.lit(0)).alias("top_days_overdue"), F.coalesce("lead_partner_name", F.lit("Account Team")).alias("top_account_mgr"))
    return beside(cur, _older_balance(ar, "customer_name", top, firm)).withColumn(
        "qoq_change_pct", _vs_prior("top_amount_k", "prior_k")).drop("prior_k")


def top_vendor_invoice(firm: Firm, filters: Filters = None) -> DataFrame:
    ap = firm.table("fact_accounts_payable")
    two = _largest_open(ap, filters, 2)
    # two rows at most, so a window without partitions is safe here
    ranked = two.select("vendor_name", scaled("amount", 1000, 0).alias("k"), "days_outstanding", "department",
                        F.expr("row_number() over (order by amount desc, invoice_id)").alias("rk"))
    at = lambda c, rk: F.max(F.when(F.col("rk") == rk, F.col(c)))
    cur = ranked.agg(at("vendor_name", 1).alias("top_vendor"), at("k", 1).alias("top_amount_k"), at("days_outstanding", 1).alias("top_days_overdue"),
                     at("department", 1).alias("top_contact"), F.coalesce(at("vendor_name", 2), F.lit("N/A")).alias("second_vendor"))
    first = two.limit(1)
    return beside(cur.where(F.col("top_vendor").isNotNull()), _older_balance(ap, "vendor_name", first, firm)).withColumn(
        "qoq_improvement_pct", _vs_prior("top_amount_k", "prior_k")).drop("prior_k")


def _pnl(firm: Firm, filters: Filters, backs: list[int]) -> DataFrame:
    return months(axis_filter(firm.table("regional_pnl"), filters), firm, backs)


def revenue_vs_budget(firm: Firm, filters: Filters = None) -> DataFrame:
    m = _pnl(firm, filters, [1, 2]).agg(in_month(firm, 1, "total_revenue").alias("rev"), in_month(firm, 1, "budgeted_revenue").alias("budget"),
                                        in_month(firm, 2, "total_revenue").alias("prior"))
    work = axis_filter(firm.table("project_profitability"), filters).where((F.col("project_status") == "Active") & (F.col("planned_revenue") > 0))
    left = work.agg(F.greatest(F.sum("planned_revenue") - F.sum("actual_revenue"), F.lit(0)).alias("left"))
    return beside(m, left).select(
        rounded(dbl("rev") * 12 / 1e6, 0).alias("revenue_millions"), rounded(dbl("budget") * 12 / 1e6, 0).alias("target_revenue_millions"),
        rounded(share_pct("rev", "budget"), 1).alias("percent_of_forecast"), scaled("left", 1e6, 0).alias("pipeline_millions"),
        rounded(change_pct("rev", "prior"), 1).alias("wow_change_pct"))


def _margin_windows(firm: Firm, filters: Filters, margin: Column, band: bool, by: list[str] | None = None) -> DataFrame:
    """Margin over revenue of projects that ended in the last 90 days and in the 90 days before."""
    p = firm.periods
    df = axis_filter(firm.table("project_profitability"), filters).where(F.col("project_end_date") >= F.lit(p.days_ago(180)))
    if band:
        df = df.where(F.col("actual_margin_pct").between(*MARGIN_BAND))
    now, before = p.since_days("project_end_date", 90), p.prior_days("project_end_date", 90, 180)
    part = lambda test, c: F.sum(F.when(test, c))
    rev = F.col("actual_revenue")
    return df.groupBy(*(by or [])).agg(part(now, margin).alias("m1"), part(now, rev).alias("r1"), part(before, margin).alias("m0"), part(before, rev).alias("r0"))


def project_margins(firm: Firm, filters: Filters = None) -> DataFrame:
    m = _margin_windows(firm, filters, F.col("actual_revenue") - F.col("actual_cost"), band=True)
    cur, prev = rounded(share_pct("m1", "r1"), 2), rounded(share_pct("m0", "r0"), 2)
    zero = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 1)
    m = m.select(cur.alias("cur"), prev.alias("prev"))
    cur, prev = F.col("cur"), F.col("prev")
    return m.select(
        zero(cur).alias("current_margin_pct"), zero(prev).alias("prior_margin_pct"), zero(cur - prev).alias("qoq_change_pp"),
        F.when(F.coalesce(prev, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(rounded(F.try_divide(cur - prev, prev) * 100, 2)).alias("qoq_change_pct"))


def months_above_partner_target(firm: Firm, filters: Filters = None) -> DataFrame:
    """Of the last six months, those whose annualised revenue per partner beats the target."""
    p = firm.periods
    span = axis_filter(firm.table("enterprise_metrics"), filters).where(p.between_months("fiscal_period", 6, 0))
    rev = span.groupBy(F.col("fiscal_period").alias("month")).agg(F.sum("revenue").alias("rev"))
    staff = axis_filter(partners(firm.table("dim_employees")), filters).where(F.col("snapshot_date") >= F.lit(p.month(6)))
    heads = staff.groupBy(month_start("snapshot_date").alias("month")).agg(F.countDistinct("employee_id").alias("n"))
    return rev.join(heads, ["month"]).where(ratio(F.col("rev") * 12, "n") > PARTNER_REVENUE_TARGET).agg(F.count(F.lit(1)).alias("months_above_target"))


def _partner_economics(firm: Firm, filters: Filters) -> DataFrame:
    rev = months(axis_filter(firm.table("enterprise_metrics"), filters), firm, [1, 13]).agg(
        (in_month(firm, 1, "revenue") * 12).alias("cur_rev"), (in_month(firm, 13, "revenue") * 12).alias("yoy_rev"))
    return beside(rev, partner_counts(firm, filters)).withColumn("cur", ratio("cur_rev", "cur_n")).withColumn("yoy", ratio("yoy_rev", "yoy_n"))


def revenue_per_partner(firm: Firm, filters: Filters = None) -> DataFrame:
    share = F.try_divide(F.col("cur"), F.col("yoy")) * 100
    return beside(_partner_economics(firm, filters), months_above_partner_target(firm, filters)).select(
        rounded(F.col("cur") / 1e6, 2).alias("revenue_per_partner_millions"), rounded(F.col("yoy") / 1e6, 2).alias("forecast_millions"),
        rounded(share, 0).alias("percent_of_forecast"), F.coalesce("months_above_target", F.lit(0).cast("bigint")).alias("months_above_target"),
        rounded(share - 100, 1).alias("yoy_growth_pct"))


def _expenses(firm: Firm, filters: Filters) -> DataFrame:
    spent = total_of_categories()
    return _pnl(firm, filters, [1, 2]).agg(in_month(firm, 1, spent).alias("exp"), in_month(firm, 1, "budgeted_expenses").alias("budget"),
                                           in_month(firm, 2, spent).alias("prior"))


def expenses_vs_budget(firm: Firm, filters: Filters = None) -> DataFrame:
    return _expenses(firm, filters).where(F.col("exp").isNotNull()).select(
        rounded(dbl("exp") * 12 / 1e6, 0).alias("expense_millions"), rounded(dbl("budget") * 12 / 1e6, 0).alias("forecast_millions"),
        rounded(share_pct("exp", "budget"), 1).alias("percent_of_forecast"), rounded(change_pct("exp", "prior"), 1).alias("variance_pct"))


STAFF_AXES = ("region", "location", "practice_area")


def _cards(firm: Firm, filters: Filters, backs: list[int], axes=tuple(DIMS)) -> DataFrame:
    return months(axis_filter(firm.table("fact_timecards"), filters, allowed=axes), firm, backs, "fiscal_month")


def utilization(firm: Firm, filters: Filters = None) -> DataFrame:
    bill = F.when(billable(), F.col("hours_worked")).otherwise(F.lit(0))
    t = _cards(firm, filters, [1, 2], STAFF_AXES).agg(*[
        in_month(firm, b, c, "fiscal_month").alias(f"{n}{b}") for b in (1, 2) for n, c in (("b", bill), ("h", "hours_worked"))])
    t = t.select(*[rounded(share_pct(f"b{b}", f"h{b}"), 1).alias(f"u{b}") for b in (1, 2)])
    return t.select(F.col("u1").alias("current_utilization_pct"), rounded(F.col("u1") - F.col("u2"), 1).alias("mom_change_pp"),
                    rounded(F.col("u1") / UTILIZATION_TARGET_PCT * 100, 0).alias("percent_of_forecast"), F.lit(UTILIZATION_TARGET_PCT).alias("forecast_utilization"))


def partner_headcount(firm: Firm, filters: Filters = None) -> DataFrame:
    """Partners of the last complete month against a budget: fixed for the firm, 5% above actual for a slice."""
    staff = axis_filter(partners(firm.table("dim_employees")), filters, allowed=STAFF_AXES)
    n = staff.where(firm.periods.in_month("snapshot_date", 1)).agg(F.countDistinct("employee_id").alias("current_partners"))
    heads = F.col("current_partners")
    budget = F.greatest(rounded(dbl(heads) * 1.05, 0).cast("bigint"), heads + 5) if active_filters(filters, STAFF_AXES) else F.lit(PARTNER_BUDGET).cast("bigint")
    return n.withColumn("budget_partners", budget).select(
        heads, "budget_partners", (F.col("budget_partners") - heads).alias("variance_count"), rounded(share_pct(heads, "budget_partners"), 1).alias("percent_of_budget"))


def bench() -> Column:
    return F.col("time_type_clean") == "Non-Billable"


def bench_cost_of_row() -> Column:
    """Hours times rate: the stored cost of a non-billable card is zero by design."""
    return F.when(bench(), F.col("hours_worked") * F.col("cost_rate")).otherwise(F.lit(0))


def bench_cost(firm: Firm, filters: Filters = None) -> DataFrame:
    idle = F.when(bench(), F.col("hours_worked")).otherwise(F.lit(0))
    t = _cards(firm, filters, [1, 2], STAFF_AXES).agg(
        in_month(firm, 1, bench_cost_of_row(), "fiscal_month").alias("c1"), in_month(firm, 2, bench_cost_of_row(), "fiscal_month").alias("c2"),
        in_month(firm, 1, idle, "fiscal_month").alias("i1"), in_month(firm, 1, "hours_worked", "fiscal_month").alias("h1"))
    return t.select(scaled("c1", 1e6, 2).alias("bench_cost_mm"), scaled("c2", 1e6, 2).alias("prior_bench_cost_mm"), rounded(change_pct("c1", "c2"), 1).alias("mom_change_pct"),
                    scaled("i1", 1e3, 1).alias("bench_hours_k"), rounded(share_pct("i1", "h1"), 1).alias("bench_pct_of_total"))


def person_hours(cards: DataFrame, *by: str) -> DataFrame:
    return cards.groupBy("employee_id", *by).agg(sum_if(billable(), "hours_worked").alias("bill"), F.sum("hours_worked").alias("hours"))


def low_utilized(hours: DataFrame) -> DataFrame:
    return hours.where((F.col("hours") > 0) & (ratio("bill", "hours") < LOW_UTILIZATION))


def low_utilized_partners(firm: Firm, filters: Filters = None) -> DataFrame:
    """Strict partners of each month whose hours that month are under half billable."""
    hours = low_utilized(person_hours(_cards(firm, None, [1, 2], ()), "fiscal_month"))
    staff = axis_filter(partners(firm.table("dim_employees")), filters, allowed=STAFF_AXES).where(firm.periods.between_months("snapshot_date", 2, 0))
    both = hours.join(staff.select("employee_id", month_start("snapshot_date").alias("fiscal_month")).distinct(), ["employee_id", "fiscal_month"], "left_semi")
    one = lambda b: F.count(F.when(F.col("fiscal_month") == F.lit(firm.periods.month(b)), 1))
    n = both.agg(one(1).alias("bench_consultants"), one(2).alias("prior_month_bench"))
    return n.withColumn("mom_change_pct", rounded(change_pct("bench_consultants", "prior_month_bench"), 0))


# Persona reports ------------------------------------------------------------------

def exec_revenue(firm: Firm, filters: Filters = None) -> DataFrame:
    m = _pnl(firm, filters, [1, 2]).agg(in_month(firm, 1, "total_revenue").alias("rev"), in_month(firm, 1, "budgeted_revenue").alias("budget"),
                                        in_month(firm, 2, "total_revenue").alias("prior"))
    work = months(axis_filter(firm.table("enterprise_metrics"), filters), firm, [1]).agg(F.sum("pipeline_revenue").alias("pipe"))
    return beside(m, work).select(
        (dbl("rev") * 12 / 1e9).alias("rev_b"), (dbl("budget") * 12 / 1e9).alias("budget_b"), change_pct("rev", "budget").alias("pct_over"),
        change_pct("rev", "prior").alias("mom_pct"), (dbl("pipe") / 1e9).alias("pipeline_b"))


def exec_margin(firm: Firm, filters: Filters = None) -> DataFrame:
    m = _margin_windows(firm, filters, F.col("actual_margin"), band=False)
    cur, prev = ratio("m1", "r1"), ratio("m0", "r0")
    return m.select((cur * 100).alias("cur_pct"), (prev * 100).alias("prior_pct"), ((cur - prev) * 100).alias("qoq_pp"))


def exec_revenue_per_partner(firm: Firm, filters: Filters = None) -> DataFrame:
    return _partner_economics(firm, filters).select(
        (F.col("cur") / 1e6).alias("cur_m"), (F.col("yoy") / 1e6).alias("yoy_m"), change_pct("cur", "yoy").alias("yoy_pct"),
        F.col("cur_n").alias("cur_partners"), F.col("yoy_n").alias("yoy_partners"))


def exec_expenses(firm: Firm, filters: Filters = None) -> DataFrame:
    return _expenses(firm, filters).select((dbl("exp") / 1e6).alias("exp_m"), (dbl("budget") / 1e6).alias("budget_m"),
                                           change_pct("exp", "budget").alias("pct_over"), change_pct("exp", "prior").alias("mom_pct"))


def _office_gap(firm: Firm, filters: Filters, actual: Column, budget: str) -> DataFrame:
    g = _pnl(firm, filters, [1]).groupBy("location").agg(F.sum(actual).alias("a"), F.sum(budget).alias("b"))
    return g.select("location", scaled(F.col("a") - F.col("b"), 1e6, 2).alias("gap_m"), rounded((ratio("a", "b") - 1) * 100, 2).alias("gap_pct"))


def offices_by_revenue_gap(firm: Firm, filters: Filters = None, best: bool = True, k: int = 5) -> DataFrame:
    g = _office_gap(firm, filters, F.col("total_revenue"), "budgeted_revenue")
    first = F.col("gap_m").desc_nulls_last() if best else F.col("gap_m").asc_nulls_last()
    return g.orderBy(first, "location").limit(k)


def offices_by_expense_overage(firm: Firm, filters: Filters = None, k: int = 5) -> DataFrame:
    g = _office_gap(firm, filters, total_of_categories(), "budgeted_expenses")
    return g.orderBy(F.col("gap_pct").desc_nulls_last(), "location").limit(k)


def practice_margins(firm: Firm, filters: Filters = None) -> DataFrame:
    df = axis_filter(firm.table("project_profitability"), filters).where(firm.periods.since_days("project_end_date", 90))
    g = df.groupBy("practice_area").agg(F.sum("actual_margin").alias("m"), F.sum("actual_revenue").alias("r"))
    return g.select("practice_area", rounded(share_pct("m", "r"), 2).alias("margin_pct")).orderBy(F.col("margin_pct").desc_nulls_last(), "practice_area")


def dso_from_snapshots(firm: Firm, filters: Filters = None) -> DataFrame:
    """Both values measured the same way, from month-end snapshots before the as-of month."""
    s = snapshot_filter(firm.table("ar_snapshot_aging"), filters).where(F.col("snapshot_date") < F.lit(firm.periods.month(0)))
    per = s.groupBy("snapshot_date").agg(rounded(ratio(F.sum(F.col("open_ar_balance") * F.col("weighted_dso_days").cast("decimal(10,1)")), F.sum("open_ar_balance")), 1).alias("dso"))
    newest = per.orderBy(F.col("snapshot_date").desc()).limit(2)
    return newest.agg(F.max_by("dso", "snapshot_date").alias("current_dso"), F.when(F.count(F.lit(1)) == 2, F.min_by("dso", "snapshot_date")).alias("prior_dso")).select(
        "current_dso", F.coalesce("prior_dso", "current_dso").alias("prior_dso"))


def dpo_days(firm: Firm, filters: Filters = None) -> DataFrame:
    days = F.when(rules.is_open(), F.col("days_outstanding"))
    mean = lambda c: rounded(F.try_divide(dbl(F.sum(c)), dbl(F.count(c))), 1)
    return axis_filter(firm.table("fact_accounts_payable"), filters).agg(mean(days).alias("dpo"), mean(F.when(days > 30, days - 30)).alias("prior_dpo"))


def _unpaid(df: DataFrame, party: str, amount: str, k: int, name: str = "total_m") -> DataFrame:
    g = df.groupBy(party).agg(F.sum(amount).alias("s"), F.count(F.lit(1)).alias("n_invoices"), F.sum("days_outstanding").alias("d"))
    return (g.select(party, scaled("s", 1e6, 2).alias(name), "n_invoices", rounded(ratio("d", "n_invoices"), 1).alias("avg_days"), "s")
            .orderBy(F.col("s").desc(), party).limit(k).drop("s"))


def top_unpaid_clients(firm: Firm, filters: Filters = None, k: int = 5) -> DataFrame:
    return _unpaid(axis_filter(firm.table("fact_accounts_receivable"), filters).where(rules.is_open()), "customer_name", "amount", k)


def top_unpaid_vendors(firm: Firm, filters: Filters = None, k: int = 5) -> DataFrame:
    return _unpaid(axis_filter(firm.table("payables_aging"), filters), "vendor_name", "amount_due", k)


def dso_by_office(firm: Firm, filters: Filters = None, k: int = 5) -> DataFrame:
    df = axis_filter(firm.table("fact_accounts_receivable"), filters).where(F.col("location").isNotNull())
    days = F.when(rules.is_open(), F.col("days_outstanding"))
    g = df.groupBy("location").agg(rounded(F.try_divide(dbl(F.sum(days)), dbl(F.count(days))), 1).alias("dso"),
                                   scaled(F.sum(F.when(rules.is_open(), F.col("amount"))), 1e6, 2).alias("open_ar_m"))
    return g.orderBy(F.col("dso").desc_nulls_last(), "location").limit(k)


def utilization_mom(firm: Firm, filters: Filters = None) -> DataFrame:
    m = months(axis_filter(firm.table("enterprise_metrics"), filters), firm, [1, 2]).agg(*[
        in_month(firm, b, c).alias(f"{c}{b}") for b in (1, 2) for c in ("billable_hours", "total_hours")])
    cur, prev = (share_pct(f"billable_hours{b}", f"total_hours{b}") for b in (1, 2))
    return m.select(cur.alias("cur_pct"), prev.alias("prior_pct"), (cur - prev).alias("mom_pp"))


def partner_change(firm: Firm, filters: Filters = None) -> DataFrame:
    return partner_counts(firm, filters).select(F.col("cur_n").alias("cur"), F.col("prior_n").alias("prior"), (F.col("cur_n") - F.col("prior_n")).alias("mom_delta"))


def bench_cost_mom(firm: Firm, filters: Filters = None) -> DataFrame:
    t = _cards(firm, filters, [1, 2]).agg(*[in_month(firm, b, bench_cost_of_row(), "fiscal_month").alias(f"c{b}") for b in (1, 2)])
    return t.select((dbl("c1") / 1e6).alias("cur_m"), (dbl("c2") / 1e6).alias("prior_m"), change_pct("c1", "c2").alias("mom_pct"))


def low_utilization(firm: Firm, filters: Filters = None) -> DataFrame:
    low = low_utilized(person_hours(_cards(firm, filters, [1, 2]), "fiscal_month"))
    one = lambda b: F.count(F.when(F.col("fiscal_month") == F.lit(firm.periods.month(b)), 1))
    return low.agg(one(1).alias("cur"), one(2).alias("prior")).withColumn("delta", F.col("cur") - F.col("prior"))


def bench_by_practice(firm: Firm, filters: Filters = None, k: int = 6) -> DataFrame:
    t = _cards(firm, filters, [1]).where(F.col("practice_area").isNotNull()).groupBy("practice_area").agg(F.sum(bench_cost_of_row()).alias("c"))
    return t.select("practice_area", scaled("c", 1e6, 2).alias("bench_m"), "c").orderBy(F.col("c").desc(), "practice_area").limit(k).drop("c")


def latest_staff(firm: Firm) -> DataFrame:
    return firm.table("dim_employees").where(F.col("is_latest_snapshot"))


def bench_by_level(firm: Firm, filters: Filters = None) -> DataFrame:
    """Cost per person first, then the level of each person: the join moves one row per person."""
    per = _cards(firm, filters, [1]).groupBy("employee_id").agg(F.sum(bench_cost_of_row()).alias("c"))
    g = per.join(latest_staff(firm).select("employee_id", "job_level"), ["employee_id"]).groupBy("job_level").agg(F.sum("c").alias("c"), F.count("employee_id").alias("emps"))
    return g.select("job_level", scaled("c", 1e6, 2).alias("bench_m"), "emps", "c").orderBy(F.col("c").desc(), "job_level").drop("c")


def low_utilization_by(firm: Firm, by: str, filters: Filters = None, k: int = 8) -> DataFrame:
    """Who is under-used is decided per person; only then is the person put into a group."""
    low = low_utilized(person_hours(_cards(firm, filters, [1])))
    staff = axis_filter(latest_staff(firm), filters).where(F.col(by).isNotNull())
    g = staff.join(low, ["employee_id"], "left_semi").groupBy(by).agg(F.countDistinct("employee_id").alias("low_util_n"))
    return g.orderBy(F.col("low_util_n").desc(), by).limit(k)


def partner_change_by_practice(firm: Firm, filters: Filters = None, k: int = 6) -> DataFrame:
    g = partner_counts(firm, filters, ["practice_area"]).where(F.col("practice_area").isNotNull() & (F.col("cur_n") > 0))
    prior = F.when(F.col("prior_n") > 0, F.col("prior_n"))
    return g.select("practice_area", F.col("cur_n").alias("cur"), prior.alias("prior"), (F.col("cur_n") - prior).alias("delta")).orderBy(
        F.col("delta").asc_nulls_first(), "practice_area").limit(k)


def filter_options(firm: Firm, filters: Filters = None) -> DataFrame:
    """Values each axis can still take under the current filters."""
    df = axis_filter(firm.table("enterprise_metrics"), filters).select(*DIMS).distinct()
    pairs = ", ".join(f"'{d}', {d}" for d in DIMS)
    return df.selectExpr(f"stack({len(DIMS)}, {pairs}) as (axis, value)").where(F.col("value").isNotNull()).distinct()


def unpaid_work_list(firm: Firm, k: int = 5) -> DataFrame:
    df = firm.table("receivables_wip_aging").where((F.col("collection_priority_score") >= 80) & F.col("lead_partner_name").isNotNull())
    score = F.col("collection_priority_score")
    return df.select("record_id", "counterparty_name", "project_name", "amount", rules.capped_age(F.col("days_outstanding"), score).alias("days_outstanding"),
                     F.coalesce("lead_partner_name", F.lit("Unassigned")).alias("lead_partner_name"), rules.collection_action(score).alias("action_item"),
                     "collection_priority_score").orderBy(F.col("amount").desc(), "record_id").limit(k)


def behind_target(firm: Firm, k: int = 5) -> DataFrame:
    """Practice and region furthest below target, with the monthly run-rate of remaining work and a partner."""
    perf = _pnl(firm, None, [1]).groupBy("practice_area", "region").agg(F.sum("total_revenue").alias("accrued"), F.sum("budgeted_revenue").alias("target"))
    today = F.lit(firm.as_of)
    work = firm.table("project_profitability").where((F.col("project_status") == "Active") & (F.col("planned_revenue") > 0) & (F.col("project_end_date") > today))
    left = F.greatest(F.col("planned_revenue") - F.col("actual_revenue"), F.lit(0))
    rate = F.round((dbl(left) / F.greatest(F.months_between("project_end_date", today), F.lit(1.0))).cast("decimal(38,8)"), 4).cast(WIDE_MONEY)
    pipe = work.groupBy("practice_area", "region").agg(F.sum(rate).alias("pipe"))
    lead = partners(firm.table("dim_employees")).where(F.col("is_latest_snapshot")).groupBy("practice_area", "region").agg(F.min_by("full_name", "employee_id").alias("lead"))
    keys = ["practice_area", "region"]
    worst = perf.withColumn("variance", change_pct("accrued", "target")).orderBy(F.col("variance").asc_nulls_last(), *keys).limit(k)
    return worst.join(pipe, keys, "left").join(lead, keys, "left").select(
        F.concat("practice_area", F.lit(" ("), "region", F.lit(")")).alias("area"), dbl("accrued").alias("accrued"),
        F.coalesce(dbl("pipe"), F.lit(0.0)).alias("pipeline"), dbl("target").alias("target"), "variance", F.coalesce("lead", F.lit("Unassigned")).alias("partner"))


# Seniority order when a department lead is chosen.
LEAD_ORDER = {"Senior Partner": 1, "Partner": 2, "Associate Partner": 3, "Director": 4}


def department_leads(firm: Firm) -> DataFrame:
    staff = firm.table("dim_employees").where(F.col("is_latest_snapshot") & (F.col("employment_status") == "Active") & F.col("job_level").isin(*LEAD_ORDER))
    named = staff.join(firm.source_table("cost_center_mapping"), F.col("cost_center") == F.col("cost_center_code"))
    order = [rules.factor(F.col("job_level"), LEAD_ORDER, 5.0), F.col("hire_date"), F.col("employee_id")]
    return top_per_group(named, ["department_category"], order).select("department_category", F.col("full_name").alias("lead_name"))


def department_run_rate(firm: Firm, over: float = 0.10, at_most: float = 0.15, k: int = 5) -> DataFrame:
    """Departments whose last month is over their trailing twelve-month average, inside a credible band."""
    p = firm.periods
    monthly = firm.table("fact_accounts_payable").where(p.between_months("fiscal_month", 13, 0)).groupBy("department", "fiscal_month").agg(F.sum("amount").alias("spend"))
    last = F.col("fiscal_month") == F.lit(p.month(1))
    g = monthly.groupBy("department").agg(F.sum(F.when(last, F.col("spend"))).alias("accrued"), F.sum(F.when(~last, F.col("spend"))).alias("s"), F.count(F.when(~last, 1)).alias("n"))
    g = g.withColumn("budget", ratio("s", "n")).withColumn("over", F.try_divide(dbl("accrued") - F.col("budget"), F.col("budget")))
    hot = g.where((F.col("over") > over) & (F.col("over") <= at_most)).orderBy(F.col("over").desc(), "department").limit(k)
    return hot.join(department_leads(firm), F.col("department") == F.col("department_category"), "left").select(
        "department", dbl("accrued").alias("accrued"), "budget", (F.col("over") * 100).alias("variance"), F.coalesce("lead_name", F.lit("Unassigned")).alias("lead"))


def expense_outliers(firm: Firm, over_pct: float = 6, k: int = 5) -> DataFrame:
    df = firm.table("te_contract_audit").where((F.col("total_contract_value") > 0) & F.col("is_active"))
    pct = share_pct("billable_expenses", "total_contract_value")
    return df.withColumn("te_pct", pct).where(F.col("te_pct") > over_pct).select(
        "project_id", "client_name", F.col("billable_expenses").alias("total_te_billed"), "total_contract_value", "te_pct",
        F.coalesce("lead_partner_name", F.lit("Unassigned")).alias("lead_partner_name"), "project_name", rules.expense_action(F.col("te_pct")).alias("action_item")
    ).orderBy(F.col("te_pct").desc(), "project_id").limit(k)


def largest_office_overage(firm: Firm, preferred: list[str], filters: Filters = None) -> DataFrame:
    """Offices of the preferred group come first whatever their overage."""
    g = _pnl(firm, filters, [1]).groupBy("location").agg(F.sum(total_of_categories()).alias("a"), F.sum("budgeted_expenses").alias("b"))
    over = F.col("a") - F.col("b")
    return (g.where(over > 0).orderBy(F.col("location").isin(*preferred).desc(), over.desc(), "location").limit(1).select(
        F.col("location").alias("office"), rounded(dbl("a") * 12 / 1e6, 0).alias("actual_mm"), rounded(dbl("b") * 12 / 1e6, 0).alias("budget_mm"),
        rounded(dbl(over) * 12 / 1e6, 0).alias("overage_mm"), rounded(share_pct(over, "b"), 1).alias("overage_pct")))


def steepest_margin_fall(firm: Firm, filters: Filters = None) -> DataFrame:
    p = firm.periods
    df = axis_filter(firm.table("project_profitability"), filters).where(
        F.col("actual_margin_pct").between(*MARGIN_BAND) & (F.col("project_end_date") >= F.lit(p.days_ago(180))))
    margin = F.col("actual_margin_pct").cast("decimal(18,2)")
    mean = lambda test: F.try_divide(dbl(F.sum(F.when(test, margin))), dbl(F.count(F.when(test, margin))))
    g = df.groupBy("practice_area").agg(mean(p.since_days("project_end_date", 90)).alias("c"), mean(p.prior_days("project_end_date", 90, 180)).alias("p"))
    fall = F.col("c") - F.col("p")
    return g.where(fall < 0).orderBy(fall, "practice_area").limit(1).select(
        "practice_area", rounded(F.col("c"), 1).alias("curr_margin"), rounded(F.col("p"), 1).alias("prior_margin"), rounded(fall, 1).alias("qoq_change_pp"))


def largest_partner_growth(firm: Firm, filters: Filters = None) -> DataFrame:
    staff = axis_filter(partners(firm.table("dim_employees")), filters)
    p = firm.periods
    at = lambda b: F.countDistinct(F.when(p.in_month("snapshot_date", b), F.col("employee_id")))
    g = staff.where(p.in_month("snapshot_date", 1) | p.in_month("snapshot_date", 13)).groupBy("practice_area").agg(at(1).alias("c"), at(13).alias("y"))
    added = F.col("c") - F.col("y")
    return g.where((F.col("c") > 0) & (F.col("y") > 0) & (added > 0)).orderBy(added.desc(), "practice_area").limit(1).select(
        "practice_area", F.col("c").alias("curr_partners"), F.col("y").alias("yoy_partners"), added.alias("net_added"), rounded(change_pct("c", "y"), 1).alias("yoy_pct"))


def delivery_share(firm: Firm, filters: Filters = None) -> DataFrame:
    m = firm.table("enterprise_metrics")
    newest = m.agg(F.max("fiscal_period").alias("newest"))
    now = with_totals(axis_filter(m, filters), newest).where(F.col("fiscal_period") == F.col("newest")).agg(
        F.sum("delivery_cost").alias("c"), F.sum("revenue").alias("r"), F.sum("profit").alias("p"))
    return now.select(rounded(share_pct("c", "r"), 1).alias("delivery_cost_pct"), rounded(share_pct("p", "r"), 1).alias("margin_pct"), scaled("r", 1e6, 1).alias("total_revenue_mm"))


def priorities(firm: Firm, filters: Filters = None) -> DataFrame:
    """Action rows chosen by thresholds on the KPI values; one row per rule area."""
    dso, dpo = dso_ratio(firm, filters), dpo_ratio(firm, filters)
    util, heads, idle = utilization(firm, filters), partner_headcount(firm, filters), low_utilized_partners(firm, filters)
    client, vendor = top_client_invoice(firm, filters), top_vendor_invoice(firm, filters)

    def pick(df: DataFrame, area: str, rank: int, value: str, text: Column) -> DataFrame:
        return df.select(F.lit(area).alias("area"), F.lit(rank).alias("priority"), text.alias("title"), dbl(value).alias("value"))

    d, t = F.col("dso_days"), F.col("target_dso")
    rows = pick(dso, "collections", 1, "dso_days", F.when(d > t * 1.2, "Critical: Accelerate Collections").when(
        F.col("qoq_improvement_days") < 0, "Reverse Collections Deterioration").otherwise("Maintain Collections Excellence"))
    k, days = F.col("top_amount_k"), F.col("top_days_overdue")
    rows = rows.unionByName(pick(client, "client", 2, "top_amount_k", F.when(
        (k > 100) & (days > 30), F.concat(F.lit("Escalate: "), "top_client", F.lit(" Collection"))).when(
        k > 50, F.concat(F.lit("Priority Collection: "), "top_client")).otherwise("Optimize Payment Terms")))
    both = beside(dpo, vendor)
    rows = rows.unionByName(pick(both, "payables", 3, "dpo_days", F.when(
        F.col("dpo_days") < F.col("target_dpo") * 0.8, "Optimize Vendor Payment Timing").otherwise(F.concat(F.lit("Vendor Strategy: "), F.col("top_vendor")))))
    u = F.col("current_utilization_pct")
    rows = rows.unionByName(pick(util, "utilization", 4, "current_utilization_pct", F.when(u < 75, "Critical: Low Utilization Crisis").when(
        F.col("mom_change_pp") < -5, "Reverse Utilization Decline").otherwise("Optimize Consultant Deployment")))
    gap = F.col("variance_count")
    rows = rows.unionByName(pick(heads, "headcount", 5, "variance_count", F.when(gap > 10, "Accelerate Partner Recruitment").when(gap > 5, "Close Headcount Gap")))
    n = F.col("bench_consultants")
    rows = rows.unionByName(pick(idle, "bench", 6, "bench_consultants", F.when(
        n > 20, F.concat(F.lit("Redeploy "), n.cast("string"), F.lit(" Bench Consultants"))).when(n > 10, "Reduce Bench Time")))
    return rows.where(F.col("title").isNotNull())


def canonical_totals(firm: Firm) -> DataFrame:
    """The firm figures a text is checked against."""
    cards = firm.table("fact_timecards").where(firm.periods.trailing_days("work_date", 90) & (F.col("fiscal_month") >= F.trunc(F.lit(firm.periods.days_ago(90)), "MM")))
    low = low_utilized(person_hours(cards)).agg(F.count(F.lit(1)).cast("double").alias("low_utilization_employees"))
    heads = partners(firm.table("dim_employees")).agg(F.countDistinct("employee_id").cast("double").alias("partners"))
    rev = firm.table("enterprise_metrics").agg(F.sum("revenue").cast("double").alias("rev"))
    owed = firm.table("receivables_wip_aging").where(F.coalesce("payment_status", F.lit("Open")) != "Paid").agg(
        F.try_divide(dbl(F.sum("days_outstanding")), dbl(F.count("days_outstanding"))).alias("dso"))
    row = beside(low, heads, rev, owed).withColumn("revenue_per_partner", F.try_divide(F.col("rev"), F.col("partners")))
    return row.selectExpr("stack(4, 'low_utilization_employees', low_utilization_employees, 'count', 'partners', partners, 'count', "
                          "'revenue_per_partner', revenue_per_partner, 'dollar', 'dso', dso, 'days') as (name, value, kind)")


def generator_sanity(firm: Firm) -> DataFrame:
    """Monthly billable revenue, hours and people."""
    per = firm.table("fact_timecards").where(billable()).groupBy("fiscal_month", "employee_id").agg(F.sum("billing_amount").alias("rev"), F.sum("hours_worked").alias("hours"))
    return per.groupBy("fiscal_month").agg(F.sum("rev").alias("revenue"), F.sum("hours").alias("hours"), F.count("employee_id").alias("heads"))


def budget_spread(firm: Firm) -> DataFrame:
    p = firm.table("dim_projects")
    lead = firm.source_table("workday_employees").select(F.col("employee_id").alias("lead_partner_id"), F.lit(1).alias("hit"))
    return p.join(lead, ["lead_partner_id"], "left").agg(
        F.min("planned_revenue").alias("min_budget"), F.try_divide(dbl(F.sum("planned_revenue")), dbl(F.count("planned_revenue"))).alias("avg_budget"),
        F.max("planned_revenue").alias("max_budget"), F.count(F.lit(1)).alias("projects"), F.count("hit").alias("projects_with_known_lead"))
