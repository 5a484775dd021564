"""Answers to the standing questions, over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import rules
from tallyhouse.functions.money import dbl, ratio, rounded, share_pct, sum_if
from tallyhouse.operators.joins import beside
from tallyhouse.operators.windows import newest_periods, share_of_all, share_within
from tallyhouse.plans import kpis
from tallyhouse.plans.firm import Firm
from tallyhouse.plans.gold import EXPENSE_NAMES, billable, total_of_categories
from tallyhouse.plans.kpis import bench, bench_cost_of_row, change_pct, partners, scaled


def _over(actual: str, target: str, digits: int = 1) -> Column:
    return rounded((ratio(actual, target) - 1) * 100, digits)


def _span(firm: Firm, table: str, backs: int, column: str = "fiscal_period") -> DataFrame:
    return firm.table(table).where(firm.periods.between_months(column, backs, 0))


def revenue_vs_target(firm: Firm) -> DataFrame:
    g = _span(firm, "regional_pnl", 1).groupBy("location", "practice_area").agg(F.sum("total_revenue").alias("a"), F.sum("budgeted_revenue").alias("t"))
    return g.select("location", "practice_area", scaled("a", 1e6, 1).alias("actual_rev_mm"), scaled("t", 1e6, 1).alias("target_rev_mm"), _over("a", "t").alias("variance_pct"),
                    rounded(F.col("a") - F.col("t"), 0).alias("dollar_gap")).orderBy(F.col("variance_pct").asc_nulls_last(), "location", "practice_area")


def worst_margins(firm: Firm, k: int = 15) -> DataFrame:
    p = firm.table("project_profitability").where(firm.periods.in_month("project_end_date", 1) & F.col("actual_margin_pct").between(-50, 70))
    gap = F.col("actual_margin_pct") - F.col("planned_margin_pct")
    return p.orderBy(gap, "project_id").limit(k).select(
        "project_id", "project_name", "client_name", "practice_area", "location", "lead_partner_name", scaled("actual_revenue", 1e3, 0).alias("actual_revenue_k"),
        scaled(F.col("actual_revenue") - F.col("actual_margin"), 1e3, 0).alias("total_cost_k"), scaled("actual_cost", 1e3, 0).alias("delivery_cost_k"),
        scaled("actual_expenses", 1e3, 0).alias("project_expenses_k"), "actual_margin_pct", "planned_margin_pct", rounded(gap, 1).alias("margin_variance_pp"))


def dso_current_and_previous(firm: Firm) -> DataFrame:
    """The two newest distinct snapshots, not two rows of the newest one."""
    s = firm.table("ar_snapshot_aging")
    per = s.join(F.broadcast(newest_periods(s, "snapshot_date", 2)), ["snapshot_date"]).groupBy("period_rank", "snapshot_date").agg(F.max("firmwide_dso_days").alias("d"))
    at = lambda r, c: F.max(F.when(F.col("period_rank") == r, F.col(c)))
    two = per.agg(at(1, "d").alias("c"), at(2, "d").alias("p"), at(1, "snapshot_date").alias("current_snapshot_date"))
    unpaid = firm.table("fact_accounts_receivable").where(rules.is_open()).agg(F.count(F.lit(1)).alias("unpaid_invoice_count"))
    return beside(two, unpaid).select(rounded(F.col("c"), 1).alias("current_dso"), rounded(F.col("p"), 1).alias("previous_dso"), rounded(F.col("c") - F.col("p"), 1).alias("dso_change_days"),
                                      "current_snapshot_date", "unpaid_invoice_count")


def revenue_per_partner(firm: Firm) -> DataFrame:
    return kpis._partner_economics(firm, None).select(
        rounded(F.col("cur") / 1e6, 2).alias("current_rev_per_partner_mm"), rounded(F.col("yoy") / 1e6, 2).alias("yoy_rev_per_partner_mm"), F.col("cur_n").alias("current_partner_count"),
        F.col("yoy_n").alias("yoy_partner_count"), rounded(F.try_divide(F.col("cur"), F.col("yoy")) * 100 - 100, 2).alias("yoy_pct_change"))


def revenue_per_partner_cells(firm: Firm, min_partners: int = 3) -> DataFrame:
    keys = ["practice_area", "region"]
    rev = kpis.months(firm.table("enterprise_metrics"), firm, [1, 13]).groupBy(*keys).agg(
        (kpis.in_month(firm, 1, "revenue") * 12).alias("r1"), (kpis.in_month(firm, 13, "revenue") * 12).alias("r13"))
    heads = kpis.partner_counts(firm, None, keys).where(F.col("cur_n") >= min_partners)
    yoy = F.when(F.col("yoy_n") > 0, F.col("yoy_n"))
    cur, old = ratio("r1", "cur_n"), ratio("r13", "yoy_n")
    return heads.join(rev, keys, "left").select(
        *keys, F.col("cur_n").alias("current_partner_count"), yoy.alias("yoy_partner_count"), (F.col("cur_n") - yoy).alias("partner_headcount_change"),
        rounded(cur / 1e6, 2).alias("current_rev_per_partner_mm"), rounded(old / 1e6, 2).alias("yoy_rev_per_partner_mm"), rounded(F.try_divide(cur, old) * 100 - 100, 2).alias("yoy_pct_change")
    ).orderBy(F.col("yoy_pct_change").asc_nulls_last(), *keys)


def practice_revenue(firm: Firm) -> DataFrame:
    g = _span(firm, "regional_pnl", 6).groupBy("fiscal_period", "practice_area").agg(F.sum("total_revenue").alias("a"), F.sum("budgeted_revenue").alias("t")).where(F.col("a") > 0)
    return g.select("fiscal_period", "practice_area", scaled("a", 1e6, 2).alias("revenue_mm"), scaled("t", 1e6, 2).alias("target_mm"), _over("a", "t").alias("variance_pct")).orderBy(
        F.col("fiscal_period").desc(), F.col("variance_pct").asc_nulls_last(), "practice_area")


def _expense_table(firm: Firm, by: list[str], budget_name: str) -> DataFrame:
    g = _span(firm, "regional_pnl", 7).groupBy(*by).agg(
        *[F.sum(f"{n}_expenses").alias(n) for n in EXPENSE_NAMES], F.sum(total_of_categories()).alias("all"), F.sum("budgeted_expenses").alias("bud"))
    return g.select(*by, *[scaled(n, 1e6, 1).alias(f"{n}_mm") for n in EXPENSE_NAMES], scaled("all", 1e6, 1).alias("total_actual_mm"), scaled("bud", 1e6, 1).alias(budget_name),
                    rounded(change_pct("all", "bud"), 1).alias("over_budget_pct"))


def office_expenses(firm: Firm) -> DataFrame:
    return _expense_table(firm, ["fiscal_period", "location"], "budget_mm").orderBy(F.col("fiscal_period").desc(), F.col("over_budget_pct").desc_nulls_last(), "location")


def category_variance(firm: Firm) -> DataFrame:
    """One aggregate, then one row per category."""
    one = _span(firm, "regional_pnl", 6).agg(*[F.sum(f"{p}{n}_expenses").alias(f"{p}{n}") for n in EXPENSE_NAMES for p in ("", "budgeted_")])
    names = {"billable": "Billable", "corporate": "Corporate", "marketing": "Marketing", "tech": "Technology", "other": "Other"}
    parts = ", ".join(f"'{label}', {n}, budgeted_{n}" for n, label in names.items())
    return one.selectExpr(f"stack({len(names)}, {parts}) as (category, a, t)").select(
        "category", scaled("a", 1e6, 1).alias("actual_mm"), scaled("t", 1e6, 1).alias("budget_mm"), rounded(change_pct("a", "t"), 1).alias("variance_pct")).orderBy(F.col("variance_pct").desc_nulls_last(), "category")


def practice_utilization(firm: Firm, k: int = 50) -> DataFrame:
    g = _span(firm, "fact_timecards", 12, "fiscal_month").groupBy(F.col("fiscal_month").alias("fiscal_period"), "practice_area").agg(F.sum("hours_worked").alias("h"), sum_if(billable(), "hours_worked").alias("b"))
    return g.select("fiscal_period", "practice_area", rounded(share_pct("b", "h"), 1).alias("utilization_pct"), scaled("h", 1e3, 0).alias("total_hours_k"), scaled("b", 1e3, 0).alias("billable_hours_k")).orderBy(
        F.col("fiscal_period").desc(), F.col("utilization_pct").asc_nulls_last(), "practice_area").limit(k)


def practice_bench(firm: Firm, k: int = 30) -> DataFrame:
    g = _span(firm, "fact_timecards", 12, "fiscal_month").groupBy(F.col("fiscal_month").alias("fiscal_period"), "practice_area").agg(
        sum_if(bench(), "hours_worked").alias("i"), F.sum(bench_cost_of_row()).alias("c"), F.sum("hours_worked").alias("h"))
    return g.orderBy(F.col("fiscal_period").desc(), F.col("c").desc(), "practice_area").limit(k).select(
        "fiscal_period", "practice_area", scaled("i", 1e3, 1).alias("bench_hours_k"), scaled("c", 1e6, 2).alias("bench_cost_mm"), rounded(share_pct("i", "h"), 1).alias("bench_pct_of_total"))


def projects_over_plan(firm: Firm, over: float = 1.3, k: int = 15) -> DataFrame:
    over_hours = F.col("actual_hours") - F.col("planned_hours")
    p = firm.table("project_profitability").where(F.col("is_active") & (F.col("planned_hours") > 0) & (dbl("actual_hours") > dbl("planned_hours") * over))
    return p.orderBy(over_hours.desc(), "project_id").limit(k).select(
        "project_id", "project_name", "client_name", "practice_area", "location", "lead_partner_name", "planned_hours", rounded(F.col("actual_hours"), 0).alias("actual_hours"),
        rounded(over_hours, 0).alias("hours_overrun"), _over("actual_hours", "planned_hours", 0).alias("overrun_pct"), "team_size", "project_status", "project_start_date")


def firm_revenue_trend(firm: Firm) -> DataFrame:
    g = _span(firm, "regional_pnl", 6).groupBy("fiscal_period").agg(F.sum("total_revenue").alias("a"), F.sum("budgeted_revenue").alias("t"))
    return g.select("fiscal_period", scaled("a", 1e6, 1).alias("revenue_mm"), scaled("t", 1e6, 1).alias("forecast_mm"), _over("a", "t").alias("variance_pct")).orderBy("fiscal_period")


def firm_expenses(firm: Firm) -> DataFrame:
    return _expense_table(firm, ["fiscal_period"], "total_budget_mm").orderBy(F.col("fiscal_period").desc())


def office_comparison(firm: Firm) -> DataFrame:
    g = _span(firm, "regional_pnl", 1).groupBy("location").agg(F.sum("total_revenue").alias("r"), F.sum(total_of_categories()).alias("e"))
    left = F.col("r") - F.col("e")
    return g.select("location", scaled("r", 1e6, 1).alias("revenue_mm"), scaled("e", 1e6, 1).alias("expenses_mm"), rounded(share_pct("e", "r"), 1).alias("expense_ratio_pct"),
                    scaled(left, 1e6, 1).alias("gross_profit_mm"), rounded(share_pct(left, "r"), 1).alias("gross_margin_pct")).orderBy(F.col("gross_margin_pct").desc_nulls_last(), "location")


def open_receivables(firm: Firm, k: int = 50) -> DataFrame:
    return firm.table("fact_accounts_receivable").where(rules.is_open()).orderBy(F.col("amount").desc(), "invoice_id").limit(k).select(
        "location", "customer_name", "invoice_id", "invoice_date", scaled("amount", 1e3, 0).alias("amount_k"), "aging_bucket", "days_outstanding", "lead_partner_name", "payment_status")


def new_partner_classes(firm: Firm) -> DataFrame:
    """How last month's partners came to be partners: hired, promoted, or partners before.

    One row per person is folded from the snapshots, so no joins between snapshots are needed.
    """
    p = firm.periods
    now, before, earlier = p.in_month("snapshot_date", 1), p.in_month("snapshot_date", 2), F.col("snapshot_date") < F.lit(p.month(1))
    is_partner = (F.col("job_level") == "Partner") & (F.col("employment_status") == "Active")
    person = firm.table("dim_employees").groupBy("employee_id").agg(
        F.max(F.when(now & is_partner, F.col("practice_area"))).alias("practice_area"), F.max(F.when(now & is_partner, 1)).alias("is_now"),
        F.max(F.when(before, F.col("job_level"))).alias("old_level"), F.max(F.when(earlier, 1)).alias("seen"))
    label = (F.when(F.col("seen").isNull(), "Lateral hire (new to firm)").when(F.col("old_level") == "Partner", "Existing partner (carryover)")
             .when(F.col("old_level").isNotNull(), F.concat(F.lit("Promotion from "), "old_level")).otherwise("Promotion (prior level unknown)"))
    g = person.where(F.col("is_now") == 1).groupBy(label.alias("classification"), "practice_area").agg(F.count(F.lit(1)).alias("partner_count"))
    return share_of_all(g, "partner_count", "share").select("classification", "practice_area", "partner_count", rounded(F.col("share"), 1).alias("pct_of_total")).orderBy(
        "classification", F.col("partner_count").desc(), "practice_area")


def _unpaid(df: DataFrame, party: str, amount: str, k: int) -> DataFrame:
    g = df.groupBy(party).agg(F.sum(amount).alias("s"), F.count(F.lit(1)).alias("unpaid_invoice_count"), F.sum("days_outstanding").alias("d"), F.max("days_outstanding").alias("max_days_outstanding"))
    return g.orderBy(F.col("s").desc(), party).limit(k).select(
        party, scaled("s", 1e6, 2).alias("total_unpaid_mm"), "unpaid_invoice_count", rounded(ratio("d", "unpaid_invoice_count"), 1).alias("avg_days_outstanding"), "max_days_outstanding")


def unpaid_clients(firm: Firm, k: int = 10) -> DataFrame:
    return _unpaid(firm.table("fact_accounts_receivable").where(rules.is_open()), "customer_name", "amount", k)


def unpaid_vendors(firm: Firm, k: int = 10) -> DataFrame:
    return _unpaid(firm.table("fact_accounts_payable").where(rules.is_open()), "vendor_name", "amount", k)


def project_margin_qoq(firm: Firm) -> DataFrame:
    m = kpis.exec_margin(firm)
    return m.select(rounded(F.col("cur_pct"), 2).alias("current_margin_pct"), rounded(F.col("prior_pct"), 2).alias("previous_margin_pct"), rounded(F.col("qoq_pp"), 2).alias("qoq_change_pp"))


def partner_headcount(firm: Firm) -> DataFrame:
    c, p = F.col("cur_n"), F.col("prior_n")
    return kpis.partner_counts(firm, None).select(c.alias("current_partner_count"), p.alias("previous_partner_count"), (c - p).alias("mom_change"), rounded(change_pct(c, p), 2).alias("mom_pct_change"))


def partner_headcount_cells(firm: Firm) -> DataFrame:
    return partners(kpis.latest_staff(firm)).groupBy("practice_area", "region").agg(F.countDistinct("employee_id").alias("partner_count")).orderBy("practice_area", "region")


def dso_trend(firm: Firm, by: list[str]) -> DataFrame:
    """Days weighted over every bucket of the place, from month-end snapshots."""
    days = F.col("weighted_dso_days").cast("decimal(10,1)")
    g = firm.table("ar_snapshot_aging").groupBy("snapshot_date", *by).agg(F.sum(F.col("open_ar_balance") * days).alias("bd"), F.sum("open_ar_balance").alias("b"))
    return g.select("snapshot_date", *by, rounded(ratio("bd", "b"), 1).alias("dso_days")).orderBy(F.col("snapshot_date").desc(), F.col("dso_days").desc_nulls_last(), *by)


def bucket_mix(firm: Firm) -> DataFrame:
    g = firm.table("ar_snapshot_aging").groupBy("snapshot_date", "aging_bucket").agg(F.sum("open_ar_balance").alias("b"))
    return share_within(g, ["snapshot_date"], "b", "share").select(
        "snapshot_date", "aging_bucket", scaled("b", 1e6, 1).alias("open_ar_m"), rounded(F.col("share") * 100, 1).alias("pct_of_snapshot")).orderBy(F.col("snapshot_date").desc(), "aging_bucket")


def aged_balance(firm: Firm, client: str) -> DataFrame:
    old = F.col("aging_bucket").isin("61-90 days", "90+ days")
    return firm.table("ar_snapshot_aging").where(F.col("customer_name") == client).groupBy("snapshot_date").agg(
        sum_if(old, "open_ar_balance").alias("aged_60plus"), sum_if(F.col("aging_bucket") == "90+ days", "open_ar_balance").alias("aged_90plus")).orderBy(F.col("snapshot_date").desc())
