"""Cleaned dimensions and facts built from the source-system tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import rules
from tallyhouse.functions.money import MONEY, dbl, rounded_money
from tallyhouse.functions.periods import month_start
from tallyhouse.functions.stable import bucket, slot, stable_hash
from tallyhouse.operators.filters import DIMS
from tallyhouse.operators.joins import enrich, full_outer, rate_history, rate_on
from tallyhouse.operators.windows import latest_row, top_per_group
from tallyhouse.plans.policy import Policy
from tallyhouse.sources.sinks import merge_update

HOURS = "decimal(18,6)"
FACTOR = "decimal(6,4)"


def product_of(columns: list[Column]) -> Column | None:
    out = None
    for c in columns:
        out = c if out is None else (out * c).cast("decimal(12,6)")
    return out


def dim_clients(accounts: DataFrame) -> DataFrame:
    """Newest version of each account."""
    newest = latest_row(accounts, "account_id", "last_modified_date", F.col("account_name"))
    return newest.select(
        F.col("account_id").alias("client_id"), F.col("account_name").alias("client_name"), "industry",
        F.col("account_type").alias("client_type"), F.col("parent_account_id").alias("parent_client_id"), "annual_revenue",
        F.coalesce("account_status", F.lit("Active")).alias("client_status"),
        "region", "location", "practice_area", "customer", "last_modified_date")


def dim_employees(employees: DataFrame, organizations: DataFrame, as_of: date, policy: Policy, months: int = 36) -> DataFrame:
    """One row per employee and month-end of the trailing months.

    Months are generated on the employee's own row, from hire (or the first month kept) on,
    so no cross join is needed. Someone who left stays up to the month of leaving, and once
    more in the latest snapshot.
    """
    offices = top_per_group(organizations, ["cost_center"], [F.col("organization_name"), F.col("country")])
    base = employees.join(offices.select("cost_center", F.col("organization_name").alias("office_name"), "country"),
                          ["cost_center"], "left")
    this_month = F.trunc(F.lit(as_of), "MM")
    first, last = F.add_months(this_month, -months), F.add_months(this_month, -1)
    start = F.greatest(first, F.trunc("hire_date", "MM"))
    spine = F.explode(F.when(start <= last, F.sequence(start, last, F.expr("interval 1 month"))))
    snapshots = base.withColumn("_month", spine).withColumn("snapshot_date", F.last_day("_month"))
    latest = F.col("_month") == last
    kept = snapshots.where(
        (F.col("hire_date") <= F.col("snapshot_date"))
        & (F.col("termination_date").isNull() | (F.col("termination_date") >= F.col("_month")) | latest))
    level = F.col("job_level")
    for rule in policy.promotions:
        promoted = ((F.col("job_level") == rule.level) & (F.col("snapshot_date") >= F.lit(rule.since))
                    & (bucket("employee_id", 1000) < rule.per_mille))
        level = F.when(promoted, F.lit(rule.to)).otherwise(level)
    return kept.select(
        "employee_id", "first_name", "last_name", F.concat_ws(" ", "first_name", "last_name").alias("full_name"),
        "hire_date", "termination_date", rules.employment_status(F.col("snapshot_date")).alias("employment_status"),
        F.col("job_title").alias("position_title"), level.alias("job_level"), F.col("job_profile").alias("job_family"),
        "office_name", "country", "manager_id", "cost_center", F.coalesce("employee_type", F.lit("Regular")).alias("employee_type"),
        F.coalesce("termination_date", F.lit(date(9999, 12, 31))).alias("effective_end_date"),
        rules.in_force(F.col("snapshot_date")).alias("is_current"), latest.alias("is_latest_snapshot"),
        *DIMS, "snapshot_date")


def dim_projects(engagements: DataFrame, contracts: DataFrame, assignments: DataFrame, policy: Policy) -> DataFrame:
    newest = latest_row(engagements, "engagement_id", "last_modified_date", F.col("engagement_name"))
    # the set of a project's people is merged before and after one shuffle by project; a distinct count shuffles once more, by person
    staffing = assignments.groupBy("project_id").agg(
        F.size(F.collect_set("employee_id")).cast("bigint").alias("assigned_headcount"),
        F.count(F.when(F.col("assignment_status") == "Active", 1)).alias("active_assignments"),
        F.count(F.when(F.col("assignment_status") == "Planned", 1)).alias("planned_assignments"),
        F.sum("allocation_percentage").alias("_alloc"), F.count("allocation_percentage").alias("_alloc_n"))
    planned = F.coalesce("forecasted_revenue", "budget_amount", F.lit(0)).cast(MONEY)
    hours = F.lit(500) + bucket("engagement_id", 4500)
    cost = (planned * F.lit(policy.planned_cost_share).cast("decimal(4,2)")).cast(MONEY)
    uplift = F.lit(2.0) + bucket(F.concat(F.col("engagement_id").cast("string"), F.lit("req")), 60) / F.lit(100.0)
    months = F.months_between(F.coalesce("end_date", F.date_add("start_date", 365)), F.col("start_date"))
    capacity = F.greatest(months / F.lit(12.0) * F.lit(2080.0), F.lit(1.0))
    # the people first: the newest versions lie by engagement already, so the wide rows move once more only, to their contracts
    joined = (newest.join(staffing.withColumnRenamed("project_id", "engagement_id"), ["engagement_id"], "left")
              .join(contracts, ["contract_id"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    mean_alloc = F.coalesce(F.round(F.try_divide(dbl("_alloc"), dbl("_alloc_n")).cast("decimal(38,8)"), 1).cast("double"), F.lit(0.0))
    return joined.select(
        F.col("engagement_id").alias("project_id"), F.col("engagement_name").alias("project_name"),
        F.col("account_id").alias("client_id"), F.col("engagement_type").alias("project_type"),
        F.col("lead_partner").alias("lead_partner_id"), F.col("engagement_manager").alias("project_manager_id"),
        F.col("start_date").alias("project_start_date"), F.col("end_date").alias("project_end_date"),
        hours.alias("planned_hours"), planned.alias("planned_revenue"), cost.alias("planned_cost"),
        (planned - cost).cast(MONEY).alias("planned_margin"),
        F.when(planned > 0, F.lit((1 - float(policy.planned_cost_share)) * 100).cast("decimal(6,2)").cast("double"))
        .otherwise(F.lit(0.0)).alias("planned_margin_pct"),
        F.when(F.col("contract_number").isNotNull(), F.col("contract_id")).alias("contract_id"),
        "contract_number", "total_contract_value", "billing_frequency",
        F.col("status").alias("project_status"), rules.is_active_status("status").alias("is_active"),
        zero("assigned_headcount"), zero("active_assignments"), zero("planned_assignments"),
        mean_alloc.alias("avg_allocation_pct"),
        F.ceil(dbl(hours) * uplift / capacity).alias("required_headcount"), *DIMS)


def credited_share(policy: Policy, level: str, hashed_card: str) -> Column:
    """Share of the logged hours that counts, by level, spread by a stable bucket of the timecard."""
    out = None
    for name, (low, spread) in policy.level_hours.items():
        share = (F.lit(low).cast(FACTOR) + slot(hashed_card, spread).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(4,2)")).cast(FACTOR)
        hit = F.col(level) == name
        out = F.when(hit, share) if out is None else out.when(hit, share)
    one = F.lit("1").cast(FACTOR)
    return one if out is None else out.otherwise(one)


def revenue_category(policy: Policy, customer: str = "customer", time_type: Column | None = None) -> Column:
    place = bucket(F.coalesce(F.col(customer), F.lit("")), 100)
    out = None
    for name, upper in policy.revenue_mix:
        out = F.when(place < upper, F.lit(name)) if out is None else out.when(place < upper, F.lit(name))
    return F.when(time_type == "Billable", out.otherwise(F.lit("Billable"))).otherwise(F.lit("Other"))


def with_rates(cards: DataFrame, billing_rates: DataFrame, cost_rates: DataFrame, employees: DataFrame) -> DataFrame:
    """Cards (employee_id and work_date among their columns) with the rates in force on the day and the person's level.

    Each person's rates are one row, so cards are shuffled once, by person. A card without a day gets nothing.
    """
    rates = rate_history("employee_id", {"_rates": (billing_rates, "billing_rate"), "_costs": (cost_rates, "hourly_cost_rate")})
    people = full_outer(rates, employees.select("employee_id", "job_level"), ["employee_id"]).withColumnRenamed("employee_id", "_key")
    known = cards.join(people, (F.col("employee_id") == F.col("_key")) & F.col("work_date").isNotNull(), "left")
    return known.select(*cards.columns, rate_on("_rates", "work_date").alias("_rate"), rate_on("_costs", "work_date").alias("_cost"), "job_level")


def fact_timecards(timecards: Callable[..., DataFrame], billing_rates: DataFrame, cost_rates: DataFrame, employees: DataFrame,
                   as_of: date, policy: Policy) -> DataFrame:
    """Timecards with the rate in force on the day, credited hours, billed and cost amounts.

    ``timecards`` takes a function that adds columns to cards; a source applies it while its rows are narrow.
    """
    cards = timecards(lambda c: with_rates(c, billing_rates, cost_rates, employees))
    cards = cards.withColumnRenamed("billing_rate", "_own_rate").withColumnRenamed("cost_rate", "_own_cost").withColumn("_h", stable_hash("timecard_id"))

    billable = rules.is_billable_type()
    adjusted = F.col("hours")
    if policy.hour_adjustments:
        story = product_of([a.as_column("work_date") for a in policy.hour_adjustments])
        adjusted = (F.col("hours") * story).cast(HOURS)
    credited = (adjusted * credited_share(policy, "job_level", "_h")
                * rules.exact_factor(F.col("practice_area"), policy.practice_premium)).cast(HOURS)
    on_bench = F.col("work_date").between(F.date_sub(F.lit(as_of), policy.bench_days), F.lit(as_of)) & (bucket("employee_id", 100) < policy.bench_percent)
    clean = F.when(billable & on_bench, "Non-Billable").otherwise(rules.clean_time_type())
    rate = F.when(billable, F.coalesce("_rate", "_own_rate", F.lit(0))).otherwise(F.lit(0)).cast("decimal(8,2)")
    cost = F.coalesce("_cost", "_own_cost", F.lit(0)).cast("decimal(8,2)")

    step = cards.select(
        "timecard_id", "employee_id", "project_id", "work_date", clean.alias("time_type_clean"), billable.alias("_billable"),
        F.when(billable, credited).otherwise(adjusted).cast(HOURS).alias("hours_worked"),
        rate.alias("billing_rate"), cost.alias("cost_rate"), "approval_status", *DIMS)
    zero = F.lit(0).cast(MONEY)
    billed = (F.col("hours_worked") * rules.exact_factor(F.col("location"), policy.office_rate) * F.col("billing_rate")).cast(MONEY)
    spent = (F.col("hours_worked") * F.col("cost_rate")).cast(MONEY)
    return step.select(
        "timecard_id", "employee_id", "project_id", "work_date", "time_type_clean", "hours_worked", "billing_rate", "cost_rate",
        F.when(F.col("_billable"), billed).otherwise(zero).alias("billing_amount"),
        F.when(F.col("_billable"), spent).otherwise(zero).alias("cost_amount"),
        "approval_status", *DIMS, revenue_category(policy, "customer", F.col("time_type_clean")).alias("revenue_category"),
        month_start("work_date").alias("fiscal_month"))


def fact_expenses(items: DataFrame, reports: DataFrame, cost_centers: DataFrame, policy: Policy) -> DataFrame:
    """Expense items with report, department, business category and budget."""
    heads = reports.select("report_id", "employee_id", "submit_date", "approval_status", "cost_center")
    base = items.join(heads, ["report_id"], "inner")
    base = enrich(base, cost_centers, "cost_center", "cost_center_code", {"department_category": "department_category"})
    amount = F.col("transaction_amount")
    if policy.expense_adjustments:
        story = product_of([a.as_column("transaction_date") for a in policy.expense_adjustments])
        amount = (amount * story).cast(MONEY)
    base = base.withColumn("amount", amount)
    group = rules.classify(rules.upper_or_blank("department_category"), rules.DEPARTMENT_GROUPS, "Other")
    by_month = {str(k): v for k, v in policy.expense_month_variance.items()}
    variance = (rules.exact_factor(F.col("location"), policy.expense_office_variance, "0")
                + rules.exact_factor(group, policy.expense_group_variance, "0")
                + rules.exact_factor(F.month("transaction_date").cast("string"), by_month, "0")
                + ((bucket("expense_id", 31) - F.lit(15)).cast("decimal(6,0)") * F.lit("0.001").cast("decimal(4,3)")).cast(FACTOR))
    budget = rounded_money(dbl("amount") / dbl(F.lit(1).cast(FACTOR) + variance))
    return base.select(
        F.col("expense_id").alias("expense_item_id"), F.col("report_id").alias("expense_report_id"), "employee_id",
        F.col("submit_date").alias("submission_date"), "approval_status", F.col("transaction_date").alias("expense_date"),
        "expense_type", "amount", "is_billable", F.col("vendor_name").alias("merchant_name"),
        rules.receipt_text().alias("receipt_status"), "cost_center", "project_id", *DIMS, "department_category",
        rules.expense_category().alias("expense_category_business"), budget.alias("budgeted_amount"),
        month_start("transaction_date").alias("fiscal_month"))


def outlier_projects(expenses: DataFrame, projects: DataFrame, policy: Policy) -> DataFrame:
    """Active mid-size projects to be shown with high expenses: the largest per office, then the largest overall."""
    spent = (expenses.where((F.col("expense_category_business") == "Billable") & F.col("project_id").isNotNull())
             .groupBy("project_id").agg(F.sum("amount").alias("current_te"), F.count(F.lit(1)).alias("row_count"))
             .where((F.col("row_count") >= 2) & (F.col("current_te") > 0)))
    low, high = policy.outlier_contract_range
    share = (F.lit("0.065").cast("decimal(6,4)") + bucket("project_id", 30).cast("decimal(4,0)") * F.lit("0.001").cast("decimal(4,3)")).cast(FACTOR)
    eligible = (projects.where(rules.is_active_status() & F.col("total_contract_value").between(F.lit(low), F.lit(high)))
                .join(spent, "project_id")
                .select("project_id", "location", "total_contract_value", "current_te", "row_count",
                        (F.col("total_contract_value") * share).cast(MONEY).alias("target_total_te")))
    order = [F.col("total_contract_value").desc(), F.col("project_id")]
    return top_per_group(eligible, ["location"], order).orderBy(*order).limit(policy.outlier_projects)


def rescale_outliers(expenses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scale the billable rows of the chosen projects so that each project meets its target total."""
    scaled = rounded_money(dbl("amount") * (dbl("src_target_total_te") / dbl("src_current_te")))
    return merge_update(expenses, chosen.select("project_id", "target_total_te", "current_te"), "project_id",
                        F.col("expense_category_business") == "Billable", {"amount": scaled})


def current_staff(employees: DataFrame) -> DataFrame:
    return employees.where(F.col("is_current") & F.col("is_latest_snapshot"))


def wip_unbilled(timecards: DataFrame, employees: DataFrame, projects: DataFrame, clients: DataFrame, as_of: date,
                 days: int = 45) -> DataFrame:
    """Recent billable timecards with people, project and client names."""
    since = F.date_sub(F.lit(as_of), days)
    recent = timecards.where((F.col("time_type_clean") == "Billable") & (F.col("fiscal_month") >= F.trunc(since, "MM"))
                             & (F.col("work_date") >= since))
    staff = current_staff(employees)
    out = enrich(recent, staff, "employee_id", "employee_id",
                 {"employee_name": "full_name", "job_level": "job_level", "job_family": "job_family"})
    out = enrich(out, projects, "project_id", "project_id",
                 {"project_name": "project_name", "client_id": "client_id", "lead_partner_id": "lead_partner_id",
                  "project_manager_id": "project_manager_id"})
    out = enrich(out, clients, "client_id", "client_id", {"client_name": "client_name"})
    out = enrich(out, staff, "lead_partner_id", "employee_id", {"lead_partner_name": "full_name"})
    out = enrich(out, staff, "project_manager_id", "employee_id", {"project_manager_name": "full_name"})
    return (out.withColumn("margin_amount", (F.col("billing_amount") - F.col("cost_amount")).cast(MONEY))
            .withColumn("is_wip", rules.is_wip()))


def fact_accounts_payable(invoices: DataFrame, policy: Policy) -> DataFrame:
    aged = invoices.withColumn("_h", stable_hash("invoice_id")).withColumn("days_outstanding", rules.payable_age("_h"))
    return aged.select(
        "invoice_id", "vendor_id", "vendor_name", "invoice_date", "due_date",
        (F.col("amount") * F.lit(policy.payable_scale).cast("decimal(6,0)")).cast(MONEY).alias("amount"), "payment_status",
        "payment_date", "department", "days_outstanding", rules.aging_bucket(F.col("days_outstanding")).alias("aging_bucket"),
        *DIMS, month_start("invoice_date").alias("fiscal_month"))


def fact_accounts_receivable(invoices: DataFrame, projects: DataFrame, employees: DataFrame, as_of: date, policy: Policy) -> DataFrame:
    """Invoices with age, bucket and the name of the partner who leads the project."""
    age = rules.receivable_age(F.lit(as_of))
    # names go to the projects' ids first, so invoices with their texts are shuffled once, by project
    leads = enrich(projects.select("project_id", "lead_partner_id"), current_staff(employees), "lead_partner_id", "employee_id", {"_lead_name": "full_name"})
    out = enrich(invoices, leads, "project_id", "project_id", {"_lead_name": "_lead_name"})
    return out.select(
        "invoice_id", "customer_id", "customer_name", "invoice_date", "due_date",
        (F.col("amount") * F.lit(policy.receivable_scale).cast("decimal(6,0)")).cast(MONEY).alias("amount"),
        "payment_status", "payment_date", rules.clamp(age, 0, 365).alias("days_outstanding"),
        rules.aging_bucket(age).alias("aging_bucket"), "project_id",
        F.coalesce("_lead_name", F.lit("Unassigned")).alias("lead_partner_name"), *DIMS,
        month_start("invoice_date").alias("fiscal_month"))


def fact_general_ledger(entries: DataFrame) -> DataFrame:
    net = F.coalesce("debit_amount", F.lit(0)) - F.coalesce("credit_amount", F.lit(0))
    return entries.select(
        "entry_id", "posting_date", "account_type", rules.account_category().alias("account_category"), "debit_amount",
        "credit_amount", net.cast(MONEY).alias("net_amount"), F.year("posting_date").alias("fiscal_year"),
        F.month("posting_date").alias("fiscal_period"), *DIMS)
