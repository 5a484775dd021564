"""SM*: named filters, measures, the metric view and the rules around them."""

from pyspark.sql import functions as F

from tallyhouse.catalogue.check_tables import ASOF, back, clean_open, dbl, div, pct, rnd
from tallyhouse.catalogue.kpi_queries import _bill
from tallyhouse.catalogue.registry import query
from tallyhouse.plans.firm import BUILDERS
from tallyhouse.functions import rules
from tallyhouse.functions.money import dbl as as_double, sum_if
from tallyhouse.plans import semantic as sm
from tallyhouse.plans.gold import billable

slug = lambda n: n.lower().replace("+", "plus").replace(" ", "_")
Y, Q = f"CAST(date_trunc('year', {ASOF}) AS DATE)", f"CAST(date_trunc('quarter', {ASOF}) AS DATE)"
_FILTERS = {
    "Active Employees": ("dim_employees", "r_employees", ["snapshot_date"], f"employment_status = 'Active' AND (termination_date IS NULL OR termination_date > {ASOF})"),
    "Active Projects": ("dim_projects", "r_projects", ["practice_area"], "is_active AND project_status = 'Active'"),
    "Aging Receivables 60+ Days": ("fact_accounts_receivable", "r_ar", ["location"], "days_outstanding >= 60 AND aging_bucket IN ('61-90 days', '90+ days')"),
    "Approved Expenses": ("fact_expenses", "r_expenses", ["location"], "approval_status = 'Approved'"),
    "Billable Time": ("fact_timecards", "r_timecards", ["location"], "time_type_clean = 'Billable'"),
    "Current Fiscal Year": ("regional_pnl", "r_pnl", ["location"], f"fiscal_period >= {Y}"),
    "Current Quarter": ("regional_pnl", "r_pnl", ["location"], f"fiscal_period >= {Q} AND fiscal_period < {Q} + INTERVAL 3 MONTH"),
    "High Value Transactions": ("fact_accounts_payable", "r_ap", ["location"], "amount >= 10000"),
    "Large Projects": ("dim_projects", "r_projects", ["practice_area"], "coalesce(total_contract_value >= 500000, false) OR planned_revenue >= 500000"),
    "Overdue Accounts Payable": ("fact_accounts_payable", "r_ap", ["location"], f"payment_status = 'Overdue' AND due_date < {ASOF}"),
    "Overdue Invoices": ("fact_accounts_receivable", "r_ar", ["location"], f"payment_status IN ('Open', 'Overdue', 'Partially Paid') AND due_date < {ASOF}"),
    "Recent Expenses": ("fact_expenses", "r_expenses", ["location"], f"expense_date >= {ASOF} - 30"),
    "Senior Level Staff": ("dim_employees", "r_employees", ["snapshot_date"], "job_level IN ('Senior Partner', 'Partner', 'Associate Partner', 'Engagement Manager', 'Director')"),
    "Strict Partners Only": ("dim_employees", "r_employees", ["snapshot_date"], "job_level = 'Partner' AND employment_status = 'Active'"),
    "Year to Date": ("regional_pnl", "r_pnl", ["location"], f"fiscal_period >= {Y} AND fiscal_period < {back(0)}"),
}
for _name, (_t, _r, _by, _where) in _FILTERS.items():
    query(f"SM4_filter_{slug(_name)}", f"SELECT {', '.join(_by)}, count(*) AS n FROM {_r} WHERE {_where} GROUP BY ALL")(
        lambda f, n=_name, t=_t, by=_by: sm.select_where(f, f.table(t), n).groupBy(*by).agg(F.count(F.lit(1)).alias("n")))

_z = lambda e: f"coalesce({e}, 0.0)"
_d2 = lambda c: f"sum(CAST({c} AS DECIMAL(38,2)))"
_MEASURES = {
    "AP Aging Days": ("fact_accounts_payable", "r_ap", div(f"sum({ASOF} - due_date)", "count(due_date)")),
    "Accounts Receivable Total": ("fact_accounts_receivable", "r_ar", dbl("sum(amount)")),
    "Active Headcount": ("dim_employees", "r_employees", "count(DISTINCT employee_id)"),
    "Average Billing Rate": ("fact_timecards", "r_timecards", _z(div("sum(CASE WHEN time_type_clean = 'Billable' THEN billing_amount ELSE 0 END)", f"sum({_bill})"))),
    "Billable Hours": ("fact_timecards", "r_timecards", dbl(f"sum({_bill})")),
    "Days Sales Outstanding": ("fact_accounts_receivable", "r_ar", div("sum(days_outstanding)", "count(*)")),
    "Expense Variance Percentage": ("department_summary", "r_dept", _z(pct(f"{_d2('accrued_expenses')} - {_d2('budgeted_expenses')}", _d2("budgeted_expenses")))),
    "Gross Margin Percentage": ("regional_pnl", "r_pnl", _z(pct("sum(total_revenue) - sum(total_cost_of_delivery)", "sum(total_revenue)"))),
    "Operating Margin Percentage": ("regional_pnl", "r_pnl", rnd(_z(pct("sum(CAST(operating_income AS DECIMAL(38,4)))", "sum(total_revenue)")), 4)),
    "Pipeline Coverage Ratio": ("enterprise_metrics", "r_ent", _z(div("sum(pipeline_revenue)", "sum(revenue)"))),
    "Project Budget Variance": ("project_profitability", "r_profit", _z(pct("sum(actual_revenue) - sum(planned_revenue)", "sum(planned_revenue)"))),
    "Project Margin Percentage": ("project_profitability", "r_profit", _z(pct("sum(actual_margin)", "sum(actual_revenue)"))),
    "Total Expense Amount": ("regional_pnl", "r_pnl", dbl("sum(total_expenses)")),
    "Travel Spend": ("fact_expenses", "r_expenses", dbl("sum(CASE WHEN expense_type IN ('Airfare', 'Hotel', 'Meals', 'Mileage', 'Parking') THEN amount ELSE 0 END)")),
    "Utilization Rate": ("fact_timecards", "r_timecards", _z(pct(f"sum({_bill})", "sum(hours_worked)"))),
    "WIP Value Total": ("wip_unbilled", "r_wip", dbl("sum(CASE WHEN is_wip THEN billing_amount ELSE 0 END)")),
}


def _measured(f, name, table):
    out = sm.measure(f, f.table(table), ["region", "practice_area"], {"value": name})
    return out.withColumn("value", F.round(F.col("value").cast("decimal(38,8)"), 4).cast("double")) if name == "Operating Margin Percentage" else out


for _name, (_t, _r, _sql) in _MEASURES.items():
    query(f"SM5_measure_{slug(_name)}", f"SELECT region, practice_area, {_sql} AS value FROM {_r} GROUP BY 1, 2" if _r != "r_dept" else f"SELECT region, practice_area, {_sql} AS value FROM r_dept GROUP BY 1, 2")(
        lambda f, n=_name, t=_t: _measured(f, n, t))
_P = "(SELECT count(DISTINCT employee_id) FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND is_latest_snapshot)"
query("SM5_measure_revenue_per_partner", f"SELECT fiscal_month, {_z(div('sum(billing_amount)', _P))} AS value FROM r_timecards GROUP BY 1")(
    lambda f: sm.measure(f, sm.beside_all(f.table("fact_timecards"), f.table("dim_employees").where(F.col("is_latest_snapshot") & sm.strict_partner()).agg(F.countDistinct("employee_id").alias("partners"))),
                         ["fiscal_month"], {"value": "Revenue per Partner"}))


def _view_sql(dims, staff, owed):
    cols = {"fiscal_period": "t.fiscal_month", "region": "p.region", "practice_area": "p.practice_area", "location": "p.location", "industry": "p.industry", "job_level": "e.job_level"}
    sel = ", ".join(f"{cols[d]} AS {d}" for d in dims)
    sj = f"LEFT JOIN (SELECT {', '.join(staff)}, count(DISTINCT employee_id) AS np FROM r_employees WHERE is_latest_snapshot AND job_level = 'Partner' AND employment_status = 'Active' GROUP BY ALL) USING ({', '.join(staff)})" if staff else f"CROSS JOIN (SELECT {_P} AS np)"
    oj = f"LEFT JOIN (SELECT {', '.join(owed)}, {div('sum(days_outstanding)', 'count(*)')} AS dso FROM r_ar WHERE {clean_open()} GROUP BY ALL) USING ({', '.join(owed)})" if owed else f"CROSS JOIN (SELECT {div('sum(days_outstanding)', 'count(*)')} AS dso FROM r_ar WHERE {clean_open()})"
    return f"""SELECT {', '.join(dims)}, {dbl('rev')} AS total_billable_revenue, {dbl('bh')} AS billable_hours, {dbl('th')} AS total_hours, coalesce(np, 0) AS strict_partner_count, {_z(div('rev', 'np'))} AS revenue_per_partner, {_z(pct('bh', 'th'))} AS utilization_rate, dso,
    {_z(div('rev', 'bh'))} AS avg_billing_rate FROM (SELECT {sel}, sum(CASE WHEN time_type_clean = 'Billable' THEN billing_amount ELSE 0 END) AS rev, sum({_bill}) AS bh, sum(hours_worked) AS th FROM r_timecards t LEFT JOIN r_projects p ON t.project_id = p.project_id
    LEFT JOIN (SELECT employee_id, job_level FROM r_employees WHERE is_latest_snapshot) e ON t.employee_id = e.employee_id GROUP BY ALL) {sj} {oj}"""


query("SM1_metric_view_by_practice", _view_sql(["practice_area"], ["practice_area"], ["practice_area"]))(lambda f: sm.metric_view(f, ["practice_area"]))
query("SM2_metric_view_by_month_and_place", _view_sql(["fiscal_period", "region", "location", "industry"], ["region", "location", "industry"], ["region", "location", "industry"]))(
    lambda f: sm.metric_view(f, ["fiscal_period", "region", "location", "industry"]))
query("SM3_metric_view_by_level", _view_sql(["job_level"], ["job_level"], []))(lambda f: sm.metric_view(f, ["job_level"]))
query("SM6_bill_rate", f"SELECT job_level, {div('sum(billing_amount)', 'sum(hours_worked)')} AS rate FROM r_timecards t JOIN (SELECT employee_id, job_level FROM r_current) e ON t.employee_id = e.employee_id WHERE time_type_clean = 'Billable' GROUP BY 1")(
    lambda f: sm.measure(f, sm.select_where(f, f.table("fact_timecards"), "Billable Time").join(f.table("dim_employees").where(F.col("is_current") & F.col("is_latest_snapshot")).select("employee_id", "job_level"), ["employee_id"]),
                         ["job_level"], {"rate": "Average Billing Rate"}))
_CH = f"({dbl('c')} - {dbl('p')}) / {dbl('p')} * 100"
_small = f"(SELECT location, count(*) FILTER (fiscal_period = {back(1)}) AS c, count(*) FILTER (fiscal_period = {back(13)}) AS p FROM r_pnl GROUP BY 1)"


@query("SM6b_small_base_change", f"SELECT location, c - p AS change_abs, CASE WHEN p >= 5 THEN {rnd(_CH, 2)} END AS change_pct, coalesce(abs(CASE WHEN p >= 5 THEN {rnd(_CH, 2)} END) > 100, false) AS flagged FROM {_small}")
def _small_base(f):
    cells = f.table("regional_pnl").groupBy("location").agg(*[F.count(F.when(F.col("fiscal_period") == F.lit(f.periods.month(n)), 1)).alias(c) for c, n in (("c", 1), ("p", 13))])
    change, change_pct, flag = sm.safe_change(F.col("c"), F.col("p"), "headcount")
    return cells.select("location", change.alias("change_abs"), change_pct.alias("change_pct"), flag.alias("flagged"))


_std = "sum(CASE WHEN time_type_clean = 'Billable' THEN CAST(hours_worked * billing_rate AS DECIMAL(38,6)) END)"
query("SM7_realization", f"""SELECT region, practice_area, a AS accrual_rate, bl AS billing_rate, cl AS collection_rate FROM (SELECT region, practice_area, {div('sum(total_revenue)', 'sum(budgeted_revenue)')} AS a FROM r_pnl GROUP BY 1, 2)
    FULL JOIN (SELECT region, practice_area, {div('sum(billing_amount)', _std)} AS bl FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY 1, 2) USING (region, practice_area)
    FULL JOIN (SELECT region, practice_area, {div("sum(CASE WHEN payment_status = 'Paid' THEN amount ELSE 0 END)", 'sum(amount)')} AS cl FROM r_ar GROUP BY 1, 2) USING (region, practice_area)""")(lambda f: sm.realization(f, ["region", "practice_area"]))
query("SM8_hours_per_partner_month", f"SELECT fiscal_month, {div(f'sum({_bill})', 'count(DISTINCT t.employee_id)')} AS hours_per_partner FROM r_timecards t WHERE employee_id IN (SELECT employee_id FROM r_current WHERE job_level = 'Partner') GROUP BY 1")(
    lambda f: f.table("fact_timecards").join(f.table("dim_employees").where(F.col("is_current") & F.col("is_latest_snapshot") & (F.col("job_level") == "Partner")), ["employee_id"], "left_semi")
    .groupBy("fiscal_month", "employee_id").agg(sum_if(billable(), "hours_worked").alias("h")).groupBy("fiscal_month").agg((as_double(F.sum("h")) / as_double(F.count("employee_id"))).alias("hours_per_partner")))
_FIVE, _WORK = "region location practice_area industry customer", "project_type project_status"
# text columns of every table of the layer, without names, free text and keys
_TEXT = {
    "dim_clients": ("r_clients", f"{_FIVE} client_type client_status"), "dim_employees": ("r_employees", f"{_FIVE} employment_status job_level job_family office_name country employee_type"),
    "dim_projects": ("r_projects", f"{_FIVE} {_WORK} contract_number billing_frequency"), "fact_timecards": ("r_timecards", f"{_FIVE} timecard_id time_type_clean approval_status revenue_category"),
    **{t: (r, f"{_FIVE} expense_item_id approval_status expense_type receipt_status department_category expense_category_business") for t, r in (("expenses_as_filed", "r_expenses_filed"), ("fact_expenses", "r_expenses"))},
    "outlier_projects": ("r_outliers", "location"), "wip_unbilled": ("r_wip", f"{_FIVE} timecard_id time_type_clean approval_status revenue_category employee_name job_level job_family"),
    "fact_accounts_payable": ("r_ap", f"{_FIVE} invoice_id payment_status department aging_bucket"), "fact_accounts_receivable": ("r_ar", f"{_FIVE} payment_status aging_bucket"),
    "fact_general_ledger": ("r_gl", f"{_FIVE} account_type account_category"), "regional_pnl": ("r_pnl", f"{_FIVE} revenue_type"), "talent_supply_demand": ("r_talent", f"{_FIVE} job_level job_family"),
    "project_profitability": ("r_profit", f"{_FIVE} {_WORK}"), "project_profitability_monthly": ("r_profit_monthly", f"{_FIVE} {_WORK}"),
    "receivables_wip_aging": ("r_recv", f"{_FIVE} category record_id invoice_number payment_status aging_bucket"), "ar_snapshot_aging": ("r_snap", "region location aging_bucket"),
    "te_contract_audit": ("r_audit", f"{_FIVE} {_WORK} contract_number budget_risk_level"), "enterprise_metrics": ("r_ent", _FIVE),
    "payables_aging": ("r_payables", f"{_FIVE} invoice_number aging_bucket department vendor_classification fiscal_period payment_status"), "enterprise_summary": ("r_summary", f"{_FIVE} metric_name"),
    "practice_area_summary": ("r_practice", _FIVE), "department_summary": ("r_dept", f"{_FIVE} department department_lead"), "partner_metrics": ("r_partner", f"{_FIVE} partner_name"),
}
query("SM9_enum_columns", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest({list(cs.split())}) AS column_name, unnest([{', '.join(f'count(DISTINCT {c})' for c in cs.split())}]) AS distinct_values FROM {r}" for t, (r, cs) in _TEXT.items()) + ") WHERE distinct_values BETWEEN 2 AND 1024")(
    lambda f: sm.enum_columns({t: f.table(t) for t in BUILDERS}))
