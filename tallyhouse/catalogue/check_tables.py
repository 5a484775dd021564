"""The sample firm's tables in plain SQL, for checking the Spark plans on another engine.

Written separately from the Spark builders and in different terms (ranked joins instead of
calendars, inequality joins instead of generated months), so agreement means something.
A check names the ``r_*`` tables it needs; ``with_tables`` puts their definitions in front.
"""

from __future__ import annotations

import re

from tallyhouse.plans.policy import SAMPLE_POLICY as P
from tallyhouse.sources.sample import (DEPARTMENTS, ENGAGEMENT_TYPES, EXPENSE_TYPES, INDUSTRIES, JOB_LEVELS, PRACTICES, VENDORS)

DIM = "region, location, practice_area, industry, customer"
ASOF = "(SELECT d FROM r_asof)"


def b(expr: str, n: int) -> str:
    """Stable bucket."""
    return f"(CAST(concat('0x', substr(md5(CAST({expr} AS VARCHAR)), 1, 7)) AS BIGINT) % {n})"


def rnd(expr: str, n: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {n}) AS DOUBLE)"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def div(a: str, c: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({c} AS DOUBLE), 0))"


def pct(a: str, c: str) -> str:
    return f"({div(a, c)} * 100.0)"


def pick(names: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({index} AS INTEGER) + 1)"


def month(expr: str) -> str:
    return f"CAST(date_trunc('month', {expr}) AS DATE)"


def back(n: int) -> str:
    """First day of the month n months before the as-of month."""
    return f"CAST(date_trunc('month', {ASOF}) - INTERVAL {n} MONTH AS DATE)"


def case(column: str, table: dict, default: str) -> str:
    if not table:
        return default
    whens = " ".join(f"WHEN {key!r} THEN {value}" for key, value in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def months_between(a: str, c: str) -> str:
    """Months with a 31-day fraction; whole when both are the same day or both month ends."""
    whole = f"((year({a}) - year({c})) * 12 + month({a}) - month({c}))"
    ends = f"({a} = last_day({a}) AND {c} = last_day({c}))"
    return f"(CASE WHEN day({a}) = day({c}) OR {ends} THEN CAST({whole} AS DOUBLE) ELSE round({whole} + (day({a}) - day({c})) / 31.0, 8) END)"


def bucket_of(days: str) -> str:
    return f"CASE WHEN {days} <= 30 THEN '0-30 days' WHEN {days} <= 60 THEN '31-60 days' WHEN {days} <= 90 THEN '61-90 days' ELSE '90+ days' END"


def capped(cur: str, base: str, test: str) -> str:
    change = rnd(f"({dbl(f'({cur}) - ({base})')} / NULLIF({dbl(base)}, 0)) * 100.0", 2)
    return f"CASE WHEN {test} THEN least(greatest({change}, -100.0), 500.0) END"


def clean_open(c: str = "payment_status") -> str:
    return f"upper(coalesce({c}, '')) NOT IN ('PAID', 'CLOSED')"


def adjustments(rules, day: str) -> str:
    out = []
    for a in rules:
        tests = [f"{day} BETWEEN DATE '{a.first}' AND DATE '{a.last}'"]
        tests += [f"{col} IN ({', '.join(repr(v) for v in vals)})" for col, vals in a.where.items()]
        out.append(f"(CASE WHEN {' AND '.join(tests)} THEN {a.factor} ELSE 1.00 END)")
    return " * ".join(out)


def level_share() -> str:
    parts = " ".join(f"WHEN {name!r} THEN {low} + {b('timecard_id', spread)} * 0.01" for name, (low, spread) in P.level_hours.items())
    return f"CASE job_level {parts} ELSE 1 END"


T: dict[str, str] = {}

T["r_asof"] = "SELECT CAST(greatest((SELECT max(l_shipdate) FROM lineitem), (SELECT max(o_orderdate) FROM orders)) AS DATE) AS d"
T["r_geo"] = """SELECT c_custkey, c_acctbal, c_name AS customer, c_mktsegment AS industry, n_name AS location, r_name AS region, n_nationkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
T["r_orders"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(38,4)) AS price, CAST(o_orderdate AS DATE) AS order_date,
    region, location, o_orderpriority AS practice_area, industry, customer FROM orders JOIN r_geo ON o_custkey = c_custkey"""
T["r_staff"] = f"""SELECT s_suppkey, s_name, s_nationkey, r_name AS region, n_name AS location, {pick(PRACTICES, 's_suppkey % 5')} AS practice_area,
    {pick(INDUSTRIES, 's_suppkey % 5')} AS industry, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS customer
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
T["r_lines"] = f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS line_id,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(38,4)) AS qty,
    CAST(l_extendedprice AS DECIMAL(38,2)) AS price, CAST(l_discount AS DECIMAL(6,2)) AS discount, CAST(l_tax AS DECIMAL(6,2)) AS tax,
    CAST(l_shipdate AS DATE) AS ship_date FROM lineitem"""

T["r_accounts"] = f"""SELECT c_custkey AS account_id, CASE WHEN v = 0 THEN customer || ' (old)' ELSE customer END AS account_name, industry,
    {pick(['Enterprise', 'Mid-Market', 'Public'], 'c_custkey % 3')} AS account_type, CASE WHEN c_custkey % 7 = 0 THEN c_custkey // 7 END AS parent_account_id,
    CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS account_status,
    CAST(c_acctbal AS DECIMAL(18,4)) AS annual_revenue, region, location, {pick(PRACTICES, 'c_custkey % 5')} AS practice_area, customer,
    DATE '2000-01-01' + CAST(c_custkey % 200 + v * 30 AS INTEGER) AS last_modified_date FROM r_geo, (VALUES (0), (1)) AS ver(v)"""
T["r_clients"] = f"""SELECT account_id AS client_id, account_name AS client_name, industry, account_type AS client_type, parent_account_id AS parent_client_id,
    annual_revenue, coalesce(account_status, 'Active') AS client_status, region, location, practice_area, customer, last_modified_date
    FROM r_accounts a WHERE last_modified_date = (SELECT max(x.last_modified_date) FROM r_accounts x WHERE x.account_id = a.account_id)"""

T["r_people"] = f"""SELECT s_suppkey AS employee_id, 'F' || s_suppkey AS first_name, 'L' || s_suppkey AS last_name,
    DATE '1993-01-01' + CAST(s_suppkey * 37 % 3100 AS INTEGER) AS hire_date,
    CASE WHEN s_suppkey % 9 = 0 THEN DATE '1993-01-01' + CAST(s_suppkey * 37 % 3100 AS INTEGER) + 1500 END AS termination_date,
    {pick(JOB_LEVELS, 's_suppkey % 7')} || ' Consultant' AS job_title, {pick(JOB_LEVELS, 's_suppkey % 7')} AS job_level,
    {pick(['Advisory', 'Delivery'], 's_suppkey % 2')} AS job_profile, CASE WHEN s_suppkey % 4 <> 0 THEN 'Regular' END AS employee_type,
    s_nationkey AS cost_center, s_suppkey // 10 AS manager_id, {DIM} FROM r_staff"""
T["r_months"] = f"""SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS snapshot_date
    FROM (SELECT unnest(generate_series({back(36)}, {back(1)}, INTERVAL 1 MONTH)) AS m)"""
_level = "job_level"
for _rule in P.promotions:
    _level = (f"CASE WHEN p.job_level = '{_rule.level}' AND snapshot_date >= DATE '{_rule.since}' AND {b('employee_id', 1000)} < {_rule.per_mille} "
              f"THEN '{_rule.to}' ELSE {_level} END")
T["r_employees"] = f"""SELECT employee_id, first_name, last_name, first_name || ' ' || last_name AS full_name, hire_date, termination_date,
    CASE WHEN termination_date <= snapshot_date THEN 'Terminated' WHEN hire_date > snapshot_date THEN 'Pre-Hire' ELSE 'Active' END AS employment_status,
    job_title AS position_title, {_level} AS job_level, job_profile AS job_family, 'Office A ' || n_name AS office_name, n_name AS country, manager_id, cost_center,
    coalesce(employee_type, 'Regular') AS employee_type, coalesce(termination_date, DATE '9999-12-31') AS effective_end_date,
    (termination_date IS NULL OR termination_date > snapshot_date) AND hire_date <= snapshot_date AS is_current, month_start = {back(1)} AS is_latest_snapshot,
    {DIM}, snapshot_date
    FROM r_people p CROSS JOIN r_months LEFT JOIN nation ON cost_center = n_nationkey
    WHERE hire_date <= snapshot_date AND (termination_date IS NULL OR termination_date >= month_start OR month_start = {back(1)})"""
T["r_current"] = "SELECT * FROM r_employees WHERE is_current AND is_latest_snapshot"

T["r_engagements"] = f"""SELECT o_orderkey AS engagement_id, customer || ' - ' || {pick(ENGAGEMENT_TYPES, 'o_orderkey % 4')} || ' - ' || o_orderkey AS engagement_name,
    o_custkey AS account_id, {pick(ENGAGEMENT_TYPES, 'o_orderkey % 4')} AS engagement_type, o_custkey % 120 AS lead_partner, o_custkey * 7 % 100 AS engagement_manager,
    order_date AS start_date, CASE WHEN o_orderkey % 17 <> 0 THEN order_date + CAST((o_orderkey % 24 + 1) * 30 AS INTEGER) END AS end_date,
    CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'On Hold' ELSE 'Completed' END AS status, price, {DIM} FROM r_orders"""
T["r_staffing"] = """SELECT l_orderkey AS project_id, count(DISTINCT l_suppkey) AS heads, count(*) FILTER (l_linestatus = 'O') AS act,
    count(*) FILTER (l_linestatus <> 'O') AS plan, sum(qty) AS alloc, count(*) AS n FROM r_lines GROUP BY 1"""
_capacity = f"greatest({months_between('coalesce(end_date, start_date + 365)', 'start_date')} / 12.0 * 2080.0, 1.0)"
T["r_projects"] = f"""SELECT engagement_id AS project_id, engagement_name AS project_name, account_id AS client_id, engagement_type AS project_type,
    lead_partner AS lead_partner_id, engagement_manager AS project_manager_id, start_date AS project_start_date, end_date AS project_end_date,
    CAST(500 + {b('engagement_id', 4500)} AS INTEGER) AS planned_hours, price AS planned_revenue, CAST(price * {P.planned_cost_share} AS DECIMAL(38,4)) AS planned_cost,
    price - CAST(price * {P.planned_cost_share} AS DECIMAL(38,4)) AS planned_margin, CASE WHEN price > 0 THEN 32.0::DOUBLE ELSE 0 END AS planned_margin_pct,
    CASE WHEN engagement_id % 13 <> 0 THEN engagement_id END AS contract_id, CASE WHEN engagement_id % 13 <> 0 THEN 'C-' || engagement_id END AS contract_number,
    CASE WHEN engagement_id % 13 <> 0 THEN CAST(price * 1.2 AS DECIMAL(38,4)) END AS total_contract_value,
    CASE WHEN engagement_id % 13 <> 0 THEN {pick(['Monthly', 'Quarterly'], 'engagement_id % 2')} END AS billing_frequency,
    status AS project_status, status IN ('Active', 'In Progress', 'Open') AS is_active,
    coalesce(heads, 0) AS assigned_headcount, coalesce(act, 0) AS active_assignments, coalesce(plan, 0) AS planned_assignments,
    coalesce({rnd(div('alloc', 'n'), 1)}, 0.0) AS avg_allocation_pct,
    CAST(ceil(CAST(500 + {b('engagement_id', 4500)} AS DOUBLE) * (2.0::DOUBLE + {b("(engagement_id || 'req')", 60)} / 100.0::DOUBLE) / {_capacity}) AS BIGINT) AS required_headcount,
    {DIM} FROM r_engagements LEFT JOIN r_staffing ON engagement_id = project_id"""

T["r_billing_rates"] = """SELECT s_suppkey AS employee_id, CAST(100 + s_suppkey % 50 + (y - 1995) * 5 AS DECIMAL(18,4)) AS rate, make_date(y, 1, 1) AS eff,
    CASE WHEN s_suppkey % 4 = 0 AND y = 1997 THEN NULL ELSE make_date(y, 12, 31) END AS fin FROM supplier, range(1995, 2002) AS years(y)
    UNION ALL SELECT s_suppkey, CAST(200 + s_suppkey % 7 AS DECIMAL(18,4)), make_date(y, 7, 1), NULL FROM supplier, range(1996, 1998) AS years(y) WHERE s_suppkey % 4 = 0"""
T["r_cost_rates"] = """SELECT s_suppkey AS employee_id, CAST(40 + s_suppkey % 30 + (y - 1995) * 2 AS DECIMAL(18,4)) AS rate, make_date(y, 1, 1) AS eff,
    make_date(y, 12, 31) AS fin FROM supplier, range(1995, 2002) AS years(y) WHERE y <> 1998"""
for _side in ("billing", "cost"):
    T[f"r_{_side}_rate_of"] = f"""SELECT line_id, rate FROM (SELECT line_id, rate, row_number() OVER (PARTITION BY line_id ORDER BY eff DESC, coalesce(fin, DATE '9999-12-31') DESC, rate DESC) AS rn
        FROM r_lines JOIN r_{_side}_rates ON l_suppkey = employee_id AND ship_date BETWEEN eff AND coalesce(fin, DATE '9999-12-31')) WHERE rn = 1"""
T["r_cards"] = f"""SELECT l.line_id AS timecard_id, l_suppkey AS employee_id, l_orderkey AS project_id, ship_date AS work_date,
    CASE l_returnflag WHEN 'A' THEN 'Billable' WHEN 'N' THEN 'Non-Billable' ELSE 'PTO' END AS time_type, qty AS hours,
    coalesce(br.rate, 80 + l_linenumber * 10) AS bill_rate, coalesce(cr.rate, 30 + l_linenumber * 2) AS cost_rate,
    CASE WHEN l_linenumber = 7 THEN 'Rejected' WHEN l_linestatus = 'F' THEN 'Approved' ELSE 'Submitted' END AS approval_status,
    region, location, practice_area, industry, customer, job_level
    FROM r_lines l JOIN r_orders ON l_orderkey = o_orderkey LEFT JOIN r_billing_rate_of br ON br.line_id = l.line_id
    LEFT JOIN r_cost_rate_of cr ON cr.line_id = l.line_id LEFT JOIN (SELECT employee_id, job_level FROM r_people) pp ON l_suppkey = pp.employee_id"""
T["r_worked"] = f"""SELECT *, CAST(hours * {adjustments(P.hour_adjustments, 'work_date')} AS DECIMAL(38,6)) AS adjusted FROM r_cards"""
T["r_credited"] = f"""SELECT *, CASE WHEN time_type = 'Billable' THEN CAST(adjusted * CAST({level_share()} AS DECIMAL(6,4)) *
    CAST({case('practice_area', P.practice_premium, '1')} AS DECIMAL(6,4)) AS DECIMAL(38,6)) ELSE adjusted END AS hours_worked FROM r_worked"""
_clean = f"""CASE WHEN time_type = 'Billable' AND work_date >= {ASOF} - {P.bench_days} AND {b('employee_id', 100)} < {P.bench_percent} THEN 'Non-Billable'
    WHEN time_type = 'PTO' THEN 'Time Off' ELSE time_type END"""
_slot = b("customer", 100)
T["r_timecards"] = f"""SELECT timecard_id, employee_id, project_id, work_date, {_clean} AS time_type_clean, hours_worked,
    CASE WHEN time_type = 'Billable' THEN bill_rate ELSE 0 END AS billing_rate, cost_rate,
    CASE WHEN time_type = 'Billable' THEN CAST(hours_worked * CAST({case('location', P.office_rate, '1')} AS DECIMAL(6,4)) * bill_rate AS DECIMAL(38,4)) ELSE 0 END AS billing_amount,
    CASE WHEN time_type = 'Billable' THEN CAST(hours_worked * cost_rate AS DECIMAL(38,4)) ELSE 0 END AS cost_amount,
    approval_status, {DIM}, CASE WHEN {_clean} <> 'Billable' THEN 'Other' WHEN {_slot} < 9 THEN 'Products' WHEN {_slot} < 22 THEN 'Partnerships'
    WHEN {_slot} < 26 THEN 'Other' ELSE 'Billable' END AS revenue_category, {month('work_date')} AS fiscal_month FROM r_credited"""

T["r_cost_centers"] = f"SELECT n_nationkey AS cost_center_code, {pick(DEPARTMENTS, 'n_nationkey % 8')} AS department_category FROM nation"
T["r_items"] = f"""SELECT line_id AS expense_id, l_orderkey AS report_id, ship_date AS transaction_date, {pick(EXPENSE_TYPES, 'l_linenumber % 7')} AS expense_type,
    r_lines.price * tax AS raw_amount, l_linenumber % 3 = 0 AS is_billable, l_linestatus = 'F' AS has_receipt, s_name AS vendor_name,
    CASE WHEN l_linenumber <> 5 THEN l_orderkey END AS project_id, region, location, practice_area, industry, customer,
    o_custkey % 100 AS employee_id, order_date AS submit_date, CASE WHEN o_orderkey % 5 = 0 THEN 'Submitted' ELSE 'Approved' END AS approval_status,
    CAST(o_orderkey % 25 AS INTEGER) AS cost_center, department_category
    FROM r_lines JOIN r_orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN r_cost_centers ON o_orderkey % 25 = cost_center_code WHERE l_returnflag = 'R'"""
_group = "CASE WHEN department_category IN ('FINANCE', 'HR', 'LEGAL', 'EXECUTIVE') THEN 'Corporate' WHEN department_category IN ('MARKETING', 'SALES') THEN 'Marketing' WHEN department_category IN ('IT', 'R&D', 'TECHNOLOGY', 'ENGINEERING') THEN 'Technology' ELSE 'Other' END"
_var = (f"(1 + {case('location', P.expense_office_variance, '0')} + {case(_group, P.expense_group_variance, '0')} + "
        f"{case('month(transaction_date)', P.expense_month_variance, '0')} + ({b('expense_id', 31)} - 15) * 0.001)")
T["r_expenses_filed"] = f"""SELECT expense_id AS expense_item_id, report_id AS expense_report_id, employee_id, submit_date AS submission_date, approval_status,
    transaction_date AS expense_date, expense_type, amount, is_billable, vendor_name AS merchant_name, CASE WHEN has_receipt THEN 'Received' ELSE 'Missing' END AS receipt_status,
    cost_center, project_id, {DIM}, department_category, CASE WHEN is_billable THEN 'Billable' ELSE {_group} END AS expense_category_business,
    CAST(round(CAST({dbl('amount')} / {dbl(_var)} AS DECIMAL(38,8)), 2) AS DECIMAL(38,4)) AS budgeted_amount, {month('transaction_date')} AS fiscal_month
    FROM (SELECT *, CAST(raw_amount * {adjustments(P.expense_adjustments, 'transaction_date')} AS DECIMAL(38,4)) AS amount FROM r_items)"""
_low, _high = P.outlier_contract_range
T["r_outliers"] = f"""SELECT project_id, location, total_contract_value, current_te, row_count, target_total_te FROM (
    SELECT project_id, location, total_contract_value, current_te, row_count, CAST(total_contract_value * (0.065 + {b('project_id', 30)} * 0.001) AS DECIMAL(38,4)) AS target_total_te,
    row_number() OVER (PARTITION BY location ORDER BY total_contract_value DESC, project_id) AS rn FROM r_projects JOIN (
    SELECT project_id, sum(amount) AS current_te, count(*) AS row_count FROM r_expenses_filed WHERE expense_category_business = 'Billable' AND project_id IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 2 AND sum(amount) > 0) USING (project_id)
    WHERE is_active AND total_contract_value BETWEEN {_low} AND {_high}) WHERE rn = 1 ORDER BY total_contract_value DESC, project_id LIMIT {P.outlier_projects}"""
T["r_expenses"] = f"""SELECT e.* REPLACE (CASE WHEN o.project_id IS NOT NULL AND expense_category_business = 'Billable'
    THEN CAST(round(CAST({dbl('amount')} * ({dbl('target_total_te')} / {dbl('current_te')}) AS DECIMAL(38,8)), 2) AS DECIMAL(38,4)) ELSE amount END AS amount)
    FROM r_expenses_filed e LEFT JOIN (SELECT project_id, target_total_te, current_te FROM r_outliers) o ON e.project_id = o.project_id"""
T["r_wip"] = f"""SELECT t.timecard_id, t.employee_id, e.full_name AS employee_name, e.job_level, e.job_family, t.project_id, p.project_name, p.client_id, c.client_name, p.lead_partner_id,
    lp.full_name AS lead_partner_name, p.project_manager_id, pm.full_name AS project_manager_name, t.work_date, t.hours_worked, t.billing_rate, t.cost_rate, t.billing_amount, t.cost_amount,
    t.billing_amount - t.cost_amount AS margin_amount, t.time_type_clean, t.revenue_category, t.approval_status, t.approval_status IN ('Approved', 'Submitted') AS is_wip,
    t.region, t.location, t.practice_area, t.industry, t.customer, t.fiscal_month
    FROM r_timecards t LEFT JOIN r_current e ON t.employee_id = e.employee_id LEFT JOIN r_projects p ON t.project_id = p.project_id
    LEFT JOIN r_clients c ON p.client_id = c.client_id LEFT JOIN r_current lp ON p.lead_partner_id = lp.employee_id LEFT JOIN r_current pm ON p.project_manager_id = pm.employee_id
    WHERE t.time_type_clean = 'Billable' AND t.work_date >= {ASOF} - 45"""

_vendor = f"CASE WHEN l_suppkey % 30 < {len(VENDORS)} THEN {pick(VENDORS, f'least(l_suppkey % 30, {len(VENDORS) - 1})')} ELSE s_name END"
_apstate = "CASE WHEN l_linestatus = 'F' THEN 'Paid' WHEN l_returnflag = 'R' THEN 'Overdue' WHEN l_linenumber = 3 THEN 'Partially Paid' ELSE 'Open' END"
T["r_payables_raw"] = f"""SELECT line_id AS invoice_id, l_suppkey AS vendor_id, {_vendor} AS vendor_name, ship_date AS invoice_date, ship_date + 45 AS due_date,
    price * (1 - discount) AS amount, {_apstate} AS payment_status, CASE WHEN l_linestatus = 'F' THEN ship_date + 45 + CAST(l_orderkey * 3 % 100 - 10 AS INTEGER) END AS payment_date,
    {pick(DEPARTMENTS, 'l_linenumber % 8')} AS department, {DIM} FROM r_lines JOIN r_staff ON l_suppkey = s_suppkey"""
_i = lambda n: b("invoice_id", n)
T["r_ap_aged"] = f"""SELECT *, CAST(CASE payment_status WHEN 'Paid' THEN greatest(coalesce(payment_date, due_date) - due_date, 0) WHEN 'Overdue' THEN 60 + {_i(35)}
    WHEN 'Partially Paid' THEN 35 + {_i(25)} ELSE CASE WHEN {_i(100)} < 70 THEN {_i(31)} WHEN {_i(100)} < 95 THEN 31 + {_i(30)} ELSE 61 + {_i(30)} END END AS INTEGER) AS days_outstanding FROM r_payables_raw"""
T["r_ap"] = f"""SELECT invoice_id, vendor_id, vendor_name, invoice_date, due_date, amount, payment_status, payment_date, department, days_outstanding,
    {bucket_of('days_outstanding')} AS aging_bucket, {DIM}, {month('invoice_date')} AS fiscal_month FROM r_ap_aged"""
T["r_invoices"] = f"""SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, customer AS customer_name, order_date + 95 AS invoice_date, order_date + 125 AS due_date, price AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Open' ELSE 'Partially Paid' END AS payment_status,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 23 <> 0 THEN order_date + CAST(o_orderkey * 7 % 120 + 100 AS INTEGER) END AS payment_date,
    CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey WHEN o_orderkey % 20 = 3 THEN -o_orderkey END AS project_id, {DIM} FROM r_orders"""
_age = f"CASE WHEN payment_status = 'Paid' THEN coalesce(payment_date, invoice_date + 45) - invoice_date ELSE {ASOF} - invoice_date END"
T["r_ar"] = f"""SELECT i.invoice_id, customer_id, customer_name, invoice_date, due_date, amount, payment_status, payment_date,
    CAST(least(greatest({_age}, 0), 365) AS INTEGER) AS days_outstanding, {bucket_of(f'({_age})')} AS aging_bucket, i.project_id,
    coalesce(full_name, 'Unassigned') AS lead_partner_name, i.region, i.location, i.practice_area, i.industry, i.customer, {month('invoice_date')} AS fiscal_month
    FROM r_invoices i LEFT JOIN (SELECT project_id, lead_partner_id FROM r_projects) p ON i.project_id = p.project_id LEFT JOIN (SELECT employee_id, full_name FROM r_current) ON lead_partner_id = employee_id"""
T["r_gl"] = f"""SELECT o_orderkey * 2 + side AS entry_id, order_date AS posting_date,
    CASE WHEN side = 1 THEN 'Revenue' WHEN o_orderkey % 9 = 0 THEN 'Suspense' ELSE 'Asset' END AS account_type,
    CASE WHEN side = 1 THEN 'Revenue' WHEN o_orderkey % 9 = 0 THEN 'Other' ELSE 'Asset' END AS account_category,
    CASE WHEN side = 0 THEN price ELSE 0 END AS debit_amount, CASE WHEN side = 1 THEN price ELSE 0 END AS credit_amount,
    CASE WHEN side = 0 THEN price ELSE -price END AS net_amount, CAST(year(order_date) AS INTEGER) AS fiscal_year, CAST(month(order_date) AS INTEGER) AS fiscal_period, {DIM}
    FROM r_orders, (VALUES (0), (1)) AS sides(side)"""

# business aggregates
_share = f"({dbl(case('region', P.overhead_region, P.overhead_default))} * {dbl(case('practice_area', P.overhead_practice, '1'))} * {dbl(f'(0.92 + ' + b('location', 16) + ' * 0.01)')})"
_cats = {"billable": "= 'Billable'", "corporate": "= 'Corporate'", "marketing": "= 'Marketing'", "tech": "= 'Technology'",
         "other": "NOT IN ('Billable', 'Corporate', 'Marketing', 'Technology')"}
T["r_pnl_rev"] = f"""SELECT {DIM}, fiscal_month AS fiscal_period, sum(billing_amount) AS total_revenue, sum(cost_amount) AS total_cost_of_delivery, sum(hours_worked) AS total_hours
    FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY ALL"""
T["r_pnl_type"] = f"""SELECT {DIM}, fiscal_period, revenue_category AS revenue_type FROM (SELECT {DIM}, fiscal_month AS fiscal_period, revenue_category,
    row_number() OVER (PARTITION BY {DIM}, fiscal_month ORDER BY sum(billing_amount) DESC, revenue_category) AS rn FROM r_timecards WHERE time_type_clean = 'Billable'
    GROUP BY {DIM}, fiscal_month, revenue_category) WHERE rn = 1"""
T["r_pnl_exp"] = f"""SELECT {DIM}, fiscal_month AS fiscal_period, sum(amount) AS total_expenses, sum(budgeted_amount) AS budgeted_expenses, {', '.join(
    f"sum(CASE WHEN expense_category_business {t} THEN amount ELSE 0 END) AS {n}_expenses, sum(CASE WHEN expense_category_business {t} THEN budgeted_amount ELSE 0 END) AS budgeted_{n}_expenses"
    for n, t in _cats.items())} FROM r_expenses WHERE project_id IS NULL OR project_id NOT IN (SELECT project_id FROM r_outliers) GROUP BY ALL"""
_expcols = ["total_expenses", "budgeted_expenses"] + [f"{x}{n}_expenses" for n in _cats for x in ("", "budgeted_")]
_budgetvar = (f"(1 + {case('location', P.revenue_office_variance, '0')} + {case('practice_area', P.revenue_practice_variance, '0')} + "
              f"({b(chr(40) + 'practice_area' + chr(32) + '|| ' + repr('|') + ' || region || ' + repr('|') + ' || location || ' + repr('|') + ' || strftime(fiscal_period, ' + repr('%Y-%m') + ')' + chr(41), 31)} - 15) * 0.001)")
T["r_pnl_cells"] = f"""SELECT r.*, revenue_type, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _expcols)} FROM r_pnl_rev r LEFT JOIN r_pnl_exp USING ({DIM}, fiscal_period) LEFT JOIN r_pnl_type USING ({DIM}, fiscal_period)"""
_opinc = f"({dbl('total_revenue')} - {dbl('total_cost_of_delivery')} - {dbl('total_revenue')} * {_share})"
T["r_pnl_base"] = f"""SELECT *, CAST(year(fiscal_period) AS INTEGER) AS fiscal_year, CAST(month(fiscal_period) AS INTEGER) AS fiscal_month, {dbl('total_cost_of_delivery')} * {_share} AS sga_overhead, {_opinc} AS operating_income,
    CASE WHEN total_revenue > 0 THEN {rnd(f"{_opinc} / {dbl('total_revenue')} * 100", 2)} ELSE 0.0 END AS operating_margin_pct, total_revenue - total_cost_of_delivery AS gross_profit,
    CASE WHEN total_revenue > 0 THEN {rnd(pct('total_revenue - total_cost_of_delivery', 'total_revenue'), 2)} ELSE 0.0 END AS gross_margin_pct,
    lag(total_revenue, 12) OVER (PARTITION BY {DIM} ORDER BY fiscal_period) AS prev_year_revenue,
    CAST(round(CAST({dbl('total_revenue')} / {dbl(_budgetvar)} AS DECIMAL(38,8)), 2) AS DECIMAL(38,4)) AS budgeted_revenue FROM r_pnl_cells"""
T["r_pnl"] = f"""SELECT a.*, (SELECT max(x.total_revenue) FROM r_pnl_cells x WHERE x.region = a.region AND x.location = a.location AND x.practice_area = a.practice_area
    AND x.industry = a.industry AND x.customer = a.customer AND x.fiscal_period = CAST(a.fiscal_period - INTERVAL 12 MONTH AS DATE)) AS prev_year_revenue_calendar,
    {capped('total_revenue', 'prev_year_revenue', 'prev_year_revenue > 0')} AS revenue_yoy_growth_pct FROM r_pnl_base a"""
PNL_COLUMNS = f"""{DIM}, fiscal_period, fiscal_year, fiscal_month, {', '.join(dbl(c) + ' AS ' + c for c in ['total_revenue', 'total_cost_of_delivery', 'total_hours', *_expcols])},
    revenue_type, sga_overhead, operating_income, operating_margin_pct, {dbl('gross_profit')} AS gross_profit, gross_margin_pct, {dbl('prev_year_revenue')} AS prev_year_revenue,
    {dbl('prev_year_revenue_calendar')} AS prev_year_revenue_calendar, {dbl('budgeted_revenue')} AS budgeted_revenue, revenue_yoy_growth_pct"""

_dimeq = lambda x, y: " AND ".join(f"{x}.{d} = {y}.{d}" for d in DIM.split(", "))
_grp = f"{DIM}, job_level, job_family"
T["r_talent"] = f"""SELECT {_grp}, fiscal_period, coalesce(headcount, 0) AS supply_headcount, coalesce(active_billers, 0) AS active_billers, {dbl('coalesce(total_hours, 0)')} AS total_hours,
    {dbl('coalesce(billable_hours, 0)')} AS billable_hours, coalesce({rnd(pct('billable_hours', 'total_hours'), 2)}, 0.0) AS utilization_pct, coalesce(demand_projects, 0) AS demand_projects,
    CAST(coalesce(demand_hours, 0) AS BIGINT) AS demand_hours,
    CASE WHEN coalesce(headcount, 0) > 0 THEN {rnd("CAST(coalesce(demand_hours, 0) AS DOUBLE) / (CAST(headcount AS DOUBLE) * 160.0) * 100.0", 2)} ELSE 0.0 END AS demand_coverage_pct
    FROM (SELECT {_grp}, count(*) AS headcount FROM r_current GROUP BY ALL)
    FULL JOIN (SELECT e.region, e.location, e.practice_area, e.industry, e.customer, e.job_level, e.job_family, t.fiscal_month AS fiscal_period, count(DISTINCT t.employee_id) AS active_billers,
      sum(t.hours_worked) AS total_hours, sum(CASE WHEN time_type_clean = 'Billable' THEN t.hours_worked ELSE 0 END) AS billable_hours
      FROM r_timecards t LEFT JOIN r_current e ON t.employee_id = e.employee_id GROUP BY ALL) USING ({_grp})
    LEFT JOIN (SELECT {DIM}, count(*) AS demand_projects, sum(planned_hours) AS demand_hours FROM r_projects WHERE is_active GROUP BY ALL) USING ({DIM})"""
_adj = f"(CASE WHEN {b('p.project_id', 100)} < 12 THEN 1.20 + {b(chr(40) + 'p.project_id || ' + repr('margin') + chr(41), 30)} * 0.01 WHEN {b('p.project_id', 100)} >= 85 THEN 0.70 + {b(chr(40) + 'p.project_id || ' + repr('margin') + chr(41), 15)} * 0.01 ELSE 0.90 + {b(chr(40) + 'p.project_id || ' + repr('margin') + chr(41), 20)} * 0.01 END)"
T["r_pool"] = """SELECT region, practice_area, full_name, row_number() OVER (PARTITION BY region, practice_area ORDER BY employee_id) AS rn
    FROM r_current WHERE upper(position_title) LIKE '%PARTNER%' OR job_level = 'Partner'"""
T["r_activity"] = """SELECT project_id, sum(billing_amount) AS rev, sum(cost_amount) AS cost, sum(hours_worked) AS hrs, sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END) AS bill,
    min(work_date) AS d0, max(work_date) AS d1, count(DISTINCT employee_id) AS team FROM r_timecards GROUP BY 1"""
T["r_prof"] = f"""SELECT p.project_id, project_name, p.client_id, client_name, project_type, lead_partner_id, coalesce(lp.full_name, fp.full_name) AS lead_partner_name, project_manager_id,
    pm.full_name AS project_manager_name, project_start_date, project_end_date, project_status, is_active, planned_hours, planned_revenue, planned_cost, planned_margin, planned_margin_pct,
    contract_id, total_contract_value, coalesce(rev, 0) AS actual_revenue, coalesce(cost, 0) AS actual_cost, coalesce(exp, 0) AS actual_expenses,
    coalesce(rev, 0) - CAST(coalesce(cost, 0) * {_adj} AS DECIMAL(38,4)) - coalesce(exp, 0) AS actual_margin, coalesce(hrs, 0) AS actual_hours, coalesce(bill, 0) AS billable_hours,
    coalesce(team, 0) AS team_size, d0 AS first_timecard_date, d1 AS last_timecard_date, p.region, p.location, p.practice_area, p.industry, p.customer
    FROM r_projects p LEFT JOIN r_activity a ON p.project_id = a.project_id
    LEFT JOIN (SELECT project_id, sum(amount) AS exp FROM r_expenses WHERE project_id IS NOT NULL GROUP BY 1) x ON p.project_id = x.project_id
    LEFT JOIN (SELECT client_id, client_name FROM r_clients) c ON p.client_id = c.client_id LEFT JOIN (SELECT employee_id, full_name FROM r_current) lp ON lead_partner_id = lp.employee_id
    LEFT JOIN (SELECT employee_id, full_name FROM r_current) pm ON project_manager_id = pm.employee_id
    LEFT JOIN r_pool fp ON p.region = fp.region AND p.practice_area = fp.practice_area AND fp.rn = {b('p.project_id', 5)} + 1"""
T["r_profit"] = f"""SELECT *, CASE WHEN actual_revenue > 0 THEN {rnd(pct('actual_margin', 'actual_revenue'), 2)} ELSE 0.0 END AS actual_margin_pct, actual_revenue - planned_revenue AS revenue_variance,
    {capped('actual_revenue', 'planned_revenue', 'planned_revenue >= 1000')} AS revenue_variance_pct, actual_hours - planned_hours AS hours_variance,
    CASE WHEN planned_hours > 0 THEN {rnd(pct('actual_hours', 'planned_hours'), 2)} ELSE 0.0 END AS pct_hours_consumed,
    CASE WHEN planned_revenue > 0 THEN {rnd(pct('actual_revenue', 'planned_revenue'), 2)} ELSE 0.0 END AS pct_revenue_recognized FROM r_prof"""
PROFIT_MONEY = ["planned_revenue", "planned_cost", "planned_margin", "total_contract_value", "actual_revenue", "actual_cost", "actual_expenses", "actual_margin", "actual_hours", "billable_hours",
                "revenue_variance", "hours_variance"]
T["r_profit_monthly"] = f"""SELECT a.project_id, project_name, p.client_id, client_name, project_type, lead_partner_id, project_start_date, project_end_date, project_status, a.fiscal_month,
    CAST(year(a.fiscal_month) AS INTEGER) AS fiscal_year, CAST(month(a.fiscal_month) AS INTEGER) AS fiscal_month_num, rev AS actual_revenue, cost AS actual_cost, coalesce(exp, 0) AS actual_expenses,
    rev - cost AS actual_margin, CASE WHEN rev > 0 THEN {rnd(pct('rev - cost', 'rev'), 2)} END AS actual_margin_pct, hrs AS actual_hours, bill AS billable_hours, team AS team_size,
    CASE WHEN project_end_date > project_start_date AND planned_revenue > 0 THEN {dbl('planned_revenue')} /
      greatest((year(project_end_date) - year(project_start_date)) * 12 + month(project_end_date) - month(project_start_date) + 1, 1) END AS planned_revenue_monthly,
    p.region, p.location, p.practice_area, p.industry, p.customer
    FROM (SELECT project_id, fiscal_month, sum(billing_amount) AS rev, sum(cost_amount) AS cost, sum(hours_worked) AS hrs, sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END) AS bill,
      count(DISTINCT employee_id) AS team FROM r_timecards GROUP BY ALL) a JOIN r_projects p ON a.project_id = p.project_id
    LEFT JOIN (SELECT project_id, fiscal_month, sum(amount) AS exp FROM r_expenses GROUP BY ALL) x ON a.project_id = x.project_id AND a.fiscal_month = x.fiscal_month
    LEFT JOIN (SELECT client_id, client_name FROM r_clients) c ON p.client_id = c.client_id"""
_score = rnd(f"CAST(coalesce(days_outstanding, 0) AS DOUBLE) / 30.0 * 40.0 + log10(greatest(CAST(amount AS DOUBLE), 1.0)) * 20.0 + CASE category WHEN 'Client Invoice' THEN 15 WHEN 'Contractor' THEN 10 WHEN 'Non-FTE Vendor' THEN 5 ELSE 0 END", 2)
T["r_claims"] = f"""SELECT 'Client Invoice' AS category, CAST(invoice_id AS VARCHAR) AS record_id, customer_name AS counterparty_name, CAST(invoice_id AS VARCHAR) AS invoice_number, invoice_date, due_date, amount,
      greatest(days_outstanding, 0) AS days_outstanding, payment_status, project_id, {DIM} FROM r_ar WHERE {clean_open()}
    UNION ALL SELECT 'Contractor', timecard_id, client_name, NULL, work_date, NULL, CAST(billing_amount * 0.35 AS DECIMAL(38,4)), {ASOF} - work_date, 'Unbilled', project_id, {DIM} FROM r_wip WHERE is_wip AND {b('timecard_id', 5)} = 0
    UNION ALL SELECT 'Other', timecard_id, client_name, NULL, work_date, NULL, CAST(billing_amount * 0.10 AS DECIMAL(38,4)), {ASOF} - work_date, 'Unbilled', project_id, {DIM} FROM r_wip WHERE is_wip AND {b('timecard_id', 10)} = 1
    UNION ALL SELECT 'Non-FTE Vendor', expense_item_id, coalesce(merchant_name, 'Unknown Vendor'), CAST(expense_report_id AS VARCHAR), expense_date, expense_date + 45, amount, greatest({ASOF} - (expense_date + 45), 0),
      CASE WHEN approval_status = 'Approved' THEN 'Open' ELSE 'Pending' END, project_id, {DIM} FROM r_expenses WHERE is_billable AND expense_date >= {ASOF} - 150"""
T["r_recv"] = f"""SELECT category, record_id, counterparty_name, invoice_number, invoice_date, due_date, amount, CAST(days_outstanding AS INTEGER) AS days_outstanding, payment_status, c.project_id, project_name, lead_partner_id,
    lp.full_name AS lead_partner_name, project_manager_id, pm.full_name AS project_manager_name, {bucket_of('days_outstanding')} AS aging_bucket, {_score} AS collection_priority_score,
    c.region, c.location, c.practice_area, c.industry, c.customer FROM r_claims c LEFT JOIN (SELECT project_id, project_name, lead_partner_id, project_manager_id FROM r_projects) p ON c.project_id = p.project_id
    LEFT JOIN (SELECT employee_id, full_name FROM r_current) lp ON lead_partner_id = lp.employee_id LEFT JOIN (SELECT employee_id, full_name FROM r_current) pm ON project_manager_id = pm.employee_id"""
T["r_open"] = f"""SELECT snapshot_date, region, location, customer_name, amount, snapshot_date - invoice_date AS days_out
    FROM (SELECT last_day(CAST(m AS DATE)) AS snapshot_date FROM (SELECT unnest(generate_series({back(13)}, {back(1)}, INTERVAL 1 MONTH)) AS m))
    JOIN r_ar ON invoice_date <= snapshot_date AND (payment_date IS NULL OR payment_date > snapshot_date)"""
T["r_snap"] = f"""SELECT x.snapshot_date, region, location, customer_name, aging_bucket, bal AS open_ar_balance, invoice_count, {rnd(div('bal_days', 'bal'), 1)} AS weighted_dso_days,
    {rnd(div('fd', 'fb'), 1)} AS firmwide_dso_days, fb AS firmwide_open_ar
    FROM (SELECT snapshot_date, region, location, customer_name, {bucket_of('days_out')} AS aging_bucket, sum(amount) AS bal, sum(amount * days_out) AS bal_days, count(*) AS invoice_count FROM (SELECT * FROM r_open WHERE days_out BETWEEN 0 AND 365) GROUP BY ALL) x
    JOIN (SELECT snapshot_date, sum(amount) AS fb, sum(amount * days_out) AS fd FROM (SELECT * FROM r_open WHERE days_out BETWEEN 0 AND 365) GROUP BY 1) f ON x.snapshot_date = f.snapshot_date"""
_con = "coalesce(total_contract_value, 0)"
T["r_audit_base"] = f"""SELECT p.project_id, project_name, p.client_id, client_name, project_type, lead_partner_id, lp.full_name AS lead_partner_name, project_manager_id, pm.full_name AS project_manager_name, contract_id,
    contract_number, total_contract_value, planned_revenue, planned_hours, planned_cost, coalesce(hrs, 0) AS actual_hours, coalesce(bill, 0) AS actual_billed, coalesce(cost, 0) AS actual_time_cost,
    coalesce(exp, 0) AS actual_expenses, coalesce(bexp, 0) AS billable_expenses, coalesce(nexp, 0) AS expense_line_items, d0 AS earliest_work_date, d1 AS latest_work_date, project_status, is_active,
    p.region, p.location, p.practice_area, p.industry, p.customer FROM r_projects p
    LEFT JOIN (SELECT project_id, sum(hours_worked) AS hrs, sum(billing_amount) AS bill, sum(cost_amount) AS cost, min(work_date) AS d0, max(work_date) AS d1 FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY 1) t ON p.project_id = t.project_id
    LEFT JOIN (SELECT project_id, sum(amount) AS exp, sum(CASE WHEN is_billable THEN amount ELSE 0 END) AS bexp, count(*) AS nexp FROM r_expenses WHERE project_id IS NOT NULL GROUP BY 1) x ON p.project_id = x.project_id
    LEFT JOIN (SELECT client_id, client_name FROM r_clients) c ON p.client_id = c.client_id LEFT JOIN (SELECT employee_id, full_name FROM r_current) lp ON lead_partner_id = lp.employee_id
    LEFT JOIN (SELECT employee_id, full_name FROM r_current) pm ON project_manager_id = pm.employee_id"""
T["r_audit"] = f"""SELECT *, actual_billed + billable_expenses AS total_te_billed, actual_time_cost + actual_expenses AS total_te_cost,
    CASE WHEN {_con} > 0 THEN {rnd(pct('actual_billed + billable_expenses', _con), 2)} ELSE 0.0 END AS contract_utilization_pct, {_con} - actual_billed - billable_expenses AS contract_remaining,
    {capped('actual_billed', 'planned_revenue', 'planned_revenue >= 1000')} AS revenue_variance_pct, {capped('actual_hours', 'planned_hours', 'planned_hours >= 10')} AS hours_variance_pct,
    CASE WHEN {_con} > 0 AND {div('actual_billed + billable_expenses', _con)} > 0.9 THEN 'High' WHEN {_con} > 0 AND {div('actual_billed + billable_expenses', _con)} > 0.75 THEN 'Medium' ELSE 'Low' END AS budget_risk_level
    FROM r_audit_base"""
AUDIT_MONEY = ["total_contract_value", "planned_revenue", "planned_cost", "actual_hours", "actual_billed", "actual_time_cost", "actual_expenses", "billable_expenses", "total_te_billed", "total_te_cost", "contract_remaining"]
_cell = f"{DIM}, fiscal_period"
T["r_ar_months"] = f"""SELECT m.*, open_ar, n_open FROM (SELECT {DIM}, fiscal_month AS fiscal_period, sum(amount) AS billed FROM r_ar GROUP BY ALL) m
    LEFT JOIN (SELECT mb.region, mb.location, mb.practice_area, mb.industry, mb.customer, mb.fiscal_month AS fiscal_period, sum(a.amount) AS open_ar, count(*) AS n_open
      FROM (SELECT DISTINCT {DIM}, fiscal_month FROM r_ar) mb JOIN r_ar a ON {_dimeq('mb', 'a')} AND a.invoice_date <= last_day(mb.fiscal_month) AND (a.payment_date IS NULL OR a.payment_date > last_day(mb.fiscal_month))
      GROUP BY ALL) o USING ({_cell})"""
_opct = lambda num: f"CASE WHEN revenue > 0 THEN {rnd(pct(num, 'revenue'), 2)} ELSE 0.0 END"
T["r_ent_base"] = f"""SELECT {DIM}, fiscal_month AS fiscal_period, sum(billing_amount) AS revenue, sum(cost_amount) AS delivery_cost, sum(hours_worked) AS total_hours,
    sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END) AS billable_hours, count(DISTINCT employee_id) AS active_employees FROM r_timecards GROUP BY ALL"""
T["r_ent_join"] = f"""SELECT b.*, coalesce(exp, 0) AS operating_expenses, coalesce(hc, 0) AS headcount, coalesce(open_ar, 0) AS accounts_receivable,
    CASE WHEN billed > 0 AND open_ar IS NOT NULL THEN {rnd(f"{div('open_ar', 'billed')} * CAST(day(last_day(fiscal_period)) AS DOUBLE)", 1)} END AS avg_days_sales_outstanding,
    coalesce(n_open, 0) AS unpaid_invoice_count, coalesce(wip, 0) AS wip_value, coalesce(pl, 0) AS pipeline_revenue FROM r_ent_base b
    LEFT JOIN (SELECT {DIM}, fiscal_month AS fiscal_period, sum(amount) AS exp FROM r_expenses GROUP BY ALL) USING ({_cell})
    LEFT JOIN r_ar_months USING ({_cell}) LEFT JOIN (SELECT {DIM}, fiscal_month AS fiscal_period, sum(billing_amount) AS wip FROM r_wip WHERE is_wip GROUP BY ALL) USING ({_cell})
    LEFT JOIN (SELECT {DIM}, count(*) AS hc FROM r_current GROUP BY ALL) USING ({DIM}) LEFT JOIN (SELECT {DIM}, sum(planned_revenue) AS pl FROM r_projects WHERE is_active GROUP BY ALL) USING ({DIM})"""
T["r_ent"] = f"""SELECT *, revenue - delivery_cost - operating_expenses AS profit, {_opct('revenue - delivery_cost - operating_expenses')} AS margin_pct, revenue - delivery_cost AS gross_profit,
    {_opct('revenue - delivery_cost')} AS gross_margin_pct, CASE WHEN total_hours > 0 THEN {rnd(pct('billable_hours', 'total_hours'), 2)} ELSE 0.0 END AS utilization_pct,
    {rnd(f"{dbl('revenue')} - {dbl('delivery_cost')} - {dbl('operating_expenses')} * 0.8::DOUBLE", 2)} AS estimated_cash_flow FROM r_ent_join"""
T["r_payables"] = f"""SELECT vendor_name, invoice_id AS invoice_number, invoice_date, due_date, amount AS amount_due, days_outstanding, aging_bucket, department,
    CASE WHEN vendor_name IN ('Deloitte', 'EY', 'PwC', 'KPMG') THEN 'Contractors' WHEN vendor_name IN ('Gartner', 'Forrester', 'IDC') THEN 'Marketing & Brand Management'
      WHEN vendor_name IN ('Oracle', 'SAP') THEN 'Professional & Legal Services' WHEN vendor_name IN ('WeWork', 'Regus', 'JLL', 'CBRE', 'Iron Mountain') THEN 'Real Estate & Facilities'
      ELSE 'IT & Technology' END AS vendor_classification,
    {rnd("CAST(least(days_outstanding, 180) AS DOUBLE) / 3.0 + log10(greatest(CAST(amount AS DOUBLE), 1.0)) * 8.0", 2)} AS payment_priority_score, strftime(invoice_date, '%Y-%m') AS fiscal_period,
    payment_status, {DIM} FROM r_ap WHERE {clean_open()}"""
T["r_latest"] = f"SELECT max(fiscal_month) AS cur, CAST(max(fiscal_month) - INTERVAL 1 MONTH AS DATE) AS prev FROM r_timecards"
_sums = lambda period: f"""SELECT {DIM}, sum(CASE WHEN time_type_clean = 'Billable' THEN billing_amount END) AS rev, sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END) AS bill, sum(hours_worked) AS hrs
    FROM r_timecards WHERE fiscal_month = (SELECT {period} FROM r_latest) GROUP BY ALL"""
T["r_cur_time"], T["r_prev_time"] = _sums("cur"), _sums("prev")
T["r_plan"] = f"""SELECT region, practice_area, sum(CAST(round(CAST({dbl('planned_revenue')} / greatest({months_between('coalesce(project_end_date, project_start_date + 365)', 'project_start_date')}, 1.0) * 1.05::DOUBLE AS DECIMAL(38,8)), 4) AS DECIMAL(38,4))) AS plan
    FROM r_projects, r_latest WHERE is_active AND project_start_date <= cur AND coalesce(project_end_date, DATE '2099-12-31') >= cur GROUP BY ALL"""
T["r_metric_rows"] = f"""SELECT 'revenue' AS metric_name, {dbl('coalesce(c.rev, 0)')} AS current_value, {dbl('coalesce(p.rev, 0)')} AS previous_value,
      CASE WHEN c.rev IS NOT NULL THEN {rnd(f"{dbl('coalesce(plan, 0)')} * coalesce({div('c.rev', 'tot')}, 0.0)", 2)} ELSE 0.0 END AS target_value, {DIM}
      FROM r_cur_time c FULL JOIN r_prev_time p USING ({DIM}) LEFT JOIN r_plan USING (region, practice_area) LEFT JOIN (SELECT region, practice_area, sum(rev) AS tot FROM r_cur_time GROUP BY ALL) USING (region, practice_area)
      WHERE coalesce(c.rev, 0) > 0 OR coalesce(p.rev, 0) > 0
    UNION ALL SELECT 'expenses', {dbl('c.exp')}, {dbl('coalesce(p.exp, 0)')}, {dbl('c.exp * 1.30')}, {DIM} FROM (SELECT {DIM}, sum(amount) AS exp FROM r_expenses WHERE fiscal_month = (SELECT cur FROM r_latest) GROUP BY ALL) c
      LEFT JOIN (SELECT {DIM}, sum(amount) AS exp FROM r_expenses WHERE fiscal_month = (SELECT prev FROM r_latest) GROUP BY ALL) p USING ({DIM})
    UNION ALL SELECT 'utilization', {rnd(pct('c.bill', 'c.hrs'), 2)}, coalesce({rnd(pct('p.bill', 'p.hrs'), 2)}, 0.0), 60.0, {DIM} FROM r_cur_time c LEFT JOIN r_prev_time p USING ({DIM})
    UNION ALL SELECT 'headcount', {dbl('c.n')}, {dbl('coalesce(p.n, 0)')}, NULL, {DIM} FROM (SELECT {DIM}, count(*) AS n FROM r_current GROUP BY ALL) c
      LEFT JOIN (SELECT {DIM}, count(*) AS n FROM r_employees WHERE is_current AND snapshot_date = last_day((SELECT prev FROM r_latest)) GROUP BY ALL) p USING ({DIM})
    UNION ALL SELECT 'dso', CASE WHEN recent > 0 THEN {rnd(f"{div('bal', 'recent')} * 30.0", 1)} END, NULL, 45.0, {DIM} FROM (SELECT {DIM}, sum(amount) AS bal FROM r_ar WHERE {clean_open()} GROUP BY ALL)
      FULL JOIN (SELECT {DIM}, sum(amount) AS recent FROM r_ar WHERE invoice_date >= {ASOF} - 30 GROUP BY ALL) USING ({DIM})
    UNION ALL SELECT 'wip_value', {dbl('sum(billing_amount)')}, NULL, NULL, {DIM} FROM r_wip WHERE is_wip GROUP BY {DIM}
    UNION ALL SELECT 'pipeline', {dbl('sum(planned_revenue)')}, NULL, NULL, {DIM} FROM r_projects WHERE is_active GROUP BY {DIM}"""
T["r_summary"] = f"""SELECT metric_name, current_value, previous_value, target_value, CASE WHEN previous_value > 0 THEN least(greatest({rnd('(current_value - previous_value) / previous_value * 100', 2)}, -100.0), 500.0)
    WHEN current_value > 0 THEN NULL ELSE 0.0 END AS change_pct, {DIM}, cur AS fiscal_period FROM r_metric_rows, r_latest"""
_tgt = f"(coalesce(m, {dbl('accrued')}) * {dbl(case('month(fiscal_period)', P.season, '1'))} * {P.stretch}::DOUBLE)"
T["r_practice"] = f"""SELECT practice_area, fiscal_period, {rnd(dbl('accrued'), 2)} AS accrued_revenue, {rnd(_tgt, 2)} AS target_revenue,
    CASE WHEN {_tgt} > 0 THEN least(greatest({rnd(f"({dbl('accrued')} - {_tgt}) / {_tgt} * 100", 2)}, -100.0), 500.0) ELSE 0.0 END AS revenue_variance_pct, lead_partner_name, region, location, industry, customer
    FROM (SELECT *, {dbl('sum(accrued) OVER w')} / NULLIF(count(accrued) OVER w, 0) AS m FROM (SELECT {DIM}, fiscal_month AS fiscal_period, sum(billing_amount) AS accrued FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY ALL)
      WINDOW w AS (PARTITION BY {DIM} ORDER BY fiscal_period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
    LEFT JOIN (SELECT practice_area, region, lead_partner_name FROM (SELECT practice_area, region, lead_partner_name, row_number() OVER (PARTITION BY practice_area, region ORDER BY sum(actual_revenue) DESC, lead_partner_name) AS rn
      FROM r_prof WHERE lead_partner_name IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1) USING (practice_area, region)"""
T["r_leads"] = """SELECT upper(department_category) AS dep, arg_min(full_name, employee_id) AS department_lead FROM r_cost_centers JOIN r_current ON cost_center_code = cost_center
    WHERE job_level IN ('Director', 'Senior Partner', 'Partner', 'Associate Partner') GROUP BY 1"""
T["r_dept"] = f"""SELECT department, fiscal_period, {rnd(dbl('spent'), 2)} AS accrued_expenses, {rnd(dbl('budget'), 2)} AS budgeted_expenses, {capped('spent', 'budget', 'budget >= 1000')} AS expense_variance_pct, department_lead, {DIM}
    FROM (SELECT expense_category_business AS department, fiscal_month AS fiscal_period, {DIM}, sum(amount) AS spent, sum(budgeted_amount) AS budget FROM r_expenses GROUP BY ALL) LEFT JOIN r_leads ON upper(department) = dep"""
T["r_partner"] = f"""SELECT full_name AS partner_name, lead_partner_id AS partner_id, fiscal_period, {rnd(dbl('rev'), 2)} AS revenue_managed, CASE WHEN rev > 0 THEN {rnd(pct('rev - cost', 'rev'), 2)} ELSE 0.0 END AS profit_margin_pct,
    client_count, project_count, CASE WHEN hrs > 0 THEN {rnd(pct('bill', 'hrs'), 2)} ELSE 0.0 END AS utilization_rate, {DIM}
    FROM (SELECT lead_partner_id, fiscal_month AS fiscal_period, count(DISTINCT project_id) AS project_count, count(DISTINCT client_id) AS client_count, sum(billing_amount) AS rev, sum(cost_amount) AS cost, sum(hours_worked) AS hrs,
      sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END) AS bill
      FROM r_timecards JOIN (SELECT project_id, client_id, lead_partner_id FROM r_projects) USING (project_id) GROUP BY ALL) LEFT JOIN r_current ON lead_partner_id = employee_id"""

_NAME = re.compile(r"\br_[a-z_]+\b")


def _ordered(names: set[str], seen: list[str]) -> None:
    for name in sorted(n for n in names if n in T):
        if name not in seen:
            _ordered(set(_NAME.findall(T[name])) - {name}, seen)
            seen.append(name)


def with_tables(body: str) -> str:
    """The check with the definitions of the tables it uses in front."""
    order: list[str] = []
    _ordered(set(_NAME.findall(body)), order)
    if not order:
        return body
    prefix = ",\n".join(f"{n} AS ({T[n]})" for n in order)
    rest = body.lstrip()
    if rest.upper().startswith("WITH "):
        return f"WITH {prefix},\n{rest[5:]}"
    return f"WITH {prefix}\n{rest}"


def doubles(columns: list[str]) -> str:
    """``* REPLACE`` list that turns exact columns into doubles."""
    return ", ".join(f"{dbl(c)} AS {c}" for c in columns)
