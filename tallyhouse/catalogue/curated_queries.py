"""TQ*: the standing questions."""

from tallyhouse.catalogue.check_tables import ASOF, back, clean_open, dbl, div, pct, rnd
from tallyhouse.catalogue.kpi_queries import _bill, _econ, _five, _idle, _idleh, _partners, _win, chg
from tallyhouse.catalogue.registry import query
from tallyhouse.plans import curated as c

mm = lambda e, d=1: rnd(f"{dbl(e)} / 1e6", d)
kk = lambda e, d=0: rnd(f"{dbl(e)} / 1e3", d)
over = lambda a, t, d=1: rnd(f"({div(a, t)} - 1) * 100", d)
span = lambda n, col="fiscal_period": f"{col} >= {back(n)} AND {col} < {back(0)}"
R, B = "sum(total_revenue)", "sum(budgeted_revenue)"

query("TQ01_revenue_vs_target", f"SELECT location, practice_area, {mm(R)} AS actual_rev_mm, {mm(B)} AS target_rev_mm, {over(R, B)} AS variance_pct, {rnd(f'{R} - {B}', 0)} AS dollar_gap FROM r_pnl WHERE fiscal_period = {back(1)} GROUP BY 1, 2")(c.revenue_vs_target)
query("TQ02_worst_margins", f"""SELECT project_id, project_name, client_name, practice_area, location, lead_partner_name, {kk('actual_revenue')} AS actual_revenue_k, {kk('actual_revenue - actual_margin')} AS total_cost_k, {kk('actual_cost')} AS delivery_cost_k,
    {kk('actual_expenses')} AS project_expenses_k, actual_margin_pct, planned_margin_pct, {rnd('actual_margin_pct - planned_margin_pct', 1)} AS margin_variance_pp FROM r_profit WHERE project_end_date >= {back(1)} AND project_end_date < {back(0)}
    AND actual_margin_pct BETWEEN -50 AND 70 ORDER BY actual_margin_pct - planned_margin_pct, project_id LIMIT 15""")(c.worst_margins)
query("TQ03_dso", f"""SELECT d[1] AS current_dso, d[2] AS previous_dso, {rnd('d[1] - d[2]', 1)} AS dso_change_days, (SELECT max(snapshot_date) FROM r_snap) AS current_snapshot_date, (SELECT count(*) FROM r_ar WHERE {clean_open()}) AS unpaid_invoice_count
    FROM (SELECT list(firmwide_dso_days ORDER BY snapshot_date DESC) AS d FROM (SELECT DISTINCT snapshot_date, firmwide_dso_days FROM r_snap))""")(c.dso_current_and_previous)
query("TQ04_revenue_per_partner", f"SELECT {rnd('c / 1e6', 2)} AS current_rev_per_partner_mm, {rnd('y / 1e6', 2)} AS yoy_rev_per_partner_mm, n1 AS current_partner_count, n12 AS yoy_partner_count, {rnd('c / NULLIF(y, 0) * 100 - 100', 2)} AS yoy_pct_change FROM {_econ('')}")(c.revenue_per_partner)
for _min, _name in ((3, "TQ04b_revenue_per_partner_cells"), (1, "TQ04b_revenue_per_partner_all_cells")):
    query(_name, f"""SELECT practice_area, region, n1 AS current_partner_count, NULLIF(n12, 0) AS yoy_partner_count, n1 - NULLIF(n12, 0) AS partner_headcount_change, {rnd('c / 1e6', 2)} AS current_rev_per_partner_mm, {rnd('y / 1e6', 2)} AS yoy_rev_per_partner_mm, {rnd('c / NULLIF(y, 0) * 100 - 100', 2)} AS yoy_pct_change
    FROM (SELECT practice_area, region, n1, n12, {div('r1', 'n1')} AS c, {div('r13', 'n12')} AS y FROM {_partners('', 'practice_area, region,')} LEFT JOIN (SELECT practice_area, region, sum(revenue) FILTER (fiscal_period = {back(1)}) * 12 AS r1,
    sum(revenue) FILTER (fiscal_period = {back(13)}) * 12 AS r13 FROM r_ent GROUP BY 1, 2) USING (practice_area, region) WHERE n1 >= {_min})""")(lambda f, m=_min: c.revenue_per_partner_cells(f, m))
query("TQ05_practice_revenue", f"SELECT fiscal_period, practice_area, {mm(R, 2)} AS revenue_mm, {mm(B, 2)} AS target_mm, {over(R, B)} AS variance_pct FROM r_pnl WHERE {span(6)} GROUP BY 1, 2 HAVING {R} > 0")(c.practice_revenue)
_cats = ", ".join(f"{mm(f'sum({n}_expenses)')} AS {n}_mm" for n in ("billable", "corporate", "marketing", "tech", "other"))
_exp = lambda by, name: f"SELECT {by}, {_cats}, {mm(f'sum({_five})')} AS total_actual_mm, {mm('sum(budgeted_expenses)')} AS {name}, {rnd(chg(f'sum({_five})', 'sum(budgeted_expenses)'), 1)} AS over_budget_pct FROM r_pnl WHERE {span(7)} GROUP BY {by}"
query("TQ06_office_expenses", _exp("fiscal_period, location", "budget_mm"))(c.office_expenses)
query("TQ06b_category_variance", " UNION ALL ".join(f"SELECT '{l}' AS category, {mm(f'sum({n}_expenses)')} AS actual_mm, {mm(f'sum(budgeted_{n}_expenses)')} AS budget_mm, {rnd(chg(f'sum({n}_expenses)', f'sum(budgeted_{n}_expenses)'), 1)} AS variance_pct FROM r_pnl WHERE {span(6)}"
    for n, l in (("billable", "Billable"), ("corporate", "Corporate"), ("marketing", "Marketing"), ("tech", "Technology"), ("other", "Other"))))(c.category_variance)
query("TQ07_practice_utilization", f"SELECT * FROM (SELECT fiscal_month AS fiscal_period, practice_area, {rnd(pct(f'sum({_bill})', 'sum(hours_worked)'), 1)} AS utilization_pct, {kk('sum(hours_worked)')} AS total_hours_k, {kk(f'sum({_bill})')} AS billable_hours_k FROM r_timecards WHERE {span(12, 'fiscal_month')} GROUP BY 1, 2) ORDER BY fiscal_period DESC, utilization_pct, practice_area LIMIT 50")(c.practice_utilization)
query("TQ08_practice_bench", f"SELECT fiscal_month AS fiscal_period, practice_area, {kk(f'sum({_idleh})', 1)} AS bench_hours_k, {mm(f'sum({_idle})', 2)} AS bench_cost_mm, {rnd(pct(f'sum({_idleh})', 'sum(hours_worked)'), 1)} AS bench_pct_of_total FROM r_timecards WHERE {span(12, 'fiscal_month')} GROUP BY 1, 2 ORDER BY 1 DESC, sum({_idle}) DESC, 2 LIMIT 30")(c.practice_bench)
_plan = lambda k: f"""SELECT project_id, project_name, client_name, practice_area, location, lead_partner_name, planned_hours, {rnd('p.actual_hours', 0)} AS actual_hours, {rnd('p.actual_hours - planned_hours', 0)} AS hours_overrun, {over('p.actual_hours', 'planned_hours', 0)} AS overrun_pct, team_size, project_status, project_start_date
    FROM r_profit p WHERE is_active AND planned_hours > 0 AND {dbl('p.actual_hours')} > {dbl('planned_hours')} * {k}::DOUBLE ORDER BY p.actual_hours - planned_hours DESC, project_id LIMIT 15"""
query("TQ09_projects_over_plan", _plan("1.3"))(c.projects_over_plan)
query("TQ09_projects_over_tenth_of_plan", _plan("0.1"))(lambda f: c.projects_over_plan(f, 0.1))
query("TQ10_firm_revenue_trend", f"SELECT fiscal_period, {mm(R)} AS revenue_mm, {mm(B)} AS forecast_mm, {over(R, B)} AS variance_pct FROM r_pnl WHERE {span(6)} GROUP BY 1")(c.firm_revenue_trend)
query("TQ11_firm_expenses", _exp("fiscal_period", "total_budget_mm"))(c.firm_expenses)
query("TQ13_office_comparison", f"SELECT location, {mm(R)} AS revenue_mm, {mm(f'sum({_five})')} AS expenses_mm, {rnd(pct(f'sum({_five})', R), 1)} AS expense_ratio_pct, {mm(f'{R} - sum({_five})')} AS gross_profit_mm, {rnd(pct(f'{R} - sum({_five})', R), 1)} AS gross_margin_pct FROM r_pnl WHERE fiscal_period = {back(1)} GROUP BY 1")(c.office_comparison)
query("TQ14_open_receivables", f"SELECT location, customer_name, invoice_id, invoice_date, {kk('amount')} AS amount_k, aging_bucket, days_outstanding, lead_partner_name, payment_status FROM r_ar WHERE {clean_open()} ORDER BY amount DESC, invoice_id LIMIT 50")(c.open_receivables)
query("TQ15_new_partner_classes", f"""SELECT classification, practice_area, count(*) AS partner_count, {rnd('CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0', 1)} AS pct_of_total FROM (SELECT cp.practice_area, CASE WHEN s.employee_id IS NULL THEN 'Lateral hire (new to firm)'
    WHEN pe.job_level = 'Partner' THEN 'Existing partner (carryover)' WHEN pe.job_level IS NOT NULL THEN 'Promotion from ' || pe.job_level ELSE 'Promotion (prior level unknown)' END AS classification
    FROM (SELECT employee_id, practice_area FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND snapshot_date = last_day({back(1)})) cp LEFT JOIN (SELECT employee_id, job_level FROM r_employees WHERE snapshot_date = last_day({back(2)})) pe ON cp.employee_id = pe.employee_id
    LEFT JOIN (SELECT DISTINCT employee_id FROM r_employees WHERE snapshot_date < {back(1)}) s ON cp.employee_id = s.employee_id) GROUP BY 1, 2""")(c.new_partner_classes)
_un = lambda t, party: f"SELECT {party}, {mm('sum(amount)', 2)} AS total_unpaid_mm, count(*) AS unpaid_invoice_count, {rnd(div('sum(days_outstanding)', 'count(*)'), 1)} AS avg_days_outstanding, max(days_outstanding) AS max_days_outstanding FROM {t} WHERE {clean_open()} GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 10"
query("TQ16_unpaid_clients", _un("r_ar", "customer_name"))(c.unpaid_clients)
query("TQ17_unpaid_vendors", _un("r_ap", "vendor_name"))(c.unpaid_vendors)
query("TQ18_project_margin_qoq", f"SELECT {rnd('c * 100', 2)} AS current_margin_pct, {rnd('p * 100', 2)} AS previous_margin_pct, {rnd('(c - p) * 100', 2)} AS qoq_change_pp FROM (SELECT {div('m1', 'r1')} AS c, {div('m0', 'r0')} AS p FROM {_win('actual_margin', '')})")(c.project_margin_qoq)
query("TQ19_partner_headcount", f"SELECT n1 AS current_partner_count, n30 AS previous_partner_count, n1 - n30 AS mom_change, {rnd(chg('n1', 'n30'), 2)} AS mom_pct_change FROM {_partners('')}")(c.partner_headcount)
query("TQ19b_partner_headcount_cells", "SELECT practice_area, region, count(DISTINCT employee_id) AS partner_count FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND is_latest_snapshot GROUP BY 1, 2")(c.partner_headcount_cells)
_w = "sum(open_ar_balance * CAST(weighted_dso_days AS DECIMAL(10,1)))"
query("TQ20_dso_trend_by_office", f"SELECT snapshot_date, location, {rnd(div(_w, 'sum(open_ar_balance)'), 1)} AS dso_days FROM r_snap GROUP BY 1, 2")(lambda f: c.dso_trend(f, ["location"]))
query("TQ20b_bucket_mix", f"SELECT snapshot_date, aging_bucket, {mm('sum(open_ar_balance)')} AS open_ar_m, {rnd(div('sum(open_ar_balance)', 'sum(sum(open_ar_balance)) OVER (PARTITION BY snapshot_date)') + ' * 100', 1)} AS pct_of_snapshot FROM r_snap GROUP BY 1, 2")(c.bucket_mix)
query("TQ20c_aged_balance_of_client", f"SELECT snapshot_date, {dbl('sum(CASE WHEN aging_bucket IN (' + repr('61-90 days') + ', ' + repr('90+ days') + ') THEN open_ar_balance ELSE 0 END)')} AS aged_60plus, {dbl('sum(CASE WHEN aging_bucket = ' + repr('90+ days') + ' THEN open_ar_balance ELSE 0 END)')} AS aged_90plus FROM r_snap WHERE customer_name = 'Customer#000000077' GROUP BY 1")(lambda f: c.aged_balance(f, "Customer#000000077"))
query("TQ20d_firm_dso_trend", f"SELECT DISTINCT snapshot_date, firmwide_dso_days, {dbl('firmwide_open_ar')} AS firmwide_open_ar FROM r_snap")(lambda f: f.table("ar_snapshot_aging").select("snapshot_date", "firmwide_dso_days", "firmwide_open_ar").distinct())
