"""KP*: KPI reports. Names ending in _filtered run the same report on one slice."""

from tallyhouse.catalogue.check_tables import ASOF, DIM, back, clean_open, dbl, div, months_between, pct, rnd
from tallyhouse.catalogue.registry import query
from tallyhouse.plans import kpis

SLICE = {"region": "ASIA", "industry": "BUILDING", "location": "All", "colour": "red"}
WHERE = "AND region = 'ASIA' AND industry = 'BUILDING'"
STAFF_SLICE = {"region": "ASIA"}


def report(name: str, plan, check, slice_=None, where=""):
    query(name, check(""))(lambda firm: plan(firm))
    if slice_:
        query(f"{name}_filtered", check(where))(lambda firm: plan(firm, slice_))


def at(value: str, n: int, col: str = "fiscal_period") -> str:
    return f"sum({value}) FILTER ({col} = {back(n)})"


def chg(a: str, c: str) -> str:
    return f"(({dbl(a)} - {dbl(c)}) / NULLIF({dbl(c)}, 0) * 100.0)"


report("KP1_dso_ratio", kpis.dso_ratio, lambda w: f"""SELECT {rnd('c', 1)} AS dso_days, {rnd('c / 60 * 100', 0)} AS percent_of_target, CAST(60 AS INTEGER) AS target_dso,
    {rnd('p - c', 1)} AS qoq_improvement_days, {rnd('(p - c) / NULLIF(p, 0) * 100', 2)} AS qoq_improvement_pct FROM (SELECT {div(at('accounts_receivable', 1), at('revenue', 1))} * 30.0 AS c,
    {div(at('accounts_receivable', 2), at('revenue', 2))} * 30.0 AS p FROM r_ent WHERE true {w})""", SLICE, WHERE)

_dpo = lambda w: f"""(SELECT {div('owed', 'c1')} * 30.0 AS c, {div('owed', 'c2')} * 30.0 AS p FROM (SELECT sum(amount) AS owed FROM r_ap WHERE {clean_open()} AND amount > 0 {w}),
    (SELECT {at('delivery_cost + operating_expenses', 1)} AS c1, {at('delivery_cost + operating_expenses', 2)} AS c2 FROM r_ent WHERE true {w}))"""
report("KP2_dpo_ratio", kpis.dpo_ratio, lambda w: f"""SELECT {rnd('c', 1)} AS dpo_days, {rnd('c / 45 * 100', 0)} AS percent_of_target, CAST(45 AS INTEGER) AS target_dpo, {rnd('p', 1)} AS prior_quarter_dpo,
    {rnd('(c - p) / NULLIF(p, 0) * 100', 2)} AS qoq_change_pct FROM {_dpo(w)}""", SLICE, WHERE)

_top = lambda t, w, n=1: f"(SELECT * FROM {t} WHERE {clean_open()} AND amount > 0 {w} ORDER BY amount DESC, invoice_id LIMIT {n})"
_client = lambda w: f"""(SELECT customer_name AS top_client, {rnd("amount / 1000.0::DOUBLE", 0)} AS top_amount_k, days_outstanding AS top_days_overdue, lead_partner_name AS top_account_mgr,
    (SELECT {rnd("CAST(sum(x.amount) AS DOUBLE) / 1000.0", 0)} FROM r_ar x WHERE {clean_open('x.payment_status')} AND x.amount > 0 AND x.invoice_date < {ASOF} - 90 AND x.customer_name = t.customer_name) AS prior_k
    FROM {_top('r_ar', w)} t)"""
report("KP3_top_client_invoice", kpis.top_client_invoice, lambda w: f"""SELECT top_client, top_amount_k, top_days_overdue, top_account_mgr,
    {rnd('(top_amount_k - coalesce(prior_k, top_amount_k)) / NULLIF(coalesce(prior_k, top_amount_k), 0) * 100', 0)} AS qoq_change_pct FROM {_client(w)}""", SLICE, WHERE)
_vendor = lambda w: f"""(SELECT vendor_name AS top_vendor, {rnd("CAST(amount AS DOUBLE) / 1000.0", 0)} AS top_amount_k, days_outstanding AS top_days_overdue, department AS top_contact,
    coalesce((SELECT vendor_name FROM (SELECT * FROM r_ap WHERE {clean_open()} AND amount > 0 {w} ORDER BY amount DESC, invoice_id LIMIT 1 OFFSET 1)), 'N/A') AS second_vendor,
    (SELECT {rnd("CAST(sum(x.amount) AS DOUBLE) / 1000.0", 0)} FROM r_ap x WHERE {clean_open('x.payment_status')} AND x.amount > 0 AND x.invoice_date < {ASOF} - 90 AND x.vendor_name = t.vendor_name) AS prior_k
    FROM {_top('r_ap', w)} t)"""
report("KP4_top_vendor_invoice", kpis.top_vendor_invoice, lambda w: f"""SELECT top_vendor, top_amount_k, top_days_overdue, top_contact, second_vendor,
    {rnd('(top_amount_k - coalesce(prior_k, top_amount_k)) / NULLIF(coalesce(prior_k, top_amount_k), 0) * 100', 0)} AS qoq_improvement_pct FROM {_vendor(w)}""", SLICE, WHERE)

_rev = lambda w: f"(SELECT {at('total_revenue', 1)} AS rev, {at('budgeted_revenue', 1)} AS budget, {at('total_revenue', 2)} AS prior FROM r_pnl WHERE true {w})"
report("KP5_revenue_vs_budget", kpis.revenue_vs_budget, lambda w: f"""SELECT {rnd(dbl('rev') + ' * 12 / 1e6', 0)} AS revenue_millions, {rnd(dbl('budget') + ' * 12 / 1e6', 0)} AS target_revenue_millions,
    {rnd(pct('rev', 'budget'), 1)} AS percent_of_forecast, {rnd(dbl('remaining') + ' / 1e6', 0)} AS pipeline_millions, {rnd(chg('rev', 'prior'), 1)} AS wow_change_pct FROM {_rev(w)},
    (SELECT greatest(sum(planned_revenue) - sum(actual_revenue), 0) AS remaining FROM r_profit WHERE project_status = 'Active' AND planned_revenue > 0 {w})""", SLICE, WHERE)

_now, _before = f"project_end_date >= {ASOF} - 90", f"project_end_date BETWEEN {ASOF} - 180 AND {ASOF} - 90"
_win = lambda m, w, extra="", by="": f"""(SELECT {by} sum({m}) FILTER ({_now}) AS m1, sum(actual_revenue) FILTER ({_now}) AS r1, sum({m}) FILTER ({_before}) AS m0, sum(actual_revenue) FILTER ({_before}) AS r0
    FROM r_profit WHERE project_end_date >= {ASOF} - 180 {extra} {w})"""
_band = "AND actual_margin_pct BETWEEN 10 AND 50"
report("KP6_project_margins", kpis.project_margins, lambda w: f"""SELECT {rnd('coalesce(c, 0)', 1)} AS current_margin_pct, {rnd('coalesce(p, 0)', 1)} AS prior_margin_pct, {rnd('coalesce(c - p, 0)', 1)} AS qoq_change_pp,
    CASE WHEN coalesce(p, 0) = 0 THEN 0.0 ELSE {rnd('(c - p) / p * 100', 2)} END AS qoq_change_pct FROM (SELECT {rnd(pct('m1', 'r1'), 2)} AS c, {rnd(pct('m0', 'r0'), 2)} AS p FROM {_win('actual_revenue - actual_cost', w, _band)})""", SLICE, WHERE)

_snaps = "(SELECT max(snapshot_date) AS s1, max(snapshot_date) FILTER (snapshot_date <= (SELECT max(snapshot_date) - INTERVAL 12 MONTH FROM r_employees)) AS s12, max(snapshot_date) FILTER (snapshot_date <= (SELECT max(snapshot_date) - 30 FROM r_employees)) AS s30 FROM r_employees)"
_partners = lambda w, by="": f"""(SELECT {by} count(DISTINCT employee_id) FILTER (snapshot_date = s1) AS n1, count(DISTINCT employee_id) FILTER (snapshot_date = s12) AS n12, count(DISTINCT employee_id) FILTER (snapshot_date = s30) AS n30
    FROM r_employees, {_snaps} WHERE job_level = 'Partner' AND employment_status = 'Active' AND snapshot_date IN (s1, s12, s30) {w} {'GROUP BY ALL' if by else ''})"""
_econ = lambda w: f"(SELECT *, {div('v1', 'n1')} AS c, {div('v13', 'n12')} AS y FROM (SELECT {at('revenue', 1)} * 12 AS v1, {at('revenue', 13)} * 12 AS v13 FROM r_ent WHERE true {w}), {_partners(w)})"
report("KP7_revenue_per_partner", kpis.revenue_per_partner, lambda w: f"""SELECT {rnd('c / 1e6', 2)} AS revenue_per_partner_millions, {rnd('y / 1e6', 2)} AS forecast_millions, {rnd('c / NULLIF(y, 0) * 100', 0)} AS percent_of_forecast,
    (SELECT count(*) FROM (SELECT fiscal_period AS m, sum(revenue) AS rev FROM r_ent WHERE fiscal_period >= {back(6)} AND fiscal_period < {back(0)} {w} GROUP BY 1) JOIN (SELECT CAST(date_trunc('month', snapshot_date) AS DATE) AS m,
      count(DISTINCT employee_id) AS n FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' {w} GROUP BY 1) USING (m) WHERE CAST(rev * 12 AS DOUBLE) / n > 3000000) AS months_above_target,
    {rnd('c / NULLIF(y, 0) * 100 - 100', 1)} AS yoy_growth_pct FROM {_econ(w)}""", SLICE, WHERE)

_five = "billable_expenses + corporate_expenses + marketing_expenses + tech_expenses + other_expenses"
_exp = lambda w: f"(SELECT {at(_five, 1)} AS e, {at('budgeted_expenses', 1)} AS bud, {at(_five, 2)} AS prior FROM r_pnl WHERE true {w})"
report("KP8_expenses_vs_budget", kpis.expenses_vs_budget, lambda w: f"""SELECT {rnd(dbl('e') + ' * 12 / 1e6', 0)} AS expense_millions, {rnd(dbl('bud') + ' * 12 / 1e6', 0)} AS forecast_millions, {rnd(pct('e', 'bud'), 1)} AS percent_of_forecast,
    {rnd(chg('e', 'prior'), 1)} AS variance_pct FROM {_exp(w)} WHERE e IS NOT NULL""", SLICE, WHERE)

_bill = "CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END"
_fm = "fiscal_month"
_util = lambda w: f"(SELECT {rnd(pct(at(_bill, 1, _fm), at('hours_worked', 1, _fm)), 1)} AS u1, {rnd(pct(at(_bill, 2, _fm), at('hours_worked', 2, _fm)), 1)} AS u2 FROM r_timecards WHERE true {w})"
report("KP9_utilization", kpis.utilization, lambda w: f"""SELECT u1 AS current_utilization_pct, {rnd('u1 - u2', 1)} AS mom_change_pp, {rnd('u1 / 85 * 100', 0)} AS percent_of_forecast, CAST(85 AS INTEGER) AS forecast_utilization FROM {_util(w)}""",
       STAFF_SLICE, "AND region = 'ASIA'")
_heads = lambda w: f"(SELECT count(DISTINCT employee_id) AS n FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND date_trunc('month', snapshot_date) = {back(1)} {w})"
report("KP10_partner_headcount", kpis.partner_headcount, lambda w: f"""SELECT n AS current_partners, budget_partners, budget_partners - n AS variance_count, {rnd(pct('n', 'budget_partners'), 1)} AS percent_of_budget
    FROM (SELECT n, CAST({'greatest(round(n * 1.05), n + 5)' if w else '5000'} AS BIGINT) AS budget_partners FROM {_heads(w)})""", STAFF_SLICE, "AND region = 'ASIA'")
_idle = "CASE WHEN time_type_clean = 'Non-Billable' THEN hours_worked * cost_rate ELSE 0 END"
_idleh = "CASE WHEN time_type_clean = 'Non-Billable' THEN hours_worked ELSE 0 END"
report("KP11_bench_cost", kpis.bench_cost, lambda w: f"""SELECT {rnd(dbl('c1') + ' / 1e6', 2)} AS bench_cost_mm, {rnd(dbl('c2') + ' / 1e6', 2)} AS prior_bench_cost_mm, {rnd(chg('c1', 'c2'), 1)} AS mom_change_pct, {rnd(dbl('i1') + ' / 1e3', 1)} AS bench_hours_k,
    {rnd(pct('i1', 'h1'), 1)} AS bench_pct_of_total FROM (SELECT {at(_idle, 1, _fm)} AS c1, {at(_idle, 2, _fm)} AS c2, {at(_idleh, 1, _fm)} AS i1, {at('hours_worked', 1, _fm)} AS h1 FROM r_timecards WHERE true {w})""", STAFF_SLICE, "AND region = 'ASIA'")
_low = lambda n, w="": f"(SELECT employee_id FROM r_timecards WHERE fiscal_month = {back(n)} {w} GROUP BY 1 HAVING sum(hours_worked) > 0 AND {div(f'sum({_bill})', 'sum(hours_worked)')} < 0.5)"
_lowp = lambda n, w: f"(SELECT count(*) FROM {_low(n)} WHERE employee_id IN (SELECT employee_id FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND date_trunc('month', snapshot_date) = {back(n)} {w}))"
report("KP12_low_utilized_partners", kpis.low_utilized_partners, lambda w: f"""SELECT a AS bench_consultants, p AS prior_month_bench, {rnd(chg('a', 'p'), 0)} AS mom_change_pct FROM (SELECT {_lowp(1, w)} AS a, {_lowp(2, w)} AS p)""", STAFF_SLICE, "AND region = 'ASIA'")

report("KP13_exec_revenue", kpis.exec_revenue, lambda w: f"""SELECT {dbl('rev')} * 12 / 1e9 AS rev_b, {dbl('budget')} * 12 / 1e9 AS budget_b, {chg('rev', 'budget')} AS pct_over, {chg('rev', 'prior')} AS mom_pct, {dbl('pl')} / 1e9 AS pipeline_b
    FROM {_rev(w)}, (SELECT {at('pipeline_revenue', 1)} AS pl FROM r_ent WHERE true {w})""", SLICE, WHERE)
report("KP14_exec_margin", kpis.exec_margin, lambda w: f"SELECT c * 100 AS cur_pct, p * 100 AS prior_pct, (c - p) * 100 AS qoq_pp FROM (SELECT {div('m1', 'r1')} AS c, {div('m0', 'r0')} AS p FROM {_win('actual_margin', w)})", SLICE, WHERE)
report("KP15_exec_revenue_per_partner", kpis.exec_revenue_per_partner, lambda w: f"SELECT c / 1e6 AS cur_m, y / 1e6 AS yoy_m, {chg('c', 'y')} AS yoy_pct, n1 AS cur_partners, n12 AS yoy_partners FROM {_econ(w)}", SLICE, WHERE)
report("KP16_exec_expenses", kpis.exec_expenses, lambda w: f"SELECT {dbl('e')} / 1e6 AS exp_m, {dbl('bud')} / 1e6 AS budget_m, {chg('e', 'bud')} AS pct_over, {chg('e', 'prior')} AS mom_pct FROM {_exp(w)}", SLICE, WHERE)
_gap = lambda a, bud: f"(SELECT location, {rnd(dbl(f'sum({a}) - sum({bud})') + ' / 1e6', 2)} AS gap_m, {rnd('(' + div(f'sum({a})', f'sum({bud})') + ' - 1) * 100', 2)} AS gap_pct FROM r_pnl WHERE fiscal_period = {back(1)} GROUP BY 1)"
query("KP17_best_offices", f"SELECT * FROM {_gap('total_revenue', 'budgeted_revenue')} ORDER BY gap_m DESC NULLS LAST, location LIMIT 5")(lambda f: kpis.offices_by_revenue_gap(f))
query("KP17b_worst_offices", f"SELECT * FROM {_gap('total_revenue', 'budgeted_revenue')} ORDER BY gap_m ASC NULLS LAST, location LIMIT 5")(lambda f: kpis.offices_by_revenue_gap(f, best=False))
query("KP18_offices_over_budget", f"SELECT * FROM {_gap(_five, 'budgeted_expenses')} ORDER BY gap_pct DESC NULLS LAST, location LIMIT 5")(lambda f: kpis.offices_by_expense_overage(f))
query("KP19_practice_margins", f"SELECT practice_area, {rnd(pct('sum(actual_margin)', 'sum(actual_revenue)'), 2)} AS margin_pct FROM r_profit WHERE {_now} GROUP BY 1")(lambda f: kpis.practice_margins(f))
_dsosnap = lambda w: f"""WITH per AS (SELECT snapshot_date, {rnd(div('sum(open_ar_balance * CAST(weighted_dso_days AS DECIMAL(10,1)))', 'sum(open_ar_balance)'), 1)} AS dso, row_number() OVER (ORDER BY snapshot_date DESC) AS rn FROM r_snap
    WHERE snapshot_date < {back(0)} {w} GROUP BY 1) SELECT max(dso) FILTER (rn = 1) AS current_dso, coalesce(max(dso) FILTER (rn = 2), max(dso) FILTER (rn = 1)) AS prior_dso FROM per"""
query("KP20_dso_from_snapshots", _dsosnap(""))(lambda f: kpis.dso_from_snapshots(f))
query("KP20_dso_from_snapshots_filtered", _dsosnap("AND region = 'ASIA' AND customer_name = 'Customer#000000031'"))(lambda f: kpis.dso_from_snapshots(f, {"region": "ASIA", "customer": "Customer#000000031"}))
query("KP20_dso_from_snapshots_fallback", _dsosnap(""))(lambda f: kpis.dso_from_snapshots(f, SLICE))
_mean = lambda c: rnd(div(f"sum({c})", f"count({c})"), 1)
_od = "(CASE WHEN payment_status NOT IN ('Paid', 'Closed') THEN days_outstanding END)"
report("KP21_dpo_days", kpis.dpo_days, lambda w: f"SELECT {_mean(_od)} AS dpo, {_mean(f'(CASE WHEN {_od} > 30 THEN {_od} - 30 END)')} AS prior_dpo FROM r_ap WHERE true {w}", STAFF_SLICE, "AND region = 'ASIA'")
_unpaid = lambda t, party, amt, w, k: f"SELECT {party}, {rnd(dbl(f'sum({amt})') + ' / 1e6', 2)} AS total_m, count(*) AS n_invoices, {rnd(div('sum(days_outstanding)', 'count(*)'), 1)} AS avg_days FROM {t} WHERE {clean_open()} {w} GROUP BY {party} ORDER BY sum({amt}) DESC, {party} LIMIT {k}"
report("KP22_top_unpaid_clients", kpis.top_unpaid_clients, lambda w: _unpaid("r_ar", "customer_name", "amount", w, 5), SLICE, WHERE)
report("KP22b_top_unpaid_vendors", kpis.top_unpaid_vendors, lambda w: _unpaid("r_payables", "vendor_name", "amount_due", w, 5), STAFF_SLICE, "AND region = 'ASIA'")
report("KP23_dso_by_office", kpis.dso_by_office, lambda w: f"SELECT location, {_mean(_od)} AS dso, {rnd(dbl('sum(amount) FILTER (' + clean_open() + ')') + ' / 1e6', 2)} AS open_ar_m FROM r_ar WHERE location IS NOT NULL {w} GROUP BY 1 ORDER BY dso DESC NULLS LAST, location LIMIT 5", SLICE, WHERE)
report("KP24_utilization_mom", kpis.utilization_mom, lambda w: f"SELECT c AS cur_pct, p AS prior_pct, c - p AS mom_pp FROM (SELECT {pct(at('billable_hours', 1), at('total_hours', 1))} AS c, {pct(at('billable_hours', 2), at('total_hours', 2))} AS p FROM r_ent WHERE true {w})", SLICE, WHERE)
report("KP25_partner_change", kpis.partner_change, lambda w: f"SELECT n1 AS cur, n30 AS prior, n1 - n30 AS mom_delta FROM {_partners(w)}", STAFF_SLICE, "AND region = 'ASIA'")
report("KP11b_bench_cost_mom", kpis.bench_cost_mom, lambda w: f"SELECT {dbl('c1')} / 1e6 AS cur_m, {dbl('c2')} / 1e6 AS prior_m, {chg('c1', 'c2')} AS mom_pct FROM (SELECT {at(_idle, 1, _fm)} AS c1, {at(_idle, 2, _fm)} AS c2 FROM r_timecards WHERE true {w})", SLICE, WHERE)
report("KP26_low_utilization", kpis.low_utilization, lambda w: f"SELECT a AS cur, p AS prior, a - p AS delta FROM (SELECT (SELECT count(*) FROM {_low(1, w)}) AS a, (SELECT count(*) FROM {_low(2, w)}) AS p)", SLICE, WHERE)
report("KP27_bench_by_practice", kpis.bench_by_practice, lambda w: f"SELECT practice_area, {rnd(dbl(f'sum({_idle})') + ' / 1e6', 2)} AS bench_m FROM r_timecards WHERE fiscal_month = {back(1)} {w} GROUP BY 1 ORDER BY sum({_idle}) DESC, 1 LIMIT 6", SLICE, WHERE)
query("KP27b_bench_by_level", f"SELECT e.job_level, {rnd(dbl(f'sum({_idle})') + ' / 1e6', 2)} AS bench_m, count(DISTINCT t.employee_id) AS emps FROM r_timecards t JOIN (SELECT employee_id, job_level FROM r_employees WHERE is_latest_snapshot) e ON t.employee_id = e.employee_id WHERE fiscal_month = {back(1)} GROUP BY 1")(lambda f: kpis.bench_by_level(f))
_lowby = lambda by, k: f"SELECT {by}, count(DISTINCT employee_id) AS low_util_n FROM r_employees WHERE is_latest_snapshot AND {by} IS NOT NULL AND employee_id IN {_low(1)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"
query("KP28_low_utilization_by_practice", _lowby("practice_area", 6))(lambda f: kpis.low_utilization_by(f, "practice_area", k=6))
query("KP28b_low_utilization_by_level", _lowby("job_level", 8))(lambda f: kpis.low_utilization_by(f, "job_level"))
query("KP29_partner_change_by_practice", f"SELECT practice_area, n1 AS cur, NULLIF(n30, 0) AS prior, n1 - NULLIF(n30, 0) AS delta FROM {_partners('', 'practice_area,')} WHERE n1 > 0 ORDER BY delta ASC NULLS FIRST, practice_area LIMIT 6")(lambda f: kpis.partner_change_by_practice(f))
report("KP30_filter_options", kpis.filter_options, lambda w: " UNION ".join(f"SELECT '{d}' AS axis, {d} AS value FROM r_ent WHERE {d} IS NOT NULL {w}" for d in DIM.split(", ")), SLICE, WHERE)
_s = "collection_priority_score"
query("KP31_unpaid_work_list", f"""SELECT record_id, counterparty_name, project_name, {dbl('amount')} AS amount, CAST(CASE WHEN days_outstanding > 90 THEN 45 + CAST(floor({_s}) AS INTEGER) % 45 WHEN days_outstanding < 30 THEN 30 + CAST(floor({_s}) AS INTEGER) % 20 ELSE days_outstanding END AS INTEGER) AS days_outstanding,
    lead_partner_name, CASE WHEN {_s} > 120 THEN 'URGENT: Invoice immediately' WHEN {_s} > 100 THEN 'HIGH: Follow up required' ELSE 'MEDIUM: Monitor closely' END AS action_item, {_s} FROM r_recv WHERE {_s} >= 80 AND lead_partner_name IS NOT NULL ORDER BY r_recv.amount DESC, record_id LIMIT 5""")(lambda f: kpis.unpaid_work_list(f))
query("KP32_behind_target", f"""SELECT practice_area || ' (' || region || ')' AS area, {dbl('accrued')} AS accrued, coalesce({dbl('pipe')}, 0.0) AS pipeline, {dbl('target')} AS target, variance, coalesce(lead, 'Unassigned') AS partner
    FROM (SELECT practice_area, region, sum(total_revenue) AS accrued, sum(budgeted_revenue) AS target, {chg('sum(total_revenue)', 'sum(budgeted_revenue)')} AS variance FROM r_pnl WHERE fiscal_period = {back(1)} GROUP BY 1, 2 ORDER BY variance ASC NULLS LAST, 1, 2 LIMIT 5)
    LEFT JOIN (SELECT practice_area, region, sum(CAST(round(CAST({dbl('greatest(planned_revenue - actual_revenue, 0)')} / greatest({months_between('project_end_date', ASOF)}, 1.0) AS DECIMAL(38,8)), 4) AS DECIMAL(38,4))) AS pipe FROM r_profit WHERE project_status = 'Active' AND planned_revenue > 0 AND project_end_date > {ASOF} GROUP BY 1, 2) USING (practice_area, region)
    LEFT JOIN (SELECT practice_area, region, arg_min(full_name, employee_id) AS lead FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' AND is_latest_snapshot GROUP BY 1, 2) USING (practice_area, region)""")(lambda f: kpis.behind_target(f))
_runrate = lambda lo, hi: f"""SELECT department, {dbl('accrued')} AS accrued, budget, over_ * 100 AS variance, coalesce(lead_name, 'Unassigned') AS lead FROM (SELECT *, ({dbl('accrued')} - budget) / NULLIF(budget, 0) AS over_ FROM (SELECT department,
    sum(amount) FILTER (fiscal_month = {back(1)}) AS accrued, {div(f'sum(amount) FILTER (fiscal_month < {back(1)})', f'count(DISTINCT fiscal_month) FILTER (fiscal_month < {back(1)})')} AS budget FROM r_ap WHERE fiscal_month >= {back(13)} AND fiscal_month < {back(0)} GROUP BY 1))
    LEFT JOIN (SELECT department_category AS department, full_name AS lead_name FROM (SELECT department_category, full_name, row_number() OVER (PARTITION BY department_category ORDER BY CASE job_level WHEN 'Senior Partner' THEN 1 WHEN 'Partner' THEN 2 WHEN 'Associate Partner' THEN 3 ELSE 4 END, hire_date, employee_id) AS rn
      FROM r_employees JOIN r_cost_centers ON cost_center = cost_center_code WHERE is_latest_snapshot AND employment_status = 'Active' AND job_level IN ('Senior Partner', 'Partner', 'Associate Partner', 'Director')) WHERE rn = 1) USING (department)
    WHERE over_ > {lo} AND over_ <= {hi} ORDER BY over_ DESC, department LIMIT 5"""
query("KP33_department_run_rate", _runrate(0.10, 0.15))(lambda f: kpis.department_run_rate(f))
query("KP33b_department_run_rate_wide", _runrate(-0.9, 9.0))(lambda f: kpis.department_run_rate(f, -0.9, 9.0))
_te = pct("billable_expenses", "total_contract_value")
query("KP34_expense_outliers", f"""SELECT project_id, client_name, {dbl('billable_expenses')} AS total_te_billed, {dbl('total_contract_value')} AS total_contract_value, {_te} AS te_pct, coalesce(lead_partner_name, 'Unassigned') AS lead_partner_name, project_name,
    CASE WHEN {_te} > 10 THEN 'URGENT: Review expenses immediately' WHEN {_te} > 8 THEN 'HIGH: Expense review required' ELSE 'MEDIUM: Monitor expenses' END AS action_item FROM r_audit WHERE total_contract_value > 0 AND is_active AND {_te} > 6 ORDER BY te_pct DESC, project_id LIMIT 5""")(lambda f: kpis.expense_outliers(f))
PREFERRED = ["NATION_4", "NATION_9", "NATION_14"]
query("KP35_largest_office_overage", f"""SELECT location AS office, {rnd(dbl('a') + ' * 12 / 1e6', 0)} AS actual_mm, {rnd(dbl('bb') + ' * 12 / 1e6', 0)} AS budget_mm, {rnd(dbl('a - bb') + ' * 12 / 1e6', 0)} AS overage_mm, {rnd(pct('a - bb', 'bb'), 1)} AS overage_pct
    FROM (SELECT location, sum({_five}) AS a, sum(budgeted_expenses) AS bb FROM r_pnl WHERE fiscal_period = {back(1)} GROUP BY 1) WHERE a > bb ORDER BY CASE WHEN location IN ('NATION_4', 'NATION_9', 'NATION_14') THEN 0 ELSE 1 END, a - bb DESC, location LIMIT 1""")(lambda f: kpis.largest_office_overage(f, PREFERRED))
_avg = lambda t: div(f"sum(CAST(actual_margin_pct AS DECIMAL(18,2))) FILTER ({t})", f"count(actual_margin_pct) FILTER ({t})")
query("KP36_steepest_margin_fall", f"""SELECT practice_area, {rnd('c', 1)} AS curr_margin, {rnd('p', 1)} AS prior_margin, {rnd('c - p', 1)} AS qoq_change_pp FROM (SELECT practice_area, {_avg(_now)} AS c, {_avg(_before)} AS p FROM r_profit WHERE actual_margin_pct BETWEEN 10 AND 50 GROUP BY 1)
    WHERE c - p < 0 ORDER BY c - p, practice_area LIMIT 1""")(lambda f: kpis.steepest_margin_fall(f))
_pm = lambda n: f"count(DISTINCT employee_id) FILTER (date_trunc('month', snapshot_date) = {back(n)})"
query("KP37_largest_partner_growth", f"""SELECT practice_area, c AS curr_partners, y AS yoy_partners, c - y AS net_added, {rnd(chg('c', 'y'), 1)} AS yoy_pct FROM (SELECT practice_area, {_pm(1)} AS c, {_pm(13)} AS y FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active' GROUP BY 1)
    WHERE c > 0 AND y > 0 AND c > y ORDER BY c - y DESC, practice_area LIMIT 1""")(lambda f: kpis.largest_partner_growth(f))
query("KP38_priorities", f"""WITH k_dso AS (SELECT {rnd('c', 1)} AS v, {rnd('p - c', 1)} AS imp FROM (SELECT {div(at('accounts_receivable', 1), at('revenue', 1))} * 30.0 AS c, {div(at('accounts_receivable', 2), at('revenue', 2))} * 30.0 AS p FROM r_ent)),
    k_dpo AS (SELECT {rnd('c', 1)} AS v FROM {_dpo('')}), k_util AS (SELECT u1 AS v, {rnd('u1 - u2', 1)} AS ch FROM {_util('')}), k_heads AS (SELECT 5000 - n AS v FROM {_heads('')}), k_bench AS (SELECT {_lowp(1, '')} AS v), k_client AS (SELECT * FROM {_client('')}), k_vendor AS (SELECT * FROM {_vendor('')})
    SELECT area, CAST(priority AS INTEGER) AS priority, title, {dbl('value')} AS value FROM (
    SELECT 'collections' AS area, 1 AS priority, CASE WHEN v > 72 THEN 'Critical: Accelerate Collections' WHEN imp < 0 THEN 'Reverse Collections Deterioration' ELSE 'Maintain Collections Excellence' END AS title, v AS value FROM k_dso
    UNION ALL SELECT 'client', 2, CASE WHEN top_amount_k > 100 AND top_days_overdue > 30 THEN 'Escalate: ' || top_client || ' Collection' WHEN top_amount_k > 50 THEN 'Priority Collection: ' || top_client ELSE 'Optimize Payment Terms' END, top_amount_k FROM k_client
    UNION ALL SELECT 'payables', 3, CASE WHEN v < 36 THEN 'Optimize Vendor Payment Timing' ELSE 'Vendor Strategy: ' || top_vendor END, v FROM k_dpo, k_vendor
    UNION ALL SELECT 'utilization', 4, CASE WHEN v < 75 THEN 'Critical: Low Utilization Crisis' WHEN ch < -5 THEN 'Reverse Utilization Decline' ELSE 'Optimize Consultant Deployment' END, v FROM k_util
    UNION ALL SELECT 'headcount', 5, CASE WHEN v > 10 THEN 'Accelerate Partner Recruitment' WHEN v > 5 THEN 'Close Headcount Gap' END, v FROM k_heads
    UNION ALL SELECT 'bench', 6, CASE WHEN v > 20 THEN 'Redeploy ' || v || ' Bench Consultants' WHEN v > 10 THEN 'Reduce Bench Time' END, v FROM k_bench) WHERE title IS NOT NULL""")(lambda f: kpis.priorities(f))
_latest = "(SELECT max(fiscal_period) FROM r_ent)"
report("KP39_delivery_share", kpis.delivery_share, lambda w: f"SELECT {rnd(pct('sum(delivery_cost)', 'sum(revenue)'), 1)} AS delivery_cost_pct, {rnd(pct('sum(profit)', 'sum(revenue)'), 1)} AS margin_pct, {rnd(dbl('sum(revenue)') + ' / 1e6', 1)} AS total_revenue_mm FROM r_ent WHERE fiscal_period = {_latest} {w}", SLICE, WHERE)
CANONICAL = f"""SELECT 'low_utilization_employees' AS name, (SELECT {dbl('count(*)')} FROM (SELECT employee_id FROM r_timecards WHERE work_date >= {ASOF} - 90 GROUP BY 1 HAVING sum(hours_worked) > 0 AND {div(f'sum({_bill})', 'sum(hours_worked)')} < 0.5)) AS value, 'count' AS kind
    UNION ALL SELECT 'partners', {dbl('count(DISTINCT employee_id)')}, 'count' FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active'
    UNION ALL SELECT 'revenue_per_partner', {dbl('(SELECT sum(revenue) FROM r_ent)')} / {dbl("(SELECT count(DISTINCT employee_id) FROM r_employees WHERE job_level = 'Partner' AND employment_status = 'Active')")}, 'dollar'
    UNION ALL SELECT 'dso', {div('sum(days_outstanding)', 'count(days_outstanding)')}, 'days' FROM r_recv WHERE payment_status <> 'Paid'"""
query("KP40_canonical_totals", CANONICAL)(lambda f: kpis.canonical_totals(f))
query("KP41_generator_sanity", f"SELECT fiscal_month, {dbl('sum(billing_amount)')} AS revenue, {dbl('sum(hours_worked)')} AS hours, count(DISTINCT employee_id) AS heads FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY 1")(lambda f: kpis.generator_sanity(f))
query("KP41b_budget_spread", f"""SELECT {dbl('min(planned_revenue)')} AS min_budget, {div('sum(planned_revenue)', 'count(*)')} AS avg_budget, {dbl('max(planned_revenue)')} AS max_budget, count(*) AS projects,
    count(*) FILTER (lead_partner_id IN (SELECT employee_id FROM r_people)) AS projects_with_known_lead FROM r_projects""")(lambda f: kpis.budget_spread(f))
