"""DQ*: quality checks, each as a table of check, actual, lo, hi, passed."""

from pyspark.sql import functions as F

from tallyhouse.catalogue.check_tables import ASOF, back, clean_open, dbl, div, pct
from tallyhouse.catalogue.registry import query
from tallyhouse.plans import envelope as env, quality as q

BOUNDS = q.Bounds.load()
num = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)"
ALL: list[q.Check] = []
SQL: dict[str, str] = {}
SCALARS: dict[str, tuple[str, str]] = {}


def row(name, low, high, scalar):
    tests = ["actual IS NOT NULL"] + ([f"actual >= {num(low)}"] if low is not None else []) + ([f"actual <= {num(high)}"] if high is not None else [])
    return f"SELECT '{name}' AS \"check\", actual, {num(low)} AS lo, {num(high)} AS hi, coalesce({' AND '.join(tests)}, false) AS passed FROM (SELECT CAST(({scalar}) AS DOUBLE) AS actual)"


def checks(qid, *items):
    """items: (name, value function, (low, high), scalar SQL[, column])"""
    made = [q.Check(n, v, *b, *column) for n, v, b, _, *column in items]
    sql = " UNION ALL ".join(row(n, *b, s) for n, _, b, s, *_ in items)
    ALL.extend(made)
    SQL.update({n: row(n, *b, s) for n, _, b, s, *_ in items})
    SCALARS.update({n: (qid, s) for n, _, _, s, *_ in items})
    query(qid, sql)(lambda f: q.evaluate(f, made))


at = BOUNDS.at
OPEN = f"FROM r_ar WHERE {clean_open()}"
checks("DQ1_trailing_revenue", ("annual revenue", q.trailing_revenue, at("firmwide", "annual_revenue"), f"SELECT sum(amount) FROM r_ar WHERE invoice_date >= {ASOF} - 365"))
checks("DQ2_headcount", ("strict partners", q.headcount, at("firmwide", "strict_partners"), "SELECT count(*) FROM r_current WHERE employment_status = 'Active' AND job_level = 'Partner'", "partners"),
       ("total employees", q.headcount, at("firmwide", "total_employees"), "SELECT count(*) FROM r_current WHERE employment_status = 'Active'", "everyone"))
checks("DQ3_open_receivables", ("open receivables", q.open_receivables, at("receivables_ar", "total_open_ar"), f"SELECT sum(amount) {OPEN}"))
_conc = lambda k, t, p, a: f"SELECT {div(f'(SELECT sum(s) FROM (SELECT sum({a}) AS s {t} GROUP BY {p} ORDER BY s DESC LIMIT {k}))', f'(SELECT sum({a}) {t})')} * 100.0"
checks("DQ4_client_concentration", ("top ten clients", lambda f: q.concentration(q._open_ar(f), "customer_name", "amount", 10), at("receivables_ar", "top_10_client_ar_concentration_pct"), _conc(10, OPEN, "customer_name", "amount")),
       ("top client", lambda f: q.concentration(q._open_ar(f), "customer_name", "amount", 1), at("receivables_ar", "top_1_client_ar_concentration_pct"), _conc(1, OPEN, "customer_name", "amount")))
checks("DQ5_largest_invoice", ("largest invoice", q.largest_invoice, at("receivables_ar", "single_invoice"), "SELECT max(amount) FROM r_ar"))
checks("DQ6_orphan_projects", ("receivable project orphans", q.orphan_count, (0, 0), "SELECT count(*) FROM r_ar WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT project_id FROM r_projects)"))
_days = {"bucket_0_30": ("0-30 days", "days_outstanding <= 30"), "bucket_31_60": ("31-60 days", "days_outstanding BETWEEN 31 AND 60"), "bucket_61_90": ("61-90 days", "days_outstanding BETWEEN 61 AND 90"), "bucket_91_plus": ("90+ days", "days_outstanding > 90")}
checks("DQ7_bucket_shares", *[(f"share of {label}", q.bucket_shares, at("receivables_ar", "aging_distribution_pct", key), f"SELECT {pct(f'sum(CASE WHEN {t} THEN amount ELSE 0 END)', 'sum(amount)')} {OPEN}", label) for key, (label, t) in _days.items()])
checks("DQ8_dso_swing", ("largest monthly change of DSO", q.dso_swing, at("receivables_ar", "max_mom_firmwide_dso_delta_days"), "SELECT max(abs(d - p)) FROM (SELECT d, lag(d) OVER (ORDER BY snapshot_date) AS p FROM (SELECT DISTINCT snapshot_date, firmwide_dso_days AS d FROM r_snap))"))
checks("DQ9_cohort_spread", ("top five against the rest", q.cohort_spread, at("receivables_ar", "min_top5_vs_rest_dso_spread_days"), f"SELECT abs({div('sum(bd) FILTER (rn <= 5)', 'sum(b) FILTER (rn <= 5)')} - {div('sum(bd) FILTER (rn > 5)', 'sum(b) FILTER (rn > 5)')}) FROM (SELECT sum(amount) AS b, sum(amount * days_outstanding) AS bd, row_number() OVER (ORDER BY sum(amount) DESC, customer_name) AS rn {OPEN} GROUP BY customer_name)"))
checks("DQ10_vendors", ("top vendor", lambda f: q.concentration(f.table("fact_accounts_payable"), "vendor_name", "amount", 1), at("payables_ap", "top_vendor_concentration_pct"), _conc(1, "FROM r_ap", "vendor_name", "amount")),
       ("vendor count", q.vendor_count, at("payables_ap", "vendor_count"), "SELECT count(DISTINCT vendor_name) FROM r_ap"))
_lc, _tex = dbl("(SELECT sum(cost_amount) FROM r_timecards WHERE time_type_clean = 'Billable')"), dbl("(SELECT sum(amount) FROM r_expenses_filed WHERE is_billable)")
checks("DQ11_labour_share", ("labour share of billable expense", q.labour_share, at("expense_structure", "billable_expense_labor_share_pct"), f"SELECT {_lc} / NULLIF({_lc} + coalesce({_tex}, 0), 0) * 100"))
checks("DQ12_partner_hours", ("monthly billable hours per partner", q.partner_hours, at("partner_economics", "monthly_billable_hours_per_partner"), f"SELECT {div('sum(h)', 'count(h)')} FROM (SELECT employee_id, fiscal_month, sum(hours_worked) AS h FROM r_timecards WHERE time_type_clean = 'Billable' AND employee_id IN (SELECT employee_id FROM r_current WHERE job_level IN ('Partner', 'Senior Partner')) GROUP BY 1, 2)"))
_cv = lambda a, b: f"SELECT max(abs({div(f'{a} - {b}', b)})) * 100 FROM r_pnl WHERE {a} > 0 AND {b} > 0 AND fiscal_period = {back(1)}"
checks("DQ13_cell_variance", ("largest revenue variance", lambda f: q.cell_variance(f, "total_revenue", "budgeted_revenue"), at("budget_variance", "office_month_variance_pct"), _cv("total_revenue", "budgeted_revenue")),
       ("largest expense variance", lambda f: q.cell_variance(f, "total_expenses", "budgeted_expenses"), at("budget_variance", "office_month_variance_pct"), _cv("total_expenses", "budgeted_expenses")))
checks("DQ14_office_count", ("offices", q.office_count, at("office_economics", "count"), "SELECT count(DISTINCT location) FROM r_current"))
_sparse = lambda t, c, n: f"SELECT count(*) FILTER (n < {n}) FROM (SELECT location, fiscal_month, count(*) AS n FROM {t} WHERE {c} >= {ASOF} - 365 GROUP BY 1, 2)"
checks("DQ15_sparse_cells", ("sparse receivable cells", lambda f: q.sparse_cells(f, "fact_accounts_receivable", "invoice_date", 25), (0, 0), _sparse("r_ar", "invoice_date", 25)))
checks("DQ16_volume_ratio", ("three months against twelve", q.volume_ratio, (0.6, 1.4), f"SELECT {div(f'sum(s) FILTER (fiscal_month >= {ASOF} - 90)', f'count(s) FILTER (fiscal_month >= {ASOF} - 90)')} / {div('sum(s)', 'count(s)')} FROM (SELECT fiscal_month, sum(amount) AS s FROM r_expenses_filed WHERE expense_date >= {ASOF} - 365 GROUP BY 1)"))
_last = f"FROM r_pnl WHERE fiscal_period = {back(1)}"
checks("DQ17_expense_variance", ("firm expense variance", q.firm_expense_variance, (-5, 5), f"SELECT {pct('sum(total_expenses) - sum(budgeted_expenses)', 'sum(budgeted_expenses)')} {_last}"),
       ("largest office expense variance", q.office_expense_variance, (None, 15), f"SELECT max(abs({div('a - b', 'b')})) * 100 FROM (SELECT location, sum(total_expenses) AS a, sum(budgeted_expenses) AS b {_last} GROUP BY 1) WHERE b > 0"))
_spread = lambda c: f"SELECT max(CAST(s AS DOUBLE)) / NULLIF(quantile_cont(CAST(s AS DOUBLE), 0.5), 0) FROM (SELECT location, sum({c}) AS s FROM r_pnl WHERE fiscal_period >= {ASOF} - 180 GROUP BY 1)"
checks("DQ18_office_spread", ("expense: largest to median office", lambda f: q.office_spread(f, "total_expenses"), (None, 2.5), _spread("total_expenses")), ("revenue: largest to median office", lambda f: q.office_spread(f, "total_revenue"), (None, 2.5), _spread("total_revenue")))
_pa, _pb = dbl(f"(SELECT sum(corporate_expenses) {_last})"), dbl(f"(SELECT sum(CAST(accrued_expenses AS DECIMAL(38,2))) FROM r_dept WHERE department = 'Corporate' AND fiscal_period = {back(1)})")
checks("DQ19_table_parity", ("corporate expense in two tables", q.table_parity, (None, 5), f"SELECT abs({_pa} - {_pb}) / NULLIF(greatest({_pa}, {_pb}), 0) * 100"))
checks("DQ20_ledger_balance", ("debits equal credits", q.ledger_balance, (0, 0), "SELECT sum(net_amount) FROM r_gl"))
# every declared bound --------------------------------------------------------------
_year = lambda t, c: f"(SELECT * FROM {t} WHERE {c} >= {ASOF} - 365)"
_mix = lambda path, c: f"SELECT '{path}' AS path, coalesce({c}, 'unknown') AS member, {pct('sum(amount)', f'(SELECT sum(amount) FROM {_year('r_ar', 'invoice_date')})')} AS actual FROM {_year('r_ar', 'invoice_date')} GROUP BY 2"
_fig = lambda path, scalar, member="": f"SELECT '{path}', '{member}', CAST(({scalar}) AS DOUBLE)"
_q = lambda x: f"SELECT quantile_cont({dbl('planned_revenue')}, {x}) FROM r_projects"
_least = lambda t, c: f"SELECT min(n) FROM (SELECT count(*) AS n FROM {_year(t, c)} GROUP BY location, fiscal_month)"
_known = lambda t: f"SELECT {pct('count(*) FILTER (project_id IN (SELECT project_id FROM r_projects))', 'count(project_id)')} FROM {t}"
_REVENUE = "FROM r_timecards WHERE time_type_clean = 'Billable'"
_filed = "SELECT sum(amount) FROM r_expenses_filed"
ACTUALS = " UNION ALL ".join([
    _mix("practice_economics.share_of_revenue_pct", "practice_area"), _mix("industry_mix.share_pct", "industry"), _mix("office_economics.share_of_revenue_pct", "location"),
    _fig("firmwide.annual_revenue", f"SELECT sum(amount) FROM {_year('r_ar', 'invoice_date')}"), _fig("practice_economics.count", f"SELECT count(DISTINCT practice_area) FROM {_year('r_ar', 'invoice_date')}"),
    _fig("firmwide.strict_partners", "SELECT count(*) FROM r_current WHERE employment_status = 'Active' AND job_level = 'Partner'"), _fig("firmwide.total_employees", "SELECT count(*) FROM r_current WHERE employment_status = 'Active'"),
    _fig("office_economics.count", "SELECT count(DISTINCT location) FROM r_current"),
    "SELECT 'practice_economics.partner_count', practice_area, CAST(count(*) FILTER (employment_status = 'Active' AND job_level = 'Partner') AS DOUBLE) FROM r_current GROUP BY 2",
    _fig("receivables_ar.total_open_ar", f"SELECT sum(amount) {OPEN}"), _fig("receivables_ar.single_invoice", "SELECT max(amount) FROM r_ar"), _fig("semantic_invariants.ar_project_id_fk_resolution_pct", _known("r_ar")),
    *[_fig("receivables_ar.aging_distribution_pct", f"SELECT {pct(f'sum(CASE WHEN {t} THEN amount ELSE 0 END)', 'sum(amount)')} {OPEN}", key) for key, (_, t) in _days.items()],
    _fig("receivables_ar.top_10_client_ar_concentration_pct", _conc(10, OPEN, "customer_name", "amount")), _fig("receivables_ar.top_1_client_ar_concentration_pct", _conc(1, OPEN, "customer_name", "amount")),
    _fig("payables_ap.top_vendor_concentration_pct", _conc(1, "FROM r_ap", "vendor_name", "amount")), _fig("payables_ap.vendor_count", "SELECT count(DISTINCT vendor_name) FROM r_ap"),
    _fig("client_portfolio.top_10_revenue_concentration_pct", _conc(10, _REVENUE, "customer", "billing_amount")), _fig("client_portfolio.top_1_revenue_concentration_pct", _conc(1, _REVENUE, "customer", "billing_amount")),
    f"SELECT 'expense_structure.category_share_pct', coalesce(expense_category_business, 'unknown'), {pct('sum(amount)', f'({_filed})')} FROM r_expenses_filed GROUP BY 2",
    _fig("engagement_economics.median_engagement_value", _q(0.5)), _fig("engagement_economics.p90_engagement_value", _q(0.9)), _fig("engagement_economics.top_engagement_value", _q(1.0)),
    _fig("firmwide.total_active_engagements", "SELECT count(*) FROM r_projects WHERE is_active"), _fig("firmwide.total_active_clients", "SELECT count(DISTINCT client_id) FROM r_projects WHERE is_active"),
    f"SELECT 'office_economics.utilization_pct', coalesce(location, 'unknown'), {pct("sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END)", 'sum(hours_worked)')} FROM {_year('r_timecards', 'work_date')} GROUP BY 2",
    _fig("volume_density.timecard_rows_per_office_month_min", _least("r_timecards", "work_date")), _fig("volume_density.ar_rows_per_office_month_min", _least("r_ar", "invoice_date")),
    _fig("volume_density.ap_rows_per_office_month_min", _least("r_ap", "invoice_date")), _fig("volume_density.events_per_day_min", "SELECT min(n) FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)"),
    _fig("semantic_invariants.expense_project_id_fk_resolution_pct", _known("r_expenses")),
    _fig("budget_variance.office_month_variance_pct", f"SELECT max(v) FROM (({_cv('total_revenue', 'budgeted_revenue')}) UNION ALL ({_cv('total_expenses', 'budgeted_expenses')})) AS t(v)"),
    *[_fig(path, scalar) for path, (_, scalar) in {
        "receivables_ar.max_mom_firmwide_dso_delta_days": SCALARS["largest monthly change of DSO"], "receivables_ar.min_top5_vs_rest_dso_spread_days": SCALARS["top five against the rest"],
        "expense_structure.billable_expense_labor_share_pct": SCALARS["labour share of billable expense"], "partner_economics.monthly_billable_hours_per_partner": SCALARS["monthly billable hours per partner"]}.items()],
    _fig("semantic_invariants.cross_region_project_share_pct", f"SELECT {pct('sum(CASE WHEN home <> region THEN hours_worked ELSE 0 END)', 'sum(hours_worked)')} FROM r_timecards JOIN (SELECT employee_id, region AS home FROM r_employees WHERE is_latest_snapshot) USING (employee_id) WHERE time_type_clean = 'Billable'"),
])


def bounds_sql(sections=None):
    limits = env.bound_rows({s: v for s, v in BOUNDS.tree.items() if sections is None or s in sections})
    values = ", ".join(f"('{p}', '{m}', {num(a)}, {num(b)})" for p, m, a, b in limits)
    return f"""SELECT path, member, lo, hi, actual, actual IS NOT NULL AND coalesce(actual >= lo, true) AND coalesce(actual <= hi, true) AS passed FROM (
        SELECT b.path, CASE WHEN b.m = '*' THEN coalesce(a.member, '*') ELSE b.m END AS member, b.lo, b.hi, a.actual FROM (VALUES {values}) AS b(path, m, lo, hi)
        LEFT JOIN ({ACTUALS}) AS a(path, member, actual) ON a.path = b.path AND (b.m = '*' OR a.member = b.m))"""


NEVER_CHECKED = ("practice_economics", "engagement_economics", "expense_structure", "industry_mix", "client_portfolio", "semantic_invariants", "volume_density")
query("DQ21_bounds_as_data", bounds_sql())(lambda f: env.envelope(f, BOUNDS.tree))
query("DQ22_declared_bounds", bounds_sql(NEVER_CHECKED))(lambda f: env.envelope(f, BOUNDS.tree, NEVER_CHECKED))
checks("DQ22b_orphans_and_cells", ("expense project orphans", lambda f: q.orphan_count(f, "fact_expenses"), (0, 0), "SELECT count(*) FROM r_expenses WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT project_id FROM r_projects)"),
       ("sparse payable cells", lambda f: q.sparse_cells(f, "fact_accounts_payable", "invoice_date", 40), (0, 0), _sparse("r_ap", "invoice_date", 40)),
       ("sparse timecard cells", lambda f: q.sparse_cells(f, "fact_timecards", "work_date", 100), (0, 0), _sparse("r_timecards", "work_date", 100)))
query("DQ_all_failures", f"SELECT * FROM ({' UNION ALL '.join(SQL.values())}) WHERE NOT passed")(lambda f: q.evaluate(f, ALL).where(~F.col("passed")))
