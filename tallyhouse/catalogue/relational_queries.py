"""JN*, AG*, WN*, OR*, SO*: joins, aggregates, windows, sorts and set operations on whole tables."""

from pyspark.sql import functions as F

from tallyhouse.catalogue.check_tables import ASOF, DIM, b, back, bucket_of, clean_open, dbl, div, month, pct, rnd
from tallyhouse.catalogue.registry import query
from tallyhouse.catalogue.row_queries import N, SUM, orders
from tallyhouse.functions import rules
from tallyhouse.functions.money import ratio, rounded, share_pct, sum_if, weighted_mean
from tallyhouse.functions.periods import month_start
from tallyhouse.operators import aggregates, joins, windows
from tallyhouse.operators.filters import DIMS
from tallyhouse.plans import gold, kpis
from tallyhouse.plans.silver import current_staff

_O = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(38,4)) AS price, CAST(o_orderdate AS DATE) AS order_date FROM orders)"

# joins ---------------------------------------------------------------------------
query("JN1_inner", "SELECT approval_status, count(*) AS n FROM r_items GROUP BY 1")(
    lambda f: f.source_table("concur_expense_items").join(f.source_table("concur_expense_reports"), ["report_id"]).groupBy("approval_status").agg(N()))


@query("JN2_enrichment_chain", """SELECT e.job_level, p.project_type, c.client_type, count(*) AS n FROM r_timecards t LEFT JOIN r_current e ON t.employee_id = e.employee_id LEFT JOIN r_projects p ON t.project_id = p.project_id
    LEFT JOIN r_clients c ON p.client_id = c.client_id GROUP BY ALL""")
def _chain(f):
    t = f.table("fact_timecards").select("timecard_id", "employee_id", "project_id")
    t = joins.enrich(t, current_staff(f.table("dim_employees")), "employee_id", "employee_id", {"job_level": "job_level"})
    t = joins.enrich(t, f.table("dim_projects"), "project_id", "project_id", {"project_type": "project_type", "client_id": "client_id"})
    t = joins.enrich(t, f.table("dim_clients"), "client_id", "client_id", {"client_type": "client_type"})
    return t.groupBy("job_level", "project_type", "client_type").agg(N())


query("JN3_interval_join", f"SELECT l_suppkey AS employee_id, count(*) AS cards, count(rate) AS rated, {dbl('sum(rate)')} AS rate_sum FROM r_lines l LEFT JOIN r_billing_rate_of r ON l.line_id = r.line_id GROUP BY 1")(
    lambda f: joins.interval_join(f.source_table("workday_timecards").select("employee_id", "work_date"), "employee_id", "work_date", {"rate": (f.source_table("workday_billing_rates"), "billing_rate")})
    .groupBy("employee_id").agg(F.count(F.lit(1)).alias("cards"), F.count("rate").alias("rated"), SUM("rate", "rate_sum")))
query("JN4_snapshot_join", f"SELECT snapshot_date, {bucket_of('days_out')} AS aging_bucket, count(*) AS n, {dbl('sum(amount)')} AS bal FROM r_open GROUP BY ALL")(
    lambda f: joins.open_at_month_ends(f.table("fact_accounts_receivable").select("invoice_date", "payment_date", "amount"), 13, 1, f.as_of)
    .groupBy("snapshot_date", rules.aging_bucket(F.col("days_out")).alias("aging_bucket")).agg(N(), SUM("amount", "bal")))
query("JN5_open_balance_at_billing_months", f"SELECT {DIM}, fiscal_period, {dbl('coalesce(open_ar, 0)')} AS accounts_receivable, coalesce(n_open, 0) AS unpaid_invoice_count, CASE WHEN billed > 0 AND open_ar IS NOT NULL THEN {rnd(div('open_ar', 'billed') + ' * CAST(day(last_day(fiscal_period)) AS DOUBLE)', 1)} END AS avg_days_sales_outstanding FROM r_ar_months")(
    lambda f: gold.receivable_months(f.table("fact_accounts_receivable")))
_CELL = f"{DIM}, fiscal_month"
query("JN6_cell_join", f"SELECT {_CELL}, {dbl('rev')} AS rev, {dbl('exp')} AS exp FROM (SELECT {_CELL}, sum(billing_amount) AS rev FROM r_timecards GROUP BY ALL) LEFT JOIN (SELECT {_CELL}, sum(amount) AS exp FROM r_expenses GROUP BY ALL) USING ({_CELL})")(
    lambda f: f.table("fact_timecards").groupBy(*DIMS, "fiscal_month").agg(SUM("billing_amount", "rev")).join(
        f.table("fact_expenses").groupBy(*DIMS, "fiscal_month").agg(SUM("amount", "exp")), [*DIMS, "fiscal_month"], "left"))


@query("JN7_null_safe_join", f"""SELECT a.loc AS location, a.practice_area, {dbl('rev')} AS rev, {dbl('exp')} AS exp FROM (SELECT NULLIF(location, 'NATION_3') AS loc, practice_area, sum(billing_amount) AS rev FROM r_timecards GROUP BY ALL) a
    LEFT JOIN (SELECT NULLIF(location, 'NATION_3') AS loc, practice_area, sum(amount) AS exp FROM r_expenses GROUP BY ALL) e ON a.loc IS NOT DISTINCT FROM e.loc AND a.practice_area IS NOT DISTINCT FROM e.practice_area""")
def _null_safe(f):
    place = F.nullif("location", F.lit("NATION_3")).alias("location")
    rev = f.table("fact_timecards").groupBy(place, "practice_area").agg(SUM("billing_amount", "rev"))
    exp = f.table("fact_expenses").groupBy(place, "practice_area").agg(SUM("amount", "exp"))
    return joins.null_safe_join(rev, exp, ["location", "practice_area"])


query("JN8_full_outer", f"SELECT {DIM}, {dbl('bal')} AS open_ar, {dbl('recent')} AS recent FROM (SELECT {DIM}, sum(amount) AS bal FROM r_ar WHERE {clean_open()} GROUP BY ALL) FULL JOIN (SELECT {DIM}, sum(amount) AS recent FROM r_ar WHERE invoice_date >= {ASOF} - 30 GROUP BY ALL) USING ({DIM})")(
    lambda f: joins.full_outer(f.table("fact_accounts_receivable").where(rules.is_open()).groupBy(*DIMS).agg(SUM("amount", "open_ar")),
                               f.table("fact_accounts_receivable").where(f.periods.trailing_days("invoice_date", 30)).groupBy(*DIMS).agg(SUM("amount", "recent")), DIMS))
query("JN9_month_spine", "SELECT employee_id, count(*) AS snapshots, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen FROM r_employees GROUP BY 1")(
    lambda f: f.build("dim_employees").groupBy("employee_id").agg(F.count(F.lit(1)).alias("snapshots"), F.min("snapshot_date").alias("first_seen"), F.max("snapshot_date").alias("last_seen")))
query("JN10_two_periods", f"SELECT {dbl(f'sum(price) FILTER (order_date >= {back(1)} AND order_date < {back(0)})')} AS cur, {dbl(f'sum(price) FILTER (order_date >= {back(2)} AND order_date < {back(1)})')} AS prior FROM {_O}")(
    lambda f: orders(f).where(f.periods.between_months("order_date", 2, 0)).agg(*[F.sum(F.when(f.periods.in_month("order_date", n), F.col("price"))).alias(c) for c, n in (("cur", 1), ("prior", 2))]))
query("JN11_one_row_beside", f"SELECT o_orderkey, {dbl('price')} AS price, (SELECT count(*) FROM customer) AS customers FROM {_O} ORDER BY price DESC, o_orderkey LIMIT 1")(
    lambda f: joins.beside(orders(f).orderBy(F.col("price").desc(), "o_orderkey").limit(1).select("o_orderkey", "price"), f.raw("customer").agg(F.count(F.lit(1)).alias("customers"))))
query("JN12_two_roles", "SELECT project_id, lp.full_name AS lead_name, pm.full_name AS manager_name FROM r_projects LEFT JOIN (SELECT employee_id, full_name FROM r_current) lp ON lead_partner_id = lp.employee_id LEFT JOIN (SELECT employee_id, full_name FROM r_current) pm ON project_manager_id = pm.employee_id")(
    lambda f: joins.enrich(joins.enrich(f.table("dim_projects"), current_staff(f.table("dim_employees")), "lead_partner_id", "employee_id", {"lead_name": "full_name"}),
                           current_staff(f.table("dim_employees")), "project_manager_id", "employee_id", {"manager_name": "full_name"}).select("project_id", "lead_name", "manager_name"))
query("JN13_pool_fallback", f"SELECT p.project_id, full_name AS pool_lead FROM r_projects p LEFT JOIN r_pool x ON p.region = x.region AND p.practice_area = x.practice_area AND x.rn = {b('p.project_id', 5)} + 1")(
    lambda f: joins.pick_from_pool(f.table("dim_projects").select("project_id", "region", "practice_area"), joins.ranked_pool(
        current_staff(f.table("dim_employees")).where(F.upper("position_title").like("%PARTNER%") | (F.col("job_level") == "Partner")), ["region", "practice_area"], [F.col("employee_id")], 5),
        ["region", "practice_area"], "project_id", 5, {"pool_lead": "full_name"}).select("project_id", "pool_lead"))
query("JN14_orphans", "SELECT invoice_id, project_id FROM r_ar WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT project_id FROM r_projects)")(
    lambda f: joins.orphans(f.table("fact_accounts_receivable").select("invoice_id", "project_id"), "project_id", f.table("dim_projects"), "project_id"))
query("JN15_semi", f"SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_O} GROUP BY 1 HAVING sum(price) > 3000000) GROUP BY 1")(
    lambda f: f.raw("customer").join(orders(f).groupBy(F.col("o_custkey").alias("c_custkey")).agg(SUM("price", "s")).where(F.col("s") > 3000000), ["c_custkey"], "left_semi").groupBy("c_mktsegment").agg(N()))
query("JN16_upper_names", "SELECT department, department_lead, count(*) AS n FROM r_dept GROUP BY ALL")(lambda f: f.table("department_summary").groupBy("department", "department_lead").agg(N()))
query("JN17_using", f"SELECT o_orderstatus, a.n AS cur, p.n AS prior FROM (SELECT o_orderstatus, count(*) AS n FROM {_O} WHERE order_date >= {back(4)} AND order_date < {back(3)} GROUP BY 1) a JOIN (SELECT o_orderstatus, count(*) AS n FROM {_O} WHERE order_date >= {back(5)} AND order_date < {back(4)} GROUP BY 1) p USING (o_orderstatus)")(
    lambda f: orders(f).where(f.periods.in_month("order_date", 4)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("cur")).join(
        orders(f).where(f.periods.in_month("order_date", 5)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("prior")), ["o_orderstatus"]))
query("JN18_distinct_lookup", "SELECT l.region, count(*) AS n FROM r_projects p LEFT JOIN (SELECT DISTINCT location, region FROM r_pnl) l ON p.location = l.location GROUP BY 1")(
    lambda f: f.table("dim_projects").select("location").join(f.table("regional_pnl").select("location", "region").distinct(), ["location"], "left").groupBy("region").agg(N()))
query("JN19_scalar_subquery", "SELECT employee_id, employment_status FROM r_employees WHERE snapshot_date = (SELECT max(snapshot_date) FROM r_employees)")(
    lambda f: f.table("dim_employees").where(F.col("snapshot_date") == f.table("dim_employees").agg(F.max("snapshot_date")).scalar()).select("employee_id", "employment_status"))

# aggregates ----------------------------------------------------------------------
_T = "CAST(l_extendedprice AS DECIMAL(38,2)) * (1 - CAST(l_discount AS DECIMAL(6,2)))"
query("AG1_monthly_sums", f"SELECT {_CELL}, {dbl('sum(billing_amount)')} AS rev, {dbl('sum(cost_amount)')} AS cost, {dbl('sum(hours_worked)')} AS hours FROM r_timecards WHERE time_type_clean = 'Billable' GROUP BY ALL")(
    lambda f: f.table("fact_timecards").where(gold.billable()).groupBy(*DIMS, "fiscal_month").agg(SUM("billing_amount", "rev"), SUM("cost_amount", "cost"), SUM("hours_worked", "hours")))
_MEM = {"billable": "Billable", "corporate": "Corporate", "marketing": "Marketing", "tech": "Technology"}
_PIV = ", ".join(f"{dbl(f'sum(CASE WHEN expense_category_business {t} THEN {v} ELSE 0 END)')} AS {p}{n}" for p, v in (("act_", "amount"), ("bud_", "budgeted_amount"))
                 for n, t in [*((k, f"= '{v2}'") for k, v2 in _MEM.items()), ("other", "NOT IN ('Billable', 'Corporate', 'Marketing', 'Technology')")])
query("AG2_conditional_pivot", f"SELECT location, fiscal_month, {_PIV} FROM r_expenses GROUP BY ALL")(
    lambda f: f.table("fact_expenses").groupBy("location", "fiscal_month").agg(*aggregates.pivot_sums(F.col("expense_category_business"), _MEM, {"act_": "amount", "bud_": "budgeted_amount"}, "other")))
_BILL = "sum(CASE WHEN time_type_clean = 'Billable' THEN hours_worked ELSE 0 END)"
query("AG3_ratio_of_sums", f"SELECT location, {div(_BILL, 'sum(hours_worked)')} AS utilization FROM r_timecards GROUP BY 1")(
    lambda f: f.table("fact_timecards").groupBy("location").agg(ratio(sum_if(gold.billable(), "hours_worked"), F.sum("hours_worked")).alias("utilization")))
query("AG4_weighted_average", f"SELECT location, {div('sum(amount * days_outstanding)', 'sum(amount)')} AS days FROM r_ar GROUP BY 1")(
    lambda f: f.table("fact_accounts_receivable").groupBy("location").agg(weighted_mean("days_outstanding", "amount").alias("days")))
query("AG5_distinct_count", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS people, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")(
    lambda f: f.raw("lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("people"), F.countDistinct("l_partkey").alias("parts")))
query("AG6_conditional_distinct", "SELECT practice_area, count(DISTINCT CASE WHEN job_level = 'Partner' AND employment_status = 'Active' THEN employee_id END) AS partners FROM r_employees GROUP BY 1")(
    lambda f: f.table("dim_employees").groupBy("practice_area").agg(F.countDistinct(F.when((F.col("job_level") == "Partner") & (F.col("employment_status") == "Active"), F.col("employee_id"))).alias("partners")))
_OD = f"CASE WHEN {clean_open()} THEN days_outstanding END"
query("AG7_conditional_average", f"SELECT location, {div(f'sum({_OD})', f'count({_OD})')} AS open_days FROM r_ar GROUP BY 1")(
    lambda f: f.table("fact_accounts_receivable").groupBy("location").agg(F.avg(F.when(rules.is_open(), F.col("days_outstanding"))).alias("open_days")))
query("AG8_date_range", "SELECT project_id, min(work_date) AS first_day, max(work_date) AS last_day FROM r_timecards GROUP BY 1")(
    lambda f: f.table("fact_timecards").groupBy("project_id").agg(F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day")))
query("AG9_first_by_order", "SELECT region, practice_area, arg_min(full_name, employee_id) AS partner FROM r_current WHERE job_level = 'Partner' GROUP BY 1, 2")(
    lambda f: current_staff(f.table("dim_employees")).where(F.col("job_level") == "Partner").groupBy("region", "practice_area").agg(F.min_by("full_name", "employee_id").alias("partner")))
query("AG10_having", f"SELECT project_id, count(*) AS n, {dbl('sum(amount)')} AS total FROM r_expenses WHERE project_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND sum(amount) > 0")(
    lambda f: f.table("fact_expenses").where(F.col("project_id").isNotNull()).groupBy("project_id").agg(N(), SUM("amount", "total")).where((F.col("n") >= 3) & (F.col("total") > 0)))
query("AG11_two_level", f"SELECT department, {div('sum(s)', 'count(*)')} AS mean_month, count(*) AS months FROM (SELECT department, fiscal_month, sum(amount) AS s FROM r_ap GROUP BY 1, 2) GROUP BY 1")(
    lambda f: f.table("fact_accounts_payable").groupBy("department", "fiscal_month").agg(SUM("amount", "s")).groupBy("department").agg(
        ratio(F.sum("s"), F.count(F.lit(1))).alias("mean_month"), F.count(F.lit(1)).alias("months")))
query("AG12_median_of_groups", f"SELECT quantile_cont({dbl('s')}, 0.5) AS median FROM (SELECT location, sum(amount) AS s FROM r_ar GROUP BY 1)")(
    lambda f: aggregates.median_of_groups(f.table("fact_accounts_receivable").groupBy("location").agg(SUM("amount", "s")), "s", "median"))
query("AG12b_exact_quantile", f"SELECT quantile_cont(o_totalprice, 0.9) AS p90 FROM orders")(lambda f: aggregates.exact_quantile(f.raw("orders"), "o_totalprice", 0.9, "p90"))
query("AG13_global", f"SELECT count(*) AS n, {dbl('sum(price)')} AS total, {dbl('min(price)')} AS lo, {dbl('max(price)')} AS hi FROM {_O}")(
    lambda f: orders(f).agg(N(), SUM("price", "total"), F.min("price").alias("lo"), F.max("price").alias("hi")))
query("AG14_rank_pivot", "SELECT location, max(d) FILTER (rn = 1) AS current_days, max(d) FILTER (rn = 2) AS prior_days FROM (SELECT location, snapshot_date, CAST(sum(invoice_count) AS BIGINT) AS d, dense_rank() OVER (ORDER BY snapshot_date DESC) AS rn FROM r_snap GROUP BY 1, 2) GROUP BY 1")(
    lambda f: f.table("ar_snapshot_aging").join(F.broadcast(windows.newest_periods(f.table("ar_snapshot_aging"), "snapshot_date", 2)), ["snapshot_date"]).groupBy("location").agg(
        *[F.sum(F.when(F.col("period_rank") == r, F.col("invoice_count"))).alias(n) for r, n in ((1, "current_days"), (2, "prior_days"))]))
query("AG15_share_of_total", f"SELECT {pct('(SELECT sum(s) FROM (SELECT sum(price) AS s FROM ' + _O + ' GROUP BY o_custkey ORDER BY s DESC LIMIT 10))', 'sum(price)')} AS top10_pct FROM {_O}")(
    lambda f: joins.beside(*_top10(f)).select(share_pct("t", "all").alias("top10_pct")))


def _top10(f):
    per = orders(f).groupBy("o_custkey").agg(SUM("price", "s"))
    return per.orderBy(F.col("s").desc()).limit(10).agg(SUM("s", "t")), orders(f).agg(SUM("price", "all"))


query("AG16_distinct", "SELECT DISTINCT region, location, practice_area FROM r_timecards")(lambda f: f.table("fact_timecards").select("region", "location", "practice_area").distinct())
_AR_TEXT = ["customer_name", "payment_status", "aging_bucket", "lead_partner_name", "region", "location", "practice_area", "industry", "customer"]
query("AG17_distinct_profile", f"SELECT unnest({_AR_TEXT}) AS column_name, unnest([{', '.join(f'count(DISTINCT {c})' for c in _AR_TEXT)}]) AS distinct_values FROM r_ar")(lambda f: aggregates.distinct_profile(f.table("fact_accounts_receivable")))
query("AG18_grouping_sets", f"""SELECT practice_area, location, region, CAST(grouping(practice_area, location, region) AS BIGINT) AS grain, {dbl('sum(billing_amount)')} AS revenue, {dbl('sum(hours_worked)')} AS hours FROM r_timecards WHERE fiscal_month = {back(1)}
    GROUP BY GROUPING SETS ((), (practice_area), (location), (region))""")(
    lambda f: kpis.months(f.table("fact_timecards"), f, [1], "fiscal_month").groupingSets([[], [F.col("practice_area")], [F.col("location")], [F.col("region")]], "practice_area", "location", "region").agg(
        F.grouping_id().alias("grain"), SUM("billing_amount", "revenue"), SUM("hours_worked", "hours")))

# windows -------------------------------------------------------------------------
query("WN1_latest_row", "SELECT account_id, account_name, last_modified_date FROM r_accounts WHERE account_name NOT LIKE '%(old)'")(
    lambda f: windows.latest_row(f.source_table("sfdc_accounts"), "account_id", "last_modified_date", F.col("account_name")).select("account_id", "account_name", "last_modified_date"))
query("WN2_one_per_key", "SELECT n_nationkey AS cost_center, 'Office A ' || n_name AS organization_name FROM nation")(
    lambda f: windows.top_per_group(f.source_table("workday_organizations"), ["cost_center"], [F.col("organization_name")]).select("cost_center", "organization_name"))
query("WN3_best_rate", "SELECT DISTINCT l_suppkey AS employee_id, ship_date AS work_date, CAST(rate AS DOUBLE) AS billing_rate FROM r_lines l JOIN r_billing_rate_of r ON l.line_id = r.line_id")(
    lambda f: joins.rate_calendar(f.source_table("workday_timecards"), "employee_id", "work_date", {"billing_rate": (f.source_table("workday_billing_rates"), "billing_rate")}).where(F.col("billing_rate").isNotNull()))
query("WN4_dominant_category", "SELECT region, location, practice_area, industry, customer, fiscal_period, revenue_type FROM r_pnl_type")(
    lambda f: aggregates.dominant(f.table("fact_timecards").where(gold.billable()).withColumnRenamed("fiscal_month", "fiscal_period"), [*DIMS, "fiscal_period"], "revenue_category", "billing_amount", "revenue_type"))
_PM = f"(SELECT practice_area, location, fiscal_month, sum(billing_amount) AS rev FROM r_timecards GROUP BY ALL)"


def _practice_months(f):
    return f.table("fact_timecards").groupBy("practice_area", "location", "fiscal_month").agg(SUM("billing_amount", "rev"))


query("WN5_lag_rows_and_months", f"""SELECT a.practice_area, a.location, a.fiscal_month, {dbl('a.rev')} AS rev, {dbl('lag_rows')} AS lag_rows, {dbl('y.rev')} AS lag_months FROM (SELECT *, lag(rev, 12) OVER (PARTITION BY practice_area, location ORDER BY fiscal_month) AS lag_rows FROM {_PM}) a
    LEFT JOIN {_PM} y ON a.practice_area = y.practice_area AND a.location = y.location AND y.fiscal_month = CAST(a.fiscal_month - INTERVAL 12 MONTH AS DATE)""")(
    lambda f: windows.lag_months(windows.lag_rows(_practice_months(f), ["practice_area", "location"], "fiscal_month", "rev", 12, "lag_rows"), ["practice_area", "location"], "fiscal_month", "rev", 12, "lag_months"))
query("WN6_trailing_mean", f"SELECT practice_area, location, fiscal_month, {dbl('rev')} AS rev, {dbl('sum(rev) OVER w')} / NULLIF(count(rev) OVER w, 0) AS mean6 FROM {_PM} WINDOW w AS (PARTITION BY practice_area, location ORDER BY fiscal_month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")(
    lambda f: windows.trailing_mean(_practice_months(f), ["practice_area", "location"], "fiscal_month", "rev", 6, "mean6"))
query("WN7_share_within", f"SELECT practice_area, location, fiscal_month, {dbl('rev')} AS rev, {div('rev', 'sum(rev) OVER (PARTITION BY practice_area, fiscal_month)')} AS share FROM {_PM}")(
    lambda f: windows.share_within(_practice_months(f), ["practice_area", "fiscal_month"], "rev", "share"))
query("WN8_share_of_all", "SELECT o_orderpriority, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS pct FROM orders GROUP BY 1")(
    lambda f: windows.share_of_all(f.raw("orders").groupBy("o_orderpriority").agg(N()), "n", "pct"))
query("WN9_share_per_snapshot", f"SELECT snapshot_date, aging_bucket, {dbl('sum(open_ar_balance)')} AS bal, {rnd(pct('sum(open_ar_balance)', 'sum(sum(open_ar_balance)) OVER (PARTITION BY snapshot_date)'), 1)} AS pct FROM r_snap GROUP BY 1, 2")(
    lambda f: windows.share_within(f.table("ar_snapshot_aging").groupBy("snapshot_date", "aging_bucket").agg(SUM("open_ar_balance", "bal")), ["snapshot_date"], "bal", "pct").withColumn("pct", rounded(F.col("pct") * 100, 1)))
query("WN10_top_one", "SELECT practice_area, region, lead_partner_name FROM (SELECT practice_area, region, lead_partner_name, row_number() OVER (PARTITION BY practice_area, region ORDER BY sum(actual_revenue) DESC, lead_partner_name) AS rn FROM r_prof WHERE lead_partner_name IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1")(
    lambda f: windows.top_per_group(f.table("project_profitability").where(F.col("lead_partner_name").isNotNull()).groupBy("practice_area", "region", "lead_partner_name").agg(SUM("actual_revenue", "s")),
                                    ["practice_area", "region"], [F.col("s").desc(), F.col("lead_partner_name")]).drop("s"))
query("WN11_one_per_office_then_top", f"SELECT project_id, location, {dbl('planned_revenue')} AS planned_revenue FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY planned_revenue DESC, project_id) AS rn FROM r_projects) WHERE rn = 1 ORDER BY planned_revenue DESC, project_id LIMIT 8")(
    lambda f: windows.top_per_group(f.table("dim_projects").select("project_id", "location", "planned_revenue"), ["location"], [F.col("planned_revenue").desc(), F.col("project_id")]).orderBy(F.col("planned_revenue").desc(), "project_id").limit(8))
query("WN12_first_and_second", f"SELECT max(vendor_name) FILTER (rn = 1) AS first_vendor, max(vendor_name) FILTER (rn = 2) AS second_vendor FROM (SELECT vendor_name, row_number() OVER (ORDER BY amount DESC, invoice_id) AS rn FROM r_ap WHERE {clean_open()})")(
    lambda f: f.table("fact_accounts_payable").where(rules.is_open()).orderBy(F.col("amount").desc(), "invoice_id").limit(2).agg(
        F.min_by("vendor_name", F.struct(-F.col("amount"), F.col("invoice_id"))).alias("first_vendor"), F.max_by("vendor_name", F.struct(-F.col("amount"), F.col("invoice_id"))).alias("second_vendor")))
query("WN13_max_swing", "SELECT max(abs(d - p)) AS swing FROM (SELECT d, lag(d) OVER (ORDER BY snapshot_date) AS p FROM (SELECT DISTINCT snapshot_date, firmwide_dso_days AS d FROM r_snap))")(
    lambda f: _max_swing(f))


def _max_swing(f):
    days = f.table("ar_snapshot_aging").groupBy("snapshot_date").agg(F.max("firmwide_dso_days").alias("d"))
    before = days.select(F.last_day(F.add_months("snapshot_date", 1)).alias("snapshot_date"), F.col("d").alias("p"))
    return days.join(before, ["snapshot_date"]).agg(F.max(F.abs(F.col("d") - F.col("p"))).alias("swing"))


query("WN14_cohort_split", f"SELECT rn <= 5 AS top5, {div('sum(bd)', 'sum(bal)')} AS dso FROM (SELECT sum(amount) AS bal, sum(amount * days_outstanding) AS bd, row_number() OVER (ORDER BY sum(amount) DESC, customer_name) AS rn FROM r_ar WHERE {clean_open()} GROUP BY customer_name) GROUP BY 1")(
    lambda f: cohort_split(f, 5))


def cohort_split(f, k):
    """The k largest clients against all others; the k names are the only broadcast."""
    per = f.table("fact_accounts_receivable").where(rules.is_open()).groupBy("customer_name").agg(SUM("amount", "bal"), F.sum(F.col("amount") * F.col("days_outstanding")).alias("bd"))
    top = per.orderBy(F.col("bal").desc(), "customer_name").limit(k).select("customer_name", F.lit(True).alias("hit"))
    return per.join(F.broadcast(top), ["customer_name"], "left").groupBy(F.coalesce("hit", F.lit(False)).alias("top5")).agg(ratio(F.sum("bd"), F.sum("bal")).alias("dso"))


query("WN15_newest_snapshots", "SELECT snapshot_date, CAST(row_number() OVER (ORDER BY snapshot_date DESC) AS INTEGER) AS period_rank FROM (SELECT DISTINCT snapshot_date FROM r_snap) ORDER BY snapshot_date DESC LIMIT 2")(
    lambda f: windows.newest_periods(f.table("ar_snapshot_aging"), "snapshot_date", 2))

# sorts and limits ----------------------------------------------------------------
for _k in (5, 8, 10, 15, 50):
    query(f"OR1_top_{_k}", f"SELECT o_orderkey, {dbl('price')} AS price FROM {_O} AS x ORDER BY x.price DESC, o_orderkey LIMIT {_k}")(
        lambda f, k=_k: orders(f).orderBy(F.col("price").desc(), "o_orderkey").limit(k).select("o_orderkey", "price"))
query("OR2_bottom_5", f"SELECT o_orderkey, {dbl('price')} AS price FROM {_O} AS x ORDER BY x.price ASC, o_orderkey LIMIT 5")(
    lambda f: orders(f).orderBy(F.col("price").asc(), "o_orderkey").limit(5).select("o_orderkey", "price"))
query("OR3_mixed_sort", "SELECT account_id, account_status, parent_account_id FROM r_accounts WHERE account_name NOT LIKE '%(old)' ORDER BY account_status DESC NULLS LAST, parent_account_id ASC NULLS LAST, account_id LIMIT 20")(
    lambda f: f.source_table("sfdc_accounts").where(~F.col("account_name").like("%(old)")).select("account_id", "account_status", "parent_account_id")
    .orderBy(F.col("account_status").desc_nulls_last(), F.col("parent_account_id").asc_nulls_last(), "account_id").limit(20))
query("OR4_flag_first", f"SELECT n_name, {dbl('sum(price)')} AS total FROM {_O} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n_name IN ('NATION_2', 'NATION_8') DESC, sum(price) DESC, n_name LIMIT 4")(
    lambda f: f.table("fact_accounts_receivable").groupBy(F.col("location").alias("n_name")).agg(SUM("amount", "total")).orderBy(F.col("n_name").isin("NATION_2", "NATION_8").desc(), F.col("total").desc(), "n_name").limit(4))
query("OR5_row_cap", "SELECT DISTINCT region, location FROM r_ent ORDER BY region, location LIMIT 1000")(
    lambda f: f.table("enterprise_metrics").select("region", "location").distinct().orderBy("region", "location").limit(1000))

# set operations ------------------------------------------------------------------
query("SO1_union_sources", f"SELECT category, count(*) AS n, count(invoice_number) AS numbered, count(due_date) AS dated, {dbl('sum(amount)')} AS total FROM r_recv GROUP BY 1")(
    lambda f: f.table("receivables_wip_aging").groupBy("category").agg(N(), F.count("invoice_number").alias("numbered"), F.count("due_date").alias("dated"), SUM("amount", "total")))
query("SO2_union_metrics", "SELECT metric_name, count(*) AS n, count(previous_value) AS with_previous, count(target_value) AS with_target FROM r_summary GROUP BY 1")(
    lambda f: f.table("enterprise_summary").groupBy("metric_name").agg(N(), F.count("previous_value").alias("with_previous"), F.count("target_value").alias("with_target")))
query("SO3_union_spine", f"SELECT {DIM} FROM r_timecards WHERE fiscal_month BETWEEN {back(2)} AND {back(0)} AND time_type_clean = 'Billable' UNION SELECT {DIM} FROM r_expenses WHERE fiscal_month BETWEEN {back(2)} AND {back(0)}")(
    lambda f: f.table("fact_timecards").where(f.periods.between_months("fiscal_month", 2, -1) & gold.billable()).select(*DIMS).union(
        f.table("fact_expenses").where(f.periods.between_months("fiscal_month", 2, -1)).select(*DIMS)).distinct())
query("SO4_unpivot", " UNION ALL ".join(f"SELECT location, '{n}' AS category, {dbl(f'sum({n}_expenses)')} AS amount FROM r_pnl GROUP BY 1" for n in ("billable", "corporate", "marketing", "tech", "other")))(
    lambda f: f.table("regional_pnl").groupBy("location").agg(*[SUM(f"{n}_expenses", n) for n in gold.EXPENSE_NAMES]).unpivot("location", gold.EXPENSE_NAMES, "category", "amount"))
