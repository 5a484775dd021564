"""SRC*, SNK*, ROW*, SCL*: sources, sinks, row rules and scalar functions on whole tables."""

import uuid

from pyspark.sql import functions as F, types as T

from tallyhouse.catalogue.check_tables import ASOF, DIM, adjustments, b, back, bucket_of, clean_open, dbl, div, month, months_between, rnd
from tallyhouse.catalogue.kpi_queries import SLICE, WHERE
from tallyhouse.catalogue.registry import query
from tallyhouse.functions import kpi_text, rules
from tallyhouse.functions.money import capped_change_pct, dbl as as_double, money, rounded
from tallyhouse.functions.periods import fiscal_text, month_spine, month_start
from tallyhouse.functions.stable import bucket, slot, stable_hash
from tallyhouse.operators.filters import axis_filter, snapshot_filter
from tallyhouse.operators.joins import enrich, except_keys
from tallyhouse.plans.policy import SAMPLE_POLICY as P
from tallyhouse.plans.silver import HOURS, product_of
from tallyhouse.session import work_dir
from tallyhouse.sources import sinks
from tallyhouse.sources.tables import inventory, scan, typed_rows

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def scratch(firm, name: str) -> str:
    return f"{work_dir(firm.spark)}/tallyhouse/{firm.spark.sparkContext.applicationId}/scratch/{name}-{uuid.uuid4().hex}"


def orders(firm):
    return firm.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("order_date"))


N = lambda: F.count(F.lit(1)).alias("n")
SUM = lambda c, out: F.sum(c).alias(out)
_O = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(38,4)) AS price, CAST(o_orderdate AS DATE) AS order_date FROM orders)"

# sources -------------------------------------------------------------------------
query("SRC1_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")(
    lambda f: scan(f.spark, f.folder, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderstatus"))
_STATUS = T.StructType([T.StructField("o_orderstatus", T.StringType(), False), T.StructField("label", T.StringType())])
query("SRC2_typed_rows", f"SELECT CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Paid' END AS label, count(*) AS n, {dbl('sum(price)')} AS total FROM {_O} GROUP BY 1")(
    lambda f: orders(f).join(F.broadcast(typed_rows(f.spark, [("O", "Open"), ("F", "Paid")], _STATUS)), ["o_orderstatus"], "left").groupBy("label").agg(N(), SUM("price", "total")))
query("SRC3_month_spine", f"""SELECT CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(date_trunc('month', min(order_date)), date_trunc('month', max(order_date)), INTERVAL 1 MONTH)) AS m FROM {_O})
    LEFT JOIN {_O} ON date_trunc('month', order_date) = m GROUP BY ALL""")(
    lambda f: month_spine(orders(f), "order_date").join(
        orders(f).groupBy(month_start("order_date").alias("month_start")).agg(N()), ["month_start"], "left").fillna(0, ["n"]))
query("SRC4_lookup", "SELECT department_category, count(*) AS n FROM orders LEFT JOIN r_cost_centers ON o_orderkey % 25 = cost_center_code GROUP BY 1")(
    lambda f: enrich(f.source_table("concur_expense_reports"), f.source_table("cost_center_mapping"), "cost_center", "cost_center_code", {"department_category": "department_category"})
    .groupBy("department_category").agg(N()))

# sinks ---------------------------------------------------------------------------
_MONTHLY = f"SELECT {month('order_date')} AS month_start, o_orderstatus, count(*) AS n, {dbl('sum(price)')} AS total FROM {_O} GROUP BY ALL"


def monthly(firm):
    return orders(firm).groupBy(month_start("order_date").alias("month_start"), "o_orderstatus").agg(N(), SUM("price", "total"))


def _stored(df, path, partition_by=None):
    sinks.rebuild(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


query("SNK1_rebuild", _MONTHLY)(lambda f: _stored(monthly(f), scratch(f, "rebuild"), "month_start"))


@query("SNK2_overwrite_then_append", _MONTHLY)
def _append(f):
    path, df = scratch(f, "append"), monthly(f)
    df.where(F.col("o_orderstatus") == "O").write.mode("overwrite").parquet(path)
    df.where(F.col("o_orderstatus") != "O").write.mode("append").parquet(path)
    return f.spark.read.schema(df.schema).parquet(path)


query("SNK3_view", f"SELECT o_orderstatus, count(*) AS n FROM {_O} WHERE price > 100000 GROUP BY 1")(
    lambda f: (sinks.as_view(orders(f), "tallyhouse_orders"), f.spark.sql("SELECT o_orderstatus, count(*) AS n FROM tallyhouse_orders WHERE price > 100000 GROUP BY o_orderstatus"))[1])


def _by_month(f, name, *columns):
    """Orders stored by month."""
    df = orders(f).select(*columns, month_start("order_date").alias("month"))
    path = scratch(f, name)
    sinks.rebuild(df, path, "month")
    return path, df.schema


@query("SNK4_merge_update", f"""SELECT o_orderkey, o_orderstatus, {dbl("CASE WHEN o_orderstatus = 'O' AND n >= 12 THEN CAST(top * 2 AS DECIMAL(38,4)) ELSE price END")} AS price FROM {_O} JOIN (SELECT o_custkey, count(*) AS n, max(price) AS top FROM {_O} GROUP BY 1) USING (o_custkey)""")
def _merge(f):
    path, schema = _by_month(f, "merge", "o_orderkey", "o_custkey", "o_orderstatus", "price")
    busy = orders(f).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top")).where("n >= 12")
    sinks.merge_into(f.spark, path, schema, busy, "o_custkey", F.col("o_orderstatus") == "O", {"price": F.col("src_top") * 2}, "month")
    return f.spark.read.schema(schema).parquet(path).select("o_orderkey", "o_orderstatus", "price")


@query("SNK5_replace_slices", f"SELECT o_orderstatus, month_start, CASE WHEN o_orderstatus = 'P' THEN n + 1000 ELSE n END AS n, total FROM ({_MONTHLY})")
def _replace(f):
    path, df = scratch(f, "slices"), monthly(f)
    sinks.replace_slices(df, path, ["o_orderstatus"])
    sinks.replace_slices(df.where(F.col("o_orderstatus") == "P").withColumn("n", F.col("n") + 1000), path, ["o_orderstatus"])
    return f.spark.read.schema(df.schema).parquet(path)


query("SNK6_backfill", "SELECT account_id, coalesce(account_status, 'Active') AS account_status, coalesce(parent_account_id, -1) AS parent_account_id FROM r_accounts")(
    lambda f: sinks.backfill(f.source_table("sfdc_accounts").select("account_id", "account_status", "parent_account_id"), {"account_status": "Active", "parent_account_id": -1}))


@query("SNK7_upsert", f"""SELECT o_orderkey, CASE WHEN order_date >= {back(1)} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, {month('order_date')} AS month FROM {_O} UNION ALL SELECT -o_orderkey, 'new', {month('order_date')} FROM {_O} WHERE order_date >= {back(1)}""")
def _upsert(f):
    path, schema = _by_month(f, "upsert", "o_orderkey", "o_orderstatus")
    late = orders(f).where(F.col("order_date") >= F.lit(f.periods.month(1))).select("o_orderkey", F.lit("X").alias("o_orderstatus"), month_start("order_date").alias("month"))
    sinks.upsert_into(f.spark, path, schema, late.unionByName(late.withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("new")})), ["o_orderkey"], "month")
    return f.spark.read.schema(schema).parquet(path)


query("SNK7b_update_by_key", f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'cust' || o_custkey ELSE o_orderstatus END AS o_orderstatus FROM {_O}")(
    lambda f: sinks.update_by_key(orders(f).select("o_orderkey", "o_custkey", "o_orderstatus"),
                                  f.raw("customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("cust"), "c_custkey").alias("o_orderstatus")),
                                  "o_custkey", ["o_orderstatus"]))
query("SNK8_add_columns", "SELECT employee_id, rate, CAST(NULL AS VARCHAR) AS note FROM (SELECT employee_id, CAST(rate AS DOUBLE) AS rate FROM r_cost_rates) UNION ALL SELECT employee_id, CAST(rate AS DOUBLE), 'billing' FROM r_billing_rates")(
    lambda f: sinks.add_columns(f.source_table("workday_cost_rates").select("employee_id", F.col("hourly_cost_rate").alias("rate")),
                                f.source_table("workday_billing_rates").select("employee_id", F.col("billing_rate").alias("rate"), F.lit("billing").alias("note"))))
@query("SNK8b_stored_table_evolves", f"""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'O' THEN {dbl('price')} END AS price, CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE -1 END AS o_custkey FROM {_O}""")
def _evolves(f):
    """Three appends, each with one more column."""
    path, df = scratch(f, "evolving"), orders(f)
    sinks.append_evolving(df.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus"), path)
    sinks.append_evolving(df.where("o_orderstatus = 'F'").select("price", "o_orderkey", "o_orderstatus"), path)
    sinks.append_evolving(df.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", "price", "o_custkey"), path, {"o_custkey": -1})
    return sinks.read_evolving(f.spark, path)


query("SNK9_empty_shell", f"SELECT 'orders' AS persona, o_orderkey AS slot_id, o_orderstatus AS value FROM {_O}")(
    lambda f: sinks.empty_shell(f.spark, T.StructType([T.StructField("persona", T.StringType(), False), T.StructField("slot_id", T.LongType(), False), T.StructField("value", T.StringType())]))
    .unionByName(orders(f).select(F.lit("orders").alias("persona"), F.col("o_orderkey").alias("slot_id"), F.col("o_orderstatus").alias("value"))))
query("SNK10_failures", f"SELECT month_start, o_orderstatus, n, false AS passed FROM ({_MONTHLY}) WHERE n <= (SELECT count(*) / 240 FROM orders)")(
    lambda f: sinks.record_failures(monthly(f).join(F.broadcast(orders(f).agg((F.count(F.lit(1)) / 240).alias("floor"))), F.lit(True)).select(
        "month_start", "o_orderstatus", "n", (F.col("n") > F.col("floor")).alias("passed")), scratch(f, "failures")))
_COMMENTS = {"clients": {"client_status": "Lifecycle state; a missing value counts as Active.", "annual_revenue": "Revenue of the client itself, a year."}, "geography": {"region": "One of five."}}
_COLUMNS = {"clients": {"client_id": "bigint", "client_name": "string", "client_status": "string", "annual_revenue": "decimal(18,4)"}, "geography": {"location": "string", "region": "string"}}
query("SNK11_comments", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{kind}', '{_COMMENTS[t].get(c, '')}', {n})" for t, cs in _COLUMNS.items() for c, kind in cs.items() for n in ["(SELECT count(*) FROM r_clients)" if t == "clients" else "(SELECT count(*) FROM nation)"]) + ") AS v(table_name, column_name, type, comment, rows)")(
    lambda f: _commented(f))


def _commented(f):
    """Two tables stored with comments; what comes back is read from their files, with the rows that these hold."""
    places = f.source._places().select("location", "region")
    paths, counts = {}, None
    for t, df in (("clients", f.table("dim_clients")), ("geography", places)):
        paths[t] = scratch(f, f"commented_{t}")
        sinks.with_comments(df.select(*_COLUMNS[t]), _COMMENTS[t]).write.parquet(paths[t])
        n = f.spark.read.parquet(paths[t]).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        counts = n if counts is None else counts.unionByName(n)
    return sinks.stored_comments(f.spark, paths).join(counts, "table_name")


@query("SNK12_inventory", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW) + " UNION ALL SELECT 'absent', -1 UNION ALL SELECT 'broken', -1 UNION ALL SELECT 'mended', count(*) FROM nation")
def _inventory(f):
    """All tables; one that is not there; one with a file that is none; one that was stored whole."""
    broken, mended = scratch(f, "broken"), scratch(f, "mended")
    f.raw("nation").write.parquet(mended)
    f.raw("nation").write.parquet(broken)
    f.raw("nation").select("n_name").write.mode("append").option("compression", "none").text(broken)
    return inventory(f.spark, {**{t: f"{f.folder.rstrip('/')}/{t}.parquet" for t in RAW}, "absent": scratch(f, "absent"), "broken": broken, "mended": mended})


# row rules -----------------------------------------------------------------------
query("ROW1_projection", "SELECT client_id, client_name, client_type, parent_client_id FROM r_clients")(lambda f: f.table("dim_clients").select("client_id", "client_name", "client_type", "parent_client_id"))
query("ROW2_default_for_null", "SELECT coalesce(account_status, 'Active') AS status, count(*) AS n FROM r_accounts GROUP BY 1")(
    lambda f: f.source_table("sfdc_accounts").groupBy(F.coalesce("account_status", F.lit("Active")).alias("status")).agg(N()))
_SPELL = "CASE l_linenumber WHEN 1 THEN 'Client Billable' WHEN 2 THEN 'bill' WHEN 3 THEN 'Admin' WHEN 4 THEN 'vacation' WHEN 5 THEN 'Travel' WHEN 6 THEN 'internal' END"


def spelled(c):
    return F.when(c == 1, "Client Billable").when(c == 2, "bill").when(c == 3, "Admin").when(c == 4, "vacation").when(c == 5, "Travel").when(c == 6, "internal")


query("ROW3_time_type", f"SELECT raw, CASE WHEN raw IN ('Client Billable', 'bill') THEN 'Billable' WHEN raw IN ('Admin', 'internal') THEN 'Non-Billable' WHEN raw = 'vacation' THEN 'Time Off' ELSE 'Other' END AS clean, count(*) AS n FROM (SELECT {_SPELL} AS raw FROM lineitem) GROUP BY ALL")(
    lambda f: f.raw("lineitem").select(spelled(F.col("l_linenumber")).alias("raw")).groupBy("raw", rules.clean_time_type("raw").alias("clean")).agg(N()))
_ACCT = ["Sales", "Direct Cost", "SGA", "Interest Income", "tax", "Fixed Asset", "Long-Term Liability", "Retained Earnings", "Suspense"]
query("ROW4_account_category", f"""SELECT {'list_extract([' + ', '.join(repr(a) for a in _ACCT) + '], CAST(o_orderkey % 9 AS INTEGER) + 1)'} AS account_type, list_extract(['Revenue', 'COGS', 'Operating Expense', 'Other Income', 'Tax', 'Asset', 'Liability', 'Equity', 'Other'], CAST(o_orderkey % 9 AS INTEGER) + 1) AS account_category, count(*) AS n FROM orders GROUP BY ALL""")(
    lambda f: f.raw("orders").select(F.element_at(F.array(*[F.lit(a) for a in _ACCT]), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("account_type")).groupBy("account_type", rules.account_category().alias("account_category")).agg(N()))
query("ROW5_expense_category", "SELECT is_billable, department_category, expense_category_business, count(*) AS n FROM r_expenses_filed GROUP BY ALL")(
    lambda f: f.table("expenses_as_filed").groupBy("is_billable", "department_category", rules.expense_category().alias("expense_category_business")).agg(N()))
query("ROW6_vendor_class", "SELECT vendor_name, vendor_classification, count(*) AS n FROM r_payables GROUP BY ALL")(
    lambda f: f.table("fact_accounts_payable").where(rules.is_open()).groupBy("vendor_name", rules.vendor_class().alias("vendor_classification")).agg(N()))
query("ROW7_aging_bucket", f"SELECT {bucket_of(f'({ASOF} - order_date)')} AS aging_bucket, count(*) AS n, min({ASOF} - order_date) AS lo, max({ASOF} - order_date) AS hi FROM {_O} GROUP BY 1")(
    lambda f: orders(f).withColumn("d", F.datediff(F.lit(f.as_of), "order_date")).groupBy(rules.aging_bucket(F.col("d")).alias("aging_bucket")).agg(N(), F.min("d").alias("lo"), F.max("d").alias("hi")))
query("ROW8_receivable_days", "SELECT invoice_id, days_outstanding FROM r_ar")(
    lambda f: f.source_table("sap_accounts_receivable").select("invoice_id", rules.clamp(rules.receivable_age(F.lit(f.as_of)), 0, 365).alias("days_outstanding")))
query("ROW9_payable_days", "SELECT payment_status, days_outstanding, count(*) AS n FROM r_ap GROUP BY ALL")(
    lambda f: f.source_table("sap_accounts_payable").withColumn("_h", stable_hash("invoice_id")).groupBy("payment_status", rules.payable_age("_h").alias("days_outstanding")).agg(N()))
query("ROW10_employment_status", "SELECT snapshot_date, CASE WHEN termination_date <= snapshot_date THEN 'Terminated' WHEN hire_date > snapshot_date THEN 'Pre-Hire' ELSE 'Active' END AS employment_status, count(*) AS n FROM r_people, r_months GROUP BY ALL")(
    lambda f: f.source_table("workday_employees").withColumn("snapshot_date", F.explode(F.array(*[F.lit(f.periods.month_end(b)) for b in range(1, 37)])))
    .groupBy("snapshot_date", rules.employment_status(F.col("snapshot_date")).alias("employment_status")).agg(N()))
query("ROW11_active_flag", "SELECT status, status IN ('Active', 'In Progress', 'Open') AS is_active, count(*) AS n FROM r_engagements GROUP BY ALL")(
    lambda f: f.source_table("sfdc_engagements").groupBy("status", rules.is_active_status("status").alias("is_active")).agg(N()))
query("ROW12_wip_flag", "SELECT time_type_clean, approval_status, time_type_clean = 'Billable' AND approval_status IN ('Approved', 'Submitted') AS is_wip, count(*) AS n FROM r_timecards GROUP BY ALL")(
    lambda f: f.table("fact_timecards").groupBy("time_type_clean", "approval_status", rules.is_wip().alias("is_wip")).agg(N()))
query("ROW13_receipt_text", "SELECT CASE WHEN has_receipt THEN 'Received' ELSE 'Missing' END AS receipt_status, count(*) AS n FROM r_items GROUP BY 1")(
    lambda f: f.source_table("concur_expense_items").groupBy(rules.receipt_text().alias("receipt_status")).agg(N()))
query("ROW14_risk_level", "SELECT project_id, budget_risk_level FROM r_audit")(
    lambda f: f.table("te_contract_audit").select("project_id", rules.risk_level(F.col("total_te_billed"), F.coalesce("total_contract_value", F.lit(0))).alias("budget_risk_level")))
query("ROW15_collection_score", "SELECT category, record_id, collection_priority_score AS score FROM r_recv")(
    lambda f: f.table("receivables_wip_aging").select("category", "record_id", rules.collection_score(F.col("days_outstanding"), F.col("amount"), F.col("category")).alias("score")))
query("ROW16_payment_score", "SELECT invoice_number, payment_priority_score AS score FROM r_payables")(
    lambda f: f.table("payables_aging").select("invoice_number", rules.payment_score(F.col("days_outstanding"), F.col("amount_due")).alias("score")))
query("ROW17_action_label", "SELECT CASE WHEN s > 120 THEN 'URGENT: Invoice immediately' WHEN s > 100 THEN 'HIGH: Follow up required' ELSE 'MEDIUM: Monitor closely' END AS action_item, count(*) AS n FROM (SELECT collection_priority_score AS s FROM r_recv) GROUP BY 1")(
    lambda f: f.table("receivables_wip_aging").groupBy(rules.collection_action(F.col("collection_priority_score")).alias("action_item")).agg(N()))
_CAP = lambda cur, base: f"CASE WHEN {base} >= 20000 THEN least(greatest({rnd(f'({dbl(cur)} - {dbl(base)}) / {dbl(base)} * 100', 2)}, -100.0), 500.0) END"
query("ROW18_capped_change", f"SELECT c_custkey, {_CAP('cur', 'base')} AS change_pct FROM (SELECT c_custkey, coalesce(sum(price) FILTER (year(order_date) = 2000), 0) AS cur, coalesce(sum(price) FILTER (year(order_date) = 1999), 0) AS base FROM customer LEFT JOIN {_O} ON c_custkey = o_custkey GROUP BY 1)")(
    lambda f: f.raw("customer").select("c_custkey").join(orders(f).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.when(F.year("order_date") == 2000, F.col("price"))).alias("cur"), F.sum(F.when(F.year("order_date") == 1999, F.col("price"))).alias("base")), ["c_custkey"], "left")
    .select("c_custkey", F.coalesce("cur", F.lit(0)).alias("cur"), F.coalesce("base", F.lit(0)).alias("base")).select("c_custkey", capped_change_pct(F.col("cur"), F.col("base"), 20000).alias("change_pct")))
query("ROW19_noise_band", "SELECT practice_area, count(*) FILTER (actual_margin_pct BETWEEN 10 AND 50) AS narrow, count(*) FILTER (actual_margin_pct BETWEEN -50 AND 70) AS wide, count(*) AS n FROM r_profit GROUP BY 1")(
    lambda f: f.table("project_profitability").groupBy("practice_area").agg(F.count(F.when(F.col("actual_margin_pct").between(10, 50), 1)).alias("narrow"), F.count(F.when(F.col("actual_margin_pct").between(-50, 70), 1)).alias("wide"), N()))
query("ROW20_open_items", f"SELECT payment_status, count(*) AS n, {dbl('sum(amount)')} AS total FROM r_ar WHERE {clean_open()} GROUP BY 1")(
    lambda f: f.table("fact_accounts_receivable").where(rules.is_open()).groupBy("payment_status").agg(N(), SUM("amount", "total")))
query("ROW21_except_keys", "SELECT expense_item_id FROM r_expenses WHERE project_id IS NULL OR project_id NOT IN (SELECT project_id FROM r_outliers)")(
    lambda f: except_keys(f.table("fact_expenses"), "project_id", f.table("outlier_projects")).select("expense_item_id"))
query("ROW22_month_windows", f"SELECT count(*) FILTER (order_date >= {back(1)} AND order_date < {back(0)}) AS last_month, count(*) FILTER (order_date >= {back(2)} AND order_date < {back(1)}) AS month_before, count(*) FILTER (order_date >= {back(13)} AND order_date < {back(12)}) AS year_before, count(*) FILTER (order_date >= {back(6)} AND order_date < {back(0)}) AS trailing_six FROM {_O}")(
    lambda f: orders(f).agg(*[F.count(F.when(f.periods.between_months("order_date", a, z), 1)).alias(n) for n, a, z in (("last_month", 1, 0), ("month_before", 2, 1), ("year_before", 13, 12), ("trailing_six", 6, 0))]))
query("ROW23_last_quarter", f"SELECT o_orderstatus, count(*) AS n FROM {_O} WHERE order_date >= date_trunc('quarter', {ASOF} - INTERVAL 3 MONTH) AND order_date < date_trunc('quarter', {ASOF}) GROUP BY 1")(
    lambda f: orders(f).where(f.periods.last_quarter("order_date")).groupBy("o_orderstatus").agg(N()))
query("ROW24_rolling_days", f"SELECT count(*) FILTER (order_date >= {ASOF} - 90) AS last_90, count(*) FILTER (order_date BETWEEN {ASOF} - 180 AND {ASOF} - 90) AS prior_90 FROM {_O}")(
    lambda f: orders(f).agg(F.count(F.when(f.periods.trailing_days("order_date", 90), 1)).alias("last_90"), F.count(F.when(f.periods.prior_days("order_date", 90, 180), 1)).alias("prior_90")))
query("ROW25_axis_filter", f"SELECT payment_status, count(*) AS n, {dbl('sum(amount)')} AS total FROM r_ar WHERE true {WHERE} GROUP BY 1")(
    lambda f: axis_filter(f.table("fact_accounts_receivable"), {**SLICE, "customer": "", "practice_area": None}).groupBy("payment_status").agg(N(), SUM("amount", "total")))
query("ROW26_snapshot_filter", f"SELECT snapshot_date, customer_name, {dbl('sum(open_ar_balance)')} AS bal FROM r_snap WHERE region = 'ASIA' GROUP BY ALL")(
    lambda f: snapshot_filter(f.table("ar_snapshot_aging"), {"region": "ASIA"}).groupBy("snapshot_date", "customer_name").agg(SUM("open_ar_balance", "bal")))
_HOUR_STORY = adjustments(P.hour_adjustments, "work_date")
_PRICE = dbl("price")
query("ROW27_adjustments", f"SELECT region, practice_area, {month('work_date')} AS m, CAST(sum(CAST(hours * {_HOUR_STORY} AS DECIMAL(38,6))) AS DOUBLE) AS hours FROM r_cards GROUP BY ALL")(
    lambda f: f.source_table("workday_timecards").groupBy("region", "practice_area", month_start("work_date").alias("m")).agg(
        F.sum((F.col("hours") * product_of([a.as_column("work_date") for a in P.hour_adjustments])).cast(HOURS)).alias("hours")))
query("ROW28_as_of", f"SELECT {ASOF} AS as_of, min({ASOF} - order_date) AS newest_age, max({ASOF} - order_date) AS oldest_age, count(*) AS n FROM {_O}")(
    lambda f: orders(f).agg(F.lit(f.as_of).alias("as_of"), F.min(F.datediff(F.lit(f.as_of), "order_date")).alias("newest_age"), F.max(F.datediff(F.lit(f.as_of), "order_date")).alias("oldest_age"), N()))
_SC = "CAST(trunc(collection_priority_score) AS INTEGER)"
query("ROW29_capped_age", f"SELECT record_id, category, CAST(CASE WHEN days_outstanding > 90 THEN 45 + {_SC} % 45 WHEN days_outstanding < 30 THEN 30 + {_SC} % 20 ELSE days_outstanding END AS INTEGER) AS days FROM r_recv")(
    lambda f: f.table("receivables_wip_aging").select("record_id", "category", rules.capped_age(F.col("days_outstanding"), F.col("collection_priority_score")).alias("days")))
query("ROW30_fiscal_text", f"SELECT strftime(order_date, '%Y-%m') AS fiscal_period, count(*) AS n FROM {_O} GROUP BY 1")(lambda f: orders(f).groupBy(fiscal_text("order_date").alias("fiscal_period")).agg(N()))
_FX = lambda e, d: f"CAST(CAST(round(CAST({e} AS DECIMAL(38,8)), {d}) AS DECIMAL(38,{d})) AS VARCHAR)"
query("ROW31_kpi_text", f"""SELECT o_custkey, CASE WHEN v >= 1e9 THEN '$' || {_FX('v / 1e9', 2)} || 'B' WHEN v >= 1e6 THEN '$' || {_FX('v / 1e6', 2)} || 'M' WHEN v >= 1e3 THEN '$' || {_FX('v / 1e3', 2)} || 'K' ELSE '$' || {_FX('v', 0)} END AS total_text,
    {_FX('n / 7.0::DOUBLE', 1)} || ' days' AS days_text, {_FX('n * 100.0::DOUBLE / 13', 2)} || '%' AS pct_text, format('{{:,}}', n * 1000) || ' partners' AS count_text FROM (SELECT o_custkey, {dbl('sum(price)')} AS v, count(*) AS n FROM {_O} GROUP BY 1)""")(
    lambda f: orders(f).groupBy("o_custkey").agg(F.sum("price").alias("v"), N()).select(
        "o_custkey", kpi_text.money_text(F.col("v")).alias("total_text"), kpi_text.days_text(F.col("n") / 7).alias("days_text"),
        kpi_text.percent_text(F.col("n") * 100.0 / 13).alias("pct_text"), kpi_text.count_text(F.col("n") * 1000, "partners").alias("count_text")))
query("ROW31b_unit_shift", """SELECT o_orderkey, 'Revenue $' || k || '0.00M beats $' || k || '0.00K; was $' || (k * 10) || ', not $1.20B' AS text FROM (SELECT o_orderkey, o_orderkey % 89 + 10 AS k FROM orders)""")(
    lambda f: f.raw("orders").select("o_orderkey", (F.col("o_orderkey") % 89 + 10).alias("k")).select(
        "o_orderkey", kpi_text.shift_units(F.concat(F.lit("Revenue $0."), "k", F.lit("B beats $0."), "k", F.lit("M; was $0."), "k", F.lit("K, not $1.20B"))).alias("text")))

# scalar functions ----------------------------------------------------------------
query("SCL1_conditional", f"SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'P'), 'part') AS s, CASE WHEN price > 300000 THEN 'large' WHEN price > 100000 THEN 'mid' ELSE 'small' END AS size FROM {_O}")(
    lambda f: orders(f).select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("part")).alias("s"), F.when(F.col("price") > 300000, "large").when(F.col("price") > 100000, "mid").otherwise("small").alias("size")))
query("SCL2_bounds", f"SELECT o_orderkey, {dbl('least(greatest(price, 50000), 400000)')} AS price FROM {_O}")(lambda f: orders(f).select("o_orderkey", rules.clamp(F.col("price"), 50000, 400000).cast("decimal(18,4)").alias("price")))
query("SCL3_math", f"SELECT o_orderkey, {rnd('price', 1)} AS r, {dbl('abs(price - 200000)')} AS a, CAST(ceil(price) AS BIGINT) AS c, {rnd(f'log10({_PRICE})', 6)} AS l, (o_orderkey - 500) % 7 AS m FROM {_O}")(
    lambda f: orders(f).select("o_orderkey", rounded(F.col("price"), 1).alias("r"), F.abs(F.col("price") - 200000).alias("a"), F.ceil("price").cast("bigint").alias("c"), rounded(F.log10(as_double("price")), 6).alias("l"), ((F.col("o_orderkey") - 500) % 7).alias("m")))
query("SCL4_truncate", f"SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, CAST(date_trunc('quarter', order_date) AS DATE) AS q, CAST(date_trunc('year', order_date) AS DATE) AS y, count(*) AS n FROM {_O} GROUP BY ALL")(
    lambda f: orders(f).groupBy(F.trunc("order_date", "MM").alias("m"), F.trunc("order_date", "QUARTER").alias("q"), F.trunc("order_date", "YEAR").alias("y")).agg(N()))
query("SCL5_shift", f"SELECT o_orderkey, CAST(order_date + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST(order_date - INTERVAL 13 MONTH AS DATE) AS minus_13, order_date + 45 AS plus_days, order_date - 30 AS minus_days FROM {_O}")(
    lambda f: orders(f).select("o_orderkey", F.add_months("order_date", 1).alias("plus_month"), F.add_months("order_date", -13).alias("minus_13"), F.date_add("order_date", 45).alias("plus_days"), F.date_sub("order_date", 30).alias("minus_days")))
query("SCL6_month_end", f"SELECT last_day(order_date) AS e, CAST(day(last_day(order_date)) AS INTEGER) AS d, count(*) AS n FROM {_O} GROUP BY ALL")(
    lambda f: orders(f).groupBy(F.last_day("order_date").alias("e"), F.dayofmonth(F.last_day("order_date")).alias("d")).agg(N()))
query("SCL7_date_diff", f"SELECT o_orderkey, {ASOF} - order_date AS days, {months_between(ASOF, 'order_date')} AS months FROM {_O}")(
    lambda f: orders(f).select("o_orderkey", F.datediff(F.lit(f.as_of), "order_date").alias("days"), F.months_between(F.lit(f.as_of), "order_date").alias("months")))
query("SCL8_parts", f"SELECT CAST(year(order_date) AS INTEGER) AS y, CAST(month(order_date) AS INTEGER) AS m, CAST(day(order_date) AS INTEGER) AS d, count(*) AS n FROM {_O} GROUP BY ALL")(
    lambda f: orders(f).groupBy(F.year("order_date").alias("y"), F.month("order_date").alias("m"), F.extract(F.lit("DAY"), "order_date").alias("d")).agg(N()))
query("SCL9_format", f"SELECT strftime(order_date, '%Y/%m/%d') AS t, count(*) AS n FROM {_O} GROUP BY 1")(lambda f: orders(f).groupBy(F.date_format("order_date", "yyyy/MM/dd").alias("t")).agg(N()))
query("SCL10_sequence", f"SELECT o_custkey, k, count(*) AS n FROM (SELECT o_custkey, unnest(generate_series(1, CAST(o_orderkey % 5 + 1 AS INTEGER))) AS k FROM {_O}) GROUP BY ALL")(
    lambda f: orders(f).select("o_custkey", F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("k")).groupBy("o_custkey", "k").agg(N()))
query("SCL11_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, c_name || '/' || CAST(c_nationkey AS VARCHAR) AS j, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS p, c_name LIKE '%77%' AS k, c_mktsegment ILIKE 'build%' AS i FROM customer")(
    lambda f: f.raw("customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), F.concat("c_name", F.lit("/"), F.col("c_nationkey").cast("string")).alias("j"),
                                       F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("p"), F.col("c_name").like("%77%").alias("k"), F.col("c_mktsegment").ilike("build%").alias("i")))
query("SCL12_stable_bucket", f"SELECT CAST({b('o_orderkey', 100)} AS INTEGER) AS slot, count(*) AS n FROM orders GROUP BY 1")(lambda f: f.raw("orders").groupBy(bucket("o_orderkey", 100).alias("slot")).agg(N()))
query("SCL13_casts", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey AS INTEGER) AS i, CAST(NULL AS VARCHAR) AS n FROM customer")(
    lambda f: f.raw("customer").select("c_custkey", as_double("c_nationkey").alias("d"), F.col("c_custkey").cast("string").alias("s"), F.col("c_custkey").cast("int").alias("i"), F.lit(None).cast("string").alias("n")))
query("SCL14_predicates", f"SELECT count(*) FILTER (price BETWEEN 1000 AND 50000) AS a, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS b, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS c, count(*) FILTER (NULLIF(o_orderstatus, 'P') IS NULL) AS d, count(*) FILTER (NULLIF(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL) AS e FROM {_O}")(
    lambda f: orders(f).withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).agg(*[F.count(F.when(t, 1)).alias(n) for n, t in (
        ("a", F.col("price").between(1000, 50000)), ("b", F.col("o_orderstatus").isin("O", "F")), ("c", ~F.col("o_orderstatus").isin("O", "F")), ("d", F.col("s").isNull()), ("e", F.col("s").eqNullSafe(F.lit(None).cast("string"))))]))
query("SCL15_regex", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers, regexp_extract(text, '([0-9]+)[.,]([0-9]+)', 2) AS fraction, CAST(length(regexp_replace(text, '[0-9]+', '#', 'g')) AS INTEGER) AS masked_length, regexp_matches(text, '@[a-z]+[.]') AS mail FROM documents")(
    lambda f: f.raw("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("numbers"), F.regexp_extract("text", "([0-9]+)[.,]([0-9]+)", 2).alias("fraction"),
                                        F.length(F.regexp_replace("text", "[0-9]+", "#")).alias("masked_length"), F.col("text").rlike("@[a-z]+[.]").alias("mail")))
