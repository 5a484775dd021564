"""Spark plans against their SQL checks, invariants of the built tables, and the shape of physical plans."""

import datetime
import os
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import TABLES, shape
from tallyhouse.functions import rules
from tallyhouse.plans import gold, kpis
from tallyhouse.plans.firm import BUILDERS, Firm

# every builder and a few of each family; TALLYHOUSE_ALL=1 runs all of them
SAMPLE = ("SV", "GD", "KP1_", "KP12_low_utilized_partners", "KP20", "KP38", "TQ03", "TQ15", "SM3", "DQ7", "DQ21", "CL2", "CL5", "CL10", "PM1", "PM4", "PM5", "PM6", "PM7", "PM8_view", "PM9_refused", "SNK4", "SNK8b", "SNK11", "SNK12", "AG17", "JN17", "IN2", "IN4", "SNK5", "SNK7", "ROW21", "JN5", "JN7", "AG18", "WN5", "SO3")
NAMES = [n for n in entry.queries() if os.environ.get("TALLYHOUSE_ALL") or n.startswith(SAMPLE)]


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    got = shape([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    assert got == shape(cur.fetchall(), [d[0] for d in cur.description])


def test_every_query_has_a_check():
    own = set(entry.registered())
    assert own <= set(entry.queries()) and own <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(BUILDERS))
def test_no_cartesian_product(spark, small, name):
    text = plan(Firm.sample(spark, small).build(name))
    assert "CartesianProduct" not in text
    if "row_number()" in text:
        assert "WindowGroupLimit" in text


def test_month_report_reads_its_months_and_columns_only(spark, small):
    text = Firm.sample(spark, small) and kpis.bench_cost(Firm.sample(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fiscal_month" in text or "PartitionFilters: [fiscal_month" in text
    scan = text[text.index("ReadSchema"):].split("\n")[0]
    assert "hours_worked" in scan and "customer" not in scan


def test_snapshot_build_has_no_join_on_dates(spark, small):
    text = plan(Firm.sample(spark, small).build("ar_snapshot_aging"))
    assert "NestedLoop" not in text


def test_balances_agree(spark, small):
    firm = Firm.sample(spark, small)
    snap, ar = firm.table("ar_snapshot_aging"), firm.table("fact_accounts_receivable")
    newest = firm.periods.month_end(1)
    by_bucket = snap.where(F.col("snapshot_date") == F.lit(newest)).agg(F.sum("open_ar_balance")).first()[0]
    age = F.datediff(F.lit(newest), "invoice_date")
    direct = ar.where((F.col("invoice_date") <= F.lit(newest)) & (F.col("payment_date").isNull() | (F.col("payment_date") > F.lit(newest))) & (age <= 365)).agg(F.sum("amount")).first()[0]
    assert by_bucket == direct
    assert firm.table("fact_general_ledger").agg(F.sum("net_amount")).first()[0] == 0


def test_groups_of_people_add_up(spark, small):
    firm = Firm.sample(spark, small)
    total = kpis.low_utilization(firm).first()["cur"]
    assert sum(r["low_util_n"] for r in kpis.low_utilization_by(firm, "practice_area", k=100).collect()) <= total


def test_rescaled_outliers_hit_their_targets(spark, small):
    firm = Firm.sample(spark, small)
    got = (firm.table("fact_expenses").where(F.col("expense_category_business") == "Billable").groupBy("project_id").agg(F.sum("amount").cast("double").alias("s"))
           .join(firm.table("outlier_projects"), "project_id").select("s", F.col("target_total_te").cast("double").alias("t"), "row_count").collect())
    assert got and all(abs(r["s"] - r["t"]) <= 0.01 * r["row_count"] for r in got)


def test_open_rule_matches_in_both_tables(spark, small):
    firm = Firm.sample(spark, small)
    assert firm.table("payables_aging").count() == firm.table("fact_accounts_payable").where(rules.is_open()).count()


def test_profitability_moves_its_wide_rows_twice(spark, small):
    """By project, and to the names; not by client, by lead, by manager and by place one after the other."""
    firm = Firm.sample(spark, small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(firm.build("project_profitability")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [b for b in text.split("\n\n") if " Exchange\n" in b and "project_name#" in b]
    assert len(moved) == 2, [b.split("\n")[-1][:200] for b in moved]


def test_profitability_of_repeated_and_missing_ids(spark):
    """Each row of a project meets the names of its own ids: those of another row under the same project id are not its names."""
    as_of = datetime.date(2020, 1, 31)
    dims = "region string, location string, practice_area string, industry string, customer string"
    here = ("R", "L", "P", "I", "C")
    projects = spark.createDataFrame(
        [(k, n, c, "T", lead, boss, None, None, 10, D(5), D(3), D(2), 40.0, k, D(100), "Active", True, *here) for k, n, c, lead, boss in
         ((1, "a", 7, 1, 2), (1, "b", 8, 2, None), (1, "b", 8, 2, None), (None, "c", None, None, 1))],
        "project_id bigint, project_name string, client_id bigint, project_type string, lead_partner_id bigint, project_manager_id bigint, project_start_date date, project_end_date date, "
        "planned_hours bigint, planned_revenue decimal(18,4), planned_cost decimal(18,4), planned_margin decimal(18,4), planned_margin_pct double, contract_id bigint, total_contract_value decimal(18,4), "
        "project_status string, is_active boolean, " + dims)
    cards = spark.createDataFrame([(1, 1, D(5), D(2), D(1), "Billable", as_of), (None, 1, D(5), D(2), D(1), "Billable", as_of)], "project_id bigint, employee_id bigint, billing_amount decimal(18,4), cost_amount decimal(18,4), hours_worked decimal(18,6), time_type_clean string, work_date date")
    spent = spark.createDataFrame([(1, D(1))], "project_id bigint, amount decimal(18,4)")
    clients = spark.createDataFrame([(7, "seven"), (8, "eight"), (8, "acht")], "client_id bigint, client_name string")
    staff = spark.createDataFrame([(k, n, True, True, as_of, "Partner", "Partner", *here) for k, n in ((1, "one"), (2, "two"))],
                                  "employee_id bigint, full_name string, is_current boolean, is_latest_snapshot boolean, snapshot_date date, position_title string, job_level string, " + dims)
    got = gold.project_profitability(projects, cards, spent, clients, staff).select("project_id", "project_name", "client_name", "lead_partner_name", "project_manager_name", F.col("actual_revenue").cast("int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", "seven", "one", "two", 5)] + [(1, "b", n, "two", None, 5) for n in ("eight", "acht")] * 2 + [(None, "c", None, None, "one", 0)], key=repr)
