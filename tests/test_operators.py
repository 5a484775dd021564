import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.periods import Periods, as_of_date
from tallyhouse.operators import aggregates, joins, windows
from tallyhouse.plans import gold, silver
from tallyhouse.plans.firm import Firm
from tallyhouse.plans.policy import SAMPLE_POLICY
from tallyhouse.sources.sinks import rebuild


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_interval_join_newest_start_wins_and_open_end(spark):
    rates = spark.createDataFrame([(1, 10.0, date(2000, 1, 1), date(2000, 12, 31)), (1, 20.0, date(2000, 7, 1), None), (1, 30.0, date(2000, 7, 1), date(2000, 7, 31)), (2, 5.0, date(2001, 1, 1), None)],
                                  "k int, rate double, effective_date date, end_date date")
    events = spark.createDataFrame([(1, date(2000, 3, 1)), (1, date(2000, 7, 15)), (1, date(2002, 1, 1)), (2, date(2000, 1, 1)), (3, date(2000, 1, 1)), (1, date(2000, 3, 1))], "k int, day date")
    got = rows(joins.interval_join(events, "k", "day", {"r": (rates, "rate")}))
    assert got == sorted([(1, date(2000, 3, 1), 10.0), (1, date(2000, 3, 1), 10.0), (1, date(2000, 7, 15), 20.0), (1, date(2002, 1, 1), 20.0), (2, date(2000, 1, 1), None), (3, date(2000, 1, 1), None)], key=repr)


def test_interval_join_is_the_calendar_joined_back_and_reads_events_once(spark, tmp_path):
    rnd, day = random.Random(3), lambda n: date(2000, 1, 1) + timedelta(days=n)
    maybe = lambda v: None if rnd.random() < 0.1 else v
    rates = spark.createDataFrame([(maybe(rnd.randrange(6)), maybe(float(rnd.randrange(9))), maybe(day(rnd.randrange(60))), maybe(day(rnd.randrange(90)))) for _ in range(60)],
                                  "k int, rate double, effective_date date, end_date date")
    spark.createDataFrame([(i % 40, maybe(rnd.randrange(8)), maybe(day(rnd.randrange(90)))) for i in range(400)], "i int, k int, day date").write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    kinds = {"r": (rates, "rate"), "other": (rates.where("rate > 3"), "rate")}
    got = joins.interval_join(events, "k", "day", kinds)
    want = events.join(joins.rate_calendar(events, "k", "day", kinds), ["k", "day"], "left")
    assert got.columns == want.columns and rows(got) == rows(want)
    assert got._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1  # the calendar reads them again for their days


def test_timecards_read_line_items_once(spark, small):
    plan = Firm.sample(spark, small).build("fact_timecards")._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "l_shipdate" in line for line in plan.splitlines()) == 1


def test_rates_of_cards_without_day_and_of_repeated_people(spark):
    cards = spark.createDataFrame([(1, 1, date(2000, 5, 1)), (2, 1, None), (3, None, date(2000, 5, 1)), (4, 2, date(2000, 5, 1)), (5, 3, date(2000, 5, 1))], "c int, employee_id int, work_date date")
    rate = lambda c: spark.createDataFrame([(1, 10.0, date(2000, 1, 1), None), (None, 3.0, date(2000, 1, 1), None)], f"employee_id int, {c} double, effective_date date, end_date date")
    people = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "employee_id int, job_level string")
    got = rows(silver.with_rates(cards, rate("billing_rate"), rate("hourly_cost_rate"), people).select("c", "_rate", "_cost", "job_level"))
    assert got == [(1, 10.0, 10.0, "a"), (2, None, None, None), (3, None, None, None), (4, None, None, "b"), (4, None, None, "c"), (5, None, None, None)]


def test_people_of_projects_are_not_dealt_out_by_person(spark, small):
    firm = Firm.sample(spark, small)
    projects = firm.build("dim_projects")
    assert not any("Exchange" in line and "employee_id" in line for line in projects._jdf.queryExecution().executedPlan().toString().splitlines())
    staff = spark.createDataFrame([(1, 7, "Active"), (1, 7, "Planned"), (1, 8, "Active"), (1, None, "Active")], "project_id bigint, employee_id bigint, assignment_status string")
    found = silver.dim_projects(firm.source_table("sfdc_engagements"), firm.source_table("sfdc_contracts"), staff.withColumn("allocation_percentage", F.lit(1.0)), firm.policy)
    assert [tuple(r) for r in found.where("project_id = 1").select("assigned_headcount", "active_assignments", "planned_assignments").collect()] in ([], [(2, 3, 1)])
    assert dict(found.dtypes)["assigned_headcount"] == "bigint"


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture
def shuffled(spark):
    """Joins are shuffled, as they are over large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_people_of_cells_and_projects_need_no_shuffle_by_person(spark):
    cards = spark.createDataFrame([(1, 7, "A"), (1, 7, "B"), (1, 8, "A"), (1, None, "B"), (2, None, "A"), (None, 7, "A"), (None, 9, "A")],
                                  "project_id long, employee_id long, customer string").select(
        "*", *[F.lit("x").alias(c) for c in ("region", "location", "practice_area", "industry")], F.lit("Billable").alias("time_type_clean"),
        F.lit(date(2001, 3, 1)).alias("fiscal_month"), F.lit(date(2001, 3, 9)).alias("work_date"),
        *[F.lit(2).cast("decimal(18,4)").alias(c) for c in ("billing_amount", "cost_amount", "hours_worked")])
    per_project = gold.project_activity(cards)
    assert rows(per_project.select("project_id", "team_size", F.col("actual_revenue").cast("int"))) == sorted([(1, 2, 8), (2, 0, 2), (None, 2, 4)], key=repr)
    dims = "region string, location string, practice_area string, industry string, customer string"
    none = lambda columns: spark.createDataFrame([], f"{dims}, {columns}")
    out = gold.enterprise_metrics(
        cards, none("fiscal_month date, amount decimal(18,4)"), none("is_current boolean, is_latest_snapshot boolean"),
        none("fiscal_month date, amount decimal(18,4), payment_date date"), none("is_wip boolean, fiscal_month date, billing_amount decimal(18,4)"),
        none("is_active boolean, planned_revenue decimal(18,4)"), SAMPLE_POLICY)
    assert rows(out.select("customer", "active_employees", F.col("revenue").cast("int"), F.col("billable_hours").cast("int"))) == [("A", 3, 10, 10), ("B", 1, 4, 4)]
    assert not [x for df in (per_project, out) for x in exchanges(df) if "employee_id" in x]


def test_wide_projects_are_shuffled_by_engagement_once(spark, small, shuffled):
    f = Firm.sample(spark, small)
    assert len([x for x in exchanges(f.build("dim_projects")) if "hashpartitioning(engagement_id" in x]) == 1


def test_invoices_are_not_shuffled_by_lead(spark, shuffled):
    invoices = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 12), (5, 99)], "invoice_id long, project_id long").select(
        "*", F.lit(1).alias("customer_id"), F.lit("c").alias("customer_name"), F.lit(date(2001, 3, 1)).alias("invoice_date"), F.lit(date(2001, 4, 1)).alias("due_date"),
        F.lit(1).cast("decimal(18,4)").alias("amount"), F.lit("Open").alias("payment_status"), F.lit(None).cast("date").alias("payment_date"),
        *[F.lit("x").alias(c) for c in ("region", "location", "practice_area", "industry", "customer")])
    projects = spark.createDataFrame([(10, 1), (10, 2), (11, None), (12, 7), (None, 1)], "project_id long, lead_partner_id long")
    staff = spark.createDataFrame([(1, "P", True), (1, "Q", True), (2, "R", True), (7, "S", False)], "employee_id long, full_name string, is_current boolean").withColumn("is_latest_snapshot", F.lit(True))
    out = silver.fact_accounts_receivable(invoices, projects, staff, date(2001, 6, 1), SAMPLE_POLICY)
    assert rows(out.select("invoice_id", "lead_partner_name")) == [(1, "P"), (1, "Q"), (1, "R"), (2, "Unassigned"), (3, "Unassigned"), (4, "Unassigned"), (5, "Unassigned")]
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    by_lead = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and ("lead" in line or "employee_id" in line)]
    below = lambda i: [x for x in plan[i + 1:next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))]]
    assert by_lead and not [i for i in by_lead if any("Join" in x for x in below(i))]


def test_receivables_are_stored_without_a_shuffle_of_their_own(spark, small, monkeypatch):
    f, seen = Firm.sample(spark, small), {}
    fresh = Firm(spark, f.source, f.folder + "/dealt", f.policy)
    monkeypatch.setattr("tallyhouse.plans.firm.rebuild", lambda df, path, by, rebalance: (seen.update({path.rsplit("/", 1)[1]: rebalance}), rebuild(df, path, by, rebalance)))
    assert fresh.table("fact_accounts_receivable").count() == f.build("fact_accounts_receivable").count()
    assert seen["fact_accounts_receivable"] is False


def test_open_month_ends_against_brute_force(spark):
    rnd, as_of = random.Random(7), date(2001, 3, 15)
    data = []
    for i in range(400):
        issued = date(1999, 6, 1) + timedelta(days=rnd.randrange(640))
        paid = None if rnd.random() < 0.4 else issued + timedelta(days=rnd.randrange(500))
        data.append((i, issued, paid))
    data += [(900, date(2001, 1, 31), date(2001, 1, 31)), (901, date(2001, 1, 31), date(2001, 2, 28)), (902, date(2000, 2, 29), None), (903, date(2001, 3, 10), None)]
    df = spark.createDataFrame(data, "i int, invoice_date date, payment_date date")
    firsts = [2001 * 12 + 2 - k for k in range(13)]
    ends = [date(x // 12, x % 12 + 1, 1) - timedelta(days=1) for x in firsts]
    for most in (None, 365):
        got = rows(joins.open_at_month_ends(df, 13, 1, as_of, max_age=most).select("i", "snapshot_date", "days_out"))
        assert got == sorted(((i, e, (e - a).days) for i, a, p in data for e in ends if a <= e and (p is None or p > e) and (most is None or (e - a).days <= most)), key=repr)


def test_rows_after_the_as_of_date_change_no_trailing_figure(spark, small):
    work = spark.createDataFrame([(date(2001, 3, 1),), (date(2001, 5, 4),)], "d date")
    paid = spark.createDataFrame([("2001-04-30",), (None,)], "p string")
    assert as_of_date((work, "d"), (paid, "p")) == date(2001, 5, 4) == as_of_date((paid, "p"), (work, "d"))
    p = Periods(date(2001, 5, 4))
    late = work.unionByName(spark.createDataFrame([(date(2001, 5, 5),), (date(2004, 1, 1),)], "d date"))
    for df in (work, late):
        assert df.where(p.trailing_days("d", 30)).count() == 1 and df.where(p.trailing_days("d", 90)).count() == 2
    assert late.where(p.since_days("d", 30)).count() == 3
    firm = Firm.sample(spark, small)
    for table, column in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        assert firm.raw(table).where(F.col(column).cast("date") > F.lit(firm.as_of)).count() == 0


def test_null_safe_and_except_and_orphans(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, b int")
    assert rows(joins.null_safe_join(a, b, ["k"])) == sorted([("x", 1, 10), (None, 2, 20), ("y", 3, None)], key=repr)
    assert rows(joins.except_keys(a, "k", b.where("k = 'x'")).select("a")) == [(2,), (3,)]
    assert rows(joins.orphans(a, "k", b, "k").select("a")) == [(3,)]


def test_full_outer_and_upper(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([("y", 2)], "k string, b int")
    assert rows(joins.full_outer(a, b, ["k"])) == sorted([("x", 1, None), ("y", None, 2)], key=repr)
    assert rows(joins.join_upper(a, spark.createDataFrame([("X", 9)], "n string, c int"), "k", "n")) == [("x", 1, 9)]


def test_pool_pick_is_within_group(spark):
    people = spark.createDataFrame([(g, n, f"{g}{n}") for g in "ab" for n in range(7)], "g string, n int, name string")
    pool = joins.ranked_pool(people, ["g"], [F.col("n")], 5)
    got = joins.pick_from_pool(spark.createDataFrame([("a", i) for i in range(40)], "g string, id long"), pool, ["g"], "id", 5, {"lead": "name"}).collect()
    assert {r["lead"] for r in got} <= {f"a{n}" for n in range(5)} and len(got) == 40


def test_lag_rows_differs_from_lag_months_in_sparse_cells(spark):
    df = spark.createDataFrame([("c", date(2000, 1, 1), 1), ("c", date(2000, 3, 1), 2), ("c", date(2001, 1, 1), 3)], "k string, m date, v int")
    out = windows.lag_months(windows.lag_rows(df, ["k"], "m", "v", 2, "by_row"), ["k"], "m", "v", 12, "by_month")
    assert rows(out.select("m", "by_row", "by_month")) == [(date(2000, 1, 1), None, None), (date(2000, 3, 1), None, None), (date(2001, 1, 1), 1, 1)]
    gap = windows.lag_months(df, ["k"], "m", "v", 10, "x")
    assert rows(gap.select("m", "x"))[2] == (date(2001, 1, 1), 2)


def test_latest_row_ties_and_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(date(2000, 1, 1)).alias("m"), F.col("id").alias("v"))
    out = windows.latest_row(df, "k", "m", F.col("v").desc())
    assert out.where("k = 0").select("v").collect()[0][0] == 19998
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "g string, v int")
    assert rows(windows.share_within(df, ["g"], "v", "s").select("v", "s")) == [(1, 0.25), (3, 0.75), (5, 1.0)]
    assert sum(r["p"] for r in windows.share_of_all(df, "v", "p").collect()) == pytest.approx(100)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_with_hot_value(spark, q):
    values = [1.0] * 4000 + [float(x) for x in range(6000)] + [1e9]
    got = aggregates.exact_quantile(spark.createDataFrame([(v,) for v in values], "v double"), "v", q, "x").first()["x"]
    assert got == pytest.approx(float(np.quantile(values, q)), rel=1e-12)


def test_dominant_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("g", "b", 5), ("g", "a", 5), ("h", "z", 1)], "g string, c string, w int")
    assert rows(aggregates.dominant(df, ["g"], "c", "w", "top")) == [("g", "a"), ("h", "z")]
