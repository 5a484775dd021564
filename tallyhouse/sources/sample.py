"""Binds the star-schema test tables to the source-system tables the builders expect.

The only module that knows the test tables. Every derived value is integer, date or exact
decimal arithmetic on the row's own keys, so another engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.functions.money import money
from tallyhouse.functions.periods import as_of_date
from tallyhouse.sources.tables import scan

PRACTICES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
JOB_LEVELS = ["Senior Partner", "Partner", "Associate Partner", "Director", "Engagement Manager", "Associate",
              "Business Analyst"]
DEPARTMENTS = ["FINANCE", "HR", "MARKETING", "SALES", "IT", "ENGINEERING", "OPERATIONS", "LEGAL"]
VENDORS = ["Deloitte", "EY", "PwC", "KPMG", "Gartner", "Forrester", "IDC", "Oracle", "SAP", "WeWork", "Regus", "JLL",
           "CBRE", "Iron Mountain"]
EXPENSE_TYPES = ["Airfare", "Hotel", "Software", "Meals", "Training", "Mileage", "Parking"]
ENGAGEMENT_TYPES = ["Strategy Review", "Operations Improvement", "Transformation", "Innovation Lab"]
FIRST_RATE_YEAR, LAST_RATE_YEAR = 1995, 2001
#: days from an order to its invoice
BILLED_AFTER = 95


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + F.lit(1)).cast("int"))


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _plus_days(start: Column, days: Column) -> Column:
    return F.date_add(start, days.cast("int"))


def _line_id(supplier: str = "l_suppkey", day: str = "ship_date") -> Column:
    """A line item's own key."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", supplier, F.col(day).cast("string"))


class SampleSource:
    """Source-system tables over one test folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._as_of: date | None = None

    def raw(self, table: str) -> DataFrame:
        return scan(self.spark, self.folder, table)

    def as_of(self) -> date:
        """The newest day on which work, expenses, payables or orders are dated."""
        if self._as_of is None:
            self._as_of = as_of_date((self.raw("lineitem"), "l_shipdate"), (self.raw("orders"), "o_orderdate"))
        return self._as_of

    def _places(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("location"), F.col("r_name").alias("region"))

    def customers(self) -> DataFrame:
        c, places = self.raw("customer"), self._places()
        return c.join(places, c.c_nationkey == places.n_nationkey).select(
            "c_custkey", "c_acctbal", F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("industry"),
            "location", "region", "n_nationkey")

    def _orders(self) -> DataFrame:
        """Orders with the five dimensions of their customer."""
        o, c = self.raw("orders"), self.customers().drop("c_acctbal")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            "o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("price"),
            _day("o_orderdate").alias("order_date"), "region", "location",
            F.col("o_orderpriority").alias("practice_area"), "industry", "customer", "n_nationkey")

    def _staff(self) -> DataFrame:
        s, places = self.raw("supplier"), self._places()
        return s.join(places, s.s_nationkey == places.n_nationkey).select(
            "s_suppkey", "s_name", "s_nationkey", "region", "location",
            pick(PRACTICES, F.col("s_suppkey") % 5).alias("practice_area"),
            pick(INDUSTRIES, F.col("s_suppkey") % 5).alias("industry"),
            F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("customer"))

    def _lines(self) -> DataFrame:
        """All line items. Their key (see ``_line_id``) is a long text, so it is made after the joins."""
        day = _day("l_shipdate")
        return self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
            money("l_quantity").alias("qty"), money("l_extendedprice").alias("price"),
            F.col("l_discount").cast("decimal(6,2)").alias("discount"), F.col("l_tax").cast("decimal(6,2)").alias("tax"),
            day.alias("ship_date"))

    # CRM
    def sfdc_accounts(self) -> DataFrame:
        """Two versions of every account; the second is the newer one."""
        k = F.col("c_custkey")
        status = F.when(k % 11 == 0, F.lit(None)).when(F.col("c_acctbal") < 0, "Inactive").otherwise("Active")
        return (self.customers().withColumn("version", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            k.alias("account_id"),
            F.when(F.col("version") == 0, F.concat("customer", F.lit(" (old)"))).otherwise(F.col("customer")).alias("account_name"),
            "industry", pick(["Enterprise", "Mid-Market", "Public"], k % 3).alias("account_type"),
            F.when(k % 7 == 0, k / F.lit(7)).cast("bigint").alias("parent_account_id"), status.alias("account_status"),
            money("c_acctbal").alias("annual_revenue"), "region", "location",
            pick(PRACTICES, k % 5).alias("practice_area"), "customer",
            _plus_days(F.lit(date(2000, 1, 1)), k % 200 + F.col("version") * 30).alias("last_modified_date")))

    def sfdc_engagements(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self._orders().select(
            k.alias("engagement_id"), F.concat_ws(" - ", "customer", pick(ENGAGEMENT_TYPES, k % 4), k).alias("engagement_name"),
            F.col("o_custkey").alias("account_id"), k.alias("contract_id"),
            pick(ENGAGEMENT_TYPES, k % 4).alias("engagement_type"),
            (F.col("o_custkey") % 120).alias("lead_partner"), (F.col("o_custkey") * 7 % 100).alias("engagement_manager"),
            F.col("order_date").alias("start_date"),
            F.when(k % 17 != 0, _plus_days(F.col("order_date"), (k % 24 + 1) * 30)).alias("end_date"),
            F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "P", "On Hold")
            .otherwise("Completed").alias("status"),
            F.when(k % 19 != 0, F.col("price")).alias("forecasted_revenue"), F.col("price").alias("budget_amount"),
            "region", "location", "practice_area", "industry", "customer", F.col("order_date").alias("last_modified_date"))

    def sfdc_contracts(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.raw("orders").where(k % 13 != 0)
        return o.select(k.alias("contract_id"), F.concat(F.lit("C-"), k).alias("contract_number"),
                        (F.col("o_totalprice").cast("decimal(16,2)") * F.lit(1.2).cast("decimal(4,2)")).cast("decimal(18,4)")
                        .alias("total_contract_value"),
                        pick(["Monthly", "Quarterly"], k % 2).alias("billing_frequency"))

    # HR
    def workday_employees(self) -> DataFrame:
        k = F.col("s_suppkey")
        hired = _plus_days(F.lit(date(1993, 1, 1)), k * 37 % 3100)
        level = pick(JOB_LEVELS, k % 7)
        return self._staff().select(
            k.alias("employee_id"), F.concat(F.lit("F"), k).alias("first_name"), F.concat(F.lit("L"), k).alias("last_name"),
            hired.alias("hire_date"), F.when(k % 9 == 0, F.date_add(hired, 1500)).alias("termination_date"),
            F.concat(level, F.lit(" Consultant")).alias("job_title"), level.alias("job_level"),
            pick(["Advisory", "Delivery"], k % 2).alias("job_profile"),
            F.when(k % 4 != 0, "Regular").alias("employee_type"), F.col("s_nationkey").alias("cost_center"),
            (k / F.lit(10)).cast("bigint").alias("manager_id"), "region", "location", "practice_area", "industry", "customer")

    def workday_organizations(self) -> DataFrame:
        """Two names per cost centre, to be reduced to one."""
        return (self.raw("nation").withColumn("v", F.explode(F.array(F.lit("B"), F.lit("A")))).select(
            F.col("n_nationkey").alias("cost_center"), F.concat_ws(" ", F.lit("Office"), "v", "n_name").alias("organization_name"),
            F.col("n_name").alias("country")))

    def workday_timecards(self, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``attach`` may add columns to cards with employee_id and work_date; it gets them before the text columns of their orders."""
        o = self._orders().select("o_orderkey", "region", "location", "practice_area", "industry", "customer")
        lines = self._lines().select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "qty",
            F.col("l_suppkey").alias("employee_id"), F.col("ship_date").alias("work_date"))
        cards = attach(lines) if attach else lines
        return cards.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            _line_id("employee_id", "work_date").alias("timecard_id"), "employee_id", F.col("l_orderkey").alias("project_id"), "work_date",
            F.when(F.col("l_returnflag") == "A", "Billable").when(F.col("l_returnflag") == "N", "Non-Billable")
            .otherwise("PTO").alias("time_type"),
            F.col("qty").alias("hours"),
            (F.lit(80) + F.col("l_linenumber") * 10).cast("decimal(18,4)").alias("billing_rate"),
            (F.lit(30) + F.col("l_linenumber") * 2).cast("decimal(18,4)").alias("cost_rate"),
            F.when(F.col("l_linenumber") == 7, "Rejected").when(F.col("l_linestatus") == "F", "Approved")
            .otherwise("Submitted").alias("approval_status"),
            "region", "location", "practice_area", "industry", "customer", *[c for c in cards.columns if c not in lines.columns])

    def _rate_years(self) -> DataFrame:
        years = F.explode(F.sequence(F.lit(FIRST_RATE_YEAR), F.lit(LAST_RATE_YEAR)))
        return self.raw("supplier").select("s_suppkey", years.alias("y"))

    def workday_billing_rates(self) -> DataFrame:
        """One rate a year; every fourth person also has overlapping open-ended rates from mid-1996 and mid-1997."""
        k, y = F.col("s_suppkey"), F.col("y")
        yearly = self._rate_years().select(
            k.alias("employee_id"), (F.lit(100) + k % 50 + (y - FIRST_RATE_YEAR) * 5).cast("decimal(18,4)").alias("billing_rate"),
            F.make_date(y, F.lit(1), F.lit(1)).alias("effective_date"),
            F.when(~((k % 4 == 0) & (y == 1997)), F.make_date(y, F.lit(12), F.lit(31))).alias("end_date"))
        overlap = self._rate_years().where((k % 4 == 0) & y.isin(1996, 1997)).select(
            k.alias("employee_id"), (F.lit(200) + k % 7).cast("decimal(18,4)").alias("billing_rate"),
            F.make_date(y, F.lit(7), F.lit(1)).alias("effective_date"), F.lit(None).cast("date").alias("end_date"))
        return yearly.unionByName(overlap)

    def workday_cost_rates(self) -> DataFrame:
        k, y = F.col("s_suppkey"), F.col("y")
        return self._rate_years().where(y != 1998).select(
            k.alias("employee_id"), (F.lit(40) + k % 30 + (y - FIRST_RATE_YEAR) * 2).cast("decimal(18,4)").alias("hourly_cost_rate"),
            F.make_date(y, F.lit(1), F.lit(1)).alias("effective_date"), F.make_date(y, F.lit(12), F.lit(31)).alias("end_date"))

    def workday_assignments(self) -> DataFrame:
        return self._lines().select(
            F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("employee_id"),
            F.col("qty").alias("allocation_percentage"),
            F.when(F.col("l_linestatus") == "O", "Active").otherwise("Planned").alias("assignment_status"))

    # Expenses
    def concur_expense_reports(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("report_id"), (F.col("o_custkey") % 100).alias("employee_id"), _day("o_orderdate").alias("submit_date"),
            F.when(k % 5 == 0, "Submitted").otherwise("Approved").alias("approval_status"), (k % 25).cast("int").alias("cost_center"))

    def concur_expense_items(self) -> DataFrame:
        o = self._orders().select("o_orderkey", "region", "location", "practice_area", "industry", "customer")
        s = self.raw("supplier").select("s_suppkey", "s_name")
        # amounts and flags are made before the joins, which then move fewer columns
        lines = self._lines().where(F.col("l_returnflag") == "R").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_date",
            (F.col("price").cast("decimal(14,2)") * F.col("tax")).cast("decimal(18,4)").alias("transaction_amount"),
            (F.col("l_linestatus") == "F").alias("has_receipt"))
        # the vendor's name first: what follows joins on the order
        return (lines.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            _line_id().alias("expense_id"), F.col("l_orderkey").alias("report_id"), F.col("ship_date").alias("transaction_date"),
            pick(EXPENSE_TYPES, F.col("l_linenumber") % 7).alias("expense_type"),
            "transaction_amount", (F.col("l_linenumber") % 3 == 0).alias("is_billable"), "has_receipt",
            F.col("s_name").alias("vendor_name"),
            F.when(F.col("l_linenumber") != 5, F.col("l_orderkey")).alias("project_id"),
            "region", "location", "practice_area", "industry", "customer"))

    def cost_center_mapping(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("cost_center_code"),
                                         pick(DEPARTMENTS, F.col("n_nationkey") % 8).alias("department_category"))

    # ERP
    def sap_accounts_payable(self) -> DataFrame:
        staff = self._staff()
        k = F.col("l_suppkey")
        vendor = F.when(k % 30 < len(VENDORS), pick(VENDORS, F.least(k % 30, F.lit(len(VENDORS) - 1)))).otherwise(F.col("s_name"))
        status = F.when(F.col("l_linestatus") == "F", "Paid").when(F.col("l_returnflag") == "R", "Overdue").when(
            F.col("l_linenumber") == 3, "Partially Paid").otherwise("Open")
        due = F.date_add("ship_date", 45)
        return self._lines().join(staff, k == F.col("s_suppkey")).select(
            _line_id().alias("invoice_id"), k.alias("vendor_id"), vendor.alias("vendor_name"),
            F.col("ship_date").alias("invoice_date"), due.alias("due_date"),
            (F.col("price").cast("decimal(14,2)") * (F.lit(1) - F.col("discount"))).cast("decimal(18,4)").alias("amount"),
            status.alias("payment_status"),
            F.when(status == "Paid", _plus_days(due, F.col("l_orderkey") * 3 % 100 - 10)).alias("payment_date"),
            pick(DEPARTMENTS, F.col("l_linenumber") % 8).alias("department"),
            "region", "location", "practice_area", "industry", "customer")

    def sap_accounts_receivable(self) -> DataFrame:
        """Orders are billed ``BILLED_AFTER`` days later, so the newest invoices are as new as the newest work."""
        k = F.col("o_orderkey")
        billed = F.date_add("order_date", BILLED_AFTER)
        status = F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "Open").otherwise("Partially Paid")
        return self._orders().select(
            k.alias("invoice_id"), F.col("o_custkey").alias("customer_id"), F.col("customer").alias("customer_name"),
            billed.alias("invoice_date"), F.date_add(billed, 30).alias("due_date"), F.col("price").alias("amount"),
            status.alias("payment_status"),
            F.when((status == "Paid") & (k % 23 != 0), _plus_days(billed, k * 7 % 120 + 5)).alias("payment_date"),
            F.when(k % 10 != 3, k).otherwise(F.when(k % 20 == 3, -k)).alias("project_id"),
            "region", "location", "practice_area", "industry", "customer")

    def sap_general_ledger(self) -> DataFrame:
        """Each order posts a debit to an asset account and the same credit to a revenue account."""
        sides = self._orders().withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        debit = F.col("side") == 0
        zero = F.lit(0).cast("decimal(18,4)")
        return sides.select(
            (F.col("o_orderkey") * 2 + F.col("side")).alias("entry_id"), F.col("order_date").alias("posting_date"),
            F.when(debit, F.when(F.col("o_orderkey") % 9 == 0, "Suspense").otherwise("Asset")).otherwise("Revenue").alias("account_type"),
            F.when(debit, F.col("price")).otherwise(zero).alias("debit_amount"),
            F.when(debit, zero).otherwise(F.col("price")).alias("credit_amount"),
            "region", "location", "practice_area", "industry", "customer")
