"""The table graph of a firm: source tables, silver and gold builders, and stored copies of them.

A stored copy is a parquet table in the shared work folder. Reports read stored tables, so
a fact is built once and its lineage ends at files that survive the loss of an executor.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.functions.periods import Periods
from tallyhouse.plans import gold, silver
from tallyhouse.plans.policy import SAMPLE_POLICY, Policy
from tallyhouse.session import work_dir
from tallyhouse.sources.sample import SampleSource
from tallyhouse.sources.sinks import rebuild

_LOCK = threading.RLock()
_OPEN: dict[tuple[str, str], "Firm"] = {}


#: tables written as their last join, window or scan by months deals them out; a shuffle of the whole wide table is saved
DEALT = {"fact_timecards", "expenses_as_filed", "fact_expenses", "fact_accounts_receivable", "regional_pnl", "enterprise_metrics"}


class Firm:
    """Source tables of one folder and everything built from them."""

    def __init__(self, spark: SparkSession, source, folder: str, policy: Policy):
        self.spark, self.source, self.folder, self.policy = spark, source, folder, policy
        self._stored: dict[str, tuple[str, object]] = {}

    @classmethod
    def sample(cls, spark: SparkSession, folder: str) -> "Firm":
        """The firm bound to a test folder; one per Spark application and folder."""
        with _LOCK:
            key = (spark.sparkContext.applicationId, folder)
            if key not in _OPEN:
                _OPEN[key] = cls(spark, SampleSource(spark, folder), folder, SAMPLE_POLICY)
            return _OPEN[key]

    @cached_property
    def as_of(self) -> date:
        return self.source.as_of()

    @cached_property
    def periods(self) -> Periods:
        return Periods(self.as_of)

    def raw(self, table: str) -> DataFrame:
        return self.source.raw(table)

    def source_table(self, name: str) -> DataFrame:
        return getattr(self.source, name)()

    def build(self, name: str) -> DataFrame:
        """The plan of a table over the stored tables it needs."""
        return BUILDERS[name][0](self)

    def table(self, name: str) -> DataFrame:
        """The stored copy, written on first use."""
        with _LOCK:
            if name not in self._stored:
                df = self.build(name)
                app = self.spark.sparkContext.applicationId
                where = self.folder.strip("/").replace("/", "_")
                path = f"{work_dir(self.spark)}/tallyhouse/{app}/{where}/{name}"
                rebuild(df, path, BUILDERS[name][1], name not in DEALT)
                self._stored[name] = (path, df.schema)
            path, schema = self._stored[name]
        return self.spark.read.schema(schema).parquet(path)


BUILDERS: dict[str, tuple[Callable[[Firm], DataFrame], str | None]] = {
    "dim_clients": (lambda f: silver.dim_clients(f.source_table("sfdc_accounts")), None),
    "dim_employees": (lambda f: silver.dim_employees(
        f.source_table("workday_employees"), f.source_table("workday_organizations"), f.as_of, f.policy), "snapshot_date"),
    "dim_projects": (lambda f: silver.dim_projects(
        f.source_table("sfdc_engagements"), f.source_table("sfdc_contracts"), f.source_table("workday_assignments"), f.policy), None),
    "fact_timecards": (lambda f: silver.fact_timecards(
        f.source.workday_timecards, f.source_table("workday_billing_rates"), f.source_table("workday_cost_rates"),
        f.source_table("workday_employees"), f.as_of, f.policy), "fiscal_month"),
    "expenses_as_filed": (lambda f: silver.fact_expenses(
        f.source_table("concur_expense_items"), f.source_table("concur_expense_reports"), f.source_table("cost_center_mapping"), f.policy),
        "fiscal_month"),
    "outlier_projects": (lambda f: silver.outlier_projects(f.table("expenses_as_filed"), f.table("dim_projects"), f.policy), None),
    "fact_expenses": (lambda f: silver.rescale_outliers(f.table("expenses_as_filed"), f.table("outlier_projects")), "fiscal_month"),
    "wip_unbilled": (lambda f: silver.wip_unbilled(
        f.table("fact_timecards"), f.table("dim_employees"), f.table("dim_projects"), f.table("dim_clients"), f.as_of), None),
    "fact_accounts_payable": (lambda f: silver.fact_accounts_payable(f.source_table("sap_accounts_payable"), f.policy), "fiscal_month"),
    "fact_accounts_receivable": (lambda f: silver.fact_accounts_receivable(
        f.source_table("sap_accounts_receivable"), f.table("dim_projects"), f.table("dim_employees"), f.as_of, f.policy), "fiscal_month"),
    "fact_general_ledger": (lambda f: silver.fact_general_ledger(f.source_table("sap_general_ledger")), None),
    "regional_pnl": (lambda f: gold.regional_pnl(
        f.table("fact_timecards"), f.table("fact_expenses"), f.table("outlier_projects"), f.policy), "fiscal_period"),
    "talent_supply_demand": (lambda f: gold.talent_supply_demand(
        f.table("dim_employees"), f.table("fact_timecards"), f.table("dim_projects")), None),
    "project_profitability": (lambda f: gold.project_profitability(
        f.table("dim_projects"), f.table("fact_timecards"), f.table("fact_expenses"), f.table("dim_clients"), f.table("dim_employees")), None),
    "project_profitability_monthly": (lambda f: gold.project_profitability_monthly(
        f.table("dim_projects"), f.table("fact_timecards"), f.table("fact_expenses"), f.table("dim_clients")), None),
    "receivables_wip_aging": (lambda f: gold.receivables_wip_aging(
        f.table("fact_accounts_receivable"), f.table("wip_unbilled"), f.table("fact_expenses"), f.table("dim_projects"),
        f.table("dim_employees"), f.as_of), None),
    "ar_snapshot_aging": (lambda f: gold.ar_snapshot_aging(f.table("fact_accounts_receivable"), f.as_of), None),
    "te_contract_audit": (lambda f: gold.te_contract_audit(
        f.table("dim_projects"), f.table("fact_timecards"), f.table("fact_expenses"), f.table("dim_clients"), f.table("dim_employees")), None),
    "enterprise_metrics": (lambda f: gold.enterprise_metrics(
        f.table("fact_timecards"), f.table("fact_expenses"), f.table("dim_employees"), f.table("fact_accounts_receivable"),
        f.table("wip_unbilled"), f.table("dim_projects"), f.policy), "fiscal_period"),
    "payables_aging": (lambda f: gold.payables_aging(f.table("fact_accounts_payable")), None),
    "enterprise_summary": (lambda f: gold.enterprise_summary(
        f.table("fact_timecards"), f.table("fact_expenses"), f.table("dim_employees"), f.table("fact_accounts_receivable"),
        f.table("wip_unbilled"), f.table("dim_projects"), f.as_of), None),
    "practice_area_summary": (lambda f: gold.practice_area_summary(
        f.table("fact_timecards"), f.table("project_profitability"), f.policy), None),
    "department_summary": (lambda f: gold.department_summary(
        f.table("fact_expenses"), f.source_table("cost_center_mapping"), f.table("dim_employees"), f.policy), None),
    "partner_metrics": (lambda f: gold.partner_metrics(f.table("dim_projects"), f.table("fact_timecards"), f.table("dim_employees")), None),
}
