"""SV*, GD*: silver and gold builders."""

from tallyhouse.catalogue.check_tables import AUDIT_MONEY, DIM, PNL_COLUMNS, PROFIT_MONEY, doubles
from tallyhouse.catalogue.registry import query


def _builder(name: str, table: str, check: str):
    query(name, check)(lambda firm: firm.build(table))


_builder("SV1_dim_clients", "dim_clients", f"SELECT * REPLACE ({doubles(['annual_revenue'])}) FROM r_clients")
_builder("SV2_dim_employees", "dim_employees", "SELECT * FROM r_employees")
_builder("SV3_dim_projects", "dim_projects",
         f"SELECT * REPLACE ({doubles(['planned_revenue', 'planned_cost', 'planned_margin', 'total_contract_value'])}) FROM r_projects")
_TIME = ["hours_worked", "billing_rate", "cost_rate", "billing_amount", "cost_amount"]
_builder("SV4_fact_timecards", "fact_timecards", f"SELECT * REPLACE ({doubles(_TIME)}) FROM r_timecards")
_builder("SV5_fact_expenses", "expenses_as_filed", f"SELECT * REPLACE ({doubles(['amount', 'budgeted_amount'])}) FROM r_expenses_filed")
_builder("SV6_rescaled_outliers", "fact_expenses", f"SELECT * REPLACE ({doubles(['amount', 'budgeted_amount'])}) FROM r_expenses")
_builder("SV6b_outlier_projects", "outlier_projects",
         f"SELECT * REPLACE ({doubles(['total_contract_value', 'current_te', 'target_total_te'])}) FROM r_outliers")
_builder("SV7_wip_unbilled", "wip_unbilled", f"SELECT * REPLACE ({doubles([*_TIME, 'margin_amount'])}) FROM r_wip")
_builder("SV8_fact_accounts_payable", "fact_accounts_payable", f"SELECT * REPLACE ({doubles(['amount'])}) FROM r_ap")
_builder("SV9_fact_accounts_receivable", "fact_accounts_receivable", f"SELECT * REPLACE ({doubles(['amount'])}) FROM r_ar")
_builder("SV10_fact_general_ledger", "fact_general_ledger",
         f"SELECT * REPLACE ({doubles(['debit_amount', 'credit_amount', 'net_amount'])}) FROM r_gl")

_builder("GD1_regional_pnl", "regional_pnl", f"SELECT {PNL_COLUMNS} FROM r_pnl")
_builder("GD2_talent_supply_demand", "talent_supply_demand", "SELECT * FROM r_talent")
_builder("GD3_project_profitability", "project_profitability", f"SELECT * REPLACE ({doubles(PROFIT_MONEY)}) FROM r_profit")
_builder("GD4_project_profitability_monthly", "project_profitability_monthly",
         f"SELECT * REPLACE ({doubles(['actual_revenue', 'actual_cost', 'actual_expenses', 'actual_margin', 'actual_hours', 'billable_hours'])}) FROM r_profit_monthly")
_builder("GD5_receivables_wip_aging", "receivables_wip_aging", f"SELECT * REPLACE ({doubles(['amount'])}) FROM r_recv")
_builder("GD6_ar_snapshot_aging", "ar_snapshot_aging", f"SELECT * REPLACE ({doubles(['open_ar_balance', 'firmwide_open_ar'])}) FROM r_snap")
_builder("GD7_te_contract_audit", "te_contract_audit", f"SELECT * REPLACE ({doubles(AUDIT_MONEY)}) FROM r_audit")
ENT_MONEY = ["revenue", "delivery_cost", "operating_expenses", "profit", "gross_profit", "total_hours", "billable_hours", "accounts_receivable",
             "wip_value", "pipeline_revenue"]
_builder("GD8_enterprise_metrics", "enterprise_metrics", f"SELECT * REPLACE ({doubles(ENT_MONEY)}) FROM r_ent")
_builder("GD9_payables_aging", "payables_aging", f"SELECT * REPLACE ({doubles(['amount_due'])}) FROM r_payables")
_builder("GD10_enterprise_summary", "enterprise_summary", "SELECT * FROM r_summary")
_builder("GD11_practice_area_summary", "practice_area_summary", "SELECT * FROM r_practice")
_builder("GD12_department_summary", "department_summary", "SELECT * FROM r_dept")
_builder("GD13_partner_metrics", "partner_metrics", "SELECT * FROM r_partner")
