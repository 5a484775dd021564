"""The insight store: KPI values as rows per persona, slot and slice, and lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType, TimestampType

from tallyhouse.functions import kpi_text
from tallyhouse.plans import kpis
from tallyhouse.plans.firm import Firm
from tallyhouse.sources.sinks import add_columns, backfill, empty_shell, nullable

_KEYS = [("persona", StringType()), ("slot_type", StringType()), ("slot_id", IntegerType())]
_TEXT = ["parent_slot_type", "headline", "value", "comparison", "trend", "trend_direction", "status_color", "narrative", "question_text", "routed_subqueries",
         "cached_agent_payload", "target_entity_type", "target_entity_value"]
SCHEMA = StructType(
    [StructField(n, t, False) for n, t in _KEYS] + [StructField("parent_slot_id", IntegerType())] + [StructField(n, StringType()) for n in _TEXT]
    + [StructField("last_refreshed", TimestampType(), False), StructField("fiscal_period_anchor", DateType()), StructField("filter_axis", StringType()), StructField("filter_value", StringType())])
FIRMWIDE = {"filter_axis": "firmwide", "filter_value": "all"}


def _row(df: DataFrame, persona: str, slot: int, headline: str, value: Column, text, prior: Column | None, higher_is_better: bool) -> DataFrame:
    """One KPI as an insight row: text, comparison, direction and colour."""
    old = F.lit(None).cast("double") if prior is None else prior
    direction = F.when(value > old, "up").when(value < old, "down").when(value == old, "flat")
    good, bad = ("up", "down") if higher_is_better else ("down", "up")
    color = F.when(direction == good, "green").when(direction == bad, "red").when(direction == "flat", "amber")
    return df.select(F.lit(persona).alias("persona"), F.lit("insight").alias("slot_type"), F.lit(slot).alias("slot_id"), F.lit(headline).alias("headline"), text(value).alias("value"),
                     F.when(old.isNotNull(), F.concat(F.lit("was "), text(old))).alias("comparison"), direction.alias("trend_direction"), color.alias("status_color"))


def kpi_insights(firm: Firm, filters=None) -> DataFrame:
    """The twelve tiles of the three personas, values as text."""
    c = F.col
    billions = lambda v: F.concat(F.lit("$"), kpi_text.fixed(v, 2), F.lit("B"))
    millions = lambda v: F.concat(F.lit("$"), kpi_text.fixed(v, 2), F.lit("M"))
    count = lambda noun: lambda v: kpi_text.count_text(v.cast("bigint"), noun)
    d = lambda name: c(name).cast("double")
    clients, vendors = kpis.top_unpaid_clients(firm, filters, 1), kpis.top_unpaid_vendors(firm, filters, 1)
    parts = [
        _row(kpis.exec_revenue(firm, filters), "admin", 0, "Revenue", c("rev_b"), billions, None, True),
        _row(kpis.exec_margin(firm, filters), "admin", 1, "Project margin", c("cur_pct"), kpi_text.percent_text, c("prior_pct"), True),
        _row(kpis.exec_revenue_per_partner(firm, filters), "admin", 2, "Revenue per partner", c("cur_m"), millions, c("yoy_m"), True),
        _row(kpis.exec_expenses(firm, filters), "admin", 3, "Expenses", c("exp_m"), millions, c("budget_m"), False),
        _row(kpis.dso_from_snapshots(firm, filters), "finance", 0, "DSO", c("current_dso"), kpi_text.days_text, c("prior_dso"), False),
        _row(kpis.dpo_days(firm, filters), "finance", 1, "DPO", c("dpo"), kpi_text.days_text, c("prior_dpo"), True),
        _row(clients, "finance", 2, "Top unpaid client", c("total_m"), millions, None, False),
        _row(vendors, "finance", 3, "Top unpaid vendor", c("total_m"), millions, None, False),
        _row(kpis.utilization_mom(firm, filters), "hr", 0, "Utilization", c("cur_pct"), kpi_text.percent_text, c("prior_pct"), True),
        _row(kpis.partner_change(firm, filters), "hr", 1, "Partners", d("cur"), count("partners"), d("prior"), True),
        _row(kpis.bench_cost_mom(firm, filters), "hr", 2, "Bench cost", c("cur_m"), millions, c("prior_m"), False),
        _row(kpis.low_utilization(firm, filters), "hr", 3, "Low utilization", d("cur"), count("employees"), d("prior"), False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup(requests: DataFrame, insights: DataFrame) -> DataFrame:
    """Rows of the asked slice, or the firmwide rows where that slice has none.

    ``requests``: request_id, persona, filter_axis, filter_value.
    """
    keys = ["persona", "filter_axis", "filter_value"]
    known = insights.select(*keys).distinct()
    served = requests.join(known.withColumn("_known", F.lit(True)), keys, "left")
    hit = F.coalesce("_known", F.lit(False))
    resolved = served.select("request_id", "persona", *[F.when(hit, F.col(k)).otherwise(F.lit(v)).alias(k) for k, v in FIRMWIDE.items()])
    return resolved.join(insights, keys)


def latest_per(df: DataFrame, key: list[str], value: str, stamp: str) -> DataFrame:
    """Newest value of each key; of equal stamps the larger value."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(stamp, value)).alias(value), F.max(stamp).alias(stamp))


def children(df: DataFrame, key: list[str], slot: str, parent: str, take: list[str]) -> DataFrame:
    """Each row that has a parent, with the parent's columns."""
    up = df.select(*key, F.col(slot).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in take])
    return df.where(F.col(parent).isNotNull()).join(up, [*key, parent])


def insight_table(firm: Firm) -> DataFrame:
    """The store with its full fixed schema: an empty shell, the KPI rows of the last complete month, and slice columns
    back-filled to the whole firm where a writer left them out."""
    stamp = F.lit(firm.as_of).cast("timestamp")
    rows = kpi_insights(firm).withColumn("last_refreshed", stamp).withColumn("fiscal_period_anchor", F.lit(firm.periods.month(1)))
    return backfill(add_columns(empty_shell(firm.spark, nullable(SCHEMA)), rows), FIRMWIDE)


def version(insights: DataFrame) -> DataFrame:
    """Newest refresh: what a reader compares to know whether its copy is stale."""
    return insights.agg(F.max("last_refreshed").alias("version"))
