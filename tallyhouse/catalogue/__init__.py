"""All registered queries."""

from tallyhouse.catalogue.registry import REGISTERED, Query


def registered() -> dict[str, Query]:
    from tallyhouse.catalogue import claims_queries, curated_queries, kpi_queries, quality_queries, relational_queries, row_queries, semantic_queries, store_queries, tables  # noqa: F401

    return REGISTERED
