"""All queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from leadlake.plans import companies, documents, endpoints, events, facts, investigations, pages, services, streams, tables, verdicts  # noqa: F401  (they register their queries)
from leadlake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
