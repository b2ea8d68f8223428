"""All registered queries of the library, but for those of the optional package."""

from __future__ import annotations

from caseloom.plans import lifecycles, models, records, relational, reporting, retrieval, texts  # noqa: F401  they register their queries
from caseloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
