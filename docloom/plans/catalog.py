"""All queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from docloom.plans import artifacts_q, html_q, jobs_q, markdown_q, pages_q, search_q, store_q  # noqa: F401  each registers its queries
from docloom.plans.registry import ORACLES, QUERIES  # noqa: F401
