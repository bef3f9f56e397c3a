"""All queries of the library and their SQL."""

from leafmill.plans import edit_queries, lint_queries, run_queries, source_queries, structure_queries, template_queries, text_queries  # noqa: F401
from leafmill.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
