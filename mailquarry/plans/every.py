"""All registered queries of the library, with their SQL."""

from mailquarry.plans import mail_queries, rule_queries, text_queries  # noqa: F401  these register theirs
from mailquarry.plans.table_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
