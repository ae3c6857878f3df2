"""Registered queries over the directory's tables, and their SQL."""

from waymark.plans import content, guides, lifecycle, linking, more, records, site  # noqa: F401
from waymark.plans.registry import ORACLE, QUERIES  # noqa: F401
