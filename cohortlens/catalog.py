"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from cohortlens.plans import bindings, campaigns, evaluation, more, records, reporting
from cohortlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bindings", "campaigns", "evaluation", "more", "records", "reporting"]
