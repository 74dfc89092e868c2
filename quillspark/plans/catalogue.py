"""All queries of the core."""

from quillspark.plans import answers, corpus, evaluation, grounding, index, relational, retrieval  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
