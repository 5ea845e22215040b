"""Imports every module that registers queries."""

from gleanery.plans import queries_answers, queries_index, queries_planning, queries_runs, queries_search, queries_text  # noqa: F401
from gleanery.plans.registry import QUERIES, SQL  # noqa: F401
