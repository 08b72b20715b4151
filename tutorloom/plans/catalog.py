"""Importing this module registers every query."""

from tutorloom.plans import q_documents, q_lists, q_reports, q_study, q_tables, q_topics  # noqa: F401
from tutorloom.plans.registry import ORACLES, QUERIES  # noqa: F401
