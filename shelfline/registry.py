"""All queries of the library itself."""

from .plans import advanced, boards, causal, commercial, decisions, evidence, learning, opportunities, roles, shopping, tree  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
