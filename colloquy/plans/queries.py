"""All queries of the library."""

from colloquy.plans import catalogue, dialogue, speech, stored  # noqa: F401  (each registers its own)
from colloquy.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
