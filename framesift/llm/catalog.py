"""Every query of this subpackage."""

from framesift.llm import queries  # noqa: F401
from framesift.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
