"""Every registered query."""

from framesift.plans import culling, images, marks, streams, suggesting  # noqa: F401
from framesift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
