"""All catalog queries (importing the modules registers them)."""

from quarry.plans import q_changes, q_context, q_filters, q_gather, q_stats, q_render, q_store, q_streaming, q_text, q_vectors  # noqa: F401
from quarry.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
