"""Imports every query module so that the registry is complete."""

from seqforge.plans import q_clean, q_corpus, q_masking, q_metrics, q_relate, q_sources, q_splits, q_stream_sql, q_vectors  # noqa: F401
from seqforge.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
