"""tallybook: payment reconciliation and settlement as Spark jobs."""

from .operators.classify import reconcile, reconcile_summary, summarize
from .rules import Rules
from .session import build_session

__all__ = ["Rules", "build_session", "reconcile", "reconcile_summary", "summarize"]
