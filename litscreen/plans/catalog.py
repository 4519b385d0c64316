"""Every query module, imported so that its queries are registered."""

from litscreen.plans import articles, citations, models, payloads, runs, scores, splits, texts  # noqa: F401
from litscreen.plans.registry import ORACLES, QUERIES  # noqa: F401
