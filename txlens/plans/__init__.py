"""Registered queries. Importing a module registers its keys."""

from txlens.plans import journal_queries, label_queries, landing_queries, metric_queries, model_queries, pool_queries, stream_queries, training_queries, truth_queries  # noqa: F401
from txlens.plans.registry import ORACLES, QUERIES  # noqa: F401
