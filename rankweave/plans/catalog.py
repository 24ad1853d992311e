"""Every registered query of the library with its SQL twin."""

from rankweave.plans import aligned_queries, build_queries, evaluation_queries, history_queries, hit_queries, live_queries, metric_queries, model_queries, prediction_queries, relative_queries, sample_queries, scenario_queries, scoring_queries, search_queries, source_queries, stream_queries, ticket_queries  # noqa: F401  they register themselves
from rankweave.plans.registry import ORACLE, QUERIES  # noqa: F401
