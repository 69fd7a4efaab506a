"""All registered queries. Importing this module fills :data:`codecorpus.plans.registry.QUERIES`."""

from codecorpus.plans import (  # noqa: F401
    q_accuracy, q_classify, q_compare, q_history, q_metrics, q_nesting, q_pairs, q_responses, q_routing, q_rules, q_sources, q_streams,
)
from codecorpus.plans.registry import ORACLES, QUERIES  # noqa: F401
