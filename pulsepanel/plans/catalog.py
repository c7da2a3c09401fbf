"""All registered queries."""

from pulsepanel.plans import queries_events, queries_index, queries_io, queries_panel, queries_scale, queries_stats  # noqa: F401
from pulsepanel.plans.registry import QUERIES, oracle, run  # noqa: F401
