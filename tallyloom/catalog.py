"""Name to query, and name to oracle SQL, of the engine without its optional subpackage."""

from __future__ import annotations

from .operators import agents, conversations, corpus, digests, evaluation, groups, intervals, isolation, judging, packed, pairing, preferences, quantiles, reconcile, records, selection, tools, toolschemas, toolset  # noqa: F401  they register their queries
from .plans.registry import REGISTRY
from .streaming import deadlines, windows  # noqa: F401

FLAGSHIP = "leakage_free_split_report"


def queries() -> dict:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
