"""Query plans: relational tools, derived domain tables and the registry."""

from importlib import import_module

MODULES = ("q_relational", "q_text", "q_chunk", "q_retrieval", "q_load", "q_more", "q_extra", "q_stream", "q_join", "q_quality", "q_proposals")


def load_all():
    """Import every query module; returns the query and oracle registries."""
    for name in MODULES:
        import_module(f"docmill.plans.{name}")
    from docmill.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
