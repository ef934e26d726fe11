"""Queries bound to concrete tables, grouped like the operator inventory."""

from importlib import import_module

from pandekt.plans.registry import ORACLES, QUERIES

MODULES = ("sources", "structure", "understanding", "retrieval", "graph", "answers", "evaluation", "curation", "streams")


def load_all():
    """Import every plan module once; return (queries, oracles)."""
    for m in MODULES:
        import_module(f"pandekt.plans.{m}")
    return QUERIES, ORACLES
