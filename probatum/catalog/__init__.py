"""Runnable queries over the given tables, one module per group of operators."""

from importlib import import_module

MODULES = ["vectors", "search", "lexemes", "fusion", "cleaning", "segmentation", "chunking", "tagging", "gating", "graph", "evidence",
           "analytics", "stateful", "evaluation", "quality", "conversation", "stores", "streams",
           "plans"]


def load() -> None:
    """Import every module so that its queries register themselves."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
