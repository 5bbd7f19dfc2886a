"""Named queries over the supplied tables."""

from importlib import import_module

MODULES = ("metrics", "pilot", "graph", "shapes", "relational", "similarity", "documents", "governance", "audit", "sources", "streaming",
           )


def load_all() -> None:
    """Import every module of named queries once."""
    for name in MODULES:
        import_module(f"quadrille.plans.{name}_queries")
