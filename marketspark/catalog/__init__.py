"""Named queries over the given tables."""

from importlib import import_module

from marketspark.catalog import registry

_MODULES = ("functions", "joins", "aggregates", "windows", "prices", "actions", "research", "shares", "sources", "rebuild")


def load() -> None:
    """Import every module that registers queries and assemble their SQL checks."""
    for name in _MODULES:
        import_module(f"marketspark.catalog.{name}")
    registry.finish()
