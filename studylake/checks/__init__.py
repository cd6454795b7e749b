"""Registered queries: each takes a data folder's tables and returns a DataFrame."""

from importlib import import_module
from pathlib import Path


def load() -> None:
    """Imports every query module, which fills the registry."""
    for path in sorted(Path(__file__).parent.glob("queries_*.py")):
        import_module(f"{__name__}.{path.stem}")
