"""Plans of the engine."""

from importlib import import_module

MODULES = ("governance", "measures", "matching", "graphs", "feeds", "texts", "folds", "intake", "wording", "versions", "layout", "reviews")


def load() -> None:
    for name in MODULES:
        import_module(f"factloom.plans.{name}")
