"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = [
    "sources",
    "prompts",
    "align",
    "extract",
    "exact",
    "overlap",
    "samples",
    "slices",
    "judge",
    "ratings",
    "retrieve",
    "sequences",
    "leaderboard",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"evalmill.plans.{name}_plans")
