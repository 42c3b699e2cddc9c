"""Registered queries by family."""

from importlib import import_module

FAMILIES = ["sources", "extraction", "chunking", "description", "search", "keywords", "retrieval", "prompts", "screening", "usage", "triage", "tables", "streams"]


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
