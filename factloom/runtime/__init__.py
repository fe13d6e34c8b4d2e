"""Pipelines of DataFrame stages, registries of what extends them, plans of work that can be taken up again."""
