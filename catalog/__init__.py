"""Registered queries and the SQL they are checked against."""

import importlib

PARTS = ("profile_queries", "sample_queries", "drift_queries", "rater_queries", "model_queries", "source_queries")


def load() -> None:
    import importlib.util

    for part in PARTS:
        if importlib.util.find_spec(f"catalog.{part}"):
            importlib.import_module(f"catalog.{part}")
