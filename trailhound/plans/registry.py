"""Where queries and their check SQL are registered by ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailhound.plans.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` names the derived views its check SQL starts from."""

    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle)
        return function

    return register
