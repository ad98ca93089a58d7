"""Name → (query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(tune(spark), sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def load_all() -> None:
    from . import clusters, factors, logs, profiles, recommendations, texts  # noqa: F401
