"""Query registry: name -> (Spark plan, DuckDB oracle SQL or None).

Plans are registered with the ``query`` decorator next to their oracle, so
the pair is reviewed together. Every plan reads the driver's tables (through
the views in ``agora.sources.tables``) in full.
"""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: str


REGISTRY: dict[str, Query] = {}
load_errors: dict[str, Exception] = {}


def query(name: str, operators: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, operators)
        return fn
    return deco


MODULES = ("analytics", "clustering", "ingestion", "learned", "modelling", "streams", "textops")


def load_all() -> dict[str, Query]:
    """Import the catalogue modules, which registers their queries.

    A module that cannot be imported loses its own queries only; it is
    reported, and ``load_errors`` keeps it for the tests.
    """
    for name in MODULES:
        if name in load_errors:
            continue
        try:
            importlib.import_module(f"agora.plans.{name}")
        except Exception as e:  # noqa: BLE001
            load_errors[name] = e
            warnings.warn(f"agora.plans.{name} is left out: {e!r}", stacklevel=2)
    return REGISTRY
