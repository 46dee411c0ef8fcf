"""Query registry: a Spark query and the SQL that must give the same rows, side by side."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strata.plans.entities import Entities
from strata.session import tune

FAMILIES = [
    "gold", "serving", "cleaning", "quality", "metadata", "windows", "monitoring", "recommend", "table_ops", "roundtrips",
]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``fn(entities) -> DataFrame`` under its own name.

    """

    def register(fn: Callable[[Entities], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Entities(tune(spark), sf_dir))

        REGISTRY[fn.__name__] = Query(fn.__name__, tuple(covers.split()), run, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"strata.queries.{family}")
    return REGISTRY
