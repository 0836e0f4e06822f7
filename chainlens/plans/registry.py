"""Named query registry: each entry builds a DataFrame from the driver tables and,
where the computation is expressible in SQL, carries the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chainlens.plans.oracle_mapping import with_mapping


@dataclass
class Query:
    name: str
    build: Callable  # (Tables) -> DataFrame
    sql: str | None = None
    ctes: dict = field(default_factory=dict)
    needs_spark: bool = False  # build takes (spark, Tables)

    def oracle(self) -> str | None:
        return with_mapping(self.sql, self.ctes) if self.sql else None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ctes: dict | None = None, needs_spark: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, dict(ctes or {}), needs_spark)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build query ``name`` over the driver tables in ``sf_dir``.  The derived domain
    tables that it reads are built once per input snapshot (see ``sources.materialize``)."""
    from chainlens.sources.materialize import materialized_domain
    q = REGISTRY[name]
    t = materialized_domain(spark, sf_dir)
    return q.build(spark, t) if q.needs_spark else q.build(t)
