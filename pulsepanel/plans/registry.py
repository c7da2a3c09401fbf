"""Query registry: a Spark plan, an output specification and, where it exists, SQL.

The specification lists output columns; ``name:6`` rounds to six digits,
``name:d`` writes a day as text and ``name:i`` widens to bigint.  Both engines
apply the same list.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.plans.oracle import sql_for


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = Query(build, spec, sql)
        return build

    return register


def output(token: str) -> Column:
    name, _, kind = token.partition(":")
    c = F.col(name)
    if not kind:
        return c
    if kind == "d":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    # Adding zero turns a rounded -0.0 into 0.0.
    return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QUERIES[name]
    return q.build(spark, sf_dir).select(*[output(t) for t in q.spec.split()])


def oracle(name: str) -> str | None:
    q = QUERIES[name]
    return sql_for(q.sql, q.spec) if q.sql else None
