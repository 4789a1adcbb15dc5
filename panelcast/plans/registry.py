"""Named queries, each with the SQL that computes the same table."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelcast.functions.exprs import tidy

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for comparison across engines."""
    return df.select(
        *[
            tidy(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """The SQL twin of ``rounded`` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias or expr}"


def rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in columns)
