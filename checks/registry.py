"""Registry of queries and their SQL, and the shared rounding rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"query {name} registered twice")
        CHECKS[name] = Check(fn, sql)
        return fn
    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded value; the small offset keeps decimal ties from rounding two ways."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double") + F.lit(3.0 * 10.0 ** -(digits + 4)), digits)


def R(expr: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(round(CAST({expr} AS DOUBLE) + 3e-{digits + 4}, {digits}) + 0.0)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
