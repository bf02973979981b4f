"""Joins between a large fact table and a reduced side.

Which strategy runs is the engine's decision: it broadcasts below
``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions at run time
(``spark.sql.adaptive.skewJoin``). All a caller can add is an honest size. Catalyst
multiplies the sizes of joins and guesses those of aggregates, so a reduced side whose
estimate is too large to broadcast is written once and read back with its true one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .shared import materialise


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df``; file sizes where it is a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reduced(small: DataFrame) -> DataFrame:
    """``small``, written once where Catalyst's estimate alone would rule out a broadcast."""
    spark = small.sparkSession
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit = -1 if text.startswith("-") else int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))
    return small if estimated_bytes(small) <= limit else materialise(small, "reduced")


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               written: bool = False) -> DataFrame:
    """Equi join of a fact table with a reduced table.

    Pass ``written=True`` when ``small`` already is a stored table, so that no second
    copy is made.
    """
    return big.join(small if written else reduced(small), on, how)
