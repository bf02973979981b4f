"""Order-dependent reductions that never sort one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .shared import materialise


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    # the whole row breaks ties, so the answer does not depend on partitioning
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key. A map-side reduction, not a window sort."""
    return _pick(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of each key."""
    return _pick(df, keys, order, F.max_by)


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", start: int = 1) -> DataFrame:
    """Number rows ``start``.. in ``order``, which should be unique.

    Rows are sorted into ranges and written; a row's number is its place in its range plus
    the rows of the ranges before it, a prefix sum over one row per range. No window sees rows.
    """
    place = F.monotonically_increasing_id()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", place)
    laid = materialise(laid, "ranges").withColumn("_range", F.shiftright("_at", 33))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return laid.join(offsets, "_range").withColumn(out, (F.col("_off") + within + F.lit(start)).cast("long")) \
        .drop("_at", "_range", "_off")


#: Hex digits of the drawing hash counted at a time, and rows left over that may be sorted together.
_DIGITS, _REST = 4, 4096


def sample_n(df: DataFrame, n: int | None, key: str, seed: int) -> DataFrame:
    """Seeded sample without replacement of exactly ``n`` rows, in key order.

    The draw depends only on (seed, key), never on partitioning. ``None`` keeps all. The
    rows with the ``n`` smallest hashes are found by counting hash prefixes: whole prefixes are
    kept by a filter, and only the few rows of the last one are sorted, so the sample itself
    never meets in one task.
    """
    if n is None:
        return df.orderBy(key)
    tagged = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    whole, need, edge = F.lit(False), n, ""
    for length in range(_DIGITS, 33, _DIGITS):
        prefix = F.substring("_draw", 1, length)
        here = tagged.filter(F.startswith("_draw", F.lit(edge)))
        counts = here.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        # a prefix per row at most, 16^digits of them
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        hit = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
            .filter((F.col("_off") < need) & (F.col("_off") + F.col("_n") >= need)).first()
        if hit is None:  # fewer rows than asked for
            return df.orderBy(key)
        whole = whole | (F.startswith("_draw", F.lit(edge)) & (prefix < hit["_p"]))
        need, edge = need - hit["_off"], hit["_p"]
        if hit["_n"] <= _REST or hit["_n"] == need:
            break
    rest = tagged.filter(F.startswith("_draw", F.lit(edge))).orderBy("_draw", key).limit(need)
    return tagged.filter(whole).union(rest).drop("_draw").orderBy(key)
