"""Exact, linearly interpolated percentiles per group by radix selection.

Values get a 64-bit key that keeps their order (the bits of the double, by arithmetic, so that
it stays in generated code). Rows are counted per group and first digit; only those whose
digit holds a wanted position go on, reduced to (key, count), to the next digits. Every step
is a hash aggregate with map-side reduction, the plan is the same for small groups and
large ones, and no task buffers the values of a group: what is ranked together are the
digits of one group, 2^24 at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import materialise

#: Bits below the first and the second digit.
_LOW1, _LOW2 = 48, 24


def order_key(value: Column) -> Column:
    """A long with the order of a double: -inf < ... < -0.0 = 0.0 < ... < inf < NaN."""
    v = F.abs(value.cast("double"))
    guess = F.floor(F.log2(v))
    power = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= v, 1).when(F.pow(F.lit(2.0), guess) > v, -1).otherwise(0)
    normal = ((power + 1023) * F.lit(1 << 52) + ((v * F.pow(F.lit(2.0), -power) - 1) * F.lit(2.0 ** 52)).cast("long"))
    bits = F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(v == float("inf"), F.lit(2047 << 52)) \
        .when(v < 2.0 ** -1022, (v * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits).cast("long")


def _placed(counted: DataFrame, group: list[str], by: str, asks: DataFrame, digit: str) -> DataFrame:
    """Asks (group, _out, _rank, _w) with the digit that holds their rank, counted from its start."""
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    laid = counted.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = laid.join(asks, group).filter((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_n")))
    return hit.select(*group, F.col(by).alias(digit), "_out", (F.col("_rank") - F.col("_off")).alias("_rank"), "_w",
                      *[c for c in counted.columns if c == "_v"])


def grouped_percentiles(df: DataFrame, keys: Sequence[str],
                        wanted: Mapping[str, tuple[str, float]],
                        also: Sequence[Column] = (), bounded: bool = False) -> DataFrame:
    """One row per group with ``wanted[out] = (value column, fraction)``.

    NULL values are ignored; a group without values has NULL percentiles. ``also`` are
    further aggregates of ``df``. ``bounded`` says that groups are small by construction,
    such as one row per scene and pixel; then the built-in aggregate holds their values.
    """
    keys, also = list(keys), list(also)
    if bounded:
        return df.groupBy(*keys).agg(*also, *[F.percentile(F.col(c), F.lit(p)).alias(out) for out, (c, p) in wanted.items()])
    # a NULL key is a key like any other inside a struct
    tag = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("_one"))
    columns = sorted({c for c, _ in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    if len(columns) == 1:
        long = df.select(tag.alias("_g"), F.lit(0).alias("_c"), F.col(columns[0]).cast("double").alias("_v"))
    else:
        long = df.select(tag.alias("_g"), F.explode(pairs).alias("_e")).select("_g", "_e._c", "_e._v")
    long = long.filter(F.col("_v").isNotNull()).withColumn("_k", order_key(F.col("_v"))) \
        .withColumn("_d", F.shiftright("_k", _LOW1))
    group = ["_g", "_c"]

    first = materialise(long.groupBy(*group, "_d").agg(F.count(F.lit(1)).alias("_n")), "first_digits")
    numbers = {c: i for i, c in enumerate(columns)}
    specs = F.array(*[F.struct(F.lit(out).alias("_out"), F.lit(numbers[c]).alias("_of"), F.lit(float(p)).alias("_p"))
                      for out, (c, p) in wanted.items()])
    asks = first.groupBy(*group).agg(F.sum("_n").alias("_total")).select(*group, "_total", F.explode(specs).alias("_a")) \
        .filter(F.col("_a._of") == F.col("_c")).withColumn("_pos", F.col("_a._p") * (F.col("_total") - 1))
    low, part = F.floor("_pos"), F.col("_pos") - F.floor("_pos")
    asks = asks.select(*group, F.col("_a._out").alias("_out"), F.explode(F.array(
        F.struct(low.alias("_rank"), (1 - part).alias("_w")),
        F.struct((low + 1).alias("_rank"), part.alias("_w")))).alias("_s")) \
        .select(*group, "_out", "_s._rank", "_s._w").filter("_w > 0")
    one = materialise(_placed(first, group, "_d", asks, "_d"), "first_targets")

    left = long.join(one.select(*group, "_d").distinct(), [*group, "_d"]).groupBy(*group, "_d", "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_v"))
    left = materialise(left.withColumn("_e", F.shiftright("_k", _LOW2)), "remaining_values")
    second = left.groupBy(*group, "_d", "_e").agg(F.sum("_n").alias("_n"))
    two = _placed(second, [*group, "_d"], "_e", one, "_e").drop("_d")
    last = left.join(two.select(*group, "_e").distinct(), [*group, "_e"]).select(*group, "_e", "_k", "_n", "_v")
    three = _placed(last, [*group, "_e"], "_k", two, "_key")

    found = three.groupBy("_g").agg(*[F.sum(F.when(F.col("_out") == out, F.col("_w") * F.col("_v"))).alias(out) for out in wanted])
    base = df.groupBy(*keys).agg(*(also or [F.count(F.lit(1)).alias("_rows")])).withColumn("_g", tag)
    out = base.join(found, "_g", "left")
    return out.select(*keys, *[c for c in base.columns if c not in (*keys, "_g", "_rows")], *wanted)
