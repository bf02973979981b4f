"""Skew-proof plan helpers agree with the plain plans they replace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.plans import dense_index, first_by, grouped_percentiles, last_by, sample_n, sized_join


def skewed(spark, n=6000):
    """Two thirds of all rows share one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
                                 "id", (F.sin(F.col("id")) * 100).alias("v"), (F.col("id") % 7).cast("double").alias("w"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sized_join_takes_maps_and_key_only_tables(spark):
    """The same rows whether the small side is broadcast or shuffled."""
    big = skewed(spark).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    small = spark.range(40).select((F.col("id") % 20).alias("k"), (F.col("id") % 20 * 2).alias("x")).distinct()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for how in ("inner", "left", "left_semi", "left_anti"):
        near = rows(sized_join(big, small, ["k"], how).select("id"))
        keys = rows(sized_join(big.select("k"), small, ["k"], how).select("k"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            far = sized_join(big, small, ["k"], how)
            assert "BroadcastHashJoin" not in far._jdf.queryExecution().executedPlan().toString()
            assert rows(far.select("id")) == near == rows(big.join(small, "k", how).select("id"))
            assert rows(sized_join(big.select("k"), small, ["k"], how).select("k")) == keys
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_hot_group_among_many_small_ones(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 10000).cast("long").alias("k"), (F.sin("id") * 9).alias("v"))
    got = grouped_percentiles(df, ["k"], {"m": ("v", .3)}, also=[F.count(F.lit(1)).alias("n")])
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(.3)).alias("m"))
    both = got.toPandas().sort_values("k").reset_index(drop=True), want.toPandas().sort_values("k").reset_index(drop=True)
    assert np.allclose(both[0].fillna(-1), both[1].fillna(-1)[both[0].columns])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from fieldspark.plans import shared_dir
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_percentiles_by_digits_are_exact(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    wanted = {"p25": ("v", .25), "med": ("v", .5), "p98": ("v", .98), "wmed": ("w", .5)}
    a = grouped_percentiles(df, ["k"], wanted, bounded=True).orderBy("k").toPandas()
    b = grouped_percentiles(df, ["k"], wanted).orderBy("k").toPandas()
    pdf = df.toPandas()
    for _, row in b.iterrows():
        g = pdf[pdf.k == row["k"]]
        assert np.isclose(row["p25"], np.nanpercentile(g.v, 25)) and np.isclose(row["med"], np.nanpercentile(g.v, 50))
        assert np.isclose(row["p98"], np.nanpercentile(g.v, 98)) and np.isclose(row["wmed"], np.median(g.w))
    assert np.allclose(a.values.astype(float), b[a.columns].values.astype(float))


def test_percentiles_by_digits_without_keys_and_with_constant_values(spark):
    df = spark.range(1000).select(F.lit(5.0).alias("c"), F.col("id").cast("double").alias("v"))
    got = grouped_percentiles(df, [], {"c": ("c", .5), "v": ("v", .37)}).first()
    assert got["c"] == 5.0 and np.isclose(got["v"], np.percentile(np.arange(1000), 37))


def test_percentile_of_a_group_without_values_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None)], "k int, v double")
    got = {r["k"]: r["m"] for r in grouped_percentiles(df, ["k"], {"m": ("v", .5)}).collect()}
    assert got == {1: 3.0, 2: None}


def test_first_and_last_do_not_depend_on_partitioning(spark):
    df = skewed(spark).select("k", (F.col("id") % 10).alias("seq"), "v")
    for pick in (first_by, last_by):
        assert rows(pick(df.repartition(1), ["k"], ["seq"])) == rows(pick(df.repartition(13), ["k"], ["seq"]))


def test_dense_index_is_gapless_and_ordered(spark):
    df = spark.range(500).select(F.lpad((F.col("id") * 37 % 1000).cast("string"), 5, "0").alias("g")).distinct()
    got = dense_index(df, ["g"], "i").orderBy("g").collect()
    assert [r["i"] for r in got] == list(range(1, len(got) + 1))


def test_sample_is_exact_sorted_and_repeatable(spark):
    df = spark.range(2000)
    a = [r["id"] for r in sample_n(df, 250, "id", 7).collect()]
    assert len(set(a)) == 250 and a == sorted(a)
    assert a == [r["id"] for r in sample_n(df.repartition(11), 250, "id", 7).collect()]
    assert a != [r["id"] for r in sample_n(df, 250, "id", 8).collect()]
    assert sample_n(df, None, "id", 7).count() == sample_n(df, 5000, "id", 7).count() == 2000


def test_order_keys_keep_the_order_of_doubles(spark):
    import struct

    from fieldspark.plans.quantiles import order_key
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal(300), 10.0 ** rng.uniform(-320, 308, 600) * rng.choice([-1, 1], 600),
                        [2.0 ** e for e in range(-1074, 1024, 7)], [np.nextafter(2.0 ** e, 0) for e in range(-1020, 1024, 9)],
                        [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, np.inf, -np.inf]])
    got = [r["k"] for r in spark.createDataFrame([(float(x),) for x in v], "v double").select(order_key(F.col("v")).alias("k")).collect()]
    bits = [struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1) for x in v.tolist()]
    assert got == bits


def test_percentiles_never_sort_or_buffer_a_group(spark):
    df = skewed(spark)
    text = grouped_percentiles(df, ["k"], {"m": ("v", .5)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_sample_of_many_rows_needs_no_single_task(spark):
    df = spark.range(50000)
    got = sample_n(df, 20000, "id", 3)
    assert got.count() == 20000 and got.distinct().count() == 20000
    draw = F.md5(F.concat_ws("|", F.lit("3"), F.col("id").cast("string")))
    assert rows(got) == rows(df.orderBy(draw, "id").limit(20000))
