"""Incremental jobs driven to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.plans import shared_path
from fieldspark.sources.sinks import fingerprint
from fieldspark.streaming import incremental

from . import fixtures as fx
from .registry import R, check, rounded


def _deliver(spark, d, folder, parts):
    """Add some thirds of the events, cut across time, to a landing folder: four files each."""
    events = fx.table(spark, d, "events")
    for k in parts:
        events.filter(F.col("event_id") % 3 == k).repartition(4).write.mode("append").parquet(folder)


def _event_stream(spark, d, folder):
    schema = fx.table(spark, d, "events").schema
    s = incremental.stream_table(spark, folder, schema, files_per_batch=4)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_two_calls(spark, d, job):
    """Run a job over two files, then again, with a fresh query, after a third has come."""
    folder = shared_path(spark, "landing")
    _deliver(spark, d, folder, (2, 0))
    job(_event_stream(spark, d, folder))
    _deliver(spark, d, folder, (1,))
    return job(_event_stream(spark, d, folder))


@check("I01_scene_intake", "SELECT DISTINCT 'scene_' || CAST(event_id // 3 AS VARCHAR) AS id FROM events")
def i01(spark, d):
    path = shared_path(spark, "scenes")
    return _in_two_calls(spark, d, lambda s: incremental.intake_scenes(s.select(
        F.concat(F.lit("scene_"), F.expr("event_id div 3").cast("string")).alias("id"), "ts"), path)).select("id")


_OBS = "SELECT CAST(date_trunc('month', ts) AS DATE) AS mth, user_id % 8 AS tile, event_id % 64 AS px, value FROM events WHERE event_type <> 'error'"


@check("I02_incremental_composite", f"SELECT CAST(mth AS VARCHAR) AS month, tile, px, {R('avg(value)')} AS value, CAST(count(*) AS INTEGER) AS OBS_COUNT FROM ({_OBS}) GROUP BY 1, 2, 3")
def i02(spark, d):
    path, keys = shared_path(spark, "composite"), ["month", "tile", "px"]

    def job(s):
        clear = s.filter("event_type <> 'error'").select(
            F.date_trunc("month", "ts").cast("date").cast("string").alias("month"), (F.col("user_id") % 8).alias("tile"),
            (F.col("event_id") % 64).alias("px"), "value")
        incremental.update_composite(clear, keys, ["value"], path, compact_every=2)
    _in_two_calls(spark, d, job)
    return rounded(incremental.read_composite(spark, path, keys, ["value"]), "value")


@check("I03_work_ledger", "SELECT o_orderkey AS unit FROM orders WHERE o_orderstatus = 'P'")
def i03(spark, d):
    units = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), "o_orderstatus")
    path, settings = shared_path(spark, "ledger"), fingerprint({"chip": 224, "min_crop_fraction": 0.05})
    for status in ("F", "O"):
        incremental.record_done(units.filter(F.col("o_orderstatus") == status).select("unit"), path, settings, status)
    return incremental.remaining_work(units.select("unit"), spark.read.parquet(path), ["unit"], settings)


@check("I04_running_band_statistics", f"SELECT event_type AS band, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM events GROUP BY 1")
def i04(spark, d):
    path = shared_path(spark, "bands")
    return rounded(_in_two_calls(spark, d, lambda s: incremental.running_band_statistics(
        s.select(F.col("event_type").alias("band"), "value"), ["band"], "value", path)), "mean", "std")


@check("I04b_new_checkpoint", f"SELECT event_type AS band, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM events WHERE event_id % 3 = 1 GROUP BY 1")
def i04b(spark, d):
    """Statistics started anew beside older, longer ones answer for the new run."""
    path = shared_path(spark, "bands")

    def job(parts, state):
        folder = shared_path(spark, "landing")
        for k in parts:
            _deliver(spark, d, folder, (k,))
        s = _event_stream(spark, d, folder).select(F.col("event_type").alias("band"), "value")
        return incremental.running_band_statistics(s, ["band"], "value", path, shared_path(spark, state))
    job((2, 0), "first")
    return rounded(job((1,), "second"), "mean", "std")


@check("I01b_intake_two_checkpoints", "SELECT DISTINCT 'scene_' || CAST(event_id // 3 AS VARCHAR) AS id FROM events WHERE event_id % 3 <> 1 OR event_id % 2 = 0")
def i01b(spark, d):
    """A table filled by one checkpoint and continued by another keeps one row per id."""
    path = shared_path(spark, "scenes")
    for parts, state in (((2, 0), "first"), ((0, 1), "second")):
        folder = shared_path(spark, "landing")
        _deliver(spark, d, folder, parts)
        s = _event_stream(spark, d, folder).filter("event_id % 3 <> 1 OR event_id % 2 = 0")
        out = incremental.intake_scenes(s.select(F.concat(F.lit("scene_"), F.expr("event_id div 3").cast("string")).alias("id"), "ts"),
                                        path, checkpoint=shared_path(spark, state))
    return out.select("id")
