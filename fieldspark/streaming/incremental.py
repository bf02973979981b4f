"""Incremental jobs: scene intake, monthly composites, work ledgers, running statistics.

State lives in a checkpoint beside the target table or in written partial sums, so a job
goes on where the last call ended. Every sink is idempotent per micro-batch: a retried batch
leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.scaling import band_std
from . import commits


def stream_table(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                 files_per_batch: int = 8) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern) \
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _run(stream: DataFrame, path: str, checkpoint: str | None, write: Callable[[DataFrame, str], None],
         mode: str = "append", after: Callable[[], None] | None = None) -> None:
    """Process what is available; ``write`` gets each micro-batch and the folder that is its own.

    The checkpoint lives beside the target unless given, so the next call goes on where this one
    ended. Folders carry the query's own id, so a query with a new checkpoint never replaces the
    output of an older one. A folder counts once its commit is in the table's log; a retried
    batch that is there already is left as it is.
    """
    spark, state = stream.sparkSession, checkpoint or f"{path.rstrip('/')}-checkpoint"

    def step(batch: DataFrame, batch_id: int) -> None:
        run = spark.read.schema("id string").json(f"{state}/metadata").first()["id"]
        folder = f"run={run}/batch={batch_id}"
        if not any((c.run, c.batch, c.kind) == (run, batch_id, "add") for c in commits.history(spark, path)):
            write(batch, folder)
            commits.commit(spark, path, "add", run, batch_id, folder)
        if after is not None:
            after()
    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows under ``path`` with their run and batch; none where nothing was written yet."""
    full = StructType([*schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def intake_scenes(stream: DataFrame, path: str, key: str = "id", checkpoint: str | None = None) -> DataFrame:
    """Add scenes not stored before to a table and return it.

    A scene is known by its id, however old. Ids of this checkpoint live in its keyed state
    (RocksDB, on disk), so a micro-batch looks up its own ids and never reads the table; only
    rows that other checkpoints stored are read, and there are none in the usual case.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, folder: str) -> None:
        run = folder.split("/")[0].split("=")[1]
        if any(c.run != run for c in commits.history(spark, path)):
            known = _stored(spark, path, stream.schema).filter(F.col("run") != run).select(key)
            batch = batch.join(known, key, "left_anti").select(*stream.columns)
        batch.write.mode("overwrite").parquet(f"{path}/{folder}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _run(stream.dropDuplicates([key]), path, checkpoint, write)
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return _stored(spark, path, stream.schema).drop("run", "batch")


def _committed(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{c.folder}" for c in commits.live(commits.history(spark, path))]


def compact_composite(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Replace the live partial sums by one folder; readers see the old ones or the new one."""
    done = commits.history(spark, path)
    if len(commits.live(done)) < 2:
        return
    folder = f"compact={done[-1].sequence:012d}"
    parts = spark.read.parquet(*_committed(spark, path))
    parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys]) \
        .write.mode("overwrite").parquet(f"{path}/{folder}")
    commits.commit(spark, path, "all", "", 0, folder)


def update_composite(stream: DataFrame, keys: Sequence[str], bands: Sequence[str], path: str,
                     checkpoint: str | None = None, compact_every: int = 64) -> None:
    """Add a stream of clear observations to a table of partial sums.

    Each micro-batch reduces to (sum, n) per key in a folder of its own, so a reopened month
    is just another partial, a retry does not count twice and a later call adds new files only.
    After ``compact_every`` folders they are merged into one, so readers meet that many at most.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, folder: str) -> None:
        batch.groupBy(*keys).agg(*[F.sum(b).alias(f"{b}_sum") for b in bands], F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(f"{path}/{folder}")

    def after() -> None:
        if len(commits.live(commits.history(spark, path))) > compact_every:
            compact_composite(spark, path, keys)
    _run(stream, path, checkpoint, write, after=after)


def read_composite(spark: SparkSession, path: str, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Current composite: means and observation counts over all partial sums."""
    return spark.read.parquet(*_committed(spark, path)).groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"{b}_sum"), F.sum("n")).alias(b) for b in bands],
        F.sum("n").cast("int").alias("OBS_COUNT"))


def record_done(units: DataFrame, path: str, settings: str, batch: str) -> None:
    """Append completed units under their settings; a retried batch replaces itself."""
    units.withColumn("settings", F.lit(settings)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def remaining_work(planned: DataFrame, ledger: DataFrame, keys: list[str], settings: str) -> DataFrame:
    """Planned units not yet done. A ledger made under other settings is refused."""
    if not ledger.filter(F.col("settings") != settings).isEmpty():
        raise ValueError("ledger was written under other settings; start a new one")
    return planned.join(ledger.select(*keys).distinct(), keys, "left_anti")


def running_band_statistics(stream: DataFrame, keys: Sequence[str], value: str, path: str,
                            checkpoint: str | None = None) -> DataFrame:
    """Count, mean and population spread per band, kept current over a stream and over calls.

    The state is one row per band, stored in the checkpoint; each trigger writes the complete
    result to its own folder, and that of the last commit is returned, whichever checkpoint
    it belongs to: after a start with a new checkpoint the answer is the new one.
    """
    stats = stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                      band_std(F.stddev_pop(value)).alias("std"))
    _run(stats, path, checkpoint, lambda batch, folder: batch.write.mode("overwrite").parquet(f"{path}/{folder}"),
         mode="complete")
    done = commits.history(stream.sparkSession, path)
    if not done:
        return stream.sparkSession.createDataFrame([], stats.schema)
    return stream.sparkSession.read.schema(stats.schema).parquet(f"{path}/{done[-1].folder}")
