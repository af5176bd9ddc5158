"""Stream output as batch folders.

A micro-batch overwrites the folder named after its id, so a batch that is retried after a
failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

BATCH = "batch"
PARTITIONS = "spark.sql.shuffle.partitions"


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts the stream with a state partition per core, or fewer where the session says so.

    A state writes files for each partition and batch, be it empty or not, and AQE doesn't coalesce them: with some hundreds
    they take longer than the rows. The number holds for the life of the checkpoint.
    """
    usual = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(usual), max(1, spark.sparkContext.defaultParallelism))))
    try:
        return writer.start()  # takes its own copy of the settings
    finally:
        spark.conf.set(PARTITIONS, usual)


def write_batches(
    stream: DataFrame,
    path: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Start the stream. Without a trigger it takes what is there and stops."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform else df
        out.write.mode("overwrite").parquet(f"{path}/data/{BATCH}={batch_id}")

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
    )
    return started(writer, stream.sparkSession)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.parquet(f"{path}/data").drop(BATCH)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key, for streams that write updates."""
    rows = spark.read.parquet(f"{path}/data")
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("row"))
    return newest.select(*keys, "row.*")


def drain(stream: DataFrame, path: str, transform=None, mode: str = "append") -> None:
    """Run the stream over everything available and wait for the end."""
    write_batches(stream, path, transform, mode).awaitTermination()
