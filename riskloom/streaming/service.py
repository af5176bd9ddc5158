"""Applications in, decisions and reasons out, continuously.

A micro-batch writes three folders named after its id: decisions, quarantined messages and, last, one row about
the batch. Readers take only batches whose last row stands, so what was decided and what was refused appear
together; a batch that is retried replaces its own folders.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality
from .sinks import BATCH

DECISIONS, QUARANTINE, BATCHES = "decisions", "quarantine", "batches"
MESSAGE, BROKEN = "message", "_broken"


def parsed(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The fields of every message beside its text. ``_broken`` holds what is no JSON of that schema."""
    options = {"columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE"}
    fields = F.from_json(column, f"{schema}, {BROKEN} string", options)
    held = messages.select(F.col(column).alias(MESSAGE), fields.alias("a")).select(MESSAGE, "a.*")
    unread = F.when(F.col(MESSAGE).isNull() | (F.trim(MESSAGE) == ""), F.coalesce(MESSAGE, F.lit("")))
    return held.withColumn(BROKEN, F.coalesce(BROKEN, unread))


def judged(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed messages with the names of the rules they break; ``message`` alone for those that could not be read."""
    rows = quality.with_violations(parsed(messages, schema, column), quality.application_rules())
    unread = F.col(BROKEN).isNotNull()
    return rows.withColumn("violations", F.when(unread, F.array(F.lit(MESSAGE))).otherwise(F.col("violations")))


def decide_stream(
    messages: DataFrame,
    schema: str,
    decide: Callable[[DataFrame], DataFrame],
    path: str,
    column: str = "value",
    key: str = "application_id",
    **trigger,
) -> StreamingQuery:
    """Start the service. ``decide`` is the batch function: valid applications to replies.

    Messages are parsed and judged once per micro-batch. A message that comes twice is decided twice, with the
    same outcome. Without a trigger the stream takes what is there and stops.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        started = time.perf_counter()
        rows = judged(df, schema, column).persist(StorageLevel.MEMORY_AND_DISK)
        valid = F.size("violations") == 0
        try:
            replies = decide(rows.where(valid).drop(MESSAGE, BROKEN, "violations"))
            known = F.when(F.col(BROKEN).isNull(), F.col(key)).alias(key)
            refused = rows.where(~valid).select(known, MESSAGE, "violations")
            replies.write.mode("overwrite").parquet(f"{path}/{DECISIONS}/{BATCH}={batch_id}")
            refused.write.mode("overwrite").parquet(f"{path}/{QUARANTINE}/{BATCH}={batch_id}")
            spent = round((time.perf_counter() - started) * 1000, 2)
            about = rows.agg(F.count(F.lit(1)).alias("received"), F.count_if(valid).alias("total_processed"))
            about = about.withColumn("processing_time_ms", F.lit(spent))
            about.write.mode("overwrite").parquet(f"{path}/{BATCHES}/{BATCH}={batch_id}")
        finally:
            rows.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finished_batches(spark: SparkSession, path: str) -> DataFrame:
    """Per finished batch: its id, messages received, applications processed and time spent."""
    return spark.read.parquet(f"{path}/{BATCHES}")


def _finished(spark: SparkSession, path: str, part: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{part}")
    return rows.join(finished_batches(spark, path).select(BATCH), BATCH, "left_semi")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Replies of all finished batches."""
    return _finished(spark, path, DECISIONS)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Refused messages of all finished batches: key where it could be read, text, broken rules."""
    return _finished(spark, path, QUARANTINE)
