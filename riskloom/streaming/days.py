"""A table of days kept by a stream of updates.

Every micro-batch adds one piece, cut by day: ``data/piece=<name>/_day=<day>``. A manifest, written last, lists
the live pieces of every day. A day with many pieces is folded into one, and only days that a batch touched
are looked at. A read opens the live pieces of the days asked for and nothing else. Pieces and manifests are named after
the batch, so a batch that is retried replaces its own; what it wrote before the failure is in no manifest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .sinks import started

DAY, ORDER, VERSION = "_day", "_order", "version"
UNDATED = "undated"
COMPACT_AFTER = 8


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[str, list[str]]:
    """Live pieces by day, oldest first, in the newest version (older than ``before``).

    Days times at most ``compact_after`` names: a file listing, not data.
    """
    try:
        listed = spark.read.schema(f"day string, piece string, place int, {VERSION} long").parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if before is not None:
        listed = listed.where(F.col(VERSION) < before)
    newest = listed.agg(F.max(VERSION)).first()[0]
    live = defaultdict(list)
    if newest is not None:
        for row in sorted(listed.where(F.col(VERSION) == newest).collect(), key=lambda r: (r.day, r.place)):
            live[row.day].append(row.piece)
    return dict(live)


def _fold(rows: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    """One row per key: sums of the columns to add, or the row of the newest batch."""
    if add:
        return rows.groupBy(DAY, *keys).agg(*[F.sum(c).alias(c) for c in add], F.max(ORDER).alias(ORDER))
    values = [c for c in rows.columns if c not in (DAY, ORDER, *keys)]
    newest = F.max_by(F.struct(ORDER, *values), ORDER).alias("row")
    return rows.groupBy(DAY, *keys).agg(newest).select(DAY, *keys, "row.*")


def _read(spark: SparkSession, path: str, live: dict[str, list[str]], keys: list[str], add: list[str]) -> DataFrame:
    """Rows of the given days; days of several pieces are folded, days of one are read as they stand."""

    def opened(pieces: list[tuple[str, str]]) -> DataFrame:
        places = [f"{path}/data/piece={p}/{DAY}={d}" for d, p in pieces]
        found = spark.read.option("basePath", f"{path}/data").parquet(*places)
        return found.withColumn(DAY, F.col(DAY).cast("string")).drop("piece")

    whole = [(d, p[0]) for d, p in live.items() if len(p) == 1]
    cut = [(d, p) for d, pieces in live.items() if len(pieces) > 1 for p in pieces]
    parts = [opened(whole)] if whole else []
    if cut:
        parts.append(_fold(opened(cut), keys, add))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _write_piece(rows: DataFrame, path: str, piece: str) -> None:
    """Rebalanced by day: few files for a small day, several tasks for a large one."""
    out = rows.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
    out.parquet(f"{path}/data/piece={piece}")


def add_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    keys: list[str],
    day: Column,
    add: list[str] | None = None,
    compact_after: int = COMPACT_AFTER,
) -> None:
    """Take in one micro-batch; ``day`` must follow from the keys.

    A key stands once in a batch. The newest row of a key counts, or with ``add`` the sums of those columns.
    Rows without a day go to a partition of their own. An empty batch changes nothing.
    """
    spark, add = batch.sparkSession, add or []
    dated = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(UNDATED))
    rows = batch.withColumn(DAY, dated).withColumn(ORDER, F.lit(batch_id).cast("long"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touched = [r[0] for r in rows.select(DAY).distinct().collect()]
        if not touched:
            return
        live = _manifest(spark, path, before=batch_id)
        _write_piece(rows, path, f"b{batch_id}")
    finally:
        rows.unpersist()
    for d in touched:
        live[d] = [*live.get(d, []), f"b{batch_id}"]
    crowded = {d: live[d] for d in touched if len(live[d]) > compact_after}
    if crowded:
        _write_piece(_read(spark, path, crowded, keys, add), path, f"c{batch_id}")
        live.update({d: [f"c{batch_id}"] for d in crowded})
    listed = [(d, p, i) for d, pieces in live.items() for i, p in enumerate(pieces)]
    manifest = spark.createDataFrame(listed, "day string, piece string, place int").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/{VERSION}={batch_id}")


def write_days(
    stream: DataFrame,
    path: str,
    keys: list[str],
    day: Column,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    add: list[str] | None = None,
    mode: str = "update",
    compact_after: int = COMPACT_AFTER,
    **trigger,
) -> StreamingQuery:
    """Start a stream into the table. Without a trigger it takes what is there and stops."""

    def write(df: DataFrame, batch_id: int) -> None:
        add_batch(transform(df) if transform else df, batch_id, path, keys, day, add, compact_after)

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
    )
    return started(writer, stream.sparkSession)


def read_days(
    spark: SparkSession,
    path: str,
    keys: list[str],
    first: str | None = None,
    last: str | None = None,
    add: list[str] | None = None,
) -> DataFrame:
    """Rows of the days from ``first`` to ``last`` (``yyyy-MM-dd``, both included); undated rows only without bounds."""
    live = _manifest(spark, path)
    bounded = first is not None or last is not None
    asked = {
        d: p for d, p in live.items()
        if not bounded or (d != UNDATED and (first is None or d >= first) and (last is None or d <= last))
    }
    if asked:
        return _read(spark, path, asked, keys, add or []).drop(DAY, ORDER)
    if not live:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return _read(spark, path, live, keys, add or []).drop(DAY, ORDER).where("false")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete pieces and manifests that none of the newest ``keep`` manifests needs; returns how many.

    Readers must be done with older versions, and no batch may be running.
    """
    if keep < 1:
        raise ValueError("at least one manifest must be kept")
    listed = spark.read.schema(f"day string, piece string, place int, {VERSION} long").parquet(f"{path}/manifest")
    versions = sorted(r[0] for r in listed.select(VERSION).distinct().collect())
    kept = versions[-keep:]
    needed = {r[0] for r in listed.where(F.col(VERSION).isin(kept)).select("piece").distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    data = hadoop.Path(f"{path}/data")
    files = data.getFileSystem(spark._jsc.hadoopConfiguration())
    pieces = [s.getPath() for s in files.listStatus(data) if s.isDirectory() and s.getPath().getName().startswith("piece=")]
    old = [p for p in pieces if p.getName().split("=", 1)[1] not in needed]
    old += [hadoop.Path(f"{path}/manifest/{VERSION}={v}") for v in versions[:-keep]]
    for place in old:
        files.delete(place, True)
    return len(old)
