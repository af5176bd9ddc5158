"""A serving snapshot that is kept by merging, so a read does not fold the whole log of entries.

Entries lie in buckets by a hash of their key: ``data/piece=<name>/_bucket=<n>``. A write adds a piece with only its
newest entry per key; after ``compact_after`` pieces all are folded into one, and entries that have expired are left
out of it. A manifest, written last, names the live pieces. A read opens those, and of them the buckets of the
keys asked for. Pieces and manifests are named after the batch: a batch that is retried replaces its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, VERSION = "_bucket", "version"
BUCKETS = 64
COMPACT_AFTER = 8
MOST_KEYS = 10_000
ENTRY = ["features", "written_at", "expires_at"]


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[str], int | None]:
    """Live pieces, oldest first, and the number of buckets, from the newest manifest (older than ``before``)."""
    try:
        listed = spark.read.schema(f"place int, piece string, buckets int, {VERSION} long").parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return [], None
    if before is not None:
        listed = listed.where(F.col(VERSION) < before)
    newest = listed.agg(F.max(VERSION)).first()[0]
    if newest is None:
        return [], None
    rows = listed.where(F.col(VERSION) == newest).orderBy("place").collect()  # at most compact_after rows
    return [r.piece for r in rows], rows[0].buckets


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _newest(entries: DataFrame, key: str) -> DataFrame:
    """The newest entry per key; of entries written at the same time the one with the larger text."""
    place = F.struct("written_at", "features")
    best = entries.groupBy(BUCKET, key).agg(F.max_by(F.struct(*ENTRY), place).alias("entry"))
    return best.select(BUCKET, key, "entry.*")


def _unexpired(entries: DataFrame, now) -> DataFrame:
    return entries.where(F.col("expires_at") > F.lit(str(now)).cast(entries.schema["expires_at"].dataType))


def _opened(spark: SparkSession, path: str, pieces: list[str]) -> DataFrame:
    places = [f"{path}/data/piece={p}" for p in pieces]
    return spark.read.option("basePath", f"{path}/data").parquet(*places).drop("piece")


def _write_piece(entries: DataFrame, path: str, piece: str) -> None:
    """Rebalanced by bucket: one file for a small bucket, several tasks for a large one."""
    entries.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/piece={piece}")


def add_batch(
    entries: DataFrame,
    batch: int,
    path: str,
    key: str,
    now,
    buckets: int = BUCKETS,
    compact_after: int = COMPACT_AFTER,
) -> None:
    """Take in entries as made by ``store.snapshot_entries``; batches are numbered upwards.

    Null keys are left out, as nobody can ask for them. The number of buckets is that of the first batch. A compaction
    leaves out entries expired at ``now``: an older entry with a longer life that arrives later counts again.
    """
    spark = entries.sparkSession
    live, known = _manifest(spark, path, before=batch)
    count = known or buckets
    keyed = entries.where(F.col(key).isNotNull()).withColumn(BUCKET, _bucket(F.col(key), count))
    newest = _newest(keyed, key)
    if newest.isEmpty():
        return
    _write_piece(newest, path, f"b{batch}")
    live = [*live, f"b{batch}"]
    if len(live) > compact_after:
        folded = _newest(_opened(spark, path, live), key)
        piece = f"c{batch}"
        _write_piece(_unexpired(folded, now), path, piece)
        # A piece without any entry has no files to open.
        live = [piece] if _holds_files(spark, path, piece) else [f"b{batch}"]
    listed = spark.createDataFrame([(i, p, count) for i, p in enumerate(live)], "place int, piece string, buckets int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{VERSION}={batch}")


def _holds_files(spark: SparkSession, path: str, piece: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}/data/piece={piece}")
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return any(s.isDirectory() for s in listed)


def read(spark: SparkSession, path: str, key: str, now, keys: list | None = None) -> DataFrame:
    """Unexpired newest entries as of ``now``; of the given keys only, whose buckets alone are opened."""
    live, buckets = _manifest(spark, path)
    if not live:
        raise FileNotFoundError(f"no batch has been written to {path}")
    entries = _opened(spark, path, live)
    if keys is not None:
        if len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys; read all and join")
        kind = entries.schema[key].dataType
        asked = [F.lit(k).cast(kind) for k in keys if k is not None]
        places = [_bucket(k, buckets) for k in asked]  # constants, so they prune folders
        entries = entries.where(F.col(BUCKET).isin(places) & F.col(key).isin(asked) if asked else F.lit(False))
    folded = _newest(entries, key) if len(live) > 1 else entries
    return _unexpired(folded, now).select(key, *ENTRY)
