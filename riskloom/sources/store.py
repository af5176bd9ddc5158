"""Feature store: versioned tables offline, a latest-per-borrower snapshot for serving."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def save_version(features: DataFrame, path: str, version: str = "latest") -> None:
    """Write under ``version=<version>``; a reader of one version opens only that folder."""
    features.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_version(spark: SparkSession, path: str, version: str = "latest") -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/version={version}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no feature version {version} under {path}") from error
        raise


def version_metadata(spark: SparkSession, path: str, version: str = "latest") -> DataFrame:
    """(column, dtype, n_columns, n_rows); no rows when the version does not exist.

    The row count is read from the parquet footers.
    """
    schema = "column string, dtype string, n_columns int, n_rows bigint"
    try:
        df = load_version(spark, path, version)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    columns = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for n, t in df.dtypes])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.inline(columns), F.lit(len(df.columns)).alias("n_columns"), "n_rows")


def snapshot_entries(
    features: DataFrame, key: str, written_at: str, ttl_seconds: int = TTL_SECONDS
) -> DataFrame:
    """Rows for the serving snapshot: key, features as JSON, when written and when they expire."""
    packed = F.to_json(F.struct(*[c for c in features.columns if c not in (key, written_at)]))
    return features.select(
        key,
        packed.alias("features"),
        F.col(written_at).alias("written_at"),
        (F.col(written_at) + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")).alias("expires_at"),
    )


def latest_entries(entries: DataFrame, now, key: str) -> DataFrame:
    """The newest unexpired entry per key as of ``now``.

    ``max_by`` combines map-side, so a key written very often is no burden to one task. Of entries
    written at the same time the one with the larger features text counts.
    """
    moment = F.lit(str(now)).cast(entries.schema["expires_at"].dataType)
    newest = entries.groupBy(key).agg(
        F.max_by(F.struct("features", "written_at", "expires_at"), F.struct("written_at", "features")).alias("entry")
    )
    return newest.select(key, "entry.*").filter(F.col("expires_at") > moment)


def read_features(entries: DataFrame, key: str, schema: str) -> DataFrame:
    """Unpack the JSON of snapshot entries."""
    return entries.select(key, F.from_json("features", schema).alias("f")).select(key, "f.*")


def latest_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key; only one candidate per key and task is shuffled."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")
