"""Reading and writing the three input tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import BORROWER_SCHEMA, PAYMENT_SCHEMA, TRANSACTION_SCHEMA

BUNDLE = {"borrowers": BORROWER_SCHEMA, "transactions": TRANSACTION_SCHEMA, "payments": PAYMENT_SCHEMA}


def read_table(spark: SparkSession, path: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``<path>/<name>.parquet`` with a declared schema, so no file is opened to infer one."""
    location = f"{path}/{name}.parquet"
    try:
        return spark.read.schema(schema or BUNDLE[name]).parquet(location)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no {name} table at {location}; generate or download it first") from error
        raise


def read_bundle(
    spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    return {name: read_table(spark, path, name, (schemas or {}).get(name)) for name in BUNDLE}


def write_bundle(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A raw loan file with a header line; blank and ``NA`` fields are null."""
    return spark.read.option("header", True).option("nullValue", "NA").schema(schema).csv(path)
