"""Session settings and the shared folder used to cut lineage or land stream output."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    UTC keeps calendar features independent of the driver's zone. AQE coalesces small
    shuffle partitions, splits skewed join partitions and turns joins whose measured side
    is small into broadcast joins, so no operator hard-codes a strategy for growing data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Fits that run side by side share the cores instead of queueing.
        "spark.scheduler.mode": "FAIR",
        # Recording a Python stack per column expression doubles the time to build wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the place every executor can reach.

    Only where the session names none and runs on this machine alone (tests) is a temporary folder
    made, and the setting is then recorded so later calls agree. On a cluster a missing setting
    raises: executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master or 'this master'} is not one machine")
        root = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Write ``df`` once to the shared folder and read it back.

    For results that several jobs read: it cuts the lineage, outlives lost executors and, as
    parquet, still lets later jobs read only the columns they need.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df):
    """``df`` with its columns worked out before any filter on them.

    The optimiser moves a filter below the projections it reads from and repeats their expressions
    there, once per mention, for every row of the scan. It moves none below a generator, so all columns
    pass through one; those that nobody reads are worked out too, hence select first.
    """
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]
    return df.select(F.inline_outer(F.array(F.struct(*columns))))


def spread(df):
    """``df`` dealt evenly to all cores, for work that takes long per row: small files would be one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
