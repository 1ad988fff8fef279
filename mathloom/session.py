"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "mathloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where none is set it is a folder of the warehouse, which executors reach as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if folder:
        if current is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if current is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        warnings.warn(f"spark.checkpoint.dir is not set: intermediate tables go to {warehouse}", stacklevel=2)
        spark.sparkContext.setCheckpointDir(f"{warehouse.rstrip('/')}/_scratch")
        current = spark.sparkContext.getCheckpointDir()
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a written table in the shared folder.

    What follows neither computes them again nor depends on the executors that did; a table also
    keeps column pruning, filter pushdown and a true size for the planner. Its shuffle files go once
    it is written, and do not wait for the driver to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
