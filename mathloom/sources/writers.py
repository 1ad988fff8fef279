"""Writers. Every one is safe to repeat after a lost executor or a replayed batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are written and non-ASCII text is kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write one run's rows into its own folder; writing the run again replaces only that folder."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def append_quarantine(df: DataFrame, path: str, run_id: str, reason: str | None = None) -> None:
    """Add rows to the quarantine table as ``(id, reason, run_id)``.

    ``reason`` names one reason for all rows; without it the rows bring their own.
    """
    why = F.lit(reason) if reason is not None else F.col("reason")
    replace_run(df.select("id", why.alias("reason")), path, run_id)


def write_metrics(df: DataFrame, path: str) -> None:
    """Write metric rows by model and dataset; a repeat replaces the rows of its own models and datasets only."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model", "dataset").json(path)


def write_records_json(df: DataFrame, path: str) -> None:
    """One JSON record per row."""
    df.write.mode("overwrite").json(path)
