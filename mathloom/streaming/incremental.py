"""Resumable curation of a growing folder of formula lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import curate
from ..session import cut_lineage
from ..sources import schemas
from ..sources.writers import replace_run
from .id_index import IdIndex, stored

STORED = "id string, latex string, run_id string"
REFUSED = "id string, reason string, line string, run_id string"


def _index(spark: SparkSession, path: str | None, good_path: str, quarantine_path: str) -> IdIndex:
    """The index beside the good rows; before the first batch it is made from what is stored there."""
    index = IdIndex(spark, path or f"{good_path.rstrip('/')}.ids")
    if not index.buckets():
        done = curate.drop_blank(stored(spark, good_path, STORED), "latex").select("id", "run_id")
        broken = stored(spark, quarantine_path, REFUSED).filter("id is not null").select("id", "run_id")
        index.start(done.union(broken))
    return index


def _without_id(rows: DataFrame) -> DataFrame:
    """Lines that show no id, as ``(id, reason, line)`` with a null id."""
    broken = F.col(schemas.CORRUPT)
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != schemas.CORRUPT]))
    nameless = rows.filter(F.col("id").isNull() & (broken.isNull() | (curate.shown_id(broken) == "")))
    lines = nameless.select(
        F.lit(None).cast("string").alias("id"),
        F.when(broken.isNull(), "no_id").otherwise("error").alias("reason"),
        F.coalesce(broken, whole).alias("line"),
    )
    return lines.distinct()


def curate_batch(
    batch: DataFrame,
    run_id: str,
    good_path: str,
    quarantine_path: str,
    rendered: str | None = None,
    index_path: str | None = None,
) -> None:
    """Judge the batch's new ids; good rows and refused ids are written under ``run_id``.

    Which ids are new is looked up in an index (``index_path``, by default beside the good rows), of
    which only the batch's own buckets are read. The run's own ids do not count as seen, so a replayed
    batch is judged again in full and replaces itself.

    A line that shows no id cannot be told from a repeat by its id, so it is refused with its text
    (``no_id`` where it can be read, else ``error``); equal lines are refused once per batch.
    """
    spark = batch.sparkSession
    rows = batch.persist()
    try:
        index = _index(spark, index_path, good_path, quarantine_path)
        readable = rows.filter(F.col(schemas.CORRUPT).isNull() & F.col("id").isNotNull())
        columns = ["id", "latex", *([rendered] if rendered else [])]
        # one row per id: a repeated id is judged once
        once = readable.groupBy("id").agg(F.min(F.struct(*columns[1:])).alias("row")).select("id", "row.*")
        errors = curate.row_errors(rows).filter(F.col("id").isNotNull())
        unreadable = errors.join(readable.select("id").distinct(), "id", "left_anti")
        seen = cut_lineage(index.seen(readable.select("id").union(errors.select("id")), run_id))
        # both outputs read the judged rows, which are stored once
        judged = cut_lineage(curate.judge(once.join(seen, "id", "left_anti"), rendered))
        refused = judged.filter(F.col("reason").isNotNull()).select("id", "reason")
        new_errors = unreadable.join(seen, "id", "left_anti")
        good = judged.filter(F.col("reason").isNull()).select("id", "latex")
        with_id = refused.unionByName(new_errors).withColumn("line", F.lit(None).cast("string"))
        replace_run(with_id.unionByName(_without_id(rows)), quarantine_path, run_id)
        replace_run(good, good_path, run_id)
        index.add(judged.select("id").union(new_errors.select("id")), run_id)
    finally:
        rows.unpersist()


def curate_incremental(
    spark: SparkSession,
    source: str,
    good_path: str,
    quarantine_path: str,
    checkpoint: str,
    rendered: str | None = None,
    files_per_batch: int = 1000,
    index_path: str | None = None,
) -> StreamingQuery:
    """Judge every new line below ``source`` once and stop when there is nothing new.

    Run it again after files were added, or after a failure: the checkpoint knows which files are
    done, a replayed batch overwrites its own folder, and ids seen in other runs are skipped.
    """
    fields = list(schemas.GT_EXTRACT.fields)
    if rendered:
        fields.append(T.StructField(rendered, T.BooleanType()))
    fields.append(T.StructField(schemas.CORRUPT, T.StringType()))
    lines = (
        spark.readStream.schema(T.StructType(fields))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        curate_batch(batch, f"batch-{batch_id}", good_path, quarantine_path, rendered, index_path)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
