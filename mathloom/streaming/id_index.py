"""Ids that earlier runs settled, stored so that a batch reads only where its own ids can be.

The index is a Parquet table partitioned by a hash bucket of the id. A batch knows its buckets, so
partition pruning leaves the others unread: it reads at most its own number of ids times the size of
a bucket, however many ids are stored. Buckets stay near ``ids_per_bucket``, for the table is written
anew with four times the buckets when those a batch has looked into are too full; every id is
rewritten a bounded number of times in all.

A level, that is a number of buckets, counts from the moment its record is written, which is after
its rows. Ids are a set: writing a run again adds nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = "id string, run_id string, bucket int"
LEVELS = "buckets int"
GROWTH = 4


def stored(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def bucket_of(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


class IdIndex:
    """Settled ids under ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str, ids_per_bucket: int = 1_000_000):
        self.spark, self.path, self.ids_per_bucket = spark, path.rstrip("/"), ids_per_bucket

    def buckets(self) -> int:
        """The buckets of the newest level; 0 before the first one."""
        return stored(self.spark, f"{self.path}/levels", LEVELS, "json").agg(F.max("buckets")).first()[0] or 0

    def rows(self, buckets: int) -> DataFrame:
        return stored(self.spark, f"{self.path}/buckets={buckets}", IDS)

    def _write(self, ids: DataFrame, buckets: int, mode: str) -> None:
        dealt = ids.select("id", "run_id", bucket_of(F.col("id"), buckets).alias("bucket"))
        dealt.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/buckets={buckets}")

    def _commit(self, buckets: int) -> None:
        self.spark.createDataFrame([(buckets,)], LEVELS).coalesce(1).write.mode("append").json(f"{self.path}/levels")

    def start(self, ids: DataFrame) -> None:
        """The first level, from ids ``(id, run_id)`` that were settled without an index."""
        needed = ids.count() // self.ids_per_bucket + 1
        buckets = GROWTH
        while buckets < needed:
            buckets *= GROWTH
        self._write(ids, buckets, "overwrite")
        self._commit(buckets)

    def candidates(self, ids: DataFrame) -> DataFrame:
        """All rows ``(id, run_id, bucket)`` in the buckets of the given ids; the others are not read.

        The list of buckets is as long as the level has buckets at most.
        """
        buckets = self.buckets()
        touched = [r.bucket for r in ids.select(bucket_of(F.col("id"), buckets).alias("bucket")).distinct().collect()]
        return self.rows(buckets).filter(F.col("bucket").isin(touched))

    def seen(self, ids: DataFrame, run_id: str) -> DataFrame:
        """Those of the ids that other runs settled, each once."""
        near = self.candidates(ids).filter(F.col("run_id") != run_id)
        return near.join(ids.select("id").distinct(), "id", "left_semi").select("id").distinct()

    def add(self, ids: DataFrame, run_id: str) -> None:
        """Settle ids; more buckets if those of these ids hold too many."""
        buckets = self.buckets()
        fullest = self.candidates(ids).groupBy("bucket").count().agg(F.avg("count")).first()[0] or 0
        if fullest > self.ids_per_bucket:
            settled = self.rows(buckets).groupBy("id").agg(F.min("run_id").alias("run_id"))
            self._write(settled, GROWTH * buckets, "overwrite")
            self._commit(GROWTH * buckets)
            buckets *= GROWTH
        self._write(ids.select("id").distinct().withColumn("run_id", F.lit(run_id)), buckets, "append")
