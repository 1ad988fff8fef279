"""Helpers the operators share: input columns, written tables and blocks of coded documents."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder, shared_dir

# Words are runs without ASCII white space, which is what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"

# The distinct words of a block that fall into one hash bucket, sorted and compressed.
PART = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        *(T.StructField(c, T.BinaryType()) for c in ("words", "places", "counts")),
    ]
)

# Bytes of text gathered into one block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def kept(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint, which keeps their partitions and order.

    The files lie in ``spark.checkpoint.dir``; Spark's cleaner removes them with the last reference
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def list_of(values: pa.Array) -> pa.Array:
    """One list that holds all of ``values``."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack_codes(codes: np.ndarray) -> bytes:
    """Small unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def pack_bytes(data: bytes) -> bytes:
    """Compressed bytes after their length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def unpack_codes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 4, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by ``key``: later joins on it move only the other side."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", new_folder(spark, "table")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: only the name goes
    return stored


def buckets_of(spark: SparkSession) -> int:
    """Word buckets: some for each shuffle partition, so that they spread evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def coded_blocks(
    docs: DataFrame, key: str, text: str, held: str | None = None, lower: bool = False, end: bytes | None = None
) -> DataFrame:
    """Documents gathered into blocks, their words replaced by places in the block's own word list.

    One row per block: ``block``, ``keys``, ``held`` flags and ``sizes`` (words) of its documents,
    ``codes`` (all words, in order) and ``parts``: the block's distinct words by hash bucket, each
    with its place and, if ``held`` is given, its count in documents that are not. Null texts are empty; ``end``
    adds a closing word to each document. A word that is frequent in a block meets the corpus once
    per block and not once per occurrence. The table is stored bucketed by block.
    """
    key_type = docs.schema[key].dataType
    buckets = buckets_of(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("codes", T.BinaryType()),
            T.StructField("parts", T.ArrayType(PART)),
        ]
    )
    part_type = pa.list_(
        pa.struct([("bucket", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("words", "places", "counts"))])
    )

    def parts_of(words: list[bytes], counts: np.ndarray) -> list[dict]:
        bucket = np.fromiter((word_bucket(w, buckets) for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(words) else np.zeros(0, int)
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)]):
            own = np.array(sorted(order[a:b].tolist(), key=words.__getitem__))
            listed = b"\n".join([words[i] for i in own.tolist()])
            out.append(
                {
                    "bucket": int(bucket[own[0]]),
                    "n": len(own),
                    "words": pack_bytes(listed),
                    "places": pack_codes(own),
                    "counts": pack_codes(counts[own]) if held else None,
                }
            )
        return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        keys, flags, codes, size = [], [], [], 0
        places: defaultdict = defaultdict()
        places.default_factory = places.__len__

        def row() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in codes], np.int32)
            flat = np.concatenate(codes)
            # frequent words get small codes, which pack in fewer bytes
            order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            flat, words = rank[flat], list(places)
            words = [words[i] for i in order.tolist()]
            held_now = np.array(flags, bool)
            counts = np.bincount(flat[np.repeat(~held_now, lengths)], minlength=len(words)) if held else np.zeros(0, int)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()),
                    list_of(pa.concat_arrays(keys)),
                    list_of(pa.array(held_now)),
                    list_of(pa.array(lengths)),
                    pa.array([pack_codes(flat)], pa.binary()),
                    pa.array([parts_of(words, counts)], part_type),
                ],
                names=schema.names,
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            start = 0
            for i, value in enumerate(texts):
                raw = value.as_py() or b""
                words = (raw.lower() if lower else raw).split()
                if end is not None:
                    words.append(end)
                codes.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                flags.append(batch.column(2)[i].as_py())
                size += len(raw)
                if size >= BLOCK_BYTES:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield row()
                    keys, flags, codes, size, start, number = [], [], [], 0, i + 1, number + 1
                    places.clear()
            if start < batch.num_rows:
                keys.append(batch.column(0).slice(start))
        if codes:
            yield row()

    flag = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    rows = docs.select(docs[key], docs[text], flag.alias("held"))
    return bucketed(rows.mapInArrow(blocks, schema), "block")


def parts(coded: DataFrame) -> DataFrame:
    """``block, bucket, n, words, places, counts``: a row for each word bucket of each block."""
    return coded.select("block", F.explode("parts").alias("p")).select("block", "p.*")
