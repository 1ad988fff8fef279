"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Only a document that is longer than a sequence is cut: into full pieces, which are sequences of
their own and never move, and a first piece with what is left. All other pieces are dealt to shards
by a hash of their number, so no key, source or repeated row gathers in a shard, and a shard holds
about ``SHARD`` pieces however many there are. In its shard a piece goes where the sum over the gaps
``g`` of N(g) squared gets smallest, N(g) being the open sequences with a gap of ``g`` tokens: into
an open sequence it fits, or into a new one.

The rule serves a stream of sizes without an end; where the end is known it leaves sequences open
that small pieces could have closed. So small pieces come last, longest first, and open a sequence
only where none has room; which sizes count as small is tried for a few bounds, and the fewest
sequences win.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tokens import encoder

CAPACITY, END = 1024, 2
SHARD = 50_000
# Bounds of a small piece, as shares of a sequence.
SMALL = (0.0, 0.0625, 0.125, 0.25, 0.375, 0.5)


def sum_of_squares(sizes: np.ndarray, late: int, capacity: int) -> tuple[list[int], int]:
    """The gap each piece is put into, and the number of sequences.

    A gap of ``capacity`` stands for a new sequence; from place ``late`` on one is opened only
    where no open one has room. Putting size s into gap g changes the sum by
    2 (N(g - s) - N(g)) + 2, by 1 less where it closes the sequence, and opening one by
    2 N(capacity - s) + 1.
    """
    counts = np.zeros(capacity + 1, np.int64)
    chosen, opened = [], 0
    for i, size in enumerate(sizes.tolist()):
        gap = capacity
        if size < capacity:
            there = counts[size:capacity]
            change = np.where(there > 0, 2 * (counts[: capacity - size] - there) + 2, np.iinfo(np.int64).max)
            change[0] -= there[0] > 0
            best = int(change.argmin())
            if there[best] > 0 and (i >= late or change[best] <= 2 * counts[capacity - size] + 1):
                gap = size + best
        if gap == capacity:
            opened += 1
        else:
            counts[gap] -= 1
        if gap > size:
            counts[gap - size] += 1
        chosen.append(gap)
    return chosen, opened


def pack_shard(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, for the best of the bounds in ``SMALL``.

    Pieces above the bound are taken in the order given, which should be random.
    """
    best: tuple[int, np.ndarray, list[int]] | None = None
    for share in SMALL:
        small = sizes <= share * capacity
        large = np.flatnonzero(~small)
        late = np.flatnonzero(small)
        order = np.r_[large, late[np.argsort(-sizes[late], kind="stable")]]
        gaps, opened = sum_of_squares(sizes[order], len(large), capacity)
        if best is None or opened < best[0]:
            best = opened, order, gaps
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if best is None:
        return sequence, offset
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap, the open sequences
    number = 0
    for i, size, gap in zip(best[1].tolist(), sizes[best[1]].tolist(), best[2]):
        if gap == capacity:
            at, number = number, number + 1
        else:
            at = waiting[gap].pop()
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            waiting[gap - size].append(at)
    return sequence, offset


def pieces(docs: DataFrame, path: str, key: str, text: str, capacity: int, end: int) -> DataFrame:
    """Every piece with a number of its own; a null or empty text is the end token alone."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("number", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, specials=True)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    of.append(i)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(c, pa.int64()) for c in (start, length, crc)),
                    pa.array(np.arange(number, number + len(of)), pa.int64()),
                ],
                names=schema.names,
            )
            number += len(of)

    return docs.select(docs[key], docs[text]).mapInArrow(cut, schema)


def pack_sequences(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    ``path`` is a tokenizer file; a document is its ids and ``end``. Pieces are numbered from 0,
    ``start`` counts the document's ids before the piece, ``ids_crc32`` is the CRC-32 of its ids as
    unsigned little-endian 32-bit numbers. In a sequence the offsets leave no gap, and no sequence
    holds more than ``capacity`` tokens. Null and empty texts are the end token alone; null keys and
    repeated rows are rows like others; an empty table gives no rows; other columns are not read.
    Sequence numbers are unique, negative for full pieces.
    """
    cut = cut_lineage(pieces(docs, path, key, text, capacity, end))
    full = cut.filter(F.col("length") == capacity)
    loose = cut.filter(F.col("length") < capacity)
    shards = -(-loose.count() // SHARD) or 1
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            *(f for f in cut.schema if f.name in ("piece", "start", "length", "ids_crc32")),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("deal", "ascending"), ("number", "ascending")])
        sequence, offset = pack_shard(group["length"].to_numpy(), capacity)
        shard = group["shard"][0].as_py()
        return pa.table(
            [group[c] for c in ("key", "piece", "start", "length", "ids_crc32")]
            + [pa.array(sequence + (shard << 32), pa.int64()), pa.array(offset, pa.int64())],
            names=schema.names,
        )

    deal = F.xxhash64("number")
    dealt = loose.withColumn("deal", deal).withColumn("shard", F.pmod(deal, F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(fill, schema)
    alone = full.select(
        F.col("key").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (-1 - F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return alone.unionByName(packed)
