"""Alignment of two tokenizers' tokens by merge-path partitioning of their byte ends.

The tokens of a text end at increasing byte offsets, once for tokenizer A and once for B. Merging
both lists cuts the text where either ends; each stretch lies in one token of A and one of B, and
those are a link. An offset where both end closes a group.

Documents are gathered into chunks whose offsets run on, so that the ends of all of them are one
pair of sorted lists. Binary searches along equidistant diagonals of the merge cut that pair into
pieces of equal work, however long single documents are; a piece knows its own ends only. A piece
that closes with an end of A and the next that opens with the same end of B are stitched: the
stretch is counted once and its group closes there.

Counts of id pairs are corpus-wide. A block of documents names each of its pairs once, by hash
buckets; buckets are dealt out, summed, and only the sums go back to the block, in the order in
which it lists its pairs. The highest count of each id of B is a table of its vocabulary's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import bucketed, buckets_of, list_of, pack_bytes, pack_codes, parts, unpack_bytes, unpack_codes
from .tokens import byte_level_vocabulary, encoder

# Bytes of text in a chunk and a block, merged ends in a piece.
CHUNK_BYTES, BLOCK_BYTES, PIECE_ENDS = 1 << 20, 16 << 20, 1 << 16

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers, loaded once per worker process."""

    known: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoder(a_path, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = byte_level_vocabulary(a_path)
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.n_b = len(b_bytes)
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)]
        # ids in decimal with what follows them: A's "," and "|", then B's "," and ";"
        shown = [f"{i}{mark}" for n, marks in ((len(a_bytes), ",|"), (self.n_b, ",;")) for i in range(n) for mark in marks]
        self.shown = pa.array(shown, pa.large_string())
        self.first_b = 2 * len(a_bytes)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        if (a_path, b_path) not in cls.known:
            cls.known[a_path, b_path] = cls(a_path, b_path)
        return cls.known[a_path, b_path]


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` merged ends are of ``a``, which goes first where both end."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        right = np.zeros(len(at), bool)
        right[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, first_shared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a piece in order, as places in ``a`` and ``b``, and which ends of each are common.

    ``first_shared`` says that the first end of ``b`` closed the piece before as an end of A.
    """
    in_b, in_a = np.searchsorted(b, a, "left"), np.searchsorted(a, b, "right")
    b_common = np.zeros(len(b), bool)
    held = in_a > 0
    b_common[held] = a[in_a[held] - 1] == b[held]
    a_common = np.zeros(len(a), bool)
    a_common[in_a[b_common] - 1] = True
    b_common[:1] |= first_shared
    of_a, of_b = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + in_b, np.arange(len(b)) + in_a
    of_a[at_a], of_b[at_a] = np.arange(len(a)), in_b
    of_a[at_b], of_b[at_b] = in_a, np.arange(len(b))
    new = np.ones(len(of_a), bool)
    new[at_b[b_common]] = False
    return of_a[new], of_b[new], a_common, b_common


def merged(a: np.ndarray, b: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links in order, as places in ``a`` and ``b``, and which ends of each are common."""
    at = np.unique(np.r_[np.arange(0, len(a) + len(b), work), len(a) + len(b)])
    cut_a = diagonals(a, b, at)
    cut_b = at - cut_a
    links_a, links_b, a_common, b_common = [], [], [], []
    shared = False
    for i, i_end, j, j_end in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]):
        la, lb, ca, cb = overlaps(a[i:i_end], b[j:j_end], shared)
        links_a.append(la + i)
        links_b.append(lb + j)
        shared = bool(i_end > i and j_end < len(b) and a[i_end - 1] == b[j_end])
        if shared:
            ca[-1] = True
        a_common.append(ca)
        b_common.append(cb)
    if not links_a:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing.astype(bool), nothing.astype(bool)
    return tuple(np.concatenate(x) for x in (links_a, links_b, a_common, b_common))


class Chunk:
    """The aligned tokens of some documents."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        spaced = [" " + t if t else "" for t in texts]
        raw = [s.encode() for s in spaced]
        ids = [
            [pair.a(s) if s else np.zeros(0, np.uint32) for s in spaced],
            [np.fromiter(x, np.uint32, len(x)) for x in pair.b.encode([t or "" for t in texts], num_threads=1)],
        ]
        for side in (0, 1):
            for i, own in enumerate(self._unequal(pair, side, ids[side], raw)):
                if own:  # such a document has no tokens
                    ids[0][i] = ids[1][i] = np.zeros(0, np.uint32)
                    raw[i] = b""
        self.n = [np.fromiter(map(len, x), np.int64, len(x)) for x in ids]
        self.ids = [np.concatenate(x).astype(np.int64) for x in ids]
        ends = [np.cumsum(pair.lengths[side][self.ids[side]]) for side in (0, 1)]
        self.link_a, self.link_b, self.a_common, self.b_common = merged(*ends)
        starts = np.r_[0, np.cumsum(self.n[0])]
        self.n_groups = np.diff(np.r_[0, np.cumsum(self.a_common)][starts])
        self.n_links = np.diff(np.searchsorted(self.link_a, starts))
        self.pair = pair

    @staticmethod
    def _unequal(pair: Pair, side: int, ids: list[np.ndarray], raw: list[bytes]) -> list[bool]:
        taken = pair.bytes[side].take(pa.array(np.concatenate(ids)))
        joined = memoryview(taken.buffers()[2] or b"").cast("B")
        bounds = np.r_[0, np.cumsum([len(x) for x in ids])]
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1][bounds].tolist() if len(taken) else [0] * len(bounds)
        return [joined[a:b] != own for a, b, own in zip(offsets, offsets[1:], raw)]

    def pairs(self) -> np.ndarray:
        return self.ids[0][self.link_a] * self.pair.n_b + self.ids[1][self.link_b]

    def shown(self) -> list[memoryview]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
        groups = [np.cumsum(c) - c for c in (self.a_common, self.b_common)]
        held = [np.bincount(g, minlength=int(self.a_common.sum())) for g in groups]
        before_b, through_a = np.cumsum(held[1]) - held[1], np.cumsum(held[0])
        order = np.empty(len(groups[0]) + len(groups[1]), np.int64)
        order[np.arange(len(groups[0])) + before_b[groups[0]]] = 2 * self.ids[0] + self.a_common
        order[np.arange(len(groups[1])) + through_a[groups[1]]] = self.pair.first_b + 2 * self.ids[1] + self.b_common
        taken = self.pair.shown.take(pa.array(order))
        text = memoryview(taken.buffers()[2] or b"").cast("B")
        bounds = np.r_[0, np.cumsum(self.n[0] + self.n[1])]
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][bounds].tolist() if len(taken) else [0] * len(bounds)
        return [text[a : max(a, b - 1)] for a, b in zip(offsets, offsets[1:])]


def chunks(pair: Pair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Chunk]]:
    """The documents ``start:stop`` of a batch, aligned together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= CHUNK_BYTES or i + 1 == batch.num_rows:
            yield start, i + 1, Chunk(pair, batch.column(1).slice(start, i + 1 - start).to_pylist())
            start, held = i + 1, 0


def token_groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and ``groups``, the document's token groups as ``a1,a2|b1;a3|b2,b3``."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("groups", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        for batch in batches:
            for start, stop, chunk in chunks(pair, batch):
                shown = pa.array([str(x, "ascii") for x in chunk.shown()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), shown], names=schema.names)

    return docs.select(docs[key], docs[text]).mapInArrow(look, schema)


def _buckets(pairs: np.ndarray, buckets: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return pack_bytes(np.ascontiguousarray(values, "<i8").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(unpack_bytes(data), "<i8")


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """One row per block: its documents' counts and digests, their links as places in the block's
    list of pairs, and that list by hash bucket with the block's counts; stored bucketed by block."""
    key_type = docs.schema[key].dataType
    n_buckets = buckets_of(docs.sparkSession)
    part = [("bucket", pa.int32()), ("n", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(key_type)),
            *(T.StructField(c, T.ArrayType(T.LongType())) for c in COUNTS),
            T.StructField("digests", T.ArrayType(T.StringType())),
            T.StructField("links", T.BinaryType()),
            T.StructField(
                "parts",
                T.ArrayType(T.StructType.fromDDL("bucket int, n int, pairs binary, counts binary")),
            ),
        ]
    )

    def block(number: int, keys: list, counts: list, digests: list, pairs: list) -> pa.RecordBatch:
        places, listed = pd.factorize(np.concatenate(pairs))
        bucket = _buckets(listed, n_buckets)
        order = np.lexsort((listed, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        links = rank[places]
        held = np.bincount(links, minlength=len(order))
        listed, bucket = listed[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, np.diff(bucket) > 0]) if len(bucket) else np.zeros(0, int)
        rows = [
            {"bucket": int(bucket[a]), "n": int(b - a), "pairs": _packed(listed[a:b]), "counts": pack_codes(held[a:b])}
            for a, b in zip(starts, np.r_[starts[1:], len(bucket)])
        ]
        columns = [np.concatenate([c[i] for c in counts]) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                list_of(pa.concat_arrays(keys)),
                *(list_of(pa.array(c, pa.int64())) for c in columns),
                list_of(pa.array(digests, pa.string())),
                pa.array([pack_codes(links)], pa.binary()),
                pa.array([rows], pa.list_(pa.struct(part))),
            ],
            names=schema.names,
        )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        number, size = TaskContext.get().partitionId() << 32, 0
        keys, counts, digests, pairs = [], [], [], []
        for batch in batches:
            for start, stop, chunk in chunks(pair, batch):
                keys.append(batch.column(0).slice(start, stop - start))
                counts.append((*chunk.n, chunk.n_groups, chunk.n_links))
                digests += [hashlib.sha256(x).hexdigest() if len(x) else "" for x in chunk.shown()]
                pairs.append(chunk.pairs())
                size += int(chunk.n[0].sum() + chunk.n[1].sum())
                if size * 2 >= BLOCK_BYTES:
                    yield block(number, keys, counts, digests, pairs)
                    number, size, keys, counts, digests, pairs = number + 1, 0, [], [], [], []
        if keys:
            yield block(number, keys, counts, digests, pairs)

    return bucketed(docs.select(docs[key], docs[text]).mapInArrow(look, schema), "block")


def _summed(b_size: int):
    """Sums of one bucket's pairs: a row for each block's part, and one with the highest of each B id."""

    def total(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_pylist()
        pairs = np.concatenate([_unpacked(x) for x in group["pairs"].to_pylist()])
        counts = np.concatenate([unpack_codes(x, n) for x, n in zip(group["counts"].to_pylist(), sizes)])
        listed, place = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(listed), np.int64)
        np.add.at(sums, place, counts.astype(np.int64))
        of_b, back = np.unique(listed % b_size, return_inverse=True)
        highest = np.zeros(len(of_b), np.int64)
        np.maximum.at(highest, back, sums)
        ends = np.r_[0, np.cumsum(sizes)]
        totals = [_packed(sums[place[a:b]]) for a, b in zip(ends, ends[1:])]
        blocks = [*group["block"].to_pylist(), None]
        return pa.table(
            [
                pa.array(blocks, pa.int64()),
                pa.array([group["bucket"][0].as_py()] * len(blocks), pa.int32()),
                pa.array([*totals, None], pa.binary()),
                pa.array([[]] * len(totals) + [of_b.tolist()], pa.list_(pa.int64())),
                pa.array([[]] * len(totals) + [highest.tolist()], pa.list_(pa.int64())),
            ],
            names=["of", "bucket", "totals", "ids", "highest"],
        )

    return total


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    A is a byte-level tokenizer file, B a sentencepiece model; special strings are plain text and A
    reads the text after one space, which B adds itself. A link is a pair of token occurrences whose
    byte ranges overlap, the count of an id pair is its links in all rows, ``n_best`` the links whose
    count is the highest of their B id, ``count_sum`` the sum of the counts over the links. Rows
    whose text is null or empty, or whose tokens of either side do not spell space and text, have no
    tokens: zeros and an empty digest. Repeated rows count as often as they occur; null keys stay; an
    empty table gives no rows; other columns are not read.
    """
    coded = aligned_blocks(docs, a_path, b_path, key, text)
    b_size = Pair.of(a_path, b_path).n_b
    sums = cut_lineage(
        parts(coded)
        .groupBy("bucket")
        .applyInArrow(_summed(b_size), "of long, bucket int, totals binary, ids array<long>, highest array<long>")
    )
    tops = (
        sums.filter("of is null")
        .select(F.explode(F.arrays_zip("ids", "highest")).alias("t"))
        .groupBy("t.ids")
        .agg(F.max("t.highest").alias("highest"))
        .collect()
    )  # no more rows than B's vocabulary has ids
    top = np.zeros(b_size, np.int64)
    for row in tops:
        top[row["ids"]] = row["highest"]
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")),
            T.StructField("groups_sha256", T.StringType()),
        ]
    )

    def assemble(blocks: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        n_links = blocks["n_links"][0].values.to_numpy()
        ends = np.r_[0, np.cumsum(n_links)]
        nothing = [np.zeros(0, np.int64)]
        totals = np.concatenate(nothing + [_unpacked(x) for x in found["totals"].to_pylist()])
        listed = np.concatenate(nothing + [_unpacked(p["pairs"]) for p in blocks["parts"][0].as_py()])
        links = unpack_codes(blocks["links"][0].as_py(), int(ends[-1]))
        best = np.r_[0, np.cumsum((totals == top[listed % b_size])[links])]
        count = np.r_[0, np.cumsum(totals[links])]
        return pa.table(
            [blocks["keys"][0].values, *(blocks[c][0].values for c in COUNTS)]
            + [pa.array(np.diff(x[ends]), pa.int64()) for x in (best, count)]
            + [blocks["digests"][0].values],
            names=schema.names,
        )

    of_block = sums.filter("of is not null").select("of", "bucket", "totals")
    return coded.groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(assemble, schema)
