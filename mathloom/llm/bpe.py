"""BPE encoding and decoding through a table of distinct words.

Documents are split into words at ASCII white space and gathered into blocks that name each of
their words once, by hash buckets. The buckets are dealt out, so that each distinct word is
encoded once, and its ids go back to the block and from there to the word's positions. The
tokenizer's own normalising, splitting and special strings never reach across white space, so the
ids of a text are those of its words in order. Decoding joins ids with the vocabulary's pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded_blocks, pack_codes, parts, unpack_bytes, unpack_codes


def _loaded(path: str):
    """The tokenizer, unpadded and untruncated; loaded once per worker process."""
    from tokenizers import Tokenizer

    if path not in _loaded.known:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _loaded.known[path] = tokenizer
    return _loaded.known[path]


_loaded.known = {}


def pieces_of(path: str) -> np.ndarray:
    """The id-to-piece table: bounded by the vocabulary, never by the data."""
    tokenizer = _loaded(path)
    table = np.empty(tokenizer.get_vocab_size(with_added_tokens=True), object)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = piece
    return table


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``ids`` (array<int>) and ``decoded`` (string), of the whole text.

    A null or empty text gives no ids and an empty string. Repeated rows are encoded like any
    others, an empty table gives no rows, and other columns are not read.
    """
    key_type = docs.schema[key].dataType
    coded = coded_blocks(docs, key, text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(path)
        bucket, known = None, {}
        for batch in batches:
            done = []
            for block, b, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != bucket:
                    bucket, known = b, {}
                listed = unpack_bytes(words).split(b"\n")
                fresh = [w for w in listed if w not in known]
                for w, e in zip(fresh, tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in fresh], add_special_tokens=False)):
                    known[w] = e.ids
                ids = [known[w] for w in listed]
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                done.append((block, b, len(listed), len(flat), pack_codes(lengths), pack_codes(flat)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), *[pa.int32()] * 2, pa.int64(), *[pa.binary()] * 2))],
                names=["of", "bucket", "n", "n_ids", "lengths", "ids"],
            )

    # sorted by bucket, so that a task remembers the words of one bucket at a time
    encoded = (
        parts(coded)
        .select("block", "bucket", "words")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(encode, "of long, bucket int, n int, n_ids long, lengths binary, ids binary")
    )
    out = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def assemble(coded_rows: pa.Table, word_rows: pa.Table) -> pa.Table:
        pieces = pieces_of(path)
        total = sum(word_rows["n"].to_pylist())
        starts, lengths, flat, at = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0
        # a part's lengths and ids come back in the order in which the block lists its words
        listed = {p["bucket"]: p["places"] for p in coded_rows["parts"][0].as_py()}
        for bucket, n, n_ids, sizes, ids in zip(*(word_rows[c].to_pylist() for c in ("bucket", "n", "n_ids", "lengths", "ids"))):
            places, sizes = unpack_codes(listed[bucket], n), unpack_codes(sizes, n).astype(np.int64)
            lengths[places], starts[places] = sizes, at + np.cumsum(sizes) - sizes
            flat.append(unpack_codes(ids, n_ids))
            at += n_ids
        flat_ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        shown = np.empty(len(lengths), object)
        for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
            shown[i] = " ".join(pieces[flat_ids[a : a + n]])
        sizes = coded_rows["sizes"][0].values.to_numpy()
        codes = unpack_codes(coded_rows["codes"][0].as_py(), int(sizes.sum()))
        token_counts = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(token_counts)])
        spread = np.repeat(starts[codes] - ends[:-1], token_counts) + np.arange(ends[-1])
        word_ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = pa.ListArray.from_arrays(
            pa.array(ends[word_ends], pa.int32()), pa.array(flat_ids[spread.astype(np.int64)], pa.int32())
        )
        decoded = []
        for a, b in zip(word_ends[:-1].tolist(), word_ends[1:].tolist()):
            own = codes[a:b]
            decoded.append(" ".join(shown[own[lengths[own] > 0]]))
        keys = coded_rows["keys"][0].values
        return pa.table([keys, ids, pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    return (
        coded.select("block", "keys", "sizes", "codes", "parts")
        .groupBy("block")
        .cogroup(encoded.groupBy("of"))
        .applyInArrow(assemble, out)
    )


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids and decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
