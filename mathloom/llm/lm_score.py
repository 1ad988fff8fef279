"""Language-model scores by prediction by partial matching over words and the bytes of words.

A text is its lower-cased words, each followed by an end-of-word symbol, and one end of text. The
longest context of a word is the word before it, of a text's first word the end of a text. A word
which that context has not seen costs an escape, and is spelled. The context of a byte is first all
of its word so far (up to ``DEPTH`` bytes: a trie anchored at the word start), then the last two
bytes, one, none, and at last all symbols alike; the first byte of a word is coded from the last two
bytes of the word before. A symbol that a context of bytes has not seen costs an escape; symbols that
a longer one has seen are excluded from the shorter one. Escapes are estimated per class of context
from the training words themselves, by leaving out one event at a time. Contexts of two bytes learn
only where the anchored context met something new, so they describe new words; the bytes of a word
beyond ``DEPTH`` are spelled from them and from nothing longer.

But for its first byte, a word's spelling depends on the word alone, so each distinct word is spelled
once. The corpus is gathered as a table of distinct words with training counts and range-partitioned:
every task holds a stretch of the sorted words and with it whole sub-tries. The nodes that cross
borders are prefixes of the words at the borders: they are counted over all tasks and handed back, at
most ``2 * DEPTH`` nodes a border. The two-byte contexts have at most 2**16 * 257 counts.

Word contexts are counted by pairs of word numbers. A block of documents names each of its pairs
once; pairs are dealt to buckets by a hash of both words, so that a frequent word's successors lie in
all buckets, and only counts go back. How often a word is a context is its own count, since every
word has a successor, so no context is gathered anywhere.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import buckets_of, coded_blocks, kept, list_of, pack_bytes, pack_codes, parts, unpack_bytes, unpack_codes, word_bucket

DEPTH = 32  # bytes of the longest anchored context
END_WORD = 256  # the symbol after the last byte of a word
END_TEXT = b" "  # stands for the end of a text; no word holds a space
SYMBOLS = 257
T_CLASSES, D_CLASSES = 24, 6


def _classes(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Class of a context by the logs of its events and of its distinct symbols."""
    t = np.minimum(np.log2(np.maximum(total, 1)).astype(int), T_CLASSES - 1)
    d = np.minimum(np.log2(np.maximum(distinct, 1)).astype(int), D_CLASSES - 1)
    return t * D_CLASSES + d


class _Trie:
    """The anchored trie of sorted distinct words, as arrays: one node and one edge id a depth."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        n = len(words)
        self.words, self.counts = words, counts.astype(np.float64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        grid = np.full((n, DEPTH + 1), END_WORD, np.uint16)
        for i, w in enumerate(words):
            cut = w[: DEPTH + 1]
            grid[i, : len(cut)] = np.frombuffer(cut, np.uint8)
        self.grid = grid
        same = grid[1:] == grid[:-1]
        self.shared = np.zeros(n, np.int64)
        self.shared[1:] = np.where(same.all(1), DEPTH + 1, np.argmin(same, 1))

    def depth(self, d: int):
        """For depth d: rows that have it, node of each, edge of each, counts by edge, edge's node and symbol."""
        has = np.flatnonzero((self.lengths >= d) if d == 0 else (self.lengths >= d) & (self.grid[:, 0] != 32))
        if not len(has):
            return None
        # the least shared length between a row and the one before it that has this depth
        gap = np.minimum.reduceat(self.shared, np.r_[0, has[:-1] + 1])
        gap[0] = -1
        node = np.cumsum(gap < d) - 1
        edge = np.cumsum(gap < d + 1) - 1
        first = np.flatnonzero(np.r_[True, np.diff(edge) > 0])
        by_edge = np.bincount(edge, self.counts[has])
        return has, node, edge, by_edge, node[first], self.grid[has[first], d].astype(np.int64), has[first]


class _Backoff:
    """Orders two, one and none, and the uniform order below, with exclusion."""

    def __init__(self, pairs: dict[tuple[bytes, int], int]):
        self.two: dict[bytes, dict[int, int]] = defaultdict(dict)
        for (context, symbol), count in pairs.items():
            if count > 0:
                self.two[context][symbol] = count
        self.one: dict[bytes, Counter] = defaultdict(Counter)
        self.none: Counter = Counter()
        for context, seen in self.two.items():
            self.one[context[1:]].update(seen.keys())
        for seen in self.one.values():
            self.none.update(seen.keys())
        self.known: dict[tuple[bytes, int], float] = {}

    def log10(self, context: bytes, symbol: int, excluded=frozenset()) -> float:
        if not excluded and (found := self.known.get((context, symbol))) is not None:
            return found
        out, gone = 0.0, set(excluded)
        for seen in (self.two.get(context), self.one.get(context[1:]), self.none):
            fresh = {a: c for a, c in (seen or {}).items() if a not in gone}
            if not fresh:
                continue
            total = sum(fresh.values()) + len(fresh)
            if symbol in fresh:
                out += math.log10(fresh[symbol] / total)
                break
            out += math.log10(len(fresh) / total)
            gone.update(fresh)
        else:
            out -= math.log10(max(1, SYMBOLS - len(gone)))
        if not excluded:
            self.known[(context, symbol)] = out
        return out


def _joint(word: bytes) -> int:
    """Last two bytes and first symbol of a word in one number."""
    tail = (b"  " + word)[-2:]
    return (tail[0] << 17) | (tail[1] << 9) | word[0]


def _transitions(codes: np.ndarray, sizes: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """For every word the last two bytes of the word before (of an end at a start) and its first symbol."""
    before = np.empty(len(codes), np.int64)
    before[1:] = joint[codes[:-1]] >> 9
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = _joint(END_TEXT) >> 9
    return (before << 9) | (joint[codes] & 511)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol begins a word after each two bytes, in training documents."""
    for batch in batches:
        for held, sizes, listed, codes in zip(*(batch.column(i) for i in range(4))):
            sizes = sizes.values.to_numpy().astype(np.int64)
            flat = unpack_codes(codes.as_py(), int(sizes.sum()))
            listed = listed.as_py()
            joint = np.zeros(sum(p["n"] for p in listed), np.int64)
            for p in listed:
                joint[unpack_codes(p["places"], p["n"])] = [_joint(w) for w in unpack_bytes(p["words"]).split(b"\n")]
            learn = np.repeat(~held.values.to_numpy(zero_copy_only=False), sizes)
            keys, n = np.unique(_transitions(flat, sizes, joint)[learn], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])


class _FirstBytes:
    """The first byte of a word after the last two bytes of another, then after nothing."""

    def __init__(self, rows: list[tuple[int, int]], root: dict[int, int]):
        self.after: dict[int, dict[int, int]] = defaultdict(dict)
        for key, n in rows:
            self.after[key >> 9][key & 511] = n
        self.root = root

    def log10(self, key: int) -> float:
        out, gone, symbol = 0.0, set(), key & 511
        for seen in (self.after.get(key >> 9), self.root):
            fresh = {a: c for a, c in (seen or {}).items() if a not in gone}
            if not fresh:
                continue
            total = sum(fresh.values()) + len(fresh)
            if symbol in fresh:
                return out + math.log10(fresh[symbol] / total)
            out += math.log10(len(fresh) / total)
            gone.update(fresh)
        return out - math.log10(max(1, SYMBOLS - len(gone)))


_opened: list = [None, None]


def _first_bytes(shared) -> _FirstBytes:
    """The table of a broadcast variable, built once per worker process."""
    if _opened[0] is not shared.value:
        _opened[:] = shared.value, _FirstBytes(*shared.value)
    return _opened[1]


def _gathered(batches: Iterator[pa.RecordBatch]):
    words, counts = [], []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy(zero_copy_only=False))
    return words, np.concatenate(counts) if counts else np.zeros(0)


def _last_two(word: bytes, at: int) -> bytes:
    return (b"  " + word)[at : at + 2]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one stretch of sorted words: border nodes, two-byte contexts and escape classes."""
    words, counts = _gathered(batches)
    if not words:
        return
    trie, border, pairs = _Trie(words, counts), {}, Counter()
    novel, events = np.zeros(T_CLASSES * D_CLASSES), np.zeros(T_CLASSES * D_CLASSES)
    outer = {w[:d] for w in (words[0], words[-1]) for d in range(min(len(w), DEPTH) + 1)}
    for d in range(DEPTH + 1):
        level = trie.depth(d)
        if level is None:
            break
        has, node, edge, by_edge, edge_node, symbol, row = level
        seen = by_edge > 0
        nodes = int(node[-1]) + 1
        total = np.bincount(edge_node, by_edge, nodes)
        distinct = np.bincount(edge_node[seen], minlength=nodes)
        single = np.bincount(edge_node[by_edge == 1], minlength=nodes)
        crossing = np.zeros(nodes, bool)
        node_row = has[np.flatnonzero(np.r_[True, np.diff(node) > 0])]
        for i in {0, nodes - 1}:
            crossing[i] = words[node_row[i]][:d] in outer
        for e in np.flatnonzero(crossing[edge_node] & seen):
            border[(words[row[e]][:d], int(symbol[e]))] = int(by_edge[e])
        _escape_events(novel, events, total, distinct, single, ~crossing)
        two = np.zeros(len(symbol), np.int64)
        for back in (2, 1):
            two = two * 256 + (trie.grid[row, d - back] if d >= back else 32)
        keys, times = np.unique((two * 512 + symbol)[seen], return_counts=True)
        for k, c in zip(keys.tolist(), times.tolist()):
            pairs[k] += c
    kinds = [("border", p, s, c) for (p, s), c in border.items()]
    kinds += [("pair", bytes([k >> 17, (k >> 9) & 255]), k & 511, c) for k, c in pairs.items()]
    kinds += [("novel", b"", int(i), int(novel[i])) for i in np.flatnonzero(novel)]
    kinds += [("event", b"", int(i), int(events[i])) for i in np.flatnonzero(events)]
    together = defaultdict(list)
    for kind, context, symbol, count in kinds:
        together[(kind, context[-1] if context else 0)].append((context, symbol, count))
    for (kind, part), rows in together.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([part], pa.int32()), *(list_of(pa.array(c, t)) for c, t in zip(zip(*rows), _ROW))],
            names=["kind", "part", "contexts", "symbols", "counts"],
        )


_ROW = (pa.binary(), pa.int32(), pa.int64())


def _merged(table: pa.Table) -> pa.Table:
    """Sums of the rows that several stretches have of one kind and last byte."""
    sums, times = Counter(), Counter()
    for contexts, symbols, counts in zip(*(table[c].to_pylist() for c in ("contexts", "symbols", "counts"))):
        for key in zip(contexts, symbols, counts):
            sums[key[:2]] += key[2]
            times[key[:2]] += 1
    keys = list(sums)
    columns = [[table["kind"][0].as_py()] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [sums[k] for k in keys], [times[k] for k in keys]]
    types = (pa.string(), *_ROW, pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "context", "symbol", "count", "parts"])


def _escape_events(novel, events, total, distinct, single, use) -> None:
    """Leaving out one event: was its symbol new to the context, seen from the class before it?"""
    ok = use & (total >= 2)
    t, d, s = total[ok], distinct[ok], single[ok]
    np.add.at(novel, _classes(t - 1, d - 1), s * (d > 1))
    np.add.at(events, _classes(t - 1, d - 1), s * (d > 1))
    np.add.at(events, _classes(t - 1, d), t - s)


class _Model:
    """What every task needs besides its own words; its size is bounded (see above)."""

    def __init__(self, rows):
        self.border: dict[bytes, dict[int, int]] = defaultdict(dict)
        pairs: dict[tuple[bytes, int], int] = Counter()
        novel, events = np.zeros(T_CLASSES * D_CLASSES), np.zeros(T_CLASSES * D_CLASSES)
        for r in rows:
            context = bytes(r["context"])
            if r["kind"] == "border":
                self.border[context][r["symbol"]] = r["count"]
                # an edge that several stretches share is new only once
                pairs[(_last_two(context, len(context)), r["symbol"])] -= r["parts"] - 1
            elif r["kind"] == "pair":
                pairs[(context, r["symbol"])] += r["count"]
            else:
                (novel if r["kind"] == "novel" else events)[r["symbol"]] += r["count"]
        for seen in self.border.values():
            counts = np.array(list(seen.values()), float)
            one = np.ones(1)
            _escape_events(novel, events, one * counts.sum(), one * len(counts), one * (counts == 1).sum(), np.ones(1, bool))
        self.escape = (novel + 0.5) / (events + 1.0)
        self.backoff = _Backoff(pairs)


def _scored(words: list[bytes], counts: np.ndarray, model: _Model) -> np.ndarray:
    """log10 probability of each of a stretch of sorted distinct words, given its first byte."""
    out = np.zeros(len(words))
    if not words:
        return out
    trie, ends, backoff = _Trie(words, counts), {words[0], words[-1]}, model.backoff
    outer = {w[:d] for w in ends for d in range(min(len(w), DEPTH) + 1)}
    for d in range(1, DEPTH + 1):
        level = trie.depth(d)
        if level is None:
            break
        has, node, edge, by_edge, edge_node, symbol, row = level
        nodes = int(node[-1]) + 1
        node_row = has[np.flatnonzero(np.r_[True, np.diff(node) > 0])]
        by_edge, extra = by_edge.copy(), {}
        for i in {0, nodes - 1}:
            prefix = words[node_row[i]][:d]
            if prefix in outer:
                extra[i] = model.border.get(prefix, {})
                own = np.flatnonzero(edge_node == i)
                by_edge[own] = [extra[i].get(int(s), 0) for s in symbol[own]]
        total = np.bincount(edge_node, by_edge, nodes)
        distinct = np.bincount(edge_node[by_edge > 0], minlength=nodes).astype(float)
        for i, seen in extra.items():
            total[i], distinct[i] = sum(seen.values()), len(seen)
        escape = np.clip(model.escape[_classes(total, distinct)], 1e-9, 1 - 1e-9)
        escape[distinct >= SYMBOLS] = 0.0
        hit = by_edge > 0
        edge_log = np.zeros(len(by_edge))
        own = edge_node[hit]
        edge_log[hit] = np.log10((1 - escape[own]) * by_edge[hit] / total[own])
        out[has] += edge_log[edge]
        # edges that training never took: escape once if the context is known, then shorter contexts
        seen_by: dict[int, frozenset] = {}
        missed = np.flatnonzero(~hit)
        if len(missed):
            edge_order = np.searchsorted(edge_node, np.arange(nodes + 1))
        for e in missed.tolist():
            i = int(edge_node[e])
            if i not in seen_by:
                if i in extra:
                    seen_by[i] = frozenset(extra[i])
                else:
                    a, b = edge_order[i], edge_order[i + 1]
                    seen_by[i] = frozenset(symbol[a:b][hit[a:b]].tolist())
            cost = math.log10(escape[i]) if total[i] > 0 else 0.0
            edge_log[e] = cost + backoff.log10(_last_two(words[row[e]], d), int(symbol[e]), seen_by[i])
        if len(missed):
            lost = ~hit[edge]
            out[has[lost]] += edge_log[edge[lost]]
    for i in np.flatnonzero(trie.lengths > DEPTH).tolist():
        word = words[i]
        for at in range(DEPTH + 1, len(word) + 1):
            out[i] += backoff.log10(_last_two(word, at), word[at] if at < len(word) else END_WORD)
    return out


NO_CLASS = 255


def _size_class(n: np.ndarray) -> np.ndarray:
    """Class of a word context by the log of its events; none without events."""
    return np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), NO_CLASS)


class _Tokens:
    """A block's words by their places, and its tokens with the place of the one before each."""

    def __init__(self, block: pa.Table, found: pa.Table):
        size = sum(found["n"].to_pylist())
        self.count, self.spelled = np.zeros(size, np.int64), np.zeros(size)
        self.joint, self.number = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        for m, *packed in zip(*(found[x].to_pylist() for x in ("n", "places", "c", "lp", "joint", "numbers"))):
            places = unpack_codes(packed[0], m)
            self.count[places] = np.frombuffer(unpack_bytes(packed[1]), "<i8")
            self.spelled[places] = np.frombuffer(packed[2], "<f4")
            self.joint[places] = unpack_codes(packed[3], m)
            self.number[places] = unpack_codes(packed[4], m)
        self.sizes = block["sizes"][0].values.to_numpy().astype(np.int64)
        self.codes = unpack_codes(block["codes"][0].as_py(), int(self.sizes.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])  # no document is without its end
        self.before = np.empty(len(self.codes), np.int64)
        self.before[1:] = self.codes[:-1]
        self.before[self.starts] = self.codes[-1]  # an end of text

    def pairs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of word numbers by bucket, the bucket of each, a token that has it, and its place for every token."""
        keys = (self.number[self.before] << np.uint64(32)) | self.number[self.codes]
        listed, first, place = np.unique(keys, return_index=True, return_inverse=True)
        mixed = (listed ^ (listed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return listed[order], bucket[order], first[order], rank[place]


def _pairs_of(buckets: int):
    """A block's pairs by bucket, with their count in its training documents and the class of their context."""

    def look(block: pa.Table, found: pa.Table) -> pa.Table:
        tokens = _Tokens(block, found)
        listed, bucket, first, place = tokens.pairs(buckets)
        learn = np.repeat(~block["held"][0].values.to_numpy(zero_copy_only=False), tokens.sizes)
        counts = np.bincount(place[learn], minlength=len(listed))
        # the class the context has without one of its events
        classes = _size_class(tokens.count[tokens.before[first]] - 1).astype(np.uint8)
        starts = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
            left, right = listed[a:b] >> np.uint64(32), listed[a:b] & np.uint64(0xFFFFFFFF)
            # sorted by the word before, whose numbers differ little
            packed = [pack_codes(np.diff(left, prepend=np.uint64(0))), pack_codes(right), pack_codes(counts[a:b]), pack_bytes(classes[a:b].tobytes())]
            rows.append((block["block"][0].as_py(), int(bucket[a]), b - a, *packed))
        types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["of", "bucket", "n", "left", "right", "counts", "classes"])

    return look


def _count_pairs(group: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's pairs for each block, and how many pairs occur once, by class."""
    sizes = group["n"].to_pylist()
    columns = [group[c].to_pylist() for c in ("left", "right", "counts", "classes")]
    keys = [
        (np.cumsum(unpack_codes(a, n), dtype=np.uint64) << np.uint64(32)) | unpack_codes(b, n)
        for n, a, b in zip(sizes, columns[0], columns[1])
    ]
    counts = np.concatenate([unpack_codes(x, n) for n, x in zip(sizes, columns[2])])
    classes = np.concatenate([np.frombuffer(unpack_bytes(x), np.uint8) for x in columns[3]])
    _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.bincount(place, counts, len(first)).astype(np.int64)
    once = np.bincount(classes[first][sums == 1], minlength=NO_CLASS + 1)
    ends = np.r_[0, np.cumsum(sizes)]
    blocks = [*group["of"].to_pylist(), None]
    return pa.table(
        [
            pa.array(blocks, pa.int64()),
            pa.array([group["bucket"][0].as_py()] * len(blocks), pa.int32()),
            pa.array([*sizes, 0], pa.int32()),
            pa.array([*(pack_codes(sums[place[a:b]]) for a, b in zip(ends, ends[1:])), None], pa.binary()),
            pa.array([[]] * len(sizes) + [once.tolist()], pa.list_(pa.int64())),
        ],
        names=["of", "bucket", "n", "totals", "once"],
    )


def _word_escapes(vocabulary: DataFrame, counted: DataFrame) -> np.ndarray:
    """For each class of word contexts how likely the next word is new to it."""
    size = F.length(F.bin(F.col("c") - 1)) - 1
    events = vocabulary.filter("c > 1").groupBy(size.alias("k")).agg(F.sum("c").alias("n")).collect()  # a row for each class
    novel = counted.filter("of is null").select(F.posexplode("once").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    seen, new = np.zeros(NO_CLASS + 1), np.zeros(NO_CLASS + 1)
    for rows, out in ((events, seen), (novel, new)):
        for r in rows:
            out[r["k"]] = r["n"]
    return np.clip((new + 0.5) / (seen + 1.0), 1e-9, 1 - 1e-9)


def score(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: token counts, a smoothed unigram score and the model's score, both log10.

    The boolean column ``held`` marks rows that nothing is learned from (null: learned from).
    Returns ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``. Null and empty
    texts are one end of text. Repeated rows count as often as they occur; an empty table gives
    no rows; columns that are not named are not read. Without training rows every symbol is
    equally likely.
    """
    coded = coded_blocks(docs, key, text, held, lower=True, end=END_TEXT)
    entries = parts(coded).select("bucket", "block", "n", "words", "places", "counts")
    buckets = buckets_of(docs.sparkSession)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, counts = None, Counter()

        def rows(done: Counter) -> Iterator[pa.RecordBatch]:
            words = list(done)
            for a in range(0, len(words), 50_000):
                own = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([done[w] for w in own], pa.int64())], names=["word", "c"]
                )

        for batch in batches:
            for b, n, words, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    yield from rows(counts)
                    bucket, counts = b, Counter()
                for w, c in zip(unpack_bytes(words).split(b"\n"), unpack_codes(found, n).tolist()):
                    counts[w] += c
        yield from rows(counts)

    # sorted by bucket, so that a task counts the words of one bucket at a time
    counted = (
        entries.select("bucket", "n", "words", "counts")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(total, "word binary, c long")
    )
    vocabulary = kept(counted.repartitionByRange("word").sortWithinPartitions("word"))
    sums = vocabulary.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0

    rows = (
        vocabulary.mapInArrow(
            _statistics, "kind string, part int, contexts array<binary>, symbols array<int>, counts array<long>"
        )
        .groupBy("kind", "part")
        .applyInArrow(_merged, "kind string, context binary, symbol int, count long, parts long")
        .collect()
    )
    starts = (
        coded.select("held", "sizes", "parts", "codes")
        .mapInArrow(_starts, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    send = docs.sparkSession.sparkContext.broadcast
    model = send([r.asDict() for r in rows])
    root = {r["symbol"]: r["count"] for r in rows if r["kind"] == "border" and not r["context"]}
    first = send(([tuple(r) for r in starts], root))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _gathered(batches)
        found = _scored(words, counts, _Model(model.value))
        for a in range(0, len(words), 50_000):
            b = a + 50_000
            bucket = pa.array([word_bucket(w, buckets) for w in words[a:b]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [bucket, pa.array(words[a:b], pa.binary()), pa.array(counts[a:b].astype(np.int64)), pa.array(found[a:b])],
                names=["in_bucket", "word", "c", "lp"],
            )

    scored = vocabulary.mapInArrow(score_words, "in_bucket int, word binary, c long, lp double")

    def place(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("word")  # words are numbered alike on every run
        words = found["word"].to_pylist()
        at = {w: i for i, w in enumerate(words)}
        c, lp = found["c"].to_numpy(), found["lp"].to_numpy().astype("<f4")
        if len(words) * buckets >= 1 << 32:
            raise ValueError("more words than numbers: raise spark.sql.shuffle.partitions")
        bucket = found["in_bucket"][0].as_py() if len(words) else 0
        joint = np.array([_joint(w) for w in words], np.int64)
        done = []
        for block, n, listed, places in zip(*(rows[x].to_pylist() for x in ("block", "n", "words", "places"))):
            own = np.array([at[w] for w in unpack_bytes(listed).split(b"\n")], np.int64)
            packed = (pack_bytes(c[own].astype("<i8").tobytes()), lp[own].tobytes(), pack_codes(joint[own]), pack_codes(own * buckets + bucket))
            done.append((block, n, places, *packed))
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        columns = [pa.array(x, t) for x, t in zip(zip(*done), types)] if done else [pa.array([], t) for t in types]
        return pa.table(columns, names=["of", "n", "places", "c", "lp", "joint", "numbers"])

    # met twice by the blocks
    placed = cut_lineage(
        entries.select("bucket", "block", "n", "words", "places")
        .groupBy("bucket")
        .cogroup(scored.groupBy("in_bucket"))
        .applyInArrow(place, "of long, n int, places binary, c binary, lp binary, joint binary, numbers binary")
    )
    blocks = coded.select("block", "keys", "held", "sizes", "codes")
    pairs = (
        blocks.groupBy("block")
        .cogroup(placed.groupBy("of"))
        .applyInArrow(_pairs_of(buckets), "of long, bucket int, n int, left binary, right binary, counts binary, classes binary")
    )
    counted_pairs = cut_lineage(
        pairs.groupBy("bucket").applyInArrow(_count_pairs, "of long, bucket int, n int, totals binary, once array<long>")
    )
    escape = _word_escapes(vocabulary, counted_pairs)
    out = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def per_document(block: pa.Table, found: pa.Table) -> pa.Table:
        is_pair = pc.is_valid(found["totals"])
        tokens, totals = _Tokens(block, found.filter(pc.invert(is_pair))), found.filter(is_pair).sort_by("bucket")
        codes, sizes, starts = tokens.codes, tokens.sizes, tokens.starts
        keys, which = np.unique(_transitions(codes, sizes, tokens.joint), return_inverse=True)
        opening = _first_bytes(first)
        spelled = tokens.spelled[codes] + np.array([opening.log10(k) for k in keys.tolist()])[which]
        # a word its context has seen, an escape from the context, or no context
        _, _, _, place = tokens.pairs(buckets)
        together = np.concatenate([unpack_codes(x, n) for x, n in zip(totals["totals"].to_pylist(), totals["n"].to_pylist())])[place]
        of_context = tokens.count[tokens.before]
        new = escape[_size_class(of_context)]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10((1 - new) * together / of_context)
        logs = np.where(together > 0, seen, np.where(of_context > 0, np.log10(new) + spelled, spelled))
        c = tokens.count[codes]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, logs)]
        arrays = [
            block["keys"][0].values,
            block["held"][0].values,
            pa.array(sizes),
            pa.array(sums[0]),
            pa.array(np.full(len(sizes), n, np.int64)),
            pa.array(sums[1]),
            pa.array(sums[2]),
        ]
        return pa.table(arrays, names=out.names)

    found = placed.unionByName(
        counted_pairs.filter("of is not null").select("of", "bucket", "n", "totals"), allowMissingColumns=True
    )
    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(per_document, out)
