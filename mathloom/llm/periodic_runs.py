"""Periodic runs of words: an online sparse dynamic program over diagonals.

A diagonal is a lag ``q``: the places ``i`` where word ``i`` equals word ``i - q``. A word's earlier
occurrences open diagonals; an active diagonal's match length grows with every further equal word,
and at the first unequal one it ends. If it is long enough and ``q`` is the stretch's smallest
period, its run is emitted at once.

Taking *all* earlier occurrences of a word would be quadratic in a text that repeats it. So that the
program stays sparse, a word's earlier occurrences are looked up with ``k = 1, 2, 4, ...`` words of
context, and of each only the nearest one with a lag in ``[k, 2k)`` opens a diagonal. No run is
lost: let a run have the smallest period ``q`` in ``[k, 2k)``. If every word sequence of length
``k`` stood twice in a period there would be at most ``q / 2 <= k`` of them, yet a word sequence of
smallest period ``q`` has at least ``min(k + 1, q)``, which is more; so one stands once in a period,
and its nearest earlier occurrence is exactly ``q`` before. Contexts are exact ranks, doubled from
level to level, and only places whose context occurs again in the text reach the next level: plain
prose ends after a few, and any text costs O(n log n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A run has at least this many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

# Words that are looked at together; a longer text is looked at alone.
GROUP_WORDS = 400_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense ranks of the keys, their order, and where in that order a key equals the one before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(~same)
    return ranks, order, same


def openings(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which an earlier occurrence opens a diagonal.

    ``codes`` names the words; no text shares a code with another one. ``longest`` is the number
    of words of the longest text. An opening whose words differ within the next two lags is left
    out, for every run has one where they do not.
    """
    n = len(codes)
    rank = codes.astype(np.int64)
    alive = np.arange(n)
    places, lags, k = [], [], 1
    while len(alive) and k * LEAST_PERIODS <= longest:
        keys = rank[alive]
        if k == 1:
            again = np.bincount(keys)[keys] > 1
            here = alive[1:][(keys[1:] == keys[:-1]) & (alive[1:] == alive[:-1] + 1)]
            lag = np.ones(len(here), np.int64)
        else:
            ranks, order, same = _ranks(keys)
            rank = np.full(n, -1, np.int64)
            rank[alive] = ranks
            before, after = alive[order[:-1]][same[1:]], alive[order[1:]][same[1:]]
            near = (after - before >= k) & (after - before < 2 * k)
            here, lag = after[near], (after - before)[near]
            again = np.zeros(len(alive), bool)
            again[order] = same
            again[order[:-1]] |= same[1:]
        for last in (False, True):  # the next context, and the last one within two lags
            at = here + (2 * lag - k if last else k)
            ok = at < n
            ok[ok] = (rank[at[ok]] >= 0) & (rank[at[ok]] == rank[(at - lag)[ok]])
            here, lag = here[ok], lag[ok]
        places.append(here)
        lags.append(lag)
        recurs = np.zeros(n, bool)
        recurs[alive[again]] = True
        alive = np.flatnonzero(recurs[: n - k] & recurs[k:])
        wide = np.full(n, -1, np.int64)
        wide[alive] = rank[alive] * (n + 1) + rank[alive + k]
        rank, k = wide, 2 * k
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def _grown(codes: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place from ``at`` on, before ``end``, that ends the diagonal."""
    step = 64
    while at < end:
        to = min(at + step, end)
        unequal = codes[at:to] != codes[at - lag : to - lag]
        if unequal.any():
            return at + int(unequal.argmax())
        at, step = to, 2 * step
    return end


def _begun(codes: np.ndarray, at: int, lag: int, first: int) -> int:
    """The least place, at least ``first``, from which the diagonal matches up to ``at``."""
    step = 64
    while at > first:
        to = max(at - step, first)
        unequal = codes[to:at] != codes[to - lag : at - lag]
        if unequal.any():
            return at - int(unequal[::-1].argmax())
        at, step = to, 2 * step
    return first


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _smallest(codes: np.ndarray, start: int, period: int) -> bool:
    """Whether the first period is no power: with four periods a smaller one would divide it."""
    root = codes[start : start + period]
    return not any(np.array_equal(root[period // r :], root[: -(period // r)]) for r in _primes(period))


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(text, start, length, period)`` of every run; text ``t`` has words ``bounds[t]:bounds[t + 1]``."""
    places, lags = openings(codes, int(np.diff(bounds).max(initial=0)))
    found: list[tuple[int, int, int, int]] = []
    active: dict[int, int] = {}  # lag -> where its last diagonal ended
    texts = np.searchsorted(bounds, places, side="right") - 1
    for place, lag, text in zip(places.tolist(), lags.tolist(), texts.tolist()):
        if active.get(lag, -1) > place:
            continue  # the diagonal is active
        first, end = int(bounds[text]), int(bounds[text + 1])
        begin = _begun(codes, place, lag, first + lag)
        active[lag] = stop = _grown(codes, place, lag, end)
        start, length = begin - lag, stop - begin + lag
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag) and _smallest(codes, start, lag):
            found.append((text, start - first, length, lag))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those inside a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_words`` (long), ``runs`` and ``collapsed``.

    ``runs`` lists ``start, length, period`` of every run by start, then period. ``collapsed`` is
    the text with each run cut to its first period, words joined by one space. Words are what ASCII
    white space separates; null and empty texts have none, so no runs and an empty ``collapsed``.
    Runs of different periods may overlap and are all listed. Every row is looked at alone, so
    repeated rows and null keys need no care, an empty table gives no rows, and other columns are
    not read. Texts are looked at whole, whatever their length.
    """
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    run_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            split: list[list[bytes]] = []
            codes: list[np.ndarray] = []
            held, names, start = 0, 0, 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                own: dict[bytes, int] = {}
                codes.append(np.fromiter([own.setdefault(w, len(own)) for w in words], np.int64, len(words)) + names)
                split.append(words)
                held, names = held + len(words), names + len(own)
                if held >= GROUP_WORDS or i + 1 == batch.num_rows:
                    bounds = np.r_[0, np.cumsum([len(w) for w in split])]
                    listed: list[list[tuple[int, int, int]]] = [[] for _ in split]
                    for t, *run in runs_of(np.concatenate(codes), bounds):
                        listed[t].append(tuple(run))
                    kept = [collapsed(w, r) if r else b" ".join(w) for w, r in zip(split, listed)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(start, i + 1 - start),
                            pa.array([len(w) for w in split], pa.int64()),
                            pa.array([[dict(zip(RUN.names, r)) for r in rs] for rs in listed], run_type),
                            pa.array(kept, pa.binary()).cast(pa.string()),
                        ],
                        names=schema.names,
                    )
                    split, codes, held, names, start = [], [], 0, 0, i + 1

    return docs.select(docs[key], docs[text]).mapInArrow(look, schema)
