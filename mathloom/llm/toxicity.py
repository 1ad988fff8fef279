"""Toxicity by a weighted finite-state grammar over the tokens of a clause.

Small weighted transducers read token classes: who is meant (``ADDRESSING``), negation within three
tokens (``NEGATING``) and reported speech (``REPORTING``). Their composition is one machine whose
arcs weigh the insults and threats they read and whose final weights say what the clause as a whole
is: a target and an insult or threat, in either order, make a pattern; a threat without a target is
none; an insult without one keeps part of its weight. A clause scores the sum of its words' weights
times arc and final weights. A document's score is a logistic function of its greatest and summed
clause scores, and of the sum by length. The insult lexicon (words and word beginnings, with
weights) and the logistic function are learnt from labelled rows; where labels call insults without
a target toxic, as they stand, the slopes make up for the part they lose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Closed word classes of the grammar, in English, French, German and Spanish.
CLOSED = {
    THREAT: "kill hurt destroy murder shoot burn tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yourself he she they him her them tu toi vous il elle ils du dich dir ihr sie euch usted ustedes él ella ellos",
    NEGATION: "not never no none isn't aren't don't nicht nie kein keine ne pas jamais nunca jamás tampoco",
    REPORT: "said says wrote called quoted claimed dit écrit selon sagte schrieb laut dijo escribió según",
}
THREAT_WEIGHT = 4.0
WITH_TARGET, BARE_INSULT, WITH_NEGATION, WITH_REPORT = 1.2, 0.5, 0.3, 0.5
PREFIXES = range(4, 8)  # characters of a word beginning
CLAUSE_END = re.compile(r"[.!?;:](?:\W*)$")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Transducer:
    """A machine over token classes from state 0: ``arcs[state][class]`` is (state, weight of what is
    read), ``finals[state]`` the weights of a clause's insults and of its threats that ends there."""

    arcs: tuple[tuple[tuple[int, float], ...], ...]
    finals: tuple[tuple[float, float], ...]


def _machine(states: int, arc: Callable[[int, int], tuple[int, float]], final: Callable[[int], tuple[float, float]]) -> Transducer:
    return Transducer(
        tuple(tuple(arc(q, kind) for kind in range(6)) for q in range(states)), tuple(final(q) for q in range(states))
    )


# No target yet, or one: it makes patterns of all insults and threats of its clause.
ADDRESSING = _machine(
    2,
    lambda q, kind: (int(q or kind == TARGET), 1.0),
    lambda q: (WITH_TARGET, WITH_TARGET) if q else (BARE_INSULT, 0.0),
)
# Tokens that a negation still reaches.
NEGATING = _machine(
    4,
    lambda q, kind: (3 if kind == NEGATION else max(0, q - 1), WITH_NEGATION if q and kind in (INSULT, THREAT) else 1.0),
    lambda q: (1.0, 1.0),
)
# Whose words these are: reporting may stand before or after them.
REPORTING = _machine(
    2,
    lambda q, kind: (int(q or kind == REPORT), 1.0),
    lambda q: (WITH_REPORT, WITH_REPORT) if q else (1.0, 1.0),
)


def compose(*machines: Transducer) -> Transducer:
    """The machine that runs all of them at once: states that can be reached, weights multiplied."""
    places, waiting = {(0,) * len(machines): 0}, [(0,) * len(machines)]
    arcs, finals = [], []
    for state in waiting:
        row = []
        for kind in range(6):
            steps = [m.arcs[q][kind] for m, q in zip(machines, state)]
            after = tuple(q for q, _ in steps)
            if after not in places:
                places[after] = len(places)
                waiting.append(after)
            row.append((places[after], prod(w for _, w in steps)))
        arcs.append(tuple(row))
        finals.append(tuple(prod(m.finals[q][i] for m, q in zip(machines, state)) for i in (0, 1)))
    return Transducer(tuple(arcs), tuple(finals))


GRAMMAR = compose(ADDRESSING, NEGATING, REPORTING)
_CLASS_OF = {w: kind for kind, words in CLOSED.items() for w in words.split()}


@dataclass(frozen=True)
class Model:
    """Documents with each lexicon entry by class, and the logistic weights; bounded by the labelled rows."""

    terms: dict[str, tuple[int, int]]
    positive: int
    negative: int
    weights: tuple[float, ...]


def _features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _weight(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Log-odds of an entry; entries of few documents, or of clean ones, weigh nothing."""
    if pos < 3:
        return 0.0
    found = np.log((pos + 0.5) / (all_pos + 1)) - np.log((neg + 0.5) / (all_neg + 1))
    return float(found) if found >= 2.0 and pos >= 4 * neg else 0.0


class _Reader:
    """Token to code, remembered per worker and label of its document up to a bound."""

    def __init__(self, model: Model):
        self.model, self.codes = model, {None: {}, 0: {}, 1: {}}

    def term(self, word: str, own: int | None = None) -> float:
        """The weight of a word, without the document itself where its label is given."""
        best = 0.0
        for f in _features(word):
            if f in self.model.terms:
                pos, neg = self.model.terms[f]
                p, n = self.model.positive, self.model.negative
                if own is not None:
                    pos, neg, p, n = pos - own, neg - (1 - own), p - own, n - (1 - own)
                best = max(best, _weight(pos, neg, p, n))
        return best

    def read(self, token: str, own: int | None = None) -> tuple[int, float, bool]:
        word = TRIM.sub("", token).lower()
        kind, weight = _CLASS_OF.get(word, OTHER), 0.0
        if found := self.term(word, own):
            kind, weight = INSULT, found
        elif kind == THREAT:
            weight = THREAT_WEIGHT
        return kind, weight, bool(CLAUSE_END.search(token))

    def matched(self, tokens: list[str], own: int | None = None) -> list[float]:
        """Scores of the clauses in which an insult or threat is met."""
        known = self.codes[own]
        if len(known) > 500_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self.read(t, own)
        read = [known[t] for t in tokens]
        if not any(weight for _, weight, _ in read):
            return []
        out, state, sums = [], 0, [0.0, 0.0]

        def close() -> None:
            score = sum(x * y for x, y in zip(sums, GRAMMAR.finals[state]))
            if score:
                out.append(score)

        for kind, weight, ends in read:
            state, factor = GRAMMAR.arcs[state][kind]
            if weight:
                sums[kind == THREAT] += factor * weight
            if ends:
                close()
                state, sums = 0, [0.0, 0.0]
        close()
        return out


def _document(clauses: list[float], tokens: int) -> tuple[float, ...]:
    """A one, the greatest clause score, their sum, and the sum in a hundred tokens."""
    total = sum(clauses)
    return 1.0, max(clauses, default=0.0), float(np.log1p(total)), float(np.log1p(100 * total / max(tokens, 1)))


def _probability(weights: tuple[float, ...], features: tuple[float, ...]) -> float:
    z = float(np.dot(weights, features))
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge; a slope that turns negative is left out and the rest fitted again."""
    used = list(range(x.shape[1]))
    while True:
        w, z = np.zeros(len(used)), x[:, used]
        ridge = np.diag([1e-3, *[0.05] * (len(used) - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge + 1e-9 * np.eye(len(used)), z.T @ (p - y) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        kept = [i for i, v in zip(used, w) if not i or v >= 0]
        if kept == used:
            out = np.zeros(x.shape[1])
            out[used] = w
            return tuple(out.tolist())
        used = kept


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 20_000,
) -> Model:
    """Learn from the rows of ``labels``, at most about ``max_rows`` of them, chosen by a hash of the key.

    Of copies (equal but for case and white space, by the digest of the whole text) one stands for
    all, so that a text copied often does not make its words insults. Texts that differ in any word
    all count. Without rows of both classes the lexicon is empty.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    docs = docs.select(docs[key].alias("_id"), docs[text].alias("_text"))  # other columns may have any names
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(max_rows * (1 << 20) / total))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("_text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    sample = (
        docs.join(F.broadcast(known), F.col("_id") == F.col("_key"))  # max_rows rows at most
        .select("_label", "_text", F.sha2(plain.cast("binary"), 256).alias("_copy"))
        .dropDuplicates(["_copy", "_label"])
        .select("_label", "_text")
    )

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = {TRIM.sub("", w).lower() for w in set((t or "").split())}
                seen[y].update({f for w in tokens if w for f in _features(w)})
                rows[y] += 1

        terms = sorted(seen[0].keys() | seen[1].keys())
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            columns = [pa.array(part), *(pa.array([s[f] for f in part], pa.int64()) for s in (seen[1], seen[0]))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "pos", "neg"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.string()), pa.array([rows[1]], pa.int64()), pa.array([rows[0]], pa.int64())],
            names=["term", "pos", "neg"],
        )

    counted = (
        sample.mapInArrow(documents_with, "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter("term is null or (pos >= 3 and pos >= 4 * neg)")
        .collect()
    )  # entries of three rows or more of a sample of max_rows
    totals = next((r for r in counted if r["term"] is None), None)
    pos, neg = (totals["pos"], totals["neg"]) if totals else (0, 0)
    terms = {r["term"]: (r["pos"], r["neg"]) for r in counted if r["term"] is not None}
    model = Model(terms if pos and neg else {}, pos, neg, (0.0,) * 4)
    if not (pos and neg):
        share = np.log((pos + 0.5) / (neg + 0.5)) if pos or neg else -2.0
        return Model({}, pos, neg, (float(share), 0.0, 0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for batch in batches:
            labels_, found = batch.column(0).to_pylist(), []
            for y, t in zip(labels_, batch.column(1)):
                tokens = (t.as_py() or "").split()
                found.append(_document(reader.matched(tokens, y), len(tokens)))
            columns = [pa.array(labels_, pa.int32()), *(pa.array([f[i] for f in found], pa.float64()) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "most", "sum", "dense"])

    rows = sample.mapInArrow(left_out, "y int, most double, sum double, dense double").collect()  # max_rows rows of four numbers
    rows.sort()  # the same sums on every run
    x = np.array([[1.0, *r[1:]] for r in rows])
    return Model(terms, pos, neg, _fit_logistic(x, np.array([r["y"] for r in rows], float)))


def annotate(
    docs: DataFrame, model: Model, text: str = "text", score: str = "score", clauses: str = "clauses"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``clauses`` (weights of matched clauses).

    A null or empty text has no clauses and gets the score of any text without one. A column of
    ``docs`` that has one of the two names is replaced. Repeated rows stay; no row is moved.
    """
    docs = docs.drop(score, clauses)
    schema = T.StructType(
        [*docs.schema, T.StructField(score, T.DoubleType()), T.StructField(clauses, T.ArrayType(T.DoubleType()))]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for batch in batches:
            found, scores = [], []
            for t in batch.column(at):  # one text's tokens at a time
                tokens = (t.as_py() or "").split()
                found.append(reader.matched(tokens))
                scores.append(_probability(shared.value.weights, _document(found[-1], len(tokens))))
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def folded(key: str = "doc_id") -> Column:
    """Rows nothing is learnt from: the remainder of crc32 of the key by three is one."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
