"""Secrets: fixed patterns, and random-looking strings found by a sliding entropy window.

Candidate strings are runs of base64 letters, cut at UUIDs and known placeholders. A window of
``window`` characters slides over a candidate; its Shannon entropy and its character class (digits,
hex, letters and digits, base64) are kept from counts that change by one character out and one in.
Each class has its own threshold. Windows above it are joined to spans, and a span that is on the
allow list (dates, words, paths, numbered names) is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns; group "s" of an assignment is the secret.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
# Bits a character that a window of random characters of the class exceeds nearly always.
THRESHOLDS = {"digits": 2.6, "hex": 3.1, "alnum": 3.6, "base64": 3.8}
# Strings that are no secrets, wherever they stand: what is beside them is read without them.
CUT = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"  # UUID
    r"|(?i:example|placeholder|changeme|xxxxx|0123456789|abcdefgh)"
)
# Spans that look random but are not secrets.
ALLOWED = [
    re.compile(p)
    for p in (
        r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}([T_-][0-9-]*)?",  # dates
        r"[A-Za-z_/=+-]+",  # words, paths and names without a digit
        r"[_/-]?([a-z]+[0-9]{0,4}[_/-])+[a-z]*[0-9]{0,4}",  # numbered names
    )
]
_SORTS = {c: i for i, chars in enumerate(("0123456789", "abcdefABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ")) for c in chars}


def windows(s: str, window: int = WINDOW) -> Iterator[tuple[int, float, str]]:
    """Start, entropy and character class of each window; counts change by one character out and one in."""
    plogp = [0.0, *(k / window * log2(k / window) for k in range(1, window + 1))]
    counts: dict[str, int] = {}
    sorts = [0, 0, 0, 0]  # digits, letters of hex, other letters, other characters
    total = 0.0
    for i, c in enumerate(s):
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += plogp[n - 1] - plogp[n]
            counts[old] = n - 1
            sorts[_SORTS.get(old, 3)] -= 1
        n = counts.get(c, 0)
        total += plogp[n + 1] - plogp[n]
        counts[c] = n + 1
        sorts[_SORTS.get(c, 3)] += 1
        if i >= window - 1:
            yield i - window + 1, -total, "base64" if sorts[3] else "alnum" if sorts[2] else "hex" if sorts[1] else "digits"


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Candidates between what the text holds of ``CUT``."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for known in CUT.finditer(text, m.start(), m.end()):
            yield at, known.start()
            at = known.end()
        yield at, m.end()


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for begin, end in _stretches(text):
        own: list[tuple[int, int]] = []
        for start, bits, kind in windows(text[begin:end], window):
            if bits >= THRESHOLDS[kind]:
                a, b = begin + start, begin + start + window
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], b)
                else:
                    own.append((a, b))
        spans += [(a, b) for a, b in own if not any(p.fullmatch(text, a, b) for p in ALLOWED)]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), leftmost and non-overlapping per kind."""
    found = []
    low = text.lower() if len(text) else text
    if any(w in low for w in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGNED:
                found.append((m.start(), m.end(), "assign", m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return found


def spans_of(text: str) -> list[tuple[int, int, str, int]]:
    """All spans by start, then kind as listed; code points, end exclusive."""
    found = base_spans(text) + [(a, b, "entropy", a) for a, b in entropy_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redacted(text: str, spans: list[tuple[int, int, str, int]], mask: str) -> str:
    """The text with each secret, overlapping spans taken together, replaced by ``mask``."""
    out, at = [], 0
    for a, b in sorted((s[3], s[1]) for s in spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def scan(
    docs: DataFrame, text: str = "text", spans: str = "spans", clean: str | None = None, mask: str = "[SECRET]"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` (array of kind, start, end) and, if asked, ``clean``.

    ``clean`` may be ``text`` itself, which then holds the redacted text. A null text has no spans
    and stays null; repeated rows stay; columns with the names of new ones are replaced. No row is
    moved: the whole text is read where it lies.
    """
    docs = docs.drop(spans, *([clean] if clean and clean != text else []))
    extra = [T.StructField(spans, T.ArrayType(SPAN))]
    if clean and clean != text:
        extra.append(T.StructField(clean, T.StringType()))
    schema = T.StructType([*docs.schema, *extra])
    at = docs.columns.index(text)
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cleaned = [], []
            for value in batch.column(at):
                t = value.as_py()
                own = spans_of(t or "")
                found.append([{"kind": k, "start": a, "end": b} for a, b, k, _ in own])
                if clean:
                    cleaned.append(redacted(t, own, mask) if own else t)
            columns = [*batch.columns, pa.array(found, arrow_span)]
            if clean == text:
                columns[at] = pa.array(cleaned, batch.column(at).type)
            elif clean:
                columns.append(pa.array(cleaned, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def joined(spans: str, kinds: tuple[str, ...] = KINDS):
    """Spans of some kinds as ``kind:start:end``, comma-joined."""
    chosen = F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
