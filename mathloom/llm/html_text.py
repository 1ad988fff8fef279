"""Main text of web pages: a recurrent labeller over the leaf blocks of a page.

A page becomes the sequence of its text blocks in page order. Each block is a vector: its path of
tags, classes and ids, hashed; all its words, hashed; its length, links and place. A bidirectional
LSTM, written in numpy, reads the whole sequence, so each block is judged in the light of all
others. It is trained on a bounded sample of pages whose own semantic tags give the labels, on
copies of them with those tags hidden and with foreign menus, comments, notices, forms and the like
put in, and on made-up pages.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH, WORDS, NUMBERS, HIDDEN = 64, 48, 8, 12
MAX_PAGES = 160  # training pages taken from the table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*/>"  # closes itself
    r"|<(script|style|noscript|template|iframe|svg|title|textarea|select)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    # no tag reaches past the next "<" outside quotes, so unclosed ones cost no more than their length
    r"|<(/?)([a-z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>"
    r"|<[!?/a-z][^<>]*>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_IN_NAME = re.compile(r"[a-z]+")
# Elements whose text runs on inside the block around them.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("p div ul ol table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre".split())
# Semantic containers: what gives the training labels.
MAIN = {"article", "main"}
BESIDE = set("nav header footer aside form head menu dialog button".split())
BESIDE_NAMES = set(
    "ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert popup modal newsletter subscribe"
    " sidebar side related recommended share social comment comments reply discussion menu nav navbar breadcrumb breadcrumbs"
    " footer header masthead copyright login signup search form pagination tags widget disclaimer".split()
)


class Path:
    """The names around a block as a link to those of the element around it, with what is asked of them.

    ``bits`` and ``bare`` are the hashed places of the names, with and without the semantic containers
    of main text; an element costs its own names only, however deep it lies.
    """

    __slots__ = ("parent", "names", "bits", "bare", "main", "beside", "depth")

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        bits, bare, main, beside, depth = (parent.bits, parent.bare, parent.main, parent.beside, parent.depth) if parent else (0, 0, False, False, 0)
        for name in names:
            place = 1 << _PATHS[name]
            bits |= place
            if name in MAIN:
                main = True
            else:
                bare |= place
            beside = beside or name in BESIDE or (name[0] == "." and name[1:] in BESIDE_NAMES)
        self.bits, self.bare, self.main, self.beside, self.depth = bits, bare, main, beside, depth + len(names)


class Block:
    """A leaf block; ``bare`` hides the semantic containers from the labeller."""

    __slots__ = ("text", "path", "links", "bare")

    def __init__(self, text: str, path: Path | None, links: int, bare: bool = False):
        self.text, self.path, self.links, self.bare = text, path, links, bare


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, references decoded and white space squeezed."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else None, links))
        parts.clear()
        links = 0

    def close(at: int) -> None:
        while len(stack) > at:
            open_tags[stack.pop()[0]] -= 1

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if m[1] is None and (token[0] != "<" or token == "<"):
                token = html.unescape(token)
                parts.append(token)
                if any(t == "a" for t, _ in stack[-3:]):
                    links += len(token)
            elif m[1] is not None:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag in CLOSES_P and open_tags["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag == "li" and open_tags["li"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol"):
                        break
                    if stack[i][0] == "li":
                        close(i)
                        break
            names = (tag,)
            if m[4]:
                for found in NAMED.finditer(m[4].lower()):
                    names += tuple("." + w for w in WORD_IN_NAME.findall(next(g for g in found.groups() if g is not None)))
            stack.append((tag, Path(stack[-1][1] if stack else None, names)))
            open_tags[tag] += 1
    flush()
    return out


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by a page's semantic tags; none where the page has no main element."""
    if not any(b.path and b.path.main for b in blocks):
        return None
    return [int(bool(b.path and b.path.main and not b.path.beside)) for b in blocks]


class _Places(dict):
    """Hashed places of names; forgets all beyond a bound."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = place = zlib.crc32(name.lower().encode("utf-8", "replace")) % self.n
        return place


_PATHS, _WORDS = _Places(PATH), _Places(WORDS)
MARKS = re.compile(r"[.,;:!?]")


_BIT = 1 << np.arange(PATH, dtype=np.uint64)


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row a block: hashed path, hashed words, numbers; of all its words and its whole text."""
    n = len(blocks)
    masks = np.array([0 if b.path is None else b.path.bare if b.bare else b.path.bits for b in blocks], np.uint64)
    path = ((masks[:, None] & _BIT) > 0).astype(float)
    rows, cols, numbers = [], [], []
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        rows.append(len(words))
        cols += map(_WORDS.__getitem__, words)
        size = len(b.text)
        numbers.append(
            (
                math.log1p(size) / 6,
                math.log1p(len(words)) / 5,
                min(1.0, b.links / size),
                min(1.0, 8 * len(MARKS.findall(b.text)) / size),
                b.text[-1] in ".!?\"",
                i / n,
                min(4.0, (b.path.depth if b.path else 0) / 8),
                1.0,
            )
        )
    row = np.repeat(np.arange(n), rows)
    bag = np.bincount(row * WORDS + np.array(cols), minlength=n * WORDS).reshape(n, WORDS)
    bag = bag / np.maximum(1.0, np.sqrt((bag**2).sum(1, keepdims=True)))
    return np.hstack([path, bag, np.array(numbers, float)])


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = PATH + WORDS + NUMBERS, HIDDEN
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = r.normal(0, 0.15, (d, 4 * h))
            self.p[f"h{way}"] = r.normal(0, 0.15, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1  # remember at first
            self.p[f"b{way}"] = bias
        self.p["o"] = r.normal(0, 0.15, 2 * h)
        self.p["c"] = np.zeros(1)

    @staticmethod
    def _batch(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded sequences, their lengths, and for each place its place in the reversed sequence."""
        lengths = np.array([len(s) for s in sequences])
        x = np.zeros((len(sequences), lengths.max(), sequences[0].shape[1]))
        for i, s in enumerate(sequences):
            x[i, : len(s)] = s
        step = np.arange(x.shape[1])
        turned = np.where(step < lengths[:, None], lengths[:, None] - 1 - step, step)
        return x, lengths, turned

    def _run(self, x: np.ndarray, way: str, learns: bool = False):
        h = HIDDEN
        inputs = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        n, steps = x.shape[:2]
        out, cell, kept = np.zeros((n, h)), np.zeros((n, h)), []
        states = np.zeros((n, steps, h))
        for t in range(steps):
            z = inputs[:, t] + out @ self.p[f"h{way}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, last = cell, out
            cell = f * before + i * new
            squashed = np.tanh(cell)
            out = o * squashed
            states[:, t] = out
            if learns:
                kept.append((i, f, o, new, before, squashed, last))
        return states, kept

    def _back(self, x: np.ndarray, way: str, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        n, steps = x.shape[:2]
        dz_all = np.zeros((n, steps, 4 * h))
        d_out, d_cell, d_h = np.zeros((n, h)), np.zeros((n, h)), np.zeros((h, 4 * h))
        for t in range(steps - 1, -1, -1):
            i, f, o, new, before, squashed, last = kept[t]
            d_now = d_states[:, t] + d_out
            d_cell = d_cell + d_now * o * (1 - squashed**2)
            dz = np.hstack(
                [
                    d_cell * new * i * (1 - i),
                    d_cell * before * f * (1 - f),
                    d_now * squashed * o * (1 - o),
                    d_cell * i * (1 - new**2),
                ]
            )
            d_h += last.T @ dz
            d_out = dz @ self.p[f"h{way}"].T
            d_cell = d_cell * f
            dz_all[:, t] = dz
        return {f"x{way}": np.einsum("ntd,ntk->dk", x, dz_all, optimize=True), f"h{way}": d_h, f"b{way}": dz_all.sum((0, 1))}

    def logits(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        x, lengths, turned = self._batch(sequences)
        forth, _ = self._run(x, "f")
        back, _ = self._run(np.take_along_axis(x, turned[:, :, None], 1), "b")
        both = np.concatenate([forth, np.take_along_axis(back, turned[:, :, None], 1)], 2)
        z = both @ self.p["o"] + self.p["c"]
        return [z[i, :n] for i, n in enumerate(lengths)]

    def fit(self, sequences: list[np.ndarray], labels: list[list[int]], epochs: int = 12, size: int = 32, rate: float = 0.01):
        r = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        by_length = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        parts = [by_length[a : a + size] for a in range(0, len(by_length), size)]
        for _ in range(epochs):
            for k in r.permutation(len(parts)):
                part = parts[k]
                x, lengths, turned = self._batch([sequences[i] for i in part])
                y = np.zeros(x.shape[:2])
                for row, i in enumerate(part):
                    y[row, : lengths[row]] = labels[i]
                mask = np.arange(x.shape[1]) < lengths[:, None]
                x_back = np.take_along_axis(x, turned[:, :, None], 1)
                forth, kept_f = self._run(x, "f", learns=True)
                back, kept_b = self._run(x_back, "b", learns=True)
                both = np.concatenate([forth, np.take_along_axis(back, turned[:, :, None], 1)], 2)
                z = both @ self.p["o"] + self.p["c"]
                dz = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / mask.sum()
                d_both = dz[:, :, None] * self.p["o"]
                grads = {"o": np.einsum("ntk,nt->k", both, dz), "c": np.array([dz.sum()])}
                grads |= self._back(x, "f", kept_f, d_both[:, :, :HIDDEN])
                d_back = np.take_along_axis(d_both[:, :, HIDDEN:], turned[:, :, None], 1)
                grads |= self._back(x_back, "b", kept_b, d_back)
                step += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.999 * s[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
        return self


def _foreign(r: random.Random, pool: list[str]) -> list[Block]:
    """A stretch of blocks that is not main text, as pages have them."""
    name = r.choice(sorted(BESIDE_NAMES))
    tag = r.choice(["div", "section", "aside", "ul", "p", "form", "nav", "footer", "header"])
    outer = ("html", "body") + (r.choice([("article",), ("main",), (), ()]))
    out = []
    for _ in range(r.choice([1, 1, 2, 4, 8])):
        text = r.choice(pool)
        text = text if name.startswith(("comment", "reply", "discussion")) else " ".join(text.split(" ")[: r.randint(1, 14)])
        link = len(text) if tag in ("ul", "nav") or r.random() < 0.3 else 0
        path = outer + (tag, "." + name) + (("li", "a") if link else r.choice([(), ("p",), ("span",)]))
        out.append(Block(text, Path(None, path), link))
    return out


def training_set(pages: list[str], seed: int = 11) -> tuple[list[np.ndarray], list[list[int]]]:
    """Sequences and labels of labelled pages, of changed copies, and of made-up pages."""
    r = random.Random(seed)
    known = [(b, y) for b in map(blocks_of, pages) if b and len(b) <= 400 and (y := own_labels(b)) is not None]
    pool = [x.text for b, _ in known for x in b if len(x.text) > 40][:2000]
    syllables = "ba co de fi gu la me ni ro su ta ve".split()
    while len(pool) < 200:
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(8, 60))]
        pool.append(" ".join(words).capitalize() + ".")
    examples = list(known)
    for _ in range(80):  # made-up pages
        path = ("html", "body") + r.choice([("article",), ("main",), ("div", ".content"), ("div", ".post", ".entry"), ("div",)])
        blocks = [Block(" ".join(r.choice(pool).split(" ")[:8]), Path(None, path + ("h1",)), 0)]
        blocks += [
            Block(r.choice(pool), Path(None, path + (r.choice(["p", "p", "p", "li", "h2", "blockquote"]),)), 0)
            for _ in range(r.randint(1, 12))
        ]
        examples.append((blocks, [1] * len(blocks)))
    sequences, labels = [], []
    for blocks, y in examples:
        for changed in (False, True):
            now, truth = list(blocks), list(y)
            if changed:
                hidden = r.random() < 0.5
                now = [Block(b.text, b.path, b.links, hidden) for b in now]
                inside = [i for i, v in enumerate(truth) if v]
                for _ in range(r.randint(1, 3)):
                    extra = _foreign(r, pool)
                    at = r.choice([0, len(now), r.choice(inside) + 1 if inside else 0])
                    now[at:at], truth[at:at] = extra, [0] * len(extra)
                    inside = [i for i, v in enumerate(truth) if v]
            sequences.append(vectors(now))
            labels.append(truth)
    return sequences, labels


def train(pages: DataFrame, page: str = "html", max_pages: int = MAX_PAGES) -> Labeller:
    """A labeller learnt from about ``max_pages`` pages of the table, chosen by a hash of their text."""
    rows = pages.select(pages[page].alias("page")).filter("page is not null")
    total = rows.count()
    share = min(1.0, 1.5 * max_pages / total) if total else 1.0
    deal = F.pmod(F.xxhash64("page"), F.lit(1 << 30))
    # the same pages however the table is dealt out
    chosen = rows.filter(deal < int(share * (1 << 30))).distinct().orderBy(deal, "page")
    sample = [r["page"] for r in chosen.limit(max_pages).collect()]
    return Labeller().fit(*training_set(sorted(sample)))


def extract(pages: DataFrame, model: Labeller, page: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with ``text``: the main blocks in page order, two newlines between.

    A null or empty page gives an empty string. Repeated rows stay; a column called ``text`` is
    replaced; no row is moved. Whole pages are read, whatever their length.
    """
    pages = pages.drop(text) if text != page else pages
    schema = T.StructType([*pages.schema, T.StructField(text, T.StringType())])
    at = pages.columns.index(page)
    shared = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [blocks_of(v.as_py() or "") for v in part.column(at)]
                out = [""] * len(found)
                # pages of like length are labelled together, up to a bound of padded blocks
                todo = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
                while todo:
                    longest, n = 0, 0
                    while n < len(todo) and (n + 1) * max(longest, len(found[todo[n]])) <= 8192:
                        longest, n = max(longest, len(found[todo[n]])), n + 1
                    group, todo = todo[: max(1, n)], todo[max(1, n) :]
                    for i, z in zip(group, labeller.logits([vectors(found[i]) for i in group])):
                        out[i] = "\n\n".join(b.text for b, v in zip(found[i], z) if v > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
