"""Token alignment, sequence packing and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mathloom.llm import periodic_runs, registered, sequence_packing, token_align, tokens

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, key string, piece int, number long, block long, n_a long, runs string, collapsed string"
ODD = [None, "", " \n\t ", "a", "a", "Hello  world\n\tx", "<|endoftext|> <s> </s>", "▁ gone", "漢字🙂 é ﬁ", "\x00a", "it's 'll  \u0085 x"]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ODD + ["one two " * 6 + "x", " ".join(f"w{i % 977} x{i}" for i in range(30_000))]
    rows = [(i or None, t, "k", 1, 2, 3, 4, "r", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def hexed(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def library(specials):
    tokenizer = Tokenizer.from_file(A_PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = not specials
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


# --- token ids


@pytest.mark.parametrize("specials", [True, False])
def test_ids_are_those_of_the_library(docs, specials):
    random.seed(3)
    marks = " \n\t\r\x0b\x0c\x1c\x85\xa0'strevmld.?!<|>_-=/0123456789abcXYZäöß漢字🙂​　́"
    made = ["".join(random.choices(marks, k=random.randint(0, 60))) for _ in range(3000)]
    own, theirs = tokens.encoder(A_PATH, specials), library(specials)
    for text in [t or "" for _, t in docs] + [t or "" for t in ODD] + made:
        assert own(text).tolist() == theirs(text)


# --- alignment


def test_merge_path_is_the_merge():
    random.seed(0)
    for _ in range(400):
        n = random.randint(1, 40)
        a, b = (sorted({n, *random.sample(range(1, n + 1), random.randint(0, n))}) for _ in range(2))
        links_a, links_b, common_a, common_b = token_align.merged(np.array(a), np.array(b), random.choice([1, 2, 3, 5, 100]))
        expected = [
            (i, j)
            for i, x in enumerate(a)
            for j, y in enumerate(b)
            if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(x, y)
        ]
        assert list(zip(links_a.tolist(), links_b.tolist())) == expected
        assert common_a.tolist() == [x in b for x in a] and common_b.tolist() == [y in a for y in b]


def brute_alignment(rows):
    """Per row n_a, n_b, n_groups, n_links, n_best, count_sum and the groups, with plain lists."""
    encode, pieces = library(False), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = tokens.byte_of()
    entries = {i: bytes(letters[c] for c in p) for p, i in Tokenizer.from_file(A_PATH).get_vocab(with_added_tokens=False).items()}

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    all_links, shown, sizes = [], [], []
    for text in rows:
        a, b = (encode(" " + text), pieces.encode(text)) if text else ([], [])
        spelt = [b"".join(map(entries.__getitem__, a)), b"".join(map(piece, b))]
        if not text or spelt != [(" " + text).encode()] * 2:
            a, b = [], []
        ends_a, ends_b = np.cumsum([0] + [len(entries[i]) for i in a]), np.cumsum([0] + [len(piece(i)) for i in b])
        links, groups, i, j = [], [], 0, 0
        first_i, first_j = 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = ends_a[i + 1], ends_b[j + 1]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
            if end_a == end_b:
                groups.append(",".join(map(str, a[first_i:i])) + "|" + ",".join(map(str, b[first_j:j])))
                first_i, first_j = i, j
        all_links.append(links)
        shown.append(";".join(groups))
        sizes.append((len(a), len(b), len(groups), len(links)))
    count = Counter(link for links in all_links for link in links)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [
        (*size, sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hexed(s) if s else "")
        for size, links, s in zip(sizes, all_links, shown)
    ], shown


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_all_documents(spark, docs, monkeypatch):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registered.op11_token_align(spark, SF).collect()}
    expected, _ = brute_alignment([t for _, t in docs])
    assert found == dict(zip([i for i, _ in docs], expected))
    assert all(n[1] >= max(n[0], 1) for n in [(v[2], v[3]) for v in found.values()] if n[0])


def test_alignment_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = token_align.align(odd, A_PATH, B_PATH)
    expected, shown = brute_alignment([t for _, t in rows])
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in found.collect()), key=key) == sorted(
        ((i, *e) for (i, _), e in zip(rows, expected)), key=key
    )
    groups = token_align.token_groups(odd, A_PATH, B_PATH).collect()
    assert sorted((tuple(r) for r in groups), key=key) == sorted(((i, s) for (i, _), s in zip(rows, shown)), key=key)
    assert token_align.align(none, A_PATH, B_PATH).count() == 0


# --- packing


def check_packed(rows, found, ids_of, capacity=1024):
    """Every id of every row in one place, gapless sequences within the capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *[r.length for r in held]])[:-1].tolist()
        assert sum(r.length for r in held) <= capacity
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = Counter()
    for i, text in rows:
        ids = [*ids_of(text or ""), 2]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        expected.update((i, n, a, b - a, crc(ids[a:b])) for n, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert expected == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    return len(sequences)


def test_packing_of_all_documents(spark, docs):
    found = registered.op12_sequence_packing(spark, SF).collect()
    used = check_packed(docs, found, library(True))
    full = sum(r.length for r in found) / 1024
    assert full <= used <= 1.02 * full + 1


def test_packing_odd(spark, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(rows, sequence_packing.pack_sequences(odd, A_PATH).collect(), library(True))
    small = sequence_packing.pack_sequences(odd, A_PATH, capacity=7)
    check_packed(rows, small.collect(), library(True), 7)
    assert sequence_packing.pack_sequences(none, A_PATH).count() == 0


def test_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(sequence_packing, "SHARD", 40)
    found = registered.op12_sequence_packing(spark, SF).collect()
    check_packed(docs, found, library(True))
    assert len({r.sequence_id >> 32 for r in found if r.sequence_id >= 0}) > 3


def test_sum_of_squares_takes_the_least():
    random.seed(1)
    sizes = np.array([random.randint(1, 30) for _ in range(400)])
    gaps, opened = sequence_packing.sum_of_squares(sizes, len(sizes), 30)
    counts, new = Counter(), 0
    squares = lambda c: sum(n * n for g, n in c.items() if g)
    for size, gap in zip(sizes.tolist(), gaps):
        options = {}
        for g in [g for g in range(size, 30) if counts[g]] + [30]:
            after = counts.copy()
            after[g] -= g < 30
            after[g - size] += 1
            options[g] = squares(after)
        assert options[gap] == min(options.values())
        counts[gap] -= gap < 30
        new += gap == 30
        counts[gap - size] += 1
    assert new == opened


@pytest.mark.parametrize("draw", [lambda r: r.integers(1, 1024, 4000), lambda r: np.minimum(r.geometric(0.004, 4000), 1023)])
def test_few_sequences(draw):
    sizes = draw(np.random.default_rng(0))
    sequence, offset = sequence_packing.pack_shard(sizes)
    used = np.bincount(sequence, weights=sizes)
    assert used.max() <= 1024 and len(used) <= 1.03 * sizes.sum() / 1024 + 2


# --- periodic runs


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            start = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            stretch = words[start - q : i]
            if i > start and len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start - q, len(stretch), q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, words):
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, milli, hexed(listed), hexed(kept))


def test_runs_of_all_documents(spark, docs):
    expected = []
    for i, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (j - a) % p] if j >= a else words[j] for j in range(n)]
        expected.append(brute_row(i, words))
    assert sorted(map(tuple, registered.op13_periodic_runs(spark, SF).collect())) == sorted(expected)
    assert sum(r[1] for r in expected) >= 10


def test_runs_in_made_texts():
    random.seed(5)
    for _ in range(300):
        texts = []
        for _ in range(random.randint(1, 5)):
            words = [random.randrange(random.choice([1, 2, 3, 9])) for _ in range(random.randint(0, 60))]
            words += words[-random.randint(1, 20) :] * random.randint(0, 7)
            texts.append(words + [7] * random.randint(0, 2))
        codes, names = [], 0
        for words in texts:
            own = {}
            codes.append(np.array([own.setdefault(w, len(own)) for w in words], np.int64) + names)
            names += len(own)
        found = defaultdict(list)
        for t, *run in periodic_runs.runs_of(np.concatenate(codes), np.cumsum([0, *map(len, texts)])):
            found[t].append(tuple(run))
        assert [found[t] for t in range(len(texts))] == [brute_runs(w) for w in texts]


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    for words in (b, b * 4, b * 5 + a):
        found = periodic_runs.runs_of(np.array(words), np.array([0, len(words)]))
        assert [r[1:] for r in found] == brute_runs(words)


def test_one_word_repeated_is_linear():
    n = 600_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64), np.array([0, n])) == [(0, 0, n, 1)]


def test_runs_odd(spark, odd, none, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 3)
    found = periodic_runs.find_runs(odd).collect()
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in odd.collect()]
    expected = []
    for i, words in rows:
        runs = brute_runs(words) if len(words) < 1000 else []
        dropped = {j for s, n, q in runs for j in range(s + q, s + n)}
        expected.append((i, len(words), runs, b" ".join(w for j, w in enumerate(words) if j not in dropped).decode()))
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, list(map(tuple, r.runs)), r.collapsed) for r in found), key=key) == sorted(expected, key=key)
    assert any(e[2] for e in expected)
    changed = registered.with_periods(odd.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(str(r.text) for r in changed.collect()) == sorted(str(r.text) for r in odd.collect())
    assert periodic_runs.find_runs(none).count() == 0
