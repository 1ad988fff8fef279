"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` features. Two multinomials over the features are
counted over whole tables: one over trusted target documents, one over the raw corpus. A document
scores the mean log-likelihood ratio of its features, so long documents are not favoured, and is
kept if the mean is at least a threshold, the same fixed one for every document.

Everything runs as DataFrame expressions. The feature table has ``BUCKETS`` rows, whatever the
corpus, and goes to the documents as one array.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD, unused

BUCKETS = 10_000  # of hashed features, as in importance resampling by hashed n-grams
# Pseudo-counts a bucket, spread like the raw corpus: little trusted text says little.
PRIOR = 20.0
LEAST_RATIO = -0.03  # nats a feature: clearly likelier in the raw corpus than in trusted text
WHITE = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 10, 5, 20


def words_of(text: Column) -> Column:
    """Words in order. White space becomes single spaces first: splitting at a character is fast."""
    plain = F.coalesce(text, F.lit(""))
    for space in WHITE[1:]:
        plain = F.replace(plain, F.lit(space), F.lit(WHITE[0]))
    pieces = F.split(F.trim(plain), " ")
    return let(pieces, lambda p: F.when(F.array_contains(p, ""), F.filter(p, lambda w: w != "")).otherwise(p))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _from(c: Column, first: int) -> Column:
    return F.slice(c, F.lit(first), F.greatest(F.size(c) - (first - 1), F.lit(0)))


def _zipped(a: Column, b: Column, drop: int) -> Column:
    """Hashes of the pairs (a[i], b[i + drop]), of as many as there are."""
    both = F.zip_with(a, _from(b, drop + 1), lambda x, y: F.xxhash64(x, y))
    return F.slice(both, F.lit(1), F.greatest(F.size(b) - drop, F.lit(0)))


def features(hashes: Column, pairs: Column) -> Column:
    """Hashes of words and of pairs of neighbours; their remainders are the buckets."""
    return F.concat(hashes, pairs)


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""
    size = REPEAT_WINDOW

    def covered(windows: Column) -> Column:
        # equal windows are neighbours once sorted; each marks its place
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))

            marks = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(marks, lambda i: F.get(p, i)["i"]))

        def length(m: Column) -> Column:
            # each mark covers up to the next one, the last a whole window
            start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))

            def step(s: Column, i: Column) -> Column:
                return F.struct((s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"), i.alias("last"))

            return F.aggregate(m, start, step, lambda s: s["n"])

        once = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(once, F.lit(0)).otherwise(let(let(placed, places), length))

    fours = lambda: _zipped(pairs, pairs, 2)
    windows = let(fours(), lambda q: _zipped(q, hashes, size - 1))
    return F.when(F.size(hashes) > size, let(windows, covered)).otherwise(F.lit(0))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_rules(hashes: Column, pairs: Column, text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    white = F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))
    return [
        F.size(hashes).cast("long").alias("n_words"),
        (F.length(text) - white).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"),
        repeated_words(hashes, pairs).cast("long").alias("n_repeat_words"),
    ]


def _ratios(docs: DataFrame, text: str, trusted: Column) -> list[float]:
    """Log ratio of each bucket's smoothed share in trusted documents and in all."""
    grams = let(let(words_of(docs[text]), hashed), lambda h: features(h, _zipped(h, h, 1)))
    exploded = docs.select(trusted.cast("int").alias("t"), F.explode(grams).alias("h"))
    # at most BUCKETS rows leave each task, and the result has BUCKETS rows
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = exploded.groupBy(bucket).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")).collect()
    raw, target = [1] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["trusted"]
    n_raw, n_target, prior = sum(raw), sum(target), PRIOR * BUCKETS
    shares = [r / n_raw for r in raw]
    return [log((t + prior * p) / (n_target + prior)) - log(p) for t, p in zip(target, shares)]


def judge(docs: DataFrame, trusted: Column, text: str = "text", least: float = LEAST_RATIO, out: str = "_quality") -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: a struct of the rules' counts and verdicts.

    ``trusted`` marks target documents (null: not one). Fields: ``n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, llr`` (mean log ratio, 0 without words), ``base_failed`` and
    ``kept``. Null and empty texts have no words and fail the base rules. Without trusted
    documents both multinomials are taken as equal. A column named as ``out`` is replaced, all
    others stay whatever their names; repeated rows stay and count as often as they occur; no row
    is moved.
    """
    trusted = F.coalesce(trusted, F.lit(False))
    spark = docs.sparkSession
    one, llr, rules = unused(docs, "_one", "_llr", "_rules")
    ratios = spark.createDataFrame([(0, _ratios(docs, text, trusted))], f"{one} int, {llr} array<double>")
    source = docs.drop(out).withColumn(one, F.lit(0))
    met = source.join(F.broadcast(ratios), one).drop(one)  # one row of BUCKETS doubles

    def judged(h: Column) -> Column:
        def with_pairs(g: Column) -> Column:
            add = lambda s, b: s + F.get(F.col(llr), F.pmod(b, F.lit(BUCKETS)).cast("int"))
            total = F.aggregate(h, F.lit(0.0), add) + F.aggregate(g, F.lit(0.0), add)
            mean = total / F.greatest(2 * F.size(h) - 1, F.lit(1))
            return F.struct(*base_rules(h, g, F.col(text)), mean.alias("llr"))

        return let(_zipped(h, h, 1), with_pairs)

    found = met.withColumn(rules, let(let(words_of(F.col(text)), hashed), judged)).drop(llr)
    few, many = F.col(f"{rules}.n_words"), F.col(f"{rules}.n_repeat_words")
    bad = (few < LEAST_WORDS) | (100 * many > MOST_REPEATED * few)
    verdicts = F.struct(f"{rules}.*", bad.alias("base_failed"), (~bad & (F.col(f"{rules}.llr") >= least)).alias("kept"))
    return found.withColumn(out, verdicts).drop(rules)


def trusted_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys labelled as good, once each."""
    return labels.filter((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
