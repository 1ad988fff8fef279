"""n-gram counts of two token arrays inside one row, so that no n-gram is ever shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens as strings; empty where there are fewer tokens."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_total(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def _numbered(items: Column) -> Column:
    """Each item with its number among equal items, so that a set operation respects counts."""

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )

        def spell(b: Column) -> Column:
            last = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n))
            runs = F.zip_with(
                b,
                last,
                lambda lo, hi: F.transform(
                    F.sequence(lo, hi - 1),
                    lambda k: F.when(k == lo, F.get(s, k)).otherwise(
                        F.concat(F.get(s, k), F.lit("\x01"), (k - lo).cast("string"))
                    ),
                ),
            )
            return F.flatten(runs)

        return F.when(n > 0, let(first, spell)).otherwise(F.array().cast("array<string>"))

    return let(F.sort_array(items), from_sorted)


def overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two string arrays.

    Where one of them repeats nothing, that is the size of the plain intersection; only where both
    do, equal items are numbered.
    """

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        once = lambda c: F.size(F.array_distinct(c)) == F.size(c)
        plain = F.size(F.array_intersect(a, b))
        return F.when(once(a) | once(b), plain).otherwise(F.size(F.array_intersect(_numbered(a), _numbered(b))))

    return let(F.struct(left.alias("a"), right.alias("b")), of)


def ngram_overlap(left: Column, right: Column, n: int) -> Column:
    """Clipped n-gram matches; equal token lists need no counting."""
    return F.when(left == right, ngram_total(left, n)).otherwise(overlap(ngrams(left, n), ngrams(right, n)))
