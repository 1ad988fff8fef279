"""General string helpers shared by the LaTeX functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as whitespace: every Unicode space, not only the ASCII ones.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, even if ``body`` uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove whitespace, Unicode included, from both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def not_blank(c: Column) -> Column:
    """True where the text has a visible character; false for null."""
    return F.coalesce(c.rlike(NOT_SPACE), F.lit(False))


def drop_all(c: Column, *words: str) -> Column:
    """Remove every occurrence of each literal word, in the order given."""
    for word in words:
        c = F.replace(c, F.lit(word), F.lit(""))
    return c


def swap_all(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def rewrite(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``change(match)``; text without a match passes through."""

    def changed(text: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(change(hit), F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)

    return let(c, changed)


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def pad(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def unpad(c: Column) -> Column:
    """Undo :func:`pad`: one character off either end."""
    return F.substring(c, F.lit(2), F.length(c) - 2)
