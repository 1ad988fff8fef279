"""SQL fragments for the DuckDB side of the check.

Its regular expressions know neither lookaround nor back-references, so these fragments reach the
same results by other means: lists of gaps and matches, repeated replacement, one pattern per name.
"""

from __future__ import annotations

from collections.abc import Callable

from ..derived import quoted


def pattern(regex: str) -> str:
    """A regular expression as an SQL literal."""
    return "'" + regex.replace("'", "''") + "'"


def sub(text: str, regex: str, new: str, every: bool = True) -> str:
    flag = ", 'g'" if every else ""
    return f"regexp_replace({text}, {pattern(regex)}, {pattern(new)}{flag})"


def strip(text: str) -> str:
    return sub(text, r"^\s+|\s+$", "")


def swap(text: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return text


def rewrite(text: str, regex: str, change: Callable[[str], str]) -> str:
    """Every match replaced by an expression over it."""
    return (
        f"list_reduce(list_transform(list_zip(string_split_regex(s, {pattern(regex)}), "
        f"regexp_extract_all(s, {pattern(regex)})), lambda z: z[1] || coalesce({change('z[2]')}, '')), "
        "lambda a, b: a || b)"
    ).join(["list_transform([" + text + "], lambda s: ", ")[1]"])


def no_spaces(text: str) -> str:
    return f"replace({text}, ' ', '')"


def squeezed(text: str) -> str:
    """The whitespace rule run to its end: three replacements, repeated."""
    text = rewrite(text, r"\\(?:operatorname|mathrm|text|mathbf)\s?\*? \{.*?\}", no_spaces)
    for _ in range(6):
        text = sub(text, r"([^a-zA-Z\\])\s+?([^a-zA-Z])", r"\1\2")
        text = sub(text, r"([^a-zA-Z\\])\s+?([a-zA-Z])", r"\1\2")
        text = sub(text, r"([a-zA-Z])\s+?([^a-zA-Z])", r"\1\2")
    return text


def unwrapped(text: str) -> str:
    return sub(sub(text, r"\$\$", "", every=False), r"\$\$", "", every=False)


def normalized(text: str, unwrap: bool = False) -> str:
    text = strip(text)
    return squeezed(unwrapped(text) if unwrap else text)


LEXER = (
    r"\\[a-zA-Z]+|[0-9]*\.?[0-9]+|[a-zA-Z]|[\^_{}()\[\]]|[+\-*/=<>,]|\\.|\s+|."
)


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, {pattern(LEXER)}), lambda t: regexp_matches(t, '\\S'))"


def tokenized(text: str) -> str:
    return f"array_to_string({tokens(text)}, ' ')"


def balanced(text: str) -> str:
    steps = (
        f"list_transform(string_split({text}, ' '), lambda t: CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)"
    )
    return f"(list_reduce({steps}, lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END, 0) = 0)"
