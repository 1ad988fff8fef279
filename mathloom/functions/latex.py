"""Formula clean-up used by curation and by text evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, pad, rewrite, strip, swap_all, without_spaces

# Character classes of the whitespace rule. A "letter" is ASCII only; a "mark" is whatever is
# neither a letter of any script nor a non-decimal number; "other" is what is left (such as é).
_LETTER = "a-zA-Z"
_OTHER = rf"[\p{{L}}\p{{Nl}}\p{{No}}&&[^{_LETTER}]]"
_MARK = r"[^\s\x1c-\x1f\x85\p{Z}\p{L}\p{Nl}\p{No}]"
_MARK_NOT_BACKSLASH = r"[^\\\s\x1c-\x1f\x85\p{Z}\p{L}\p{Nl}\p{No}]"
_LETTER_OR_MARK = rf"(?:[{_LETTER}]|{_MARK})"

# The patterns below define the cleaned form and must stay as they are.
FONT_GROUP_SPACE = (
    r"((?:\\(?:operatorname|mathrm|text|mathbf)(?=[\s\x1c-\x1f\x85\p{Z}]?\*? \{[^}\n]*\})|(?<!\A)\G)"
    r"[^} ]*) "
)
ENVIRONMENT_NAME = r"\\(begin|end)[\s\x1c-\x1f\x85\p{Z}]*\{[\s\x1c-\x1f\x85\p{Z}]*([^}]*)\}"
LEXER = (
    r"(?d)\\[a-zA-Z]+|[0-9]*\.?[0-9]+|[a-zA-Z]|[\^_{}()\[\]]|[+\-*/=<>,]|\\."
    r"|[^\s\x1c-\x1f\x85\p{Z}]"
)


# mteval-v13a: text replaced first, then patterns set apart by spaces
TEXT_13A = {
    "<skipped>": "", "-\n": "", "\n": " ", "&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">",
}
SPACED_13A = {
    r"([\{-~\[-` -&\(-\+:-@/])": " $1 ",
    r"([^0-9])([.,])": "$1 $2 ",
    r"([.,])([^0-9])": " $1 $2",
    r"([0-9])(-)": "$1 $2 ",
}


def strip_env(c: Column) -> Column:
    """Drop every ``\\begin{..}`` and ``\\end{..}``, with the space before an end, and trim."""
    return strip(F.regexp_replace(c, rf"(?d)\\begin\{{.*?\}}|{SPACE}*\\end\{{.*?\}}", ""))


def strip_display(c: Column, align: bool = False) -> Column:
    """Drop the first two ``$$``; with ``align`` the align* wrappers go first."""
    if align:
        c = strip(F.regexp_replace(c, r"\\(?:begin|end)\{align\*\}", ""))
    for _ in range(2):
        c = F.regexp_replace(c, r"(?s)\A(.*?)\$\$", "$1")
    return c


def squeeze(c: Column) -> Column:
    """Whitespace that TeX ignores removed.

    Spaces inside font groups go first. Then a whitespace run goes if it stands between two of
    letter and mark (not both letters, and not right after a backslash); it shrinks to one
    character beside any other text, and to its first and last between two other characters. After
    a backslash a run that contains a space stays as one space.
    """
    c = F.regexp_replace(c, FONT_GROUP_SPACE, "$1")
    gone = (
        rf"(?<={_MARK_NOT_BACKSLASH}){SPACE}+(?={_LETTER_OR_MARK})"
        rf"|(?<=[{_LETTER}]){SPACE}+(?={_MARK})"
    )
    blank = r"[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
    long_runs = c
    for pattern, kept in (
        (rf"(?<=\\){blank}+(?={_LETTER_OR_MARK})", ""),
        (rf"(?<=\\){SPACE}{{2,}}(?={_LETTER_OR_MARK})", " "),
        (rf"(?<=\A|\\|{_OTHER})({SPACE}){SPACE}+({SPACE})(?={_OTHER}|\z)", "$1$2"),
        (gone, ""),
        (rf"(?<=[{_LETTER}])({SPACE}){SPACE}+(?=[{_LETTER}])", "$1"),
        (rf"(?<=[{_LETTER}]|{_MARK_NOT_BACKSLASH}){SPACE}+({SPACE})(?={_OTHER}|\z)", "$1"),
        (rf"(?<=\A|{_OTHER})({SPACE}){SPACE}+(?={_LETTER_OR_MARK})", "$1"),
    ):
        long_runs = F.regexp_replace(long_runs, pattern, kept)
    has_long_run = c.rlike(rf"{SPACE}{{2}}|\\{blank}")
    return F.when(has_long_run, long_runs).otherwise(F.regexp_replace(c, gone, ""))


def named_env(c: Column) -> Column:
    """No spaces in ``\\begin{..}`` and ``\\end{..}``, so that each is one token."""
    return rewrite(
        c,
        ENVIRONMENT_NAME,
        lambda m: without_spaces(F.regexp_replace(m, ENVIRONMENT_NAME, r"\\$1{$2}")),
    )


def clean_env(c: Column) -> Column:
    """No spaces in environment names; ``$ $`` becomes ``$$``."""
    return F.regexp_replace(named_env(c), rf"\${SPACE}+\$", r"\$\$")


def tokens(c: Column) -> Column:
    """The lexer's tokens as an array: commands, numbers, letters, syntax, operators, the rest."""
    return F.regexp_extract_all(c, F.lit(LEXER), F.lit(0))


def tokenize(c: Column) -> Column:
    """The lexer's tokens joined by one space."""
    return F.array_join(tokens(c), " ")


def tokens_13a(c: Column) -> Column:
    """Tokens by the published mteval-v13a rules, the usual choice for reported corpus BLEU."""
    c = pad(swap_all(c, TEXT_13A))
    for pattern, spaced in SPACED_13A.items():
        c = F.regexp_replace(c, pattern, spaced)
    return F.filter(F.split(c, rf"{SPACE}+"), lambda t: t != "")


def wrap_align(c: Column) -> Column:
    """Wrap in align* where the formula has a line break or an alignment mark."""
    wrapped = F.concat(F.lit("\\begin{align*} "), c, F.lit(" \\end{align*}"))
    return F.when(c.contains("\\\\") | c.contains("&"), wrapped).otherwise(c)


def same_ignoring_space(a: Column, b: Column) -> Column:
    """Equal after newlines and spaces are removed."""
    return F.regexp_replace(a, "[\n ]", "") == F.regexp_replace(b, "[\n ]", "")


def normalize_formula(c: Column, unwrap: bool = False) -> Column:
    """The one form in which formulas are compared: trimmed, unwrapped on request, squeezed."""
    c = strip(c)
    return squeeze(strip_display(c) if unwrap else c)
