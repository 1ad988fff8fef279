"""Text steps before and after LaTeX tokenisation, and token classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .brackets import fill_arguments, glue_groups
from .latex import named_env, tokenize
from .text import SPACE, drop_all, let, pad, rewrite, strip, swap_all, unpad, without_spaces

# ---- Fixed values: names and patterns that decide the result ---------------------------------

OPERATOR_NAMES = (
    "arccos", "arcsin", "arctan", "arg", "cos", "cosh", "cot", "coth", "csc", "deg", "det", "dim",
    "exp", "gcd", "hom", "inf", "injlim", "ker", "lg", "lim", "liminf", "limsup", "ln", "log",
    "max", "min", "Pr", "projlim", "sec", "sin", "sinh", "sup", "tan", "tanh",
)
DOTS = ("\\ldots", "\\cdots", "\\dots", "\\dotsb")
SPELLED = ("\\log", "\\exp", "\\sin", "\\cos", "\\tan", "\\tanh", "\\cosh", "\\sinh")
SPACED_AGAIN = ("\\hline", "\\midrule", "\\times", "\\bf", "\\footnotesize", "\\cr", "\\log")

SKIPPED = (
    "\\", "\\\\", "\\index", "\\a", "&", "$", "\\multirow", "\\def", "\\raggedright", "\\url",
    "\\cr", "\\ensuremath", "\\left", "\\right", "\\mathchoice", "\\scriptstyle",
    "\\displaystyle", "\\qquad", "\\quad", "\\,", "\\!", "~", "\\boldmath", "\\multicolumn",
)
SKIPPED_PATTERNS = (
    r"\{", r"\}", r"[\[\]]", r"\\begin\{.*?\}", r"\\end\{.*?\}", r"\^", r"\_", r"\\.*rule.*",
    r"\\.*line.*", r"\[[\-.0-9]+[epm][xtm]\]",
)
PHANTOM = ("\\fontfamily", "\\vphantom", "\\phantom", "\\rowcolor", "\\ref")
TWO_ARG = ("\\frac", "\\binom")
OPTIONAL_ARG = ("\\xrightarrow", "\\xleftarrow", "\\sqrt")
TWO_ARG_STYLE = ("\\overset", "\\underset", "\\stackrel")
ONE_ARG = (
    "\\widetilde", "\\overline", "\\hat", "\\widehat", "\\tilde", "\\Tilde", "\\dot", "\\bar",
    "\\vec", "\\underline", "\\underbrace", "\\check", "\\breve", "\\Bar", "\\Vec", "\\mathring",
    "\\ddot",
)
STYLE_ONLY = (
    "\\boldsymbol", "\\pmb", "\\textbf", "\\mathrm", "\\mathbf", "\\mathbb", "\\mathcal",
    "\\textmd", "\\texttt", "\\textnormal", "\\text", "\\textit", "\\textup", "\\mathop",
    "\\mathbin", "\\smash", "\\operatorname", "\\textrm", "\\mathfrak", "\\emph", "\\textsf",
    "\\textsc",
)
SYNONYMS = {
    "\\cdot": ".", "\\mid": "|", "\\to": "\\rightarrow", "\\top": "T", "\\Tilde": "\\tilde",
    "\\cdots": "\\dots", "\\prime": "'", "\\ast": "*", "\\left<": "\\langle",
    "\\right>": "\\rangle",
}
COLOR_COMMAND = r"\\(?:colorbox|color|textcolor|cellcolor)[ \[\]RGBrgb]+\{ [A-Za-z 0-9,!]+ \} "
TRAILING_SPACE = (
    r"(?:\\(?:hspace\*?\{[^{}]*?\}|vspace\*?\{[^{}]*?\}|smallskip|medskip|quad|qquad|bigskip|[;,])"
    r"|~|\.)*+\z"
)

# constructs that count as one token
SPACE_COMMAND = r"\\[hv]space \{ [.0-9a-z ]+ \}"
TABLE_EDGE = r"\\(begin|end) \{(tabular|array)\}"
TABLE_HEAD = "\\begin{tabular}"
TABLE_RULES = ("\\cmidrule", "\\cline")
ARRAY_HEAD = r"\\begin\{array\} \{ [lrc ]+ \}"
NOT_SIGN = r"\\not [<>+=\-]"
SIZED_DELIMITER = r"\\[Bb]igg?[glrm]? [(){}|\[\]] "
SIZED_COMMAND = r"(?s)\\[Bb]igg?[glrm]? \\.*? "
ACCENT = r"\\' [^{] "
TABLE_LENGTH = r"\[ [\-.0-9 ]+[exptcm ]+ \]"
PARBOX = r"\\parbox \{[^{]+\}"
RAISEBOX = r"\\raisebox \{[^{]+\} [\[\]0-9 exptcm]+\{"
CHARACTER = r"\{ \\char[0-9' ]+\}"
NOT_COMMAND = r"\\not [\\=<>][^ ]+ "
SPECIAL_RULE = r"\\specialrule" + r" \{[ .0-9a-z]+\}" * 3

# ---- Before the parser -----------------------------------------------------------------------


def canonical_env(c: Column) -> Column:
    """The align family becomes ``aligned`` and ``smallmatrix`` becomes ``matrix``, pair by pair."""
    for names, new in (("split|align|alignedat|alignat|eqnarray", "aligned"), ("smallmatrix", "matrix")):
        pair = rf"(?s)\\begin\{{({names})\*?\}}(.+?)\\end\{{\1\*?\}}"
        c = F.regexp_replace(c, pair, rf"\\begin{{{new}}}$2\\end{{{new}}}")
    return c


def _precondition(c: Column, drop_comment: bool, drop_dollar: bool) -> Column:
    c = F.regexp_replace(c, r"\A%", "")
    if drop_comment:
        c = F.substring_index(c, "%", 1)
    c = swap_all(c, {"\\~": " ", "\\>": " "})
    if drop_dollar:
        c = F.replace(c, F.lit("$"), F.lit(" "))
    c = F.regexp_replace(c, r"\\label\{.*?\}", "")
    no_rows = ~c.rlike("matrix|cases|array|begin")
    return F.when(no_rows, F.replace(c, F.lit("\\\\"), F.lit("\\,"))).otherwise(c)


def precondition_formula(c: Column) -> Column:
    """Comments, ``\\~``, ``\\>``, ``$`` and labels out; ``\\\\`` is a thin space outside environments."""
    return _precondition(c, drop_comment=True, drop_dollar=True)


def precondition_table(c: Column) -> Column:
    """As :func:`precondition_formula`, but text after ``%`` and dollars stay."""
    return _precondition(c, drop_comment=False, drop_dollar=False)


def rm_to_mathrm(c: Column) -> Column:
    """The old ``\\rm`` switch as ``\\mathrm{``."""
    return swap_all(c, {"{\\rm": "\\mathrm{", "{ \\rm": "\\mathrm{", "\\rm{": "\\mathrm{"})


def repair_tabular(c: Column) -> Column:
    """Comment cut (``\\%`` is kept), a missing table end added, one line, ``hskip`` as ``hspace{}``."""
    c = swap_all(c, {"\\\\%": "\\\\ %", "\\%": "<PERCENTAGE_TOKEN>"})
    c = F.replace(F.substring_index(c, "%", 1), F.lit("<PERCENTAGE_TOKEN>"), F.lit("\\%"))
    c = F.when(c.contains("\\end{tabular}"), c).otherwise(F.concat(c, F.lit("\\end{tabular}")))
    c = F.translate(c, "\r\n", "  ")
    return F.regexp_replace(c, r"hskip(.*?)(cm|in|pt|mm|em)", r"hspace{$1$2}")


# ---- After the parser ------------------------------------------------------------------------


def operator_names(c: Column) -> Column:
    """``\\operatorname {s i n}`` as ``\\sin`` for the known names; one space between tokens.

    Any spaces are allowed between and around the letters of the name.
    """
    c = strip(F.regexp_replace(c, rf"{SPACE}+", " "))
    spaced = "|".join(" *".join(name) for name in OPERATOR_NAMES)
    c = rewrite(
        c,
        rf"\\operatorname \{{ *(?:{spaced}) *\}}",
        lambda m: F.concat(F.lit("\\"), F.regexp_replace(m, r"\\operatorname|[{} ]", "")),
    )
    return F.replace(c, F.lit("\\\\ \\end{array}"), F.lit("\\end{array}"))


def expand_functions(c: Column) -> Column:
    """Dots as three full stops, function names spelled letter by letter in ``\\mathrm``."""
    pairs = {f" {name} ": " . . . " for name in DOTS}
    pairs |= {f" {name} ": " \\mathrm { " + " ".join(name[1:]) + " } " for name in SPELLED}
    return unpad(swap_all(pad(c), pairs))



def glue_tokens(c: Column) -> Column:
    """Spaces out of the constructs that count as one token.

    The first table head and all table rules are glued with their groups, whatever their depth.
    """
    table = c.contains("tabular")
    one_space_after = lambda m: F.concat(without_spaces(m), F.lit(" "))
    c = rewrite(pad(c), SPACE_COMMAND, lambda m: F.when(table, F.lit("")).otherwise(without_spaces(m)))
    heads = F.regexp_replace(c, TABLE_EDGE, r"\\$1{$2}")
    c = F.when(table, glue_groups(heads, TABLE_HEAD, TABLE_RULES)).otherwise(c)
    head = "\\begin{array} "
    columns = lambda m: without_spaces(F.substring(m, F.lit(len(head)), F.length(m)))
    c = rewrite(c, ARRAY_HEAD, lambda m: F.concat(F.lit(head), columns(m)))
    c = rewrite(c, NOT_SIGN, without_spaces)
    for pattern in (SIZED_DELIMITER, SIZED_COMMAND, ACCENT):
        c = rewrite(c, pattern, one_space_after)
    c = F.when(table, rewrite(c, TABLE_LENGTH, without_spaces)).otherwise(c)
    c = rewrite(c, PARBOX, without_spaces)
    c = rewrite(c, RAISEBOX, lambda m: F.concat(F.rtrim(without_spaces(m), F.lit("{")), F.lit(" {")))
    c = rewrite(c, CHARACTER, lambda m: F.concat(F.lit("{ "), F.translate(m, "{} ", ""), F.lit(" }")))
    c = rewrite(c, NOT_COMMAND, one_space_after)
    return unpad(rewrite(c, SPECIAL_RULE, without_spaces))


def drop_color(c: Column) -> Column:
    """Colour commands and their arguments out."""
    return F.regexp_replace(c, COLOR_COMMAND, "")


def drop_layout(c: Column) -> Column:
    """Layout-only commands out; ``\\footnote`` as a superscript; old matrix names protected."""
    c = swap_all(strip(c), {"\\pmatrix": "\\mypmatrix", "\\matrix": "\\mymatrix"})
    c = drop_all(c, "\\raggedright", "\\arraybackslash", "\\lowercase", "\\uppercase")
    c = swap_all(c, {"\\operatorname *": "\\operatorname"})
    return swap_all(drop_all(c, "\\lefteqn"), {"\\footnote ": "^ "})


def braces_balanced(c: Column, opening: str = "{", closing: str = "}") -> Column:
    """True where every opening token has its closing one; tokens are parted by spaces."""
    depth = F.aggregate(
        F.split(c, " "),
        F.lit(0),
        lambda d, t: F.when(d < 0, d).when(t == opening, d + 1).when(t == closing, d - 1).otherwise(d),
    )
    return depth == 0


def trim_trailing_space(c: Column) -> Column:
    """Spacing commands and full stops off the end."""
    return F.regexp_replace(c, TRAILING_SPACE, "")


def compact(c: Column) -> Column:
    """Whitespace out except beside a backslash; put back after the commands that need it."""
    c = F.regexp_replace(c, rf"(?<=[^\\]){SPACE}+(?=[^\\])", "")
    c = swap_all(c, {word: word + " " for word in SPACED_AGAIN})
    return F.replace(c, F.lit(" \\textcolor{black}"), F.lit("\\textcolor{black}"))


# Delimiter pairs inside which rows stay, and the tokens that go outside them.
_ROW_SAFE = {"\\left(": "\\right)", "\\left[": "\\right]", "\\left{": "\\right}"}
_ROW_TOKENS = ("\\\\", "~", "\\qquad")


def flatten_rows(c: Column) -> Column:
    """A many-row formula on one row, in ``$ .. $``; null where a ``\\left`` has no partner.

    Tokens inside a matched pair stay as they are.
    """
    parts = F.split(c, " ")

    def body(t: Column) -> Column:
        has_head = F.element_at(t, 1) == "\\begin{array}"
        has_tail = F.element_at(t, -1) == "\\end{array}"
        kept = F.size(t) - 2 - has_tail.cast("int")
        return F.when(has_head, F.slice(t, F.lit(3), F.greatest(kept, F.lit(0)))).otherwise(t)

    start = F.struct(
        F.lit("").alias("open"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out")
    )

    def step(state: Column, token: Column) -> Column:
        outside = state["depth"] == 0
        closing = F.lit("")
        for left, right in _ROW_SAFE.items():
            closing = F.when(state["open"] == left, F.lit(right)).otherwise(closing)
        opens = token.isin(*_ROW_SAFE)
        depth = (
            F.when(outside & opens, F.lit(1))
            .when(outside, F.lit(0))
            .when(token == state["open"], state["depth"] + 1)
            .when(token == closing, state["depth"] - 1)
            .otherwise(state["depth"])
        )
        dropped = outside & token.isin(*_ROW_TOKENS)
        return F.struct(
            F.when(outside & opens, token).otherwise(state["open"]).alias("open"),
            depth.alias("depth"),
            F.when(dropped, state["out"]).otherwise(F.concat(state["out"], F.array(token))).alias("out"),
        )

    def scan(t: Column) -> Column:
        nested = F.aggregate(
            t, start, step, lambda s: F.when(s["depth"] == 0, F.array_join(s["out"], " "))
        )
        plain = F.array_join(F.filter(t, lambda x: ~x.isin(*_ROW_TOKENS)), " ")
        return F.when(F.arrays_overlap(t, F.array(*map(F.lit, _ROW_SAFE))), nested).otherwise(plain)

    return F.concat(F.lit("$ "), let(body(parts), scan), F.lit(" $"))


def brace_single_args(c: Column) -> Column:
    """Missing braces around one-token arguments: ``\\hat x`` as ``\\hat { x }``, ``\\frac a b`` too.

    Arguments that are groups may be of any depth.
    """
    return fill_arguments(c, ONE_ARG + STYLE_ONLY, TWO_ARG + TWO_ARG_STYLE, OPTIONAL_ARG)


def normalize_token(c: Column) -> Column:
    """One spelling for tokens that look alike."""
    same = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    command = F.coalesce(F.element_at(same, c), c)
    # a token that begins with \\left or \\right loses every one of them
    command = F.regexp_replace(command, r"(?s)\A\\(?:left|right)|(?<!\A)\G(.*?)\\(?:left|right)", "$1")
    # a sized delimiter is named by its last command, or else by its last character
    command = F.regexp_replace(
        command, r"(?s)\A\\[bB]ig.*(\\[^\\]*)\z|\A\\[bB]i(?=g)[^\\]*([^\\])\z", "$1$2"
    )
    # only commands take the slow way
    c = F.when(c.startswith("\\"), command).otherwise(c)
    return (
        F.when(c.isin("\\leq", "\\geq"), F.left(c, F.lit(3)))
        .when(c.isin("\\lVert", "\\rVert", "\\Vert"), F.lit("\\|"))
        .when(c.isin("\\lvert", "\\rvert", "\\vert"), F.lit("|"))
        .when(c.endswith("rightarrow"), F.lit("\\rightarrow"))
        .when(c.endswith("leftarrow"), F.lit("\\leftarrow"))
        .when(c.startswith("\\wide"), F.replace(c, F.lit("wide"), F.lit("")))
        .when(c.startswith("\\var"), F.replace(c, F.lit("\\var"), F.lit("")))
        .otherwise(c)
    )


def token_class(c: Column) -> Column:
    """How a token shows on the page: one of seven class names, the first that fits."""
    skip = r"(?d)\A(?:" + "|".join(SKIPPED_PATTERNS) + ")"
    return (
        F.when(c.isin(*PHANTOM), F.lit("phantom"))
        .when(c.isin(*TWO_ARG), F.lit("two-arg"))
        .when(c.isin(*ONE_ARG), F.lit("one-arg"))
        .when(c.isin(*STYLE_ONLY), F.lit("style-only"))
        .when(c.isin(*OPTIONAL_ARG), F.lit("optional-arg"))
        .when(c.isin(*SKIPPED, *TWO_ARG_STYLE) | c.rlike(skip), F.lit("skip"))
        .otherwise(F.lit("visible"))
    )


def size_bucket(n_visible: Column) -> Column:
    """Paper size for a number of visible tokens."""
    return F.when(n_visible > 1300, 3).when(n_visible > 600, 4).otherwise(5)


def tokenized_formula(c: Column) -> Column:
    """Ground truth in its tokenised form: the text steps around the lexer, in order.

    Text with a ``tabular`` is repaired and keeps its dollars and percent signs; all other text is
    taken as a formula. Environment names stay whole.
    """
    formula = rm_to_mathrm(precondition_formula(canonical_env(c)))
    table = rm_to_mathrm(precondition_table(repair_tabular(c)))
    as_formula = operator_names(named_env(tokenize(formula)))
    return F.when(c.contains("tabular"), named_env(tokenize(table))).otherwise(as_formula)
