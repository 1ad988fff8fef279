"""Expected strings worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from mathloom.functions import latex, markup

CASES = {
    latex.strip_env: [
        (r"\begin{align*} x = 1 \end{align*}", "x = 1"),
        (r"  \begin{array}{l}a\\ \end{array} b", r"{l}a\\ b"),
        ("\u00a0é\u3000", "é"),
        ("\\begin{a\nb} x", "\\begin{a\nb} x"),
        (None, None),
    ],
    latex.strip_display: [
        ("$$ x $$", " x "),
        ("a $$ b $$ c $$ d", "a  b  c $$ d"),
        ("$$$a", "$a"),
        ("$ $", "$ $"),
    ],
    latex.squeeze: [
        ("x _ { 1 }", "x_{1}"),
        ("a  b c", "a b c"),
        (r"\sin x + \alpha 2", r"\sin x+\alpha2"),
        (r"a \ b", r"a\ b"),
        ("é é  + é", "é é + é"),
        ("é   é", "é  é"),
        (r"\mathrm { m a x } x", r"\mathrm{max}x"),
        (r"\mathrm { a { b } c }", r"\mathrm{a{b}c}"),
        (r"\mathbf{ a b}", r"\mathbf{a b}"),
        ("a\t\tb", "a\tb"),
        ("1\n 2", "12"),
        ("\\\\\nx", "\\\\x"),
        ("", ""),
    ],
    latex.clean_env: [
        (r"\begin { a l i g n * } x \end{ b }", r"\begin{align*} x \end{b}"),
        ("a $  $ b", "a $$ b"),
    ],
    latex.tokenize: [
        (r"\frac{1.5}{x_1}+\%é", r"\frac { 1.5 } { x _ 1 } + \% é"),
        ("ab12 .5", "a b 12 .5"),
        ("a\nb", "a b"),
        ("\\", "\\"),
    ],
    latex.wrap_align: [
        (r"a \\ b", r"\begin{align*} a \\ b \end{align*}"),
        ("a & b", r"\begin{align*} a & b \end{align*}"),
        ("a", "a"),
    ],
    latex.normalize_formula: [("  x _ 1 ", "x_1"), ("$$ x $$", "$$x$$")],
    markup.canonical_env: [
        (
            "\\begin{align*} a \\\\\n b \\end{align*} \\begin{smallmatrix} c \\end{smallmatrix}",
            "\\begin{aligned} a \\\\\n b \\end{aligned} \\begin{matrix} c \\end{matrix}",
        ),
        (r"\begin{split} a \end{align}", r"\begin{split} a \end{align}"),
    ],
    markup.operator_names: [
        (r"\operatorname {s i n}  x", r"\sin x"),
        (r"\operatorname { l i m s u p } y", r"\limsup y"),
        (r"\operatorname {f o o}", r"\operatorname {f o o}"),
        (r"a \\ \end{array}", r"a \end{array}"),
    ],
    markup.precondition_formula: [
        ("%x + 1 % note", "x + 1 "),
        (r"a \~ b \> $c$ \label{q} \\ d", r"a   b    c   \, d"),
        (r"\begin{x} a \\ b", r"\begin{x} a \\ b"),
    ],
    markup.precondition_table: [(r"%a % $b$ \\ c", r"a % $b$ \, c")],
    markup.rm_to_mathrm: [(r"{\rm d} { \rm e} \rm{f}", r"\mathrm{ d} \mathrm{ e} \mathrm{f}")],
    markup.repair_tabular: [
        (r"50\% a % b", r"50\% a \end{tabular}"),
        (r"a \\% c", r"a \\ \end{tabular}"),
        ("hskip 1 cm\nx\\end{tabular}", "hspace{ 1 cm} x\\end{tabular}"),
    ],
    markup.expand_functions: [
        (r"\dots \sin x", r". . . \mathrm { s i n } x"),
        (r"\dots \dots", r". . . \dots"),
        (r"\sine", r"\sine"),
    ],
    markup.glue_tokens: [
        (r"\hspace { 1 . 5 cm } x", r"\hspace{1.5cm} x"),
        (r"\begin{array} { l r c } x", r"\begin{array} {lrc} x"),
        (r"a \not = b \big ( c \big \langle d", r"a \not= b \big( c \big\langle d"),
        (r"\' e f", r"\'e f"),
        (r"\parbox { 3 cm } { x }", r"\parbox{3cm} { x }"),
        (r"\raisebox { - 1 ex } [ 0 pt ] { x }", r"\raisebox{-1ex}[0pt] { x }"),
        (r"{ \char ' 1 2 }", r"{ \char'12 }"),
        (r"\not \in x", r"\not\in x"),
        (r"\specialrule { 1 pt } { 2 pt } { 3 pt }", r"\specialrule{1pt}{2pt}{3pt}"),
        (
            r"\begin {tabular} { l { 3 } r } \cmidrule ( l { 3 p t } ) { 1 - 1 } [ -1.5 ex ] \hspace { 1 cm } y",
            r"\begin{tabular}{l{3}r} \cmidrule(l{3pt}){1-1} [-1.5ex]  y",
        ),
        (
            r"\begin {tabular} [ t ] { l { 3 { p { 1 } } } r } a \cline { { { { { { 1 } } } } } } \begin {tabular} { c } b",
            r"\begin{tabular}[t]{l{3{p{1}}}r} a \cline{{{{{{1}}}}}} \begin{tabular} { c } b",
        ),
        (
            r"\begin {tabular} { c } \cmidrule ( l { 3 ( p ( t ) ) } ) { 1 - { 2 } } x \cline { 1",
            r"\begin{tabular}{c} \cmidrule(l{3(p(t))}){1-{2}} x \cline { 1",
        ),
    ],
    markup.drop_color: [(r"\color [ r g b ] { 0 , 1 } x \textcolor { red } y", "x y")],
    markup.drop_layout: [
        (r" \raggedright \pmatrix a \operatorname * b \footnote c", r" \mypmatrix a \operatorname b ^ c"),
    ],
    markup.braces_balanced: [("{ a { b } }", True), ("{ a", False), ("} {", False), ("x", True)],
    markup.trim_trailing_space: [(r"x\hspace{1cm}\quad\;~.", "x"), ("x", "x"), (". x", ". x")],
    markup.compact: [("a b c", "abc"), (r"a \hline b", r"a \hline b"), (r"{ a } \textcolor{black} x", r"{a}\textcolor{black}x")],
    markup.flatten_rows: [
        (r"\begin{array} {lr} a \\ b ~ c \end{array}", "$ a b c $"),
        (r"\left( a \\ b \right) \\ c", r"$ \left( a \\ b \right) c $"),
        (r"\left( \left( a \right) \\ b \right) \qquad c", r"$ \left( \left( a \right) \\ b \right) c $"),
        (r"\left( a", None),
    ],
    markup.brace_single_args: [
        (r"\hat x + 1", r"\hat { x } + 1"),
        (r"\hat \bar x", r"\hat { \bar { x } }"),
        (r"\hat \bar { x y } z", r"\hat { \bar { x y } } z"),
        (r"\sqrt [ 3 ] x \sqrt y", r"\sqrt [ 3 ] { x } \sqrt { y }"),
        (r"\frac a b", r"\frac { a } { b }"),
        (r"\binom { \hat { n } } k", r"\binom { \hat { n } } { k }"),
        (r"\frac { a } { b }", r"\frac { a } { b }"),
        (r"\frac { \sqrt { x ^ { 2 } } } y", r"\frac { \sqrt { x ^ { 2 } } } { y }"),
        (r"\hat \bar { a { b { c { d { e { f } } } } } } g", r"\hat { \bar { a { b { c { d { e { f } } } } } } } g"),
        (r"\binom { { { { { { n } } } } } } \alpha z", r"\binom { { { { { { n } } } } } } { \alpha } z"),
        (r"\sqrt [ { a [ b ] } ] x y", r"\sqrt [ { a [ b ] } ] { x } y"),
        (r"\frac { \hat a } \sqrt b", r"\frac { \hat { a } } { \sqrt { } } b"),
        (r"\frac \frac a b c", r"\frac { \frac { } { } } { a } b c"),
        (r"{ \hat } { \frac a } { \sqrt }", r"{ \hat { } } { \frac { a } { } } { \sqrt { } }"),
        (r"\hat \bar", r"\hat { \bar }"),
        (r"a } \hat { b", r"a } \hat { b"),
    ],
    markup.normalize_token: [
        (r"\cdot", "."), (r"\left<", r"\langle"), (r"\left(", "("), (r"\right\}", r"\}"), (r"\bigl(", "("),
        (r"\Big\langle", r"\langle"), (r"\leq", r"\le"), (r"\lVert", r"\|"), (r"\vert", "|"),
        (r"\longrightarrow", r"\rightarrow"), (r"\widehat", r"\hat"), (r"\varepsilon", "epsilon"), ("x", "x"),
        # a rule on the first letters also takes whole arrow names
        (r"\leftarrow", "arrow"), (r"\to", "arrow"),
    ],
    markup.token_class: [
        (r"\phantom", "phantom"), (r"\frac", "two-arg"), (r"\hat", "one-arg"), (r"\mathbf", "style-only"),
        (r"\sqrt", "optional-arg"), ("{", "skip"), (r"\toprule", "skip"), (r"\overset", "skip"), ("[1.5ex]", "skip"),
        (r"\alpha", "visible"), ("x", "visible"),
    ],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_literal_cases(apply, function):
    texts, expected = zip(*CASES[function])
    assert apply(function, texts) == list(expected)


def test_unwrap_and_align(apply):
    assert apply(lambda c: latex.normalize_formula(c, unwrap=True), ["$$ x _ 1 $$"]) == [" x_1 "]
    assert apply(lambda c: latex.strip_display(c, align=True), [r"\begin{align*} $$x$$ \end{align*}"]) == ["x"]


def test_same_ignoring_space(spark):
    df = spark.createDataFrame([("a b", "a\nb", True), ("a", "b", False), ("a\tb", "ab", False)], "a string, b string, e boolean")
    assert df.filter(latex.same_ignoring_space(F.col("a"), F.col("b")) != F.col("e")).count() == 0


def test_13a_tokens(apply):
    texts = ["a,b 1,000 x-1 3-4", "f(x)=&lt;2.", r"\frac{a}"]
    expected = [
        "a , b 1,000 x-1 3 - 4".split(),
        "f ( x ) = < 2 .".split(),
        r"\ frac { a }".split(),
    ]
    assert apply(latex.tokens_13a, texts) == expected


def test_size_bucket(spark):
    rows = spark.createDataFrame([(600,), (601,), (1300,), (1301,)], "n int").select(markup.size_bucket(F.col("n")).alias("b"))
    assert [r.b for r in rows.collect()] == [5, 4, 4, 3]


def test_tokenized_text_keeps_environment_names_and_tables(apply):
    got = apply(
        markup.tokenized_formula,
        [r"\begin{align*} x &= 1 \end{align*}", r"\begin{tabular}{l} a \% b $c$ % note", r"a \% b"],
    )
    assert got == [
        r"\begin{aligned} x & = 1 \end{aligned}", r"\begin{tabular} { l } a \% b $ c $ \end{tabular}", "a \\"
    ]


def _filled(tokens):
    """Arguments in braces by recursive descent over a partner table; texts are balanced."""
    one, two = set(markup.ONE_ARG + markup.STYLE_ONLY), set(markup.TWO_ARG + markup.TWO_ARG_STYLE)
    optional = set(markup.OPTIONAL_ARG)
    partner, stack = {}, []
    for i, t in enumerate(tokens):
        if t in "{[":
            stack.append(i)
        elif t in "}]":
            partner[stack.pop()] = i

    def alone(t):
        return [t] + ["{", "}"] * (2 if t in two else 1 if t in one or t in optional else 0)

    def argument(i, stop, nests=False):
        if i >= stop:
            return ["{", "}"], i
        if tokens[i] == "{":
            return ["{", *body(i + 1, partner[i]), "}"], partner[i] + 1
        if nests and tokens[i] in one:
            inner, end = argument(i + 1, stop, True)
            return ["{", tokens[i], *inner, "}"], end
        return ["{", *alone(tokens[i]), "}"], i + 1

    def body(i, stop):
        out = []
        while i < stop:
            t = tokens[i]
            out.append(t)
            i += 1
            if t in optional and i < stop and tokens[i] == "[":
                out += ["[", *body(i + 1, partner[i]), "]"]
                i = partner[i] + 1
            elif t == "{":
                out += [*body(i, partner[i - 1]), "}"]
                i = partner[i - 1] + 1
            for _ in range(2 if t in two else 1 if t in one or t in optional else 0):
                arg, i = argument(i, stop, t in one)
                out += arg
        return out

    return body(0, len(tokens))


def test_arguments_against_recursive_descent(apply):
    import random

    random.seed(2)
    heads = [r"\hat", r"\bar", r"\mathrm", r"\frac", r"\overset", r"\sqrt", r"\xrightarrow", "x", "y", "+", "2"]

    def group(depth):
        out = []
        for _ in range(random.randint(0, 5)):
            t = random.choice(heads)
            out.append(t)
            if t in markup.OPTIONAL_ARG and random.random() < 0.5:
                # a head right before a closing bracket is not defined
                out += ["[", *[random.choice("abc") for _ in range(random.randint(1, 3))], "]"]
            if depth and random.random() < 0.6:
                out += ["{", *group(depth - 1), "}"]
        return out

    texts = [[*group(7), "z", "z", "z"] for _ in range(400)]
    found = apply(markup.brace_single_args, [" ".join(t) for t in texts])
    assert found == [" ".join(_filled(t)) for t in texts]
