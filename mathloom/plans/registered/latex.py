"""Text functions over the markup table: one formula per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import latex, markup
from ..derived import markup as markup_table
from ..derived import predictions, quoted, table, with_tables
from . import sqltext as q


def _query(function):
    return lambda spark, sf: markup_table(spark, sf).select("id", function(F.col("text")).alias("out"))


def _oracle(expression: str) -> str:
    return with_tables(["markup"], f"SELECT id, {expression} AS out FROM markup")


_T = "text"


def _precondition(text: str, comment: bool, dollar: bool) -> str:
    text = q.sub(text, "^%", "", every=False)
    if comment:
        text = f"split_part({text}, '%', 1)"
    text = q.swap(text, {"\\~": " ", "\\>": " "})
    if dollar:
        text = q.swap(text, {"$": " "})
    text = q.sub(text, r"\\label\{.*?\}", "")
    thin = q.swap("t", {"\\\\": "\\,"})
    return (
        f"list_transform([{text}], lambda t: CASE WHEN regexp_matches(t, 'matrix|cases|array|begin') "
        f"THEN t ELSE {thin} END)[1]"
    )


def _canonical_env(text: str) -> str:
    names = {n: "aligned" for n in ("split", "align", "alignedat", "alignat", "eqnarray")} | {"smallmatrix": "matrix"}
    for name, new in names.items():
        text = q.sub(text, rf"(?s)\\begin\{{{name}\*?\}}(.+?)\\end\{{{name}\*?\}}", rf"\\begin{{{new}}}\1\\end{{{new}}}")
    return text


def _rm(text: str) -> str:
    return q.swap(text, {"{\\rm": "\\mathrm{", "{ \\rm": "\\mathrm{", "\\rm{": "\\mathrm{"})


def _operator_names(text: str) -> str:
    text = f"trim({q.sub(text, r'\s+', ' ')})"
    for name in markup.OPERATOR_NAMES:
        text = q.sub(text, r"\\operatorname \{ *" + " *".join(name) + r" *\}", r"\\" + name)
    return q.swap(text, {"\\\\ \\end{array}": "\\end{array}"})


def _repair(text: str) -> str:
    text = q.swap(text, {"\\\\%": "\\\\ %", "\\%": "<PERCENTAGE_TOKEN>"})
    text = q.swap(f"split_part({text}, '%', 1)", {"<PERCENTAGE_TOKEN>": "\\%"})
    end = quoted("\\end{tabular}")
    text = f"list_transform([{text}], lambda t: CASE WHEN contains(t, {end}) THEN t ELSE t || {end} END)[1]"
    return q.sub(q.swap(text, {"\r": " ", "\n": " "}), r"hskip(.*?)(cm|in|pt|mm|em)", r"hspace{\1\2}")


def tokenized_formula_sql(text: str) -> str:
    """Table text and formula text each by its own steps; ``text`` is a column name."""
    whole = lambda t: q.rewrite(q.tokenized(t), r"\\(?:begin|end) \{[^}]*\}", q.no_spaces)
    table = whole(_rm(_precondition(_repair(text), False, False)))
    formula = _operator_names(whole(_rm(_precondition(_canonical_env(text), True, True))))
    return f"CASE WHEN contains({text}, 'tabular') THEN {table} ELSE {formula} END"


def _expand(text: str) -> str:
    text = f"(' ' || {text} || ' ')"
    for name in ("ldots", "cdots", "dots", "dotsb"):
        text = q.swap(text, {f" \\{name} ": " . . . "})
    for name in ("log", "exp", "sin", "cos", "tan", "tanh", "cosh", "sinh"):
        text = q.swap(text, {f" \\{name} ": f" \\mathrm {{ {' '.join(name)} }} "})
    return f"list_transform([{text}], lambda t: t[2:-2])[1]"


def _glue() -> str:
    """Table heads and rules by running depth over their tokens, the other constructs by pattern."""
    one_space = lambda m: f"replace({m}, ' ', '') || ' '"
    lengths_out = q.rewrite(
        "(' ' || text || ' ')", r"\\[hv]space \{ [.0-9a-z ]+ \}",
        lambda m: f"CASE WHEN contains(text, 'tabular') AND {m} IS NOT NULL THEN '' ELSE replace({m}, ' ', '') END",
    )
    edges = q.sub("s", r"\\(begin|end) \{(tabular|array)\}", r"\\\1{\2}")
    steps = q.rewrite(
        "s", r"\\begin\{array\} \{ [lrc ]+ \}",
        lambda m: f"{quoted(chr(92) + 'begin{array} ')} || replace(substr({m}, 15), ' ', '')",
    )
    steps = q.rewrite(steps, r"\\not [<>+=\-]", q.no_spaces)
    steps = q.rewrite(steps, r"\\[Bb]igg?[glrm]? [(){}|\[\]] ", one_space)
    steps = q.rewrite(steps, r"(?s)\\[Bb]igg?[glrm]? \\.*? ", one_space)
    steps = q.rewrite(steps, r"\\' [^{] ", one_space)
    lengths = q.rewrite("s", r"\[ [\-.0-9 ]+[exptcm ]+ \]", q.no_spaces)
    steps = f"list_transform([{steps}], lambda s: CASE WHEN contains(text, 'tabular') THEN {lengths} ELSE s END)[1]"
    steps = q.rewrite(steps, r"\\parbox \{[^{]+\}", q.no_spaces)
    steps = q.rewrite(
        steps, r"\\raisebox \{[^{]+\} [\[\]0-9 exptcm]+\{", lambda m: f"rtrim(replace({m}, ' ', ''), '{{') || ' {{'"
    )
    steps = q.rewrite(
        steps, r"\{ \\char[0-9' ]+\}",
        lambda m: f"'{{ ' || replace(replace(replace({m}, ' ', ''), '{{', ''), '}}', '') || ' }}'",
    )
    steps = q.rewrite(steps, r"\\not [\\=<>][^ ]+ ", one_space)
    size = r" \{[ .0-9a-z]+\}"
    steps = q.rewrite(steps, rf"\\specialrule{size}{size}{size}", q.no_spaces)
    return with_tables(
        ["markup"],
        rf"""WITH spaced AS (SELECT id, text, {lengths_out} AS s FROM markup),
    edged AS (SELECT id, {edges} AS s FROM spaced WHERE contains(text, 'tabular')),
    tok AS (SELECT id, unnest(string_split(s, ' ')) AS t, generate_subscripts(string_split(s, ' '), 1) AS i FROM edged),
    deep AS (SELECT *, lead(t) OVER w AS following,
        sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS braces,
        sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS rounds,
        row_number() OVER (PARTITION BY id, t ORDER BY i) AS nth
        FROM tok WINDOW w AS (PARTITION BY id ORDER BY i)),
    head AS (SELECT * FROM deep WHERE (t = '\begin{{tabular}}' AND nth = 1) OR t IN ('\cmidrule', '\cline')),
    round_end AS (SELECT h.id, h.i, min(d.i) AS j FROM head h JOIN deep d ON d.id = h.id AND d.i > h.i
        AND h.following = '(' AND h.t <> '\begin{{tabular}}' AND d.t = ')' AND d.rounds = h.rounds GROUP BY h.id, h.i),
    begun AS (SELECT h.id, h.i, coalesce(r.j, h.i) AS j FROM head h LEFT JOIN round_end r ON r.id = h.id AND r.i = h.i),
    ended AS (SELECT b.id, b.i, min(d.i) AS j FROM begun b JOIN deep f ON f.id = b.id AND f.i = b.j
        JOIN deep d ON d.id = b.id AND d.i > b.j AND d.t = '}}' AND d.braces = f.braces GROUP BY b.id, b.i),
    heads AS (SELECT id, string_agg(CASE WHEN i = 1 OR EXISTS (SELECT 1 FROM ended e WHERE e.id = deep.id
        AND deep.i > e.i AND deep.i <= e.j) THEN '' ELSE ' ' END || t, '' ORDER BY i) AS s FROM deep GROUP BY id),
    joined AS (SELECT spaced.id, text, coalesce(heads.s, spaced.s) AS s FROM spaced LEFT JOIN heads USING (id))
    SELECT id, list_transform([{steps}], lambda t: t[2:-2])[1] AS out FROM joined""",
    )


def _layout(text: str) -> str:
    text = q.swap(q.strip(text), {"\\pmatrix": "\\mypmatrix", "\\matrix": "\\mymatrix"})
    gone = ("\\raggedright", "\\arraybackslash", "\\lowercase", "\\uppercase")
    text = q.swap(q.swap(text, {w: "" for w in gone}), {"\\operatorname *": "\\operatorname"})
    return q.swap(text, {"\\lefteqn": "", "\\footnote ": "^ "})


def _compact(text: str) -> str:
    for _ in range(3):
        text = q.sub(text, r"([^\\\s])\s+([^\\\s])", r"\1\2")
    # what is left beside a backslash or an end: one space stays on that side
    text = q.sub(text, r"([^\\\s])\s+(\s\\)", r"\1\2")
    text = q.sub(text, r"([^\\\s])\s+(\s)$", r"\1\2")
    for word in markup.SPACED_AGAIN:
        text = q.swap(text, {word: word + " "})
    return q.swap(text, {" \\textcolor{black}": "\\textcolor{black}"})


_FLATTEN = with_tables(
    ["markup"],
    rf"""WITH cut AS (SELECT id, string_split(text, ' ') AS t FROM markup),
    body AS (SELECT id, CASE WHEN t[1] = '\begin{{array}}' THEN
        CASE WHEN t[-1] = '\end{{array}}' THEN t[3:-2] ELSE t[3:] END ELSE t END AS t FROM cut),
    tok AS (SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM body),
    deep AS (SELECT *, coalesce(sum(CASE token WHEN '\left(' THEN 1 WHEN '\right)' THEN -1 ELSE 0 END)
        OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
        sum(CASE token WHEN '\left(' THEN 1 WHEN '\right)' THEN -1 ELSE 0 END) OVER (PARTITION BY id) AS final
        FROM tok)
    SELECT id, CASE WHEN any_value(final) = 0 THEN '$ ' || coalesce(string_agg(token, ' ' ORDER BY i)
        FILTER (WHERE NOT (depth = 0 AND token IN ('\\', '~', '\qquad'))), '') || ' $' END AS out
    FROM deep GROUP BY id""",
)


def _braced() -> str:
    """Braces to add before and after each token, from the running depth of the groups around it."""
    names = lambda *groups: ", ".join(quoted(n) for g in groups for n in g)
    return with_tables(
        ["markup"],
        f"""WITH tok AS (SELECT id, unnest(string_split(text, ' ')) AS t,
        generate_subscripts(string_split(text, ' '), 1) AS i FROM markup),
    deep AS (SELECT *, CASE WHEN t IN ({names(markup.ONE_ARG, markup.STYLE_ONLY)}) THEN 'one'
        WHEN t IN ({names(markup.TWO_ARG, markup.TWO_ARG_STYLE)}) THEN 'two'
        WHEN t IN ({names(markup.OPTIONAL_ARG)}) THEN 'optional' ELSE '' END AS kind,
        sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w + (t = '}}')::INT AS brace,
        sum(CASE t WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w + (t = ']')::INT AS bracket
        FROM tok WINDOW w AS (PARTITION BY id ORDER BY i)),
    pair AS (SELECT id, i, lead(i) OVER (PARTITION BY id, brace ORDER BY i) AS j, t FROM deep WHERE t IN ('{{', '}}')
        UNION ALL
        SELECT id, i, lead(i) OVER (PARTITION BY id, bracket ORDER BY i), t FROM deep WHERE t IN ('[', ']')),
    -- each token with the end of what begins there: its group, or itself
    unit AS (SELECT d.*, coalesce(p.j, d.i) AS j FROM deep d LEFT JOIN pair p ON p.id = d.id AND p.i = d.i AND p.t IN ('{{', '[')),
    -- the first place after a chain of heads
    chained AS (SELECT *, min(CASE WHEN kind <> 'one' THEN i END) OVER
        (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS last FROM unit),
    one AS (SELECT c.id, c.i + 1 AS a, e.j AS b FROM chained c JOIN unit e ON e.id = c.id AND e.i = c.last
        JOIN unit n ON n.id = c.id AND n.i = c.i + 1 WHERE c.kind = 'one' AND n.t <> '{{'),
    option AS (SELECT h.id, CASE WHEN n.t = '[' THEN n.j ELSE h.i END AS before FROM unit h
        JOIN unit n ON n.id = h.id AND n.i = h.i + 1 WHERE h.kind = 'optional'),
    first AS (SELECT id, i AS before FROM unit WHERE kind = 'two'),
    second AS (SELECT f.id, n.j AS before FROM first f JOIN unit n ON n.id = f.id AND n.i = f.before + 1),
    single AS (SELECT w.id, n.i AS a, n.i AS b FROM
        (SELECT * FROM option UNION ALL SELECT * FROM first UNION ALL SELECT * FROM second) w
        JOIN unit n ON n.id = w.id AND n.i = w.before + 1 WHERE n.t <> '{{'),
    wrap AS (SELECT * FROM one UNION ALL SELECT * FROM single),
    opened AS (SELECT id, a AS i, count(*) AS n FROM wrap GROUP BY id, a),
    closed AS (SELECT id, b AS i, count(*) AS n FROM wrap GROUP BY id, b)
    SELECT d.id, string_agg(repeat('{{ ', coalesce(o.n, 0)) || t || repeat(' }}', coalesce(c.n, 0)), ' ' ORDER BY d.i) AS out
    FROM deep d LEFT JOIN opened o ON o.id = d.id AND o.i = d.i LEFT JOIN closed c ON c.id = d.id AND c.i = d.i
    GROUP BY d.id""",
    )


def norm_token_sql(token: str) -> str:
    pairs = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in markup.SYNONYMS.items())
    one = f"CASE {token} {pairs} ELSE {token} END"
    two = (
        r"CASE WHEN regexp_matches(t, '^\\(left|right)') THEN replace(replace(t, '\left', ''), '\right', '') ELSE t END"
    )
    three = (
        r"CASE WHEN regexp_matches(t, '^\\[bB]ig') THEN CASE WHEN contains(substr(t, 5), '\') "
        r"THEN '\' || string_split(substr(t, 5), '\')[-1] ELSE right(t, 1) END ELSE t END"
    )
    four = (
        r"CASE WHEN t IN ('\leq', '\geq') THEN left(t, 3) WHEN t IN ('\lVert', '\rVert', '\Vert') THEN '\|' "
        r"WHEN t IN ('\lvert', '\rvert', '\vert') THEN '|' WHEN ends_with(t, 'rightarrow') THEN '\rightarrow' "
        r"WHEN ends_with(t, 'leftarrow') THEN '\leftarrow' WHEN starts_with(t, '\wide') THEN replace(t, 'wide', '') "
        r"WHEN starts_with(t, '\var') THEN replace(t, '\var', '') ELSE t END"
    )
    text = f"[{one}]"
    for step in (two, three, four):
        text = f"list_transform({text}, lambda t: {step})"
    return f"{text}[1]"


def _class_sql() -> str:
    within = lambda names: f"token IN ({', '.join(quoted(n) for n in names)})"
    skip = r"^(?:\{|\}|[\[\]]|\\begin\{.*?\}|\\end\{.*?\}|\^|_|\\.*rule.*|\\.*line.*|\[[\-.0-9]+[epm][xtm]\])"
    return (
        f"CASE WHEN {within(markup.PHANTOM)} THEN 'phantom' WHEN {within(markup.TWO_ARG)} THEN 'two-arg' "
        f"WHEN {within(markup.ONE_ARG)} THEN 'one-arg' WHEN {within(markup.STYLE_ONLY)} THEN 'style-only' "
        f"WHEN {within(markup.OPTIONAL_ARG)} THEN 'optional-arg' "
        f"WHEN {within(markup.SKIPPED + markup.TWO_ARG_STYLE)} OR regexp_matches(token, {q.pattern(skip)}) THEN 'skip' "
        "ELSE 'visible' END"
    )


def _each_token(function):
    def run(spark, sf):
        tokens = markup_table(spark, sf).select("id", F.posexplode(F.split("text", " ")).alias("i", "token"))
        return tokens.select("id", "i", "token", function(F.col("token")).alias("out"))

    return run


def _each_token_sql(expression: str) -> str:
    return with_tables(
        ["markup"],
        "WITH tok AS (SELECT id, unnest(string_split(text, ' ')) AS token, "
        "generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM markup) "
        f"SELECT id, i, token, {expression} AS out FROM tok",
    )


def _size_bucket(spark, sf):
    """Documents by their number of words, whole texts."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return table(spark, sf, "documents").select("doc_id", words.alias("n"), markup.size_bucket(words).alias("out"))


def _same(spark, sf):
    same = latex.same_ignoring_space(F.col("gt"), F.col("pred"))
    return predictions(spark, sf).select("model", "id", same.cast("int").alias("out"))


def _both_forms(spark, sf):
    return predictions(spark, sf).select(
        "model", "id",
        latex.normalize_formula(F.col("gt")).alias("gt_form"),
        latex.normalize_formula(F.col("pred"), unwrap=True).alias("pred_form"),
    )


QUERIES = {
    "t01_strip_env": _query(latex.strip_env),
    "t02_strip_display": _query(latex.strip_display),
    "t02_strip_display_align": _query(lambda c: latex.strip_display(c, align=True)),
    "t03_squeeze": _query(latex.squeeze),
    "t04_clean_env": _query(latex.clean_env),
    "t05_tokenize": _query(latex.tokenize),
    "t06_wrap_align": _query(latex.wrap_align),
    "t07_same_ignoring_space": _same,
    "t08_canonical_env": _query(markup.canonical_env),
    "t09_operator_names": _query(markup.operator_names),
    "t10_precondition_formula": _query(markup.precondition_formula),
    "t11_precondition_table": _query(markup.precondition_table),
    "t12_rm_to_mathrm": _query(markup.rm_to_mathrm),
    "t13_repair_tabular": _query(markup.repair_tabular),
    "t14_expand_functions": _query(markup.expand_functions),
    "t15_glue_tokens": _query(markup.glue_tokens),
    "t16_drop_color": _query(markup.drop_color),
    "t17_drop_layout": _query(markup.drop_layout),
    "t18_braces_balanced": _query(lambda c: markup.braces_balanced(c).cast("int")),
    "t19_trim_trailing_space": _query(markup.trim_trailing_space),
    "t20_compact": _query(markup.compact),
    "t21_flatten_rows": _query(markup.flatten_rows),
    "t22_brace_single_args": _query(markup.brace_single_args),
    "t23_normalize_token": _each_token(markup.normalize_token),
    "t24_token_class": _each_token(markup.token_class),
    "t25_size_bucket": _size_bucket,
    "t26_normalize_formula": _both_forms,
}

_COLOR = r"\\(?:colorbox|color|textcolor|cellcolor)[ \[\]RGBrgb]+\{ [A-Za-z 0-9,!]+ \} "
_TRAIL = (
    r"(?:\\(?:hspace\*?\{[^{}]*?\}|vspace\*?\{[^{}]*?\}|smallskip|medskip|quad|qquad|bigskip|[;,])|~|\.)*$"
)
_NAMED = r"\\(?:begin|end)\s*\{\s*[^}]*\}"
_NAMED_GROUPS = r"\\(begin|end)\s*\{\s*([^}]*)\}"

ORACLES = {
    "t01_strip_env": _oracle(q.strip(q.sub(_T, r"\\begin\{.*?\}|\s*\\end\{.*?\}", ""))),
    "t02_strip_display": _oracle(q.unwrapped(_T)),
    "t02_strip_display_align": _oracle(q.unwrapped(q.strip(q.sub(_T, r"\\(begin|end)\{align\*\}", "")))),
    "t03_squeeze": _oracle(q.squeezed(_T)),
    "t04_clean_env": _oracle(
        q.sub(q.rewrite(_T, _NAMED, lambda m: q.no_spaces(q.sub(m, _NAMED_GROUPS, r"\\\1{\2}"))), r"\$\s+\$", "$$")
    ),
    "t05_tokenize": _oracle(q.tokenized(_T)),
    "t06_wrap_align": _oracle(
        r"CASE WHEN contains(text, '\\') OR contains(text, '&') THEN '\begin{align*} ' || text || ' \end{align*}' "
        "ELSE text END"
    ),
    "t07_same_ignoring_space": with_tables(
        ["predictions"],
        "SELECT model, id, (replace(replace(gt, chr(10), ''), ' ', '') = replace(replace(pred, chr(10), ''), ' ', ''))"
        "::int AS out FROM predictions",
    ),
    "t08_canonical_env": _oracle(_canonical_env(_T)),
    "t09_operator_names": _oracle(_operator_names(_T)),
    "t10_precondition_formula": _oracle(_precondition(_T, True, True)),
    "t11_precondition_table": _oracle(_precondition(_T, False, False)),
    "t12_rm_to_mathrm": _oracle(_rm(_T)),
    "t13_repair_tabular": _oracle(_repair(_T)),
    "t14_expand_functions": _oracle(_expand(_T)),
    "t15_glue_tokens": _glue(),
    "t16_drop_color": _oracle(q.sub(_T, _COLOR, "")),
    "t17_drop_layout": _oracle(_layout(_T)),
    "t18_braces_balanced": _oracle(f"{q.balanced(_T)}::int"),
    "t19_trim_trailing_space": _oracle(q.sub(_T, _TRAIL, "", every=False)),
    "t20_compact": _oracle(_compact(_T)),
    "t21_flatten_rows": _FLATTEN,
    "t22_brace_single_args": _braced(),
    "t23_normalize_token": _each_token_sql(norm_token_sql("token")),
    "t24_token_class": _each_token_sql(_class_sql()),
    "t25_size_bucket": (
        r"WITH words AS (SELECT doc_id, len(string_split_regex(trim(text), '\s+')) AS n FROM documents) "
        "SELECT doc_id, n, CASE WHEN n > 1300 THEN 3 WHEN n > 600 THEN 4 ELSE 5 END AS out FROM words"
    ),
    "t26_normalize_formula": with_tables(
        ["predictions"],
        f"SELECT model, id, {q.normalized('gt')} AS gt_form, {q.normalized('pred', True)} AS pred_form FROM predictions",
    ),
}
