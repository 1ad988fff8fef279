"""Formula, prediction and box tables derived from the driver's tables.

The driver's tables hold no LaTeX, so formulas are spelled out from the keys of ``orders``. Every
table covers all rows it is derived from. Expressions are plain SQL that Spark and DuckDB read the
same way; ``chr(92)`` is the backslash and ``chr(39)`` the quote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 50_000  # of orders; each becomes some fifty box rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """Over all cores, and over as many tasks as the rows fill; inputs in enough splits stay where they are.

    A split of a few compressed megabytes holds hours of text work, and a whole row group is read by
    one task. The rows are counted from the footers of the files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def quoted(text: str) -> str:
    """``text`` as an SQL expression without a backslash or a quote inside a literal."""
    parts, run = [], ""
    for char in text:
        if char in "\\'\n":
            if run:
                parts.append(f"'{run}'")
                run = ""
            parts.append(f"chr({ord(char)})")
        else:
            run += char
    if run or not parts:
        parts.append(f"'{run}'")
    return "(" + " || ".join(parts) + ")"


def spelled(template: str, **columns: str) -> str:
    """A template with ``<name>`` marks as one SQL expression; marks become columns as text."""
    expression = quoted(template)
    for name, column in columns.items():
        expression = expression.replace(f"<{name}>", f"' || cast({column} AS string) || '")
    return expression


_CUST, _KEY = "o_custkey", "o_orderkey"

FORMULA = f"""CASE
  WHEN o_orderkey % 101 = 0 THEN '  '
  WHEN o_orderkey % 97 = 0 THEN {spelled(r'\frac { <c> } { 2', c=_CUST)}
  WHEN o_orderkey % 5 = 0 THEN {spelled(r'\begin{align*} x _ { <c> } & = \frac { 1 } { <c> } \\ y & = 1 \end{align*}', c=_CUST)}
  WHEN o_orderkey % 5 = 1 THEN {spelled(r'$$ \sqrt { <c> } + \sin x \leq y $$', c=_CUST)}
  WHEN o_orderkey % 5 = 2 THEN {spelled(r'\mathrm { m a x } _ { k } \hat x \cdot 3.14')}
  WHEN o_orderkey % 5 = 3 THEN {spelled(r'\left( a + <k> \right) ^ { 2 } \dots b', k=_KEY)}
  ELSE {spelled('x _ { <c> } + y ^ { <k> } = z', c='o_custkey % 10', k='o_orderkey % 10')} END"""

FORMULA_COLUMNS = {
    "id": "cast(o_orderkey AS string)",
    "latex_formula": FORMULA,
    "key": "o_orderkey",
    "cust": "o_custkey",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
    "rendered": "o_orderkey % 11 <> 0",
}

PREDICTION = f"""CASE
  WHEN model = 'base' AND key % 3 = 0 THEN replace(latex_formula, '+', '-')
  WHEN model = 'base' AND key % 3 = 1 THEN replace(latex_formula, ' }} ', '}} ')
  WHEN model = 'tuned' AND key % 9 = 4 THEN {quoted('x ^ 2 + ')} || latex_formula || {quoted(' \\leq x')}
  WHEN model = 'tuned' AND key % 6 = 0 THEN replace(latex_formula, {quoted(chr(92) + 'leq')}, {quoted(chr(92) + 'le')})
  ELSE latex_formula END"""

PREDICTION_COLUMNS = {
    "model": "model",
    "dataset": "CASE WHEN key % 4 < 2 THEN 'printed' ELSE 'handwritten' END",
    "subset": "status",
    "id": "id",
    "gt": "latex_formula",
    "pred": PREDICTION,
    "gt_rendered": "key % 11 <> 0",
    "pred_rendered": "key % 13 <> 0",
    "key": "key",
}

# Constructs that the text functions act on, one per order, followed by a second one.
CONSTRUCTS = [
    r"\begin { a l i g n * } x &= 1 \end { align* }",
    r"\begin{array} { l r c } a & b \\ \end{array}",
    r"% lead x + 1 % tail",
    r"a \~ b \> c \label{eq:1} \\ d",
    r"{\rm d} x + { \rm e} + \rm{f}",
    r"\operatorname {s i n} x + \operatorname { l i m s u p } y",
    r"\operatorname * {a r g} z",
    r"\hspace { 1 . 5 cm } x \vspace { 2 ex } y",
    r"\not = b \not \in c",
    r"\big ( c \Bigg \rangle d \bigl [ e",
    r"\' e \' { o } f",
    r"\parbox { 3 cm } { x }",
    r"\raisebox { - 1 ex } [ 0 pt ] { x }",
    r"{ \char ' 1 2 } g",
    r"\specialrule { 1 pt } { 2 pt } { 3 pt } h",
    r"\begin {tabular} { l { 3 } r } \cmidrule ( l { 3 p t } ) { 1 - 1 } [ -1.5 ex ] u \\% v",
    r"\color [ r g b ] { 0 , 1 , 0 } x \textcolor { red } y",
    r"\raggedright \lowercase q \uppercase r \lefteqn s \footnote t",
    r"\pmatrix { 1 } \matrix { 2 }",
    r"\ldots \sin x \cdots \tanh y \dots \dots z \log w",
    r"\hat x + \hat \bar y + \hat { z }",
    r"\sqrt x + \sqrt [ 3 ] y + \sqrt { z }",
    r"\frac a b + \frac { c } d + \binom n { k } + \overset a b",
    r"\hat \tilde { x y } + \overline \lambda",
    r"\begin{array} {lr} a \\ b ~ c \qquad d \end{array}",
    r"\left( a \\ \left( b \\ c \right) \right) \\ d",
    r"\left( a \\ b",
    r"x \hspace{1cm}\quad\;~.",
    r"a \hline b c \times d \bf e",
    r"\begin{split} a \\ b \end{split} \begin{smallmatrix} c \end{smallmatrix}",
    r"\begin{eqnarray*} a & b \end{eqnarray*} \begin{alignat} c \end{alignat}",
    r"\mathrm { a b } c \text { d e } f \mathbf {g h}",
    r"$$ a + b $$ c $ $ d $$ e",
    r"\frac{1.5}{x_1}+\%\#.5<[2]>;",
    r"{ a { b } c } } {",
    r"{ a { b } c",
    r"hskip 3 cm x hskip4pt y \% z",
    r"\vert a \rVert b \longrightarrow c \widehat d \varepsilon e",
    r"\leq \geq \to \cdot \prime \ast \top \mid \Leftarrow",
    r"a  b   1   2    c",
    r"\vphantom { x } \displaystyle y \toprule \cline { 1 }",
    r"\frac { \sqrt { x ^ { 2 } } } y + \hat \bar { a { b { c } } } \sqrt [ { 3 } ] z",
    r"\overline { a _ { b _ { c _ { d _ { e _ { f } } } } } } \binom { { { { { { n } } } } } } k",
    r"\begin {tabular} { l { 3 { p { 1 } } } r } \cmidrule ( l { 3 { p { t } } } ) { 1 - { 2 { 3 } } } "
    r"\cline { { { { { { 1 } } } } } } u \begin {tabular} { c } v",
]
SECOND = [r"+ 1", r"\\", r"", r"\quad", r"& x _ 2", r"- \alpha .", r"\textcolor{black} k"]


def _choice(texts: list[str], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts))
    return f"CASE {index} {cases} END"


MARKUP = (
    f"{_choice(CONSTRUCTS, f'o_orderkey % {len(CONSTRUCTS)}')} || ' ' || cast(o_custkey AS string) || ' ' || "
    f"{_choice(SECOND, f'o_custkey % {len(SECOND)}')}"
)
MARKUP_COLUMNS = {"id": "cast(o_orderkey AS string)", "text": MARKUP}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.selectExpr(*_select(FORMULA_COLUMNS))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.selectExpr(*_select(MARKUP_COLUMNS))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = formulas(spark, sf_dir).withColumn("model", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
    return runs.selectExpr(*_select(PREDICTION_COLUMNS))


HIDDEN = ("{", "}", "^", "_", "&", "")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their places on a page of one line, both sides of every prediction."""
    sides = F.array(
        F.struct(F.lit("gt").alias("side"), F.col("gt").alias("text")),
        F.struct(F.lit("pred").alias("side"), F.col("pred").alias("text")),
    )
    cut = (
        predictions(spark, sf_dir)
        .select("model", "dataset", F.col("id").alias("sample_id"), "key", F.explode(sides).alias("s"))
        .select("model", "dataset", "sample_id", "key", "s.side", F.split(F.trim("s.text"), " ").alias("tokens"))
    )
    x = (
        20 * F.col("seq")
        + F.when(F.col("side") == "pred", 3).otherwise(0)
        + F.when((F.col("side") == "pred") & (F.col("key") % 4 == 0) & (F.col("seq") % 2 == 1), 40).otherwise(0)
    ).cast("int")
    hidden = F.col("token").isin(*HIDDEN) | F.col("token").startswith("$")
    box = F.when(hidden, F.array().cast("array<int>")).otherwise(F.array(x, F.lit(0), x + 12, F.lit(16)))
    return cut.select(
        "model", "dataset", "sample_id", "side", "key", F.size("tokens").alias("n"),
        F.posexplode("tokens").alias("seq", "token"),
    ).select(
        "model", "dataset", "sample_id", "side", "seq", "token", box.alias("bbox"),
        (20 * F.col("n") + 60).alias("page_w"), F.lit(40).alias("page_h"),
    )


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that exist: one for each part that was ever ordered."""
    parts = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return parts.select(F.format_string("%07d.png", "l_partkey").alias("name"))


# ---- The same tables for the SQL check --------------------------------------------------------

_CTE = {
    "formulas": f"SELECT {', '.join(_select(FORMULA_COLUMNS))} FROM orders",
    "markup": f"SELECT {', '.join(_select(MARKUP_COLUMNS))} FROM orders",
    "predictions": (
        f"SELECT {', '.join(_select(PREDICTION_COLUMNS))} FROM "
        "(SELECT *, unnest(['base', 'tuned']) AS model FROM formulas)"
    ),
    "side_texts": (
        "SELECT model, dataset, id AS sample_id, key, 'gt' AS side, string_split(trim(gt), ' ') AS tokens "
        "FROM predictions UNION ALL "
        "SELECT model, dataset, id, key, 'pred', string_split(trim(pred), ' ') FROM predictions"
    ),
    "all_boxes": (
        "SELECT *, NOT (token IN ('{', '}', '^', '_', '&', '') OR starts_with(token, '$')) AS visible, "
        "20 * seq + CASE WHEN side = 'pred' THEN 3 ELSE 0 END "
        "+ CASE WHEN side = 'pred' AND key % 4 = 0 AND seq % 2 = 1 THEN 40 ELSE 0 END AS x0, "
        "20 * n + 60 AS page_w FROM (SELECT model, dataset, sample_id, key, side, len(tokens) AS n, "
        "unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS seq FROM side_texts)"
    ),
    "image_names": "SELECT DISTINCT printf('%07d.png', l_partkey) AS name FROM lineitem",
}
_NEEDS = {
    "predictions": ["formulas"],
    "side_texts": ["predictions"],
    "all_boxes": ["side_texts"],
}


def with_tables(names: list[str], body: str) -> str:
    """``body`` after the CTEs that it names and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_CTE[name]})" for name in ordered)
    head = f"WITH {ctes}" if ctes else ""
    if body.lstrip().upper().startswith("WITH "):
        return head + ",\n" + body.lstrip()[5:] if head else body
    return f"{head}\n{body}"
