"""Box-table operators over both sides of every prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import alignment
from ...operators import structure as s
from ..derived import boxes, predictions, with_tables
from .latex import norm_token_sql

BY = ["model", "dataset"]
KEYS = [*BY, "sample_id"]
GROUP = [*KEYS, "side"]


def _seen(spark, sf):
    return s.visible_boxes(boxes(spark, sf))


def box_center(spark, sf):
    return s.box_center(_seen(spark, sf)).select(*GROUP, "seq", "x_c", "y_c")


def visible_boxes(spark, sf):
    flat = [F.get("bbox", i).alias(f"b{i}") for i in range(4)]
    return _seen(spark, sf).select(*GROUP, "seq", "token", *flat, "page_w", "page_h")


def token_order(spark, sf):
    ordered = s.token_order(_seen(spark, sf), KEYS)
    return ordered.select(*GROUP, "seq", F.round("order", 9).alias("order"))


def occurrence_rank(spark, sf):
    return s.occurrence_rank(_seen(spark, sf), KEYS).select(*GROUP, "seq", "norm_token", "k")


def pair_samples(spark, sf):
    return s.pair_samples(boxes(spark, sf), KEYS)


_PAIR = [*KEYS, "norm_token", "gt_seq", "pred_seq"]


def pair_candidates(spark, sf):
    return s.pair_candidates(_seen(spark, sf), KEYS).select(*_PAIR, "token_cost")


def pair_cost(spark, sf):
    pairs = s.pair_candidates(s.token_order(_seen(spark, sf), KEYS), KEYS)
    return s.pair_cost(pairs).select(*_PAIR, F.round("cost", 6).alias("cost"))


def align_by_occurrence(spark, sf):
    return s.align_by_occurrence(_seen(spark, sf), KEYS).select(*_PAIR)


def align_mutual_best(spark, sf):
    return s.align_mutual_best(_seen(spark, sf), KEYS).select(*_PAIR)


def align_by_cost(spark, sf):
    """No SQL: the alignment is a dynamic program; tests hold it against brute force."""
    return alignment.align_by_cost(_seen(spark, sf), KEYS).select(*_PAIR)


def residual_inliers(spark, sf):
    matches = s.align_by_occurrence(_seen(spark, sf), KEYS)
    return s.residual_inliers(matches, KEYS).select(*_PAIR, F.col("inlier").cast("int").alias("inlier"))


def _scores(samples):
    return samples.select(*KEYS, "recall", "precision", "f1", F.col("exact").cast("int").alias("exact"))


def _samples(spark, sf):
    matches = s.align_by_occurrence(_seen(spark, sf), KEYS)
    return s.score_samples(matches, s.pair_samples(boxes(spark, sf), KEYS), KEYS)


def score_samples(spark, sf):
    return _scores(_samples(spark, sf))


def score_corpus(spark, sf):
    return s.score_corpus(_samples(spark, sf), BY)


def token_vocab(spark, sf):
    return s.token_vocab(_seen(spark, sf))


def token_ids(spark, sf):
    return s.token_ids(_seen(spark, sf))


def token_bag_f1(spark, sf):
    return _scores(s.token_bag_f1(boxes(spark, sf), KEYS))


def structure_score(spark, sf):
    return s.structure_score(boxes(spark, sf), BY, KEYS)


def stack_sides(spark, sf):
    rows = predictions(spark, sf)
    side = lambda name: rows.select("model", "id", F.col(name).alias("text"))
    return s.stack_sides(side("gt"), side("pred"))


QUERIES = {
    "p08_box_center": box_center,
    "f04_visible_boxes": visible_boxes,
    "w01_token_order": token_order,
    "w03_occurrence_rank": occurrence_rank,
    "j07_pair_samples": pair_samples,
    "j09_pair_candidates": pair_candidates,
    "m01_pair_cost": pair_cost,
    "m02a_align_by_occurrence": align_by_occurrence,
    "m02b_align_mutual_best": align_mutual_best,
    "m02b_align_by_cost": align_by_cost,
    "m03_residual_inliers": residual_inliers,
    "a07_score_samples": score_samples,
    "a08_score_corpus": score_corpus,
    "a11_token_vocab": token_vocab,
    "a11_token_ids": token_ids,
    "m04_token_bag_f1": token_bag_f1,
    "m05_structure_score": structure_score,
    "u03_stack_sides": stack_sides,
}

# ---- SQL: plain windows and self joins --------------------------------------------------------

_K = "model, dataset, sample_id"
_ON = "g.model = p.model AND g.dataset = p.dataset AND g.sample_id = p.sample_id"


def _boxes_sql(body: str) -> str:
    return with_tables(["all_boxes"], body)


_RANKED = (
    "token_forms AS MATERIALIZED (SELECT token, "
    f"{norm_token_sql('token')} AS norm_token FROM (SELECT DISTINCT token FROM all_boxes WHERE visible)), "
    f"named AS MATERIALIZED (SELECT b.*, norm_token, (row_number() OVER (PARTITION BY {_K}, side ORDER BY seq) - 1)::double / "
    f"count(*) OVER (PARTITION BY {_K}, side) AS ord FROM all_boxes b JOIN token_forms USING (token) WHERE visible), "
    f"ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_K}, side, norm_token ORDER BY seq) - 1 AS k "
    "FROM named)"
)
_COST = (
    "round(CASE WHEN g.token = p.token THEN 0.0 ELSE 0.05 END "
    "+ 0.05 * ((abs(g.x0 / g.page_w::double - p.x0 / p.page_w::double) "
    "+ abs((g.x0 + 12) / g.page_w::double - (p.x0 + 12) / p.page_w::double)) / 4) + 0.15 * abs(g.ord - p.ord), 9)"
)


def _pairs(condition: str, columns: str = "") -> str:
    return (
        f"SELECT g.model, g.dataset, g.sample_id, g.norm_token, g.seq AS gt_seq, p.seq AS pred_seq{columns} "
        f"FROM ranked g JOIN ranked p ON {_ON} AND g.norm_token = p.norm_token AND {condition} "
        "WHERE g.side = 'gt' AND p.side = 'pred'"
    )


_COUNTS = (
    f"counts AS (SELECT {_K}, sum((side = 'gt')::int)::bigint AS n_gt, sum((side = 'pred')::int)::bigint AS n_pred "
    f"FROM all_boxes WHERE visible GROUP BY ALL HAVING sum((side = 'gt')::int) > 0)"
)


def _scored(hits: str) -> str:
    return (
        f"hits AS (SELECT {_K}, count(*) AS n FROM {hits} GROUP BY ALL), "
        f"scored AS (SELECT {_K}, round(coalesce(n, 0) / n_gt, 3) AS recall, "
        "CASE WHEN n_pred = 0 THEN 0.0 ELSE round(coalesce(n, 0) / n_pred, 3) END AS precision, "
        "round(2 * coalesce(n, 0) / (n_gt + n_pred), 3) AS f1, "
        "(coalesce(n, 0) = n_gt AND coalesce(n, 0) = n_pred)::int AS exact "
        f"FROM counts LEFT JOIN hits USING ({_K}))"
    )


_MATCHED = f"matched AS MATERIALIZED ({_pairs('g.k = p.k', ', g.x0 + 6.0 AS gx, 8.0 AS gy, p.x0 + 6.0 AS px, 8.0 AS py')})"
_SCORE_COLUMNS = f"{_K}, recall::double AS recall, precision::double AS precision, f1::double AS f1, exact"
_CORPUS = (
    "SELECT model, dataset, round(avg(f1), 3) AS cdm, round(avg(exact), 3) AS exp_cdm FROM scored GROUP BY ALL"
)


def _residual_rounds(rounds: int = 3) -> str:
    """The fits written out: first means, then quartiles of the open matches."""
    parts, open_rows = [], "matched"
    for r in range(rounds):
        last = r == rounds - 1
        if r == 0:
            stats = (
                "avg(gx) AS mx, avg(gy) AS my, avg(px) - avg(gx) AS dx, avg(py) - avg(gy) AS dy, "
                "sqrt(var_pop(gx) + var_pop(gy)) AS gs, sqrt(var_pop(px) + var_pop(py)) AS ps"
            )
        else:
            quarter = lambda c: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
            stats = (
                "quantile_cont(gx, 0.5) AS mx, quantile_cont(gy, 0.5) AS my, quantile_cont(px - gx, 0.5) AS dx, "
                f"quantile_cont(py - gy, 0.5) AS dy, {quarter('gx')} + {quarter('gy')} AS gs, {quarter('px')} + {quarter('py')} AS ps"
            )
        parts.append(f"fit{r} AS MATERIALIZED (SELECT {_K}, count(*) AS n, {stats} FROM {open_rows} GROUP BY ALL)")
        scale = "CASE WHEN gs > 0 AND ps > 0 THEN ps / gs ELSE 1.0 END"
        parts.append(f"at{r} AS (SELECT m.*, n, {scale} AS sc, mx, my, dx, dy FROM {open_rows} m JOIN fit{r} USING ({_K}))")
        distance = "round(sqrt((sc * (gx - mx) + mx + dx - px) ** 2 + (sc * (gy - my) + my + dy - py) ** 2), 6)"
        first = "true" if r == 0 else "false"
        parts.append(
            f"judged{r} AS MATERIALIZED (SELECT *, CASE WHEN n <= 3 THEN {first} ELSE {distance} < 25 END AS fits FROM at{r})"
        )
        columns = f"{_K}, norm_token, gt_seq, pred_seq, gx, gy, px, py"
        closed = "true" if last else "(fits OR n <= 3)"
        parts.append(f"done{r} AS (SELECT {columns}, fits FROM judged{r} WHERE {closed})")
        parts.append(f"open{r} AS (SELECT {columns} FROM judged{r} WHERE NOT {closed})")
        open_rows = f"open{r}"
    union = " UNION ALL ".join(f"SELECT * FROM done{r}" for r in range(rounds))
    return ", ".join(parts) + f", settled AS ({union})"


# The whole chain from boxes to a score per group, for texts that have CTEs of their own.
STRUCTURE_CTES = (
    f"{_RANKED}, {_MATCHED}, {_residual_rounds()}, inliers AS (SELECT * FROM settled WHERE fits), {_COUNTS}, "
    f"{_scored('inliers')}, placed AS ({_CORPUS})"
)


def _two_tiers(columns: str = "") -> str:
    """Of each spelling the shared number of tokens is paired in order; the surplus is paired by form."""
    pairs = lambda rows, same: (
        f"SELECT g.model, g.dataset, g.sample_id, g.norm_token, g.seq AS gt_seq, p.seq AS pred_seq{columns} FROM {rows} g "
        f"JOIN {rows} p ON {_ON} AND {same} WHERE g.side = 'gt' AND p.side = 'pred'"
    )
    return (
        f"spelled AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_K}, side, token ORDER BY seq) AS nth FROM named), "
        f"shared AS (SELECT {_K}, token, least(count(*) FILTER (side = 'gt'), count(*) FILTER (side = 'pred')) AS n_shared "
        "FROM spelled GROUP BY ALL), "
        f"surplus AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY {_K}, side, norm_token ORDER BY seq) AS j "
        f"FROM spelled s JOIN shared USING ({_K}, token) WHERE nth > n_shared), "
        f"paired AS MATERIALIZED ({pairs('spelled', 'g.token = p.token AND g.nth = p.nth')} "
        f"UNION ALL {pairs('surplus', 'g.norm_token = p.norm_token AND g.j = p.j')}) SELECT * FROM paired"
    )


ORACLES = {
    "p08_box_center": _boxes_sql(
        f"SELECT {_K}, side, seq, (2 * x0 + 12) / 2.0::double AS x_c, 8.0::double AS y_c FROM all_boxes WHERE visible"
    ),
    "f04_visible_boxes": _boxes_sql(
        f"SELECT {_K}, side, seq, token, x0 AS b0, 0 AS b1, x0 + 12 AS b2, 16 AS b3, page_w, 40 AS page_h "
        "FROM all_boxes WHERE visible"
    ),
    "w01_token_order": _boxes_sql(
        f"SELECT {_K}, side, seq, round((row_number() OVER (PARTITION BY {_K}, side ORDER BY seq) - 1)::double / "
        f"count(*) OVER (PARTITION BY {_K}, side), 9) AS \"order\" FROM all_boxes WHERE visible"
    ),
    "w03_occurrence_rank": _boxes_sql(f"WITH {_RANKED} SELECT {_K}, side, seq, norm_token, k FROM ranked"),
    "j07_pair_samples": _boxes_sql(f"WITH {_COUNTS} SELECT * FROM counts"),
    "j09_pair_candidates": _boxes_sql(
        f"WITH {_RANKED}, " + _two_tiers(", CASE WHEN g.token = p.token THEN 0.0::double ELSE 0.05::double END AS token_cost")
    ),
    "m01_pair_cost": _boxes_sql(f"WITH {_RANKED}, " + _two_tiers(f", round({_COST}, 6)::double AS cost")),
    "m02a_align_by_occurrence": _boxes_sql(
        f"WITH {_RANKED}, paired AS MATERIALIZED ({_pairs('g.k = p.k')}) SELECT * FROM paired"
    ),
    "m02b_align_mutual_best": _boxes_sql(f"WITH {_RANKED}, " + _two_tiers()),
    "m03_residual_inliers": _boxes_sql(
        f"WITH {_RANKED}, {_MATCHED}, {_residual_rounds()} "
        f"SELECT {_K}, norm_token, gt_seq, pred_seq, fits::int AS inlier FROM settled"
    ),
    "a07_score_samples": _boxes_sql(
        f"WITH {_RANKED}, {_MATCHED}, {_COUNTS}, {_scored('matched')} SELECT {_SCORE_COLUMNS} FROM scored"
    ),
    "a08_score_corpus": _boxes_sql(f"WITH {_RANKED}, {_MATCHED}, {_COUNTS}, {_scored('matched')} {_CORPUS}"),
    "a11_token_vocab": _boxes_sql(
        f"SELECT token, {norm_token_sql('token')} AS norm_token, sum((side = 'gt')::int)::bigint AS gt_count, "
        "sum((side = 'pred')::int)::bigint AS pred_count FROM all_boxes WHERE visible GROUP BY token"
    ),
    "a11_token_ids": _boxes_sql(
        f"WITH vocab AS (SELECT token, {norm_token_sql('token')} AS norm_token, sum((side = 'gt')::int)::bigint AS gt_count, "
        "sum((side = 'pred')::int)::bigint AS pred_count FROM all_boxes WHERE visible GROUP BY token) "
        "SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id, norm_token, "
        "dense_rank() OVER (ORDER BY norm_token) - 1 AS norm_id, gt_count, pred_count FROM vocab"
    ),
    "m04_token_bag_f1": _boxes_sql(
        f"WITH {_RANKED}, {_COUNTS}, bag AS (SELECT {_K}, norm_token, least(sum((side = 'gt')::int), sum((side = 'pred')::int)) AS c "
        f"FROM ranked GROUP BY ALL), pool AS (SELECT {_K} FROM (SELECT *, unnest(range(c::bigint)) AS i FROM bag)), "
        f"{_scored('pool')} SELECT {_SCORE_COLUMNS} FROM scored"
    ),
    "m05_structure_score": _boxes_sql(f"WITH {STRUCTURE_CTES} SELECT * FROM placed"),
    "u03_stack_sides": with_tables(
        ["predictions"],
        "SELECT model, id, gt AS text, 'gt' AS side FROM predictions UNION ALL SELECT model, id, pred, 'pred' FROM predictions",
    ),
}
