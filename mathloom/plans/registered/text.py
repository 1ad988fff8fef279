"""Text scores of the predictions, whole formulas and all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import latex
from ...operators import metric_states as states
from ...operators import structure
from ...operators import text_metrics as m
from ...session import new_folder
from ..derived import boxes, image_names, predictions, table, with_tables
from . import sqltext as q
from . import structure as boxed

BY = ["model", "dataset", "subset"]
METRICS = ["bleu", "edit", "anls", "exp"]


def _forms(spark, sf):
    return m.normalized(predictions(spark, sf), unwrap=True)


def corpus_bleu(spark, sf):
    return m.corpus_bleu(_forms(spark, sf), BY)


def corpus_bleu_13a(spark, sf):
    return m.corpus_bleu(_forms(spark, sf), BY, tokens=latex.tokens_13a)


def mean_edit(spark, sf):
    return m.mean_edit(_forms(spark, sf), BY)


def mean_anls(spark, sf):
    return m.mean_anls(_forms(spark, sf), BY)


def exact_rate(spark, sf):
    return m.exact_rate(_forms(spark, sf), BY)


def _renders(spark, sf):
    """A render's digest stands for its pixels; formulas that look alike share it."""
    rows = _forms(spark, sf)
    for side in ("gt", "pred"):
        there = F.col(f"{side}_rendered")
        text = F.regexp_replace(side, "[\n ]", "")
        rows = rows.withColumns(
            {
                f"{side}_width": F.when(there, F.length(text)),
                f"{side}_height": F.when(there, F.lit(40)),
                f"{side}_digest": F.when(there, F.md5(text)),
            }
        )
    return m.image_exact_match(rows)


def image_exact_match(spark, sf):
    return _renders(spark, sf).select("model", "id", F.col("image_match").cast("int").alias("image_match"))


def masked_rates(spark, sf):
    return m.masked_rates(_renders(spark, sf), ["model", "dataset"])


def artifact_rate(spark, sf):
    """Parts whose image exists, by part type."""
    from ...operators import curate

    rows = table(spark, sf, "part").select("p_type", curate.image_name(F.col("p_partkey")).alias("name"))
    return m.artifact_rate(curate.flag_existing(rows, image_names(spark, sf)), ["p_type"])


def lookup_results(spark, sf):
    """The predictions of the sampled wrong ids."""
    from ...operators import curate

    rows = predictions(spark, sf).select("model", "id", "gt", "pred")
    wrong = curate.sample_errors(rows, F.col("gt") != F.col("pred"), 10)
    return m.lookup_results(wrong, rows)


def evaluate_text(spark, sf):
    return m.evaluate_text(_forms(spark, sf), ["model", "dataset"])


def evaluate(spark, sf):
    by = ["model", "dataset"]
    scores = structure.structure_score(boxes(spark, sf), by, boxed.KEYS)
    return m.evaluate(predictions(spark, sf), scores, by, unwrap=True)


def _stored_states(spark, sf):
    """Predictions scored in two runs, by halves of the ids; states by model, data set and subset."""
    path = new_folder(spark, "states")
    rows = _forms(spark, sf)
    half = F.crc32("id") % 2
    for number in range(2):
        states.write_states(states.text_states(rows.filter(half == number), BY), path, f"run-{number}")
    return path


def evaluate_states(spark, sf):
    """The scores by model and data set, from stored states alone."""
    by = ["model", "dataset"]
    return states.scores(states.merge(states.read_states(spark, _stored_states(spark, sf)), by), by)


def report_states(spark, sf):
    """Every model against the baseline, from stored states alone."""
    return m.model_report(evaluate_states(spark, sf), "base", METRICS, ["dataset"])


def evaluate_states_structure(spark, sf):
    """Text and structure scores of both kinds of states, stored and merged."""
    by, path = ["model", "dataset"], new_folder(spark, "states")
    matches = structure.align_by_occurrence(structure.visible_boxes(boxes(spark, sf)), boxed.KEYS)
    matches = structure.residual_inliers(structure.bare(matches, boxed.KEYS), boxed.KEYS)
    samples = structure.score_samples(matches, structure.pair_samples(boxes(spark, sf), boxed.KEYS), boxed.KEYS)
    text = states.text_states(_forms(spark, sf), by)
    states.write_states(states.with_structure(text, states.structure_states(samples, by), by), path, "run-0")
    return states.scores(states.merge(states.read_states(spark, path), by), by)


def model_report(spark, sf):
    metrics = m.evaluate_text(_forms(spark, sf), ["model", "dataset"])
    return m.model_report(metrics, "base", METRICS, ["dataset"])


def model_report_wide(spark, sf):
    metrics = m.evaluate_text(_forms(spark, sf), ["model", "dataset"])
    return m.model_report(metrics, "base", ["bleu", "exp"], ["dataset"], models=["base", "tuned"])


QUERIES = {
    "a01_corpus_bleu": corpus_bleu,
    "a01_corpus_bleu_13a": corpus_bleu_13a,
    "a02_mean_edit": mean_edit,
    "a03_mean_anls": mean_anls,
    "a04_exact_rate": exact_rate,
    "a05_masked_rates": masked_rates,
    "a06_artifact_rate": artifact_rate,
    "a09_evaluate_text": evaluate_text,
    "a09_evaluate": evaluate,
    "a09_evaluate_states": evaluate_states,
    "a09_evaluate_states_structure": evaluate_states_structure,
    "a12_report_states": report_states,
    "a12_model_report": model_report,
    "a12_model_report_wide": model_report_wide,
    "j08_lookup_results": lookup_results,
    "m06_image_exact_match": image_exact_match,
}

# ---- SQL -------------------------------------------------------------------------------------

_FORMS = (
    "forms AS MATERIALIZED (SELECT model, dataset, subset, id, gt_rendered, pred_rendered, "
    f"{q.normalized('gt')} AS gt, {q.normalized('pred', True)} AS pred FROM predictions)"
)


def _sql(body: str) -> str:
    return with_tables(["predictions"], f"WITH {_FORMS}{body}")


def _tokens_13a(text: str) -> str:
    text = q.swap(text, {"<skipped>": "", "-\n": "", "\n": " ", "&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"})
    text = f"(' ' || {text} || ' ')"
    text = q.sub(text, r"([{-~\[-` -&(-+:-@/])", r" \1 ")
    text = q.sub(text, r"([^0-9])([.,])", r"\1 \2 ")
    text = q.sub(text, r"([.,])([^0-9])", r" \1 \2")
    text = q.sub(text, r"([0-9])(-)", r"\1 \2 ")
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> '')"


def _bleu(by: str, cut) -> str:
    """n-grams as rows, counted per prediction and side, clipped by a join."""
    return f""", rows AS MATERIALIZED (SELECT *, row_number() OVER () AS r, {cut('gt')} AS g, {cut('pred')} AS p FROM forms),
    grams AS (SELECT r, n, 'g' AS side, unnest(list_transform(generate_series(1, len(g) - n + 1),
        lambda i: array_to_string(g[i:i + n - 1], ' '))) AS gram FROM rows, (SELECT unnest([1, 2, 3, 4]) AS n)
      UNION ALL SELECT r, n, 'p', unnest(list_transform(generate_series(1, len(p) - n + 1),
        lambda i: array_to_string(p[i:i + n - 1], ' '))) FROM rows, (SELECT unnest([1, 2, 3, 4]) AS n)),
    counted AS (SELECT r, n, gram, count(*) FILTER (WHERE side = 'g') AS cg, count(*) FILTER (WHERE side = 'p') AS cp
      FROM grams GROUP BY ALL),
    per_order AS (SELECT {by}, n, sum(least(cg, cp)) AS m, sum(cp) AS t FROM counted JOIN rows USING (r) GROUP BY ALL),
    lens AS (SELECT {by}, sum(len(g)) AS lg, sum(len(p)) AS lp FROM rows GROUP BY ALL),
    bleu AS (SELECT {by}, round(CASE WHEN min(m) > 0 THEN
        CASE WHEN any_value(lp) > any_value(lg) THEN 1.0 ELSE exp(1 - any_value(lg)::double / any_value(lp)) END
        * exp(sum(ln(m::double / t)) / 4) ELSE 0.0 END, 6)::double AS bleu
      FROM per_order JOIN lens USING ({by}) GROUP BY {by})"""


_NL = (
    "CASE WHEN gt = pred THEN 0.0::double ELSE levenshtein(gt, pred)::double / greatest(length(gt), length(pred)) END"
)
_OTHERS = (
    f"round(avg({_NL}), 6) AS edit, round(avg(CASE WHEN {_NL} < 0.5 THEN 1 - ({_NL}) ELSE 0 END), 6) AS anls, "
    "round(avg((gt = pred)::int), 6) AS exp"
)


def _text_scores(by: str) -> str:
    return f"{_bleu(by, q.tokens)}, others AS (SELECT {by}, {_OTHERS} FROM forms GROUP BY ALL)"


_B3 = "model, dataset, subset"
_B2 = "model, dataset"
_IMAGE = (
    "coalesce(CASE WHEN gt_rendered AND pred_rendered THEN replace(gt, ' ', '') = replace(pred, ' ', '') END, false)"
)
_REPORT = (
    "SELECT a.model, dataset, {values} FROM scores a LEFT JOIN (SELECT * FROM scores WHERE model = 'base') b USING (dataset)"
)
_SCORES = f"{_text_scores(_B2)}, scores AS (SELECT * FROM bleu JOIN others USING ({_B2}))"
_DELTAS = ", ".join(f"a.{x} AS {x}, round(a.{x} - b.{x}, 6) AS {x}_delta" for x in METRICS)
_WIDE = ", ".join(
    f"max(CASE WHEN model = '{name}' THEN {x} END) AS {name}_{x}"
    for name in ("base", "tuned")
    for x in ("bleu", "exp", "bleu_delta", "exp_delta")
)


ORACLES = {
    "a01_corpus_bleu": _sql(f"{_bleu(_B3, q.tokens)} SELECT * FROM bleu"),
    "a01_corpus_bleu_13a": _sql(f"{_bleu(_B3, _tokens_13a)} SELECT * FROM bleu"),
    "a02_mean_edit": _sql(f" SELECT {_B3}, round(avg({_NL}), 6) AS edit FROM forms GROUP BY ALL"),
    "a03_mean_anls": _sql(
        f" SELECT {_B3}, round(avg(CASE WHEN {_NL} < 0.5 THEN 1 - ({_NL}) ELSE 0 END), 6) AS anls FROM forms GROUP BY ALL"
    ),
    "a04_exact_rate": _sql(f" SELECT {_B3}, round(avg((gt = pred)::int), 6) AS exp FROM forms GROUP BY ALL"),
    "a05_masked_rates": _sql(
        f", marked AS (SELECT *, {_IMAGE} AS image_match, replace(gt, ' ', '') = replace(pred, ' ', '') AS text_match FROM forms) "
        f"SELECT {_B2}, count(*) AS total_samples, "
        "round(avg(pred_rendered::int) FILTER (WHERE gt_rendered), 2) AS render_success_rate, "
        "round(avg(image_match::int) FILTER (WHERE gt_rendered), 2) AS render_exact_match_accuracy, "
        "round(avg(text_match::int) FILTER (WHERE gt_rendered), 2) AS latex_exact_match_accuracy, "
        f"round(avg(CASE WHEN {_NL} < 0.5 THEN 1 - ({_NL}) ELSE 0 END) FILTER (WHERE gt_rendered), 2) AS anls_score "
        "FROM marked GROUP BY ALL"
    ),
    "a06_artifact_rate": (
        "SELECT p_type, count(*) AS total, sum((p_partkey IN (SELECT l_partkey FROM lineitem))::int)::bigint AS success "
        "FROM part GROUP BY 1"
    ),
    "a09_evaluate_text": _sql(f"{_SCORES} SELECT * FROM scores"),
    "a09_evaluate": with_tables(
        ["predictions", "all_boxes"],
        f"WITH {_FORMS}{_SCORES}, {boxed.STRUCTURE_CTES} SELECT * FROM scores JOIN placed USING ({_B2})",
    ),
    "a12_model_report": _sql(f"{_SCORES} " + _REPORT.format(values=_DELTAS)),
    "a12_model_report_wide": _sql(
        f"{_SCORES}, report AS ({_REPORT.format(values=_DELTAS)}) SELECT dataset, {_WIDE} FROM report GROUP BY dataset"
    ),
    "a09_evaluate_states": _sql(f"{_SCORES} SELECT * FROM scores"),
    "a12_report_states": _sql(f"{_SCORES} " + _REPORT.format(values=_DELTAS)),
    "j08_lookup_results": with_tables(
        ["predictions"],
        "WITH wrong AS (SELECT id FROM predictions WHERE gt <> pred "
        "QUALIFY row_number() OVER (ORDER BY md5('42:' || id), id) <= 10) "
        "SELECT model, id, gt, pred FROM predictions WHERE id IN (SELECT id FROM wrong)",
    ),
    "m06_image_exact_match": _sql(f" SELECT model, id, ({_IMAGE})::int AS image_match FROM forms"),
}
ORACLES["a09_evaluate_states_structure"] = ORACLES["a09_evaluate"]
