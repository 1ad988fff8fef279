"""Scores of predicted formulas against their ground truth, from the text alone.

Every score of a row is computed inside the row, so a corpus is scored in one scan followed by
one small grouped aggregate, whatever the number of rows in a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bags, latex
from ..functions.distance import edit_distance
from ..plans.ranks import broadcast_if_small, null_safe_join
from ..session import cut_lineage

DIGITS = 6


def normalized(df: DataFrame, unwrap: bool = False) -> DataFrame:
    """Predictions in the compared form; ``unwrap`` drops ``$$`` around the prediction."""
    return df.withColumn("gt", latex.normalize_formula(F.col("gt"))).withColumn(
        "pred", latex.normalize_formula(F.col("pred"), unwrap)
    )


# ---- Row scores ------------------------------------------------------------------------------


def normalized_distance(gt: Column, pred: Column, most: Column | None = None) -> Column:
    """Levenshtein distance over the longer length, in code points; 0 for two empty texts.

    ``most`` is the greatest distance of interest: farther texts only get a greater one than that.
    """
    longer = F.greatest(F.length(gt), F.length(pred))
    return F.when(gt == pred, F.lit(0.0)).otherwise(edit_distance(gt, pred, most) / longer)


def anls(gt: Column, pred: Column, threshold: float = 0.5) -> Column:
    """``1 - d`` where the normalised distance ``d`` is below the threshold, else 0; case-sensitive.

    Texts whose lengths alone put them past the threshold are not compared, and long ones only as
    far as the threshold.
    """
    longer = F.greatest(F.length(gt), F.length(pred))
    gap = F.try_divide(F.abs(F.length(gt) - F.length(pred)), longer)
    distance = normalized_distance(gt, pred, F.floor(threshold * longer).cast("int") + 1)
    return F.when(gap >= threshold, F.lit(0.0)).when(distance < threshold, 1 - distance).otherwise(F.lit(0.0))


def bleu_counts(df: DataFrame, max_n: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Add per-row clipped matches and totals of each order, and both token counts.

    Equal texts are cut once and every n-gram of theirs matches.
    """
    same = F.col("gt") == F.col("pred")
    cut = df.withColumn("_pred", tokens(F.col("pred"))).withColumn("_same", same)
    cut = cut.withColumn("_gt", F.when(F.col("_same"), F.col("_pred")).otherwise(tokens(F.col("gt"))))
    gt, pred = F.col("_gt"), F.col("_pred")
    overlap = lambda n: F.when(F.col("_same"), bags.ngram_total(pred, n)).otherwise(bags.ngram_overlap(pred, gt, n))
    orders = range(1, max_n + 1)
    return cut.select(
        *df.columns,
        *[overlap(n).alias(f"_match{n}") for n in orders],
        *[bags.ngram_total(pred, n).alias(f"_total{n}") for n in orders],
        F.size(pred).alias("_pred_len"),
        F.size(gt).alias("_gt_len"),
    )


def sum_names(max_n: int) -> list[str]:
    """The counts of :func:`bleu_counts` that add up over rows."""
    return [*(f"_{kind}{n}" for kind in ("match", "total") for n in range(1, max_n + 1)), "_pred_len", "_gt_len"]


def _bleu_sums(max_n: int) -> list[Column]:
    return [F.sum(name).alias(name) for name in sum_names(max_n)]


def bleu_of(max_n: int) -> Column:
    """The published formula over summed counts: no smoothing, and a zero precision gives 0."""
    orders = range(1, max_n + 1)
    logs = reduce(lambda a, b: a + b, [F.log(F.col(f"_match{n}") / F.col(f"_total{n}")) for n in orders])
    every = reduce(lambda a, b: a & b, [F.col(f"_match{n}") > 0 for n in orders])
    brevity = F.when(F.col("_pred_len") > F.col("_gt_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("_gt_len") / F.col("_pred_len"))
    )
    return F.round(F.when(every, brevity * F.exp(logs / max_n)).otherwise(F.lit(0.0)), DIGITS)


# ---- Corpus scores ---------------------------------------------------------------------------


def corpus_bleu(
    df: DataFrame, by: list[str], max_n: int = 4, tokens: Callable[[Column], Column] = latex.tokens
) -> DataFrame:
    """Corpus BLEU per group. ``tokens`` cuts a text; ``latex.tokens_13a`` is the other usual choice."""
    counted = bleu_counts(df.select(*by, "gt", "pred"), max_n, tokens)
    return counted.groupBy(*by).agg(*_bleu_sums(max_n)).select(*by, bleu_of(max_n).alias("bleu"))


def mean_edit(df: DataFrame, by: list[str]) -> DataFrame:
    distance = normalized_distance(F.col("gt"), F.col("pred"))
    return df.groupBy(*by).agg(F.round(F.avg(distance), DIGITS).alias("edit"))


def mean_anls(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    score = anls(F.col("gt"), F.col("pred"), threshold)
    return df.groupBy(*by).agg(F.round(F.avg(score), DIGITS).alias("anls"))


def exact_rate(df: DataFrame, by: list[str]) -> DataFrame:
    same = (F.col("gt") == F.col("pred")).cast("int")
    return df.groupBy(*by).agg(F.round(F.sum(same) / F.count(same), DIGITS).alias("exp"))


def evaluate_text(
    df: DataFrame,
    by: list[str],
    max_n: int = 4,
    threshold: float = 0.5,
    tokens: Callable[[Column], Column] = latex.tokens,
) -> DataFrame:
    """All text scores per group in one pass: one scan, one distance per row, one aggregate."""
    scored = df.select(*by, "gt", "pred").withColumn(
        "_distance", normalized_distance(F.col("gt"), F.col("pred"))
    )
    counted = bleu_counts(scored, max_n, tokens)
    kept = F.when(F.col("_distance") < threshold, 1 - F.col("_distance")).otherwise(F.lit(0.0))
    same = (F.col("gt") == F.col("pred")).cast("int")
    sums = counted.groupBy(*by).agg(
        *_bleu_sums(max_n),
        F.round(F.avg("_distance"), DIGITS).alias("edit"),
        F.round(F.avg(kept), DIGITS).alias("anls"),
        F.round(F.sum(same) / F.count(same), DIGITS).alias("exp"),
    )
    return sums.select(*by, bleu_of(max_n).alias("bleu"), "edit", "anls", "exp")


def evaluate(predictions: DataFrame, structure: DataFrame, by: list[str], unwrap: bool = False) -> DataFrame:
    """Text scores beside structure scores, one row per group.

    ``structure`` is the output of ``structure.score_corpus`` for the same groups.
    """
    return null_safe_join(evaluate_text(normalized(predictions, unwrap), by), structure, by, "left")


def masked_rates(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Rates over the rows whose ground truth rendered; all 0 where there is none.

    Needs ``gt, pred, gt_rendered, pred_rendered, image_match``, texts in the compared form.
    """
    valid = F.col("gt_rendered")
    count_if = lambda flag: F.sum((valid & flag).cast("int"))
    n_valid = F.sum(valid.cast("int"))
    score = F.sum(F.when(valid, anls(F.col("gt"), F.col("pred"), threshold)))
    rate = lambda total: F.coalesce(F.round(F.try_divide(total, n_valid), 2), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        rate(count_if(F.col("pred_rendered"))).alias("render_success_rate"),
        rate(count_if(F.col("image_match"))).alias("render_exact_match_accuracy"),
        rate(count_if(latex.same_ignoring_space(F.col("gt"), F.col("pred")))).alias("latex_exact_match_accuracy"),
        rate(F.round(score, DIGITS)).alias("anls_score"),
    )


def artifact_rate(df: DataFrame, by: list[str], flag: str = "renderable") -> DataFrame:
    """Rows and successes per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(flag).cast("bigint")).alias("success")
    )


def image_exact_match(df: DataFrame) -> DataFrame:
    """Add ``image_match``: both images exist and agree in size and content digest.

    Needs ``gt_width, gt_height, gt_digest`` and the same for ``pred``.
    """
    same = [F.col(f"gt_{part}") == F.col(f"pred_{part}") for part in ("width", "height", "digest")]
    return df.withColumn("image_match", F.coalesce(reduce(lambda a, b: a & b, same), F.lit(False)))


def file_digests(files: DataFrame, key: Column) -> DataFrame:
    """``(key, length, digest)`` of listed files with their bytes; each file is read once, where it lies."""
    return files.select(key.alias("key"), "length", F.sha2("content", 256).alias("digest"))


def image_files_match(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``(key, image_match)`` for every gt file: the pred file of that key exists and has the same bytes.

    Both sides come from :func:`file_digests`; keys are unique per side.
    """
    named = pred.select("key", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    same = (F.col("length") == F.col("_length")) & (F.col("digest") == F.col("_digest"))
    return gt.join(named, "key", "left").select("key", F.coalesce(same, F.lit(False)).alias("image_match"))


def lookup_results(ids: DataFrame, results: DataFrame) -> DataFrame:
    """The results of the given ids. Few ids are broadcast, after a count; many are shuffled."""
    return results.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi")


def model_report(
    metrics: DataFrame, baseline: str, names: list[str], on: list[str], models: list[str] | None = None
) -> DataFrame:
    """Metrics and their distance to the baseline model on the same data.

    With ``models`` the result is one row per data set with a column per model and metric. The
    metrics, a row per model and data set, are computed once, for they are met twice; they are kept
    beside the states of :mod:`metric_states` in the shared folder.
    """
    metrics = cut_lineage(metrics, "states/metrics")
    base = metrics.filter(F.col("model") == baseline).select(*on, *[F.col(m).alias(f"_{m}") for m in names])
    deltas = [F.round(F.col(m) - F.col(f"_{m}"), DIGITS).alias(f"{m}_delta") for m in names]
    long = null_safe_join(metrics, base, on, "left").select("model", *on, *names, *deltas)
    if models is None:
        return long
    columns = names + [f"{m}_delta" for m in names]
    return long.groupBy(*on).pivot("model", models).agg(*[F.first(c).alias(c) for c in columns])
