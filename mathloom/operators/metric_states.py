"""Mergeable states of the scores: a run is scored once, reports add what is stored.

A state is one row per group of sums that can be added: n-gram matches and totals, token counts,
distances, exact rows, and of the structure scores the sums over samples. Row scores enter as
decimals, so sums do not depend on order or on how rows were dealt out: states of parts, added, are
the state of the whole to the last digit. A report over many runs and models reads states only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex
from ..plans.ranks import null_safe_join
from ..sources.writers import replace_run
from .text_metrics import DIGITS, bleu_counts, bleu_of, normalized_distance, sum_names

STRUCTURE_DIGITS = 3
ROW_SCORE = "decimal(28,15)"
COUNTS = ["rows", "compared"]
SCORES = ["edit_sum", "anls_sum", "exact_sum"]
STRUCTURE = ["samples", "f1_sum", "exact_samples"]


def _exact(score: Column) -> Column:
    return F.sum(score.cast(ROW_SCORE))


def text_states(
    df: DataFrame,
    by: list[str],
    max_n: int = 4,
    threshold: float = 0.5,
    tokens: Callable[[Column], Column] = latex.tokens,
) -> DataFrame:
    """One state per group of predictions in the compared form: one scan, one aggregate.

    ``rows`` counts all rows, ``compared`` those with both texts; the others add nothing else.
    """
    scored = df.select(*by, "gt", "pred").withColumn("_distance", normalized_distance(F.col("gt"), F.col("pred")))
    kept = F.when(F.col("_distance") < threshold, 1 - F.col("_distance")).when(F.col("_distance").isNotNull(), F.lit(0.0))
    same = (F.col("gt") == F.col("pred")).cast("bigint")
    return (
        bleu_counts(scored, max_n, tokens)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("_distance").alias("compared"),
            *[F.sum(name).cast("bigint").alias(name) for name in sum_names(max_n)],
            _exact(F.col("_distance")).alias("edit_sum"),
            _exact(kept).alias("anls_sum"),
            F.sum(same).alias("exact_sum"),
        )
    )


def structure_states(samples: DataFrame, by: list[str]) -> DataFrame:
    """One state per group of scored samples (``structure.score_samples``)."""
    return samples.groupBy(*by).agg(
        F.count("f1").alias("samples"),
        _exact(F.col("f1")).alias("f1_sum"),
        F.sum(F.col("exact").cast("bigint")).alias("exact_samples"),
    )


def with_structure(text: DataFrame, structure: DataFrame, by: list[str]) -> DataFrame:
    """Text states beside structure states of the same groups."""
    return null_safe_join(text, structure, by, "left")


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of groups that ``by`` puts together."""
    sums = [c for c in states.columns if c in {*COUNTS, *SCORES, *STRUCTURE} or c.startswith("_")]
    return states.groupBy(*by).agg(*[F.sum(c).cast(states.schema[c].dataType).alias(c) for c in sums])


def scores(states: DataFrame, by: list[str], max_n: int = 4) -> DataFrame:
    """BLEU, mean distance, ANLS and exact rate of each state; ``cdm`` and ``exp_cdm`` if it has samples."""
    share = lambda total, of, digits: F.round((F.col(total) / F.col(of)).cast("double"), digits)
    out = [
        bleu_of(max_n).alias("bleu"),
        share("edit_sum", "compared", DIGITS).alias("edit"),
        F.round((F.col("anls_sum") / F.col("rows")).cast("double"), DIGITS).alias("anls"),
        share("exact_sum", "compared", DIGITS).alias("exp"),
    ]
    if "samples" in states.columns:
        out += [
            share("f1_sum", "samples", STRUCTURE_DIGITS).alias("cdm"),
            share("exact_samples", "samples", STRUCTURE_DIGITS).alias("exp_cdm"),
        ]
    return states.select(*by, *out)


def write_states(states: DataFrame, path: str, run_id: str) -> None:
    """Store one run's states; writing the run again replaces only its own."""
    replace_run(states, path, run_id)


def read_states(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The stored states of all runs, or of some; other runs' folders are not read."""
    stored = spark.read.option("mergeSchema", True).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return stored.filter(F.col("run_id").isin(runs)) if runs is not None else stored
