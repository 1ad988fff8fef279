"""A corpus through five operators: toxic and poor documents go, one of each near-copy group stays,
secrets are masked, and what is left is packed into batches.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again
as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm import ngram_join, packing, quality, secret_scan, toxicity
from mathloom.llm.common import table, unused
from mathloom.plans.ranks import broadcast_if_small
from mathloom.session import cut_lineage

TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go; learnt from the labels of the kept folds."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.folded())
    model = toxicity.fit(docs, labels)
    score, clauses = unused(docs, "_toxicity", "_clauses")
    scored = toxicity.annotate(docs, model, score=score, clauses=clauses)
    return scored.filter(F.col(score) < TOXIC).drop(score, clauses)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike trusted text go."""
    key, good, verdict = unused(docs, "_key", "_good", "_quality")
    trusted = quality.trusted_keys(table(spark, sf_dir, "labels")).toDF(key)
    marked = docs.join(trusted.hint("merge"), docs["doc_id"] == trusted[key], "left").withColumn(good, F.col(key).isNotNull())
    judged = quality.judge(marked.drop(key), F.col(good), out=verdict)
    return judged.filter(f"{verdict}.kept").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at Jaccard 0.8 or more the one with the smallest id stays.

    Rows with one doc_id are one document and stay together; rows without one are always kept.
    """
    found = ngram_join.jaccard_components(docs, size=5, num=80, den=100).filter("doc_id is not null")
    stays = F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    gone = found.groupBy("doc_id").agg(stays.alias("_stays")).filter("not _stays").select("doc_id")
    # the ids that go are fewer than those that stay; a short list goes to the texts
    return docs.join(broadcast_if_small(gone, ngram_join.LISTED), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[SECRET]``; ``n_chars`` follows the text. No document goes."""
    (spans,) = unused(docs, "_spans")
    clean = secret_scan.scan(docs, spans=spans, clean="text")
    changed = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_copies", keep_one_of_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Learnt scores and hashed features decide rows, which SQL cannot say; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
