"""Length buckets that waste least: padding minimised over the corpus, batches under a token budget.

A histogram of document lengths is counted over the whole table, exact up to ``EXACT`` tokens and
with ``FINE`` bins an octave beyond, so it has a few thousand bins however large the corpus is.
Dynamic programming over the bins finds the boundaries of at most ``buckets`` buckets with the
fewest padding tokens: a bucket pads its documents to its longest. Inside a bucket, documents are
numbered and cut into batches of as many rows as the token budget holds. Numbers are given per
shard of about ``SHARD`` rows, so no task sorts a whole bucket; each shard may leave one batch
that is not full. A document longer than the budget is a batch of its own; nothing is cut off.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD

BUDGET, BUCKETS = 16_384, 16
EXACT, FINE = 1_024, 64
SHARD = 50_000


def bin_of(n: Column) -> Column:
    """The histogram bin of a length; bins are ordered like lengths."""
    octave = F.floor(F.log2(n / EXACT))
    fine = F.floor((n / (F.lit(float(EXACT)) * F.pow(F.lit(2.0), octave)) - 1) * FINE)
    return F.when(n <= EXACT, n).otherwise(EXACT + octave * FINE + F.least(fine, F.lit(FINE - 1)) + 1).cast("int")


def boundaries(longest: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Indices of the last bin of each bucket, for the least sum of rows * bucket length - tokens."""
    n = len(longest)
    k = min(buckets, n)
    all_rows, all_tokens = np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(tokens)]
    best = np.full((k + 1, n + 1), np.inf)
    best[0, 0] = 0
    cut = np.zeros((k + 1, n + 1), int)
    for b in range(1, k + 1):
        for j in range(1, n + 1):
            i = np.arange(j)
            cost = best[b - 1, :j] + (all_rows[j] - all_rows[i]) * longest[j - 1] - (all_tokens[j] - all_tokens[i])
            cut[b, j] = cost.argmin()
            best[b, j] = cost[cut[b, j]]
    b, j, out = int(best[1:, n].argmin()) + 1, n, []
    while j > 0:
        out.append(j - 1)
        j, b = int(cut[b, j]), b - 1
    return out[::-1]


def count_words(text: Column) -> Column:
    """The default length: words, and one token that ends the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long") + 1


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    length: Column | None = None,
    text: str = "text",
    budget: int = BUDGET,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``key, n_tokens, bucket, padded, batch, place`` per row.

    ``length`` is the token count (default: words and an end; null or less than one counts as
    one). ``padded`` is the length of the row's bucket and ``batch`` a string unique to the batch;
    ``place`` numbers its rows from 0. Null and empty texts are one token; repeated rows are rows
    of their own; an empty table gives no rows; other columns are not read.
    """
    tokens = count_words(docs[text]) if length is None else length
    rows = docs.select(docs[key].alias("key"), F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long").alias("n"))
    # each row gets a number as it is stored, so that repeated and null keys spread over the shards
    rows = cut_lineage(rows.withColumn("bin", bin_of(F.col("n"))).withColumn("row", F.monotonically_increasing_id()))
    histogram = (
        rows.groupBy("bin").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    ).orderBy("bin").collect()  # a few thousand bins at most
    if not histogram:
        ends = []
    else:
        columns = [np.array([r[c] for r in histogram], float) for c in ("longest", "rows", "tokens")]
        ends = boundaries(*columns, buckets)
    counts, first, plan = [r["rows"] for r in histogram], 0, []
    for b, last in enumerate(ends):
        held, longest = sum(counts[first : last + 1]), histogram[last]["longest"]
        plan.append((b, histogram[last]["bin"], longest, max(1, budget // longest), -(-held // SHARD)))
        first = last + 1

    def chosen(i: int) -> Column:
        out = F.lit(plan[-1][i] if plan else 1)
        for p in reversed(plan[:-1]):
            out = F.when(F.col("bin") <= p[1], F.lit(p[i])).otherwise(out)
        return out

    placed = rows.select("key", "n", "row", chosen(0).alias("bucket"), chosen(2).cast("long").alias("padded"), chosen(3).alias("_rows"), chosen(4).alias("_shards"))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("row"), F.col("_shards")).cast("int"))
    order = Window.partitionBy("bucket", "_shard").orderBy("key", "n", "row")
    placed = placed.withColumn("_i", F.row_number().over(order) - 1)
    batch = F.concat_ws("-", "bucket", "_shard", F.floor(F.col("_i") / F.col("_rows")))
    place = (F.col("_i") % F.col("_rows")).cast("int")
    return placed.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), "bucket", "padded", batch.alias("batch"), place.alias("place"))
