"""Row numbers, group statistics and exact top-n cuts that stay whole under skew.

A plain window hands a whole group to one task. Here a group is cut into blocks of its (dense,
non-negative) position column, so no task ever sorts more than one block, whatever share of the
table one key holds. Groups that fit in one block, nearly all of them, pay nothing extra: the
part that stitches blocks together is empty for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rows of one group per block. A position is an int, so a group has at most 2**11 blocks.
BLOCK_BITS = 20
BLOCK = "_block"


def block_of(position: Column, bits: int | None = None) -> Column:
    return F.shiftright(position, BLOCK_BITS if bits is None else bits)


def numbered(
    df: DataFrame,
    keys: list[str],
    position: str,
    rank: str,
    total: str | None = None,
    sample: list[str] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Add the 0-based ``rank`` of each row by ``position`` within ``keys`` and the group's ``total``.

    ``position`` must be unique within ``keys`` and dense within ``sample`` (a subset of ``keys``,
    all of them by default). Put the most telling key first: rows are sorted by the keys in order.
    """
    sample = sample or keys
    size = 1 << (BLOCK_BITS if bits is None else bits)
    blocked = df.withColumn(BLOCK, block_of(F.col(position), bits))
    in_block = Window.partitionBy(*keys, BLOCK)
    out = blocked.withColumn(rank, F.row_number().over(in_block.orderBy(position)) - 1)
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(in_block))

    # Samples longer than one block. Positions are dense, so each such sample has over 2**20 rows:
    # 10**12 rows hold at most 10**6 of them, which bounds the broadcast. The test on the bare
    # position reaches the scan.
    long_samples = df.filter(F.col(position) >= size).select(*sample).distinct()
    long_blocks = (
        blocked.select(*keys, BLOCK)
        .join(F.broadcast(long_samples), sample, "left_semi")
        .groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    whole = Window.partitionBy(*keys)
    carry = long_blocks.select(
        *keys,
        BLOCK,
        (F.sum("_n").over(whole.orderBy(BLOCK)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_whole"),
    )
    out = out.join(carry, keys + [BLOCK], "left").withColumn(
        rank, (F.col(rank) + F.coalesce("_before", F.lit(0))).cast("int")
    )
    if total:
        out = out.withColumn(total, F.coalesce("_whole", F.col(total)))
    return out.drop(BLOCK, "_before", "_whole")


# Rows of a task that holds whole samples: small enough to be sorted in memory.
SAMPLE_TASK_ROWS = 1 << 19
_DEALT = "_dealt_by"


def mark_dealt(df: DataFrame, sample: list[str], bits: int | None = None) -> DataFrame:
    """Note on the frame that :func:`by_sample` has dealt its rows, none of them of a longer sample.

    The note only saves counting and moving rows again; what the plan needs is the planner's to ensure.
    """
    setattr(df, _DEALT, (frozenset(sample), bits))
    return df


def dealt_by(df: DataFrame) -> tuple | None:
    """The note of :func:`mark_dealt`, if the frame has one."""
    return getattr(df, _DEALT, None)


def by_sample(df: DataFrame, sample: list[str], position: str, bits: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows dealt out once by ``sample``, and apart from them the rows of samples longer than a block.

    Windows and groups over ``sample`` and more then need no other shuffle, and a task sorts about
    ``SAMPLE_TASK_ROWS`` rows. Where no sample is longer than a block the second table is None.
    """
    if dealt_by(df) == (frozenset(sample), bits):
        return df, None
    size = 1 << (BLOCK_BITS if bits is None else bits)
    found = df.agg(F.count(F.lit(1)).alias("n"), F.max(position).alias("last")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-found["n"] // SAMPLE_TASK_ROWS))
    if found["last"] is None or found["last"] < size:
        return df.repartition(tasks, *sample), None
    listed = broadcast_if_small(df.filter(F.col(position) >= size).select(*sample).distinct())
    return df.join(listed, sample, "left_anti").repartition(tasks, *sample), df.join(listed, sample, "left_semi")


def ranked(df: DataFrame, keys: list[str], position: str, rank: str, total: str | None = None) -> DataFrame:
    """What :func:`numbered` adds, by one window over each group: for samples within a block."""
    group = Window.partitionBy(*keys)
    out = df.withColumn(rank, F.row_number().over(group.orderBy(position)) - 1)
    return out.withColumn(total, F.count(F.lit(1)).over(group)) if total else out


def numbered_by_sample(
    df: DataFrame, keys: list[str], position: str, rank: str, sample: list[str], total: str | None = None,
    longest: list[str] | None = None, bits: int | None = None,
) -> DataFrame:
    """As :func:`numbered`, with rows dealt out by ``sample``; ``position`` is dense within ``longest``."""
    short, long_rows = by_sample(df, sample, position, bits)
    out = ranked(short, keys, position, rank, total)
    if long_rows is None:
        return mark_dealt(out, sample, bits)
    return out.unionByName(numbered(long_rows, keys, position, rank, total, longest, bits))


def dense_ranks(df: DataFrame, keys: list[str], order: list[str], rank: str, total: str | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of each row by ``order`` within ``keys`` (none: in the whole table), and the ``total``.

    Rows are dealt out by ranges of keys and order, so a hot key is cut into as many tasks as it
    fills; a row's rank is its place in its task and what earlier tasks hold of its key. Only that
    table, with a row for each task and key in it, is summed up. ``order`` must be unique within
    ``keys``; null keys are a group.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    marks = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    placed = cut_lineage(ranged.withColumns(marks))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    carried = counts.select(
        *keys,
        "_part",
        (F.sum("_n").over(group.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(group).alias("_whole"),
    )
    met = null_safe_join(placed, broadcast_if_small(carried), [*keys, "_part"])
    out = met.withColumn(rank, F.col("_at") + F.col("_shift"))
    if total:
        out = out.withColumn(total, F.col("_whole"))
    return out.drop("_part", "_at", "_shift", "_whole")


def per_block(stats: DataFrame, last_position: str, bits: int | None = None) -> DataFrame:
    """One copy of a group's statistics per block of the group, to be joined on keys and block.

    A group within one block gives one row, so only long groups are copied, and their rows meet
    the copies in as many tasks as they have blocks.
    """
    blocks = F.sequence(F.lit(0), block_of(F.col(last_position), bits))
    return stats.withColumn(BLOCK, F.explode(blocks)).drop(last_position)


def shuffle_key(id_col: Column, seed: int) -> Column:
    """The order of a seeded shuffle: a hash of seed and id, the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))


_PREFIX = 5  # hex digits: about a million buckets


def smallest_by_key(
    df: DataFrame, key: str, n: int, by: list[str], tie: list[str], strict: bool = False
) -> DataFrame:
    """Exactly the ``n`` rows per group with the smallest ``key`` (a hex digest).

    First a histogram of digest prefixes, then only the rows up to the prefix in which the n-th
    row lies: about ``n`` plus a millionth of the group. Wide rows are filtered where they are
    and only those few are shuffled and ranked. ``strict`` fails on a group with fewer rows.
    """
    prefix = F.left(F.col(key), F.lit(_PREFIX))
    histogram = df.groupBy(*by, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    cut = (
        histogram.withColumn("_before", F.sum("_n").over(group.orderBy("_prefix")) - F.col("_n"))
        .withColumn("_size", F.sum("_n").over(group))
        .filter(F.col("_before") < n)
        .groupBy(*by)
        .agg(F.max("_prefix").alias("_last"), F.max("_size").alias("_size"))
    )
    if strict:
        names = [F.col(c).cast("string") for c in by] or [F.lit("the table")]
        short = F.raise_error(F.concat_ws(" ", F.lit("not enough rows in"), *names))
        cut = cut.withColumn("_last", F.when(F.col("_size") >= n, F.col("_last")).otherwise(short))
    cut = cut.drop("_size")
    if not by:
        # the whole table is one group, so the cut is one value
        row = cut.first()
        near = df.filter(prefix <= row["_last"]) if row else df
        return near.orderBy(key, *tie).limit(n)
    near = null_safe_join(df, broadcast_if_small(cut), by).filter(prefix <= F.col("_last"))
    rank = F.row_number().over(group.orderBy(key, *tie))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key, as it does in a grouping."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    matches = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, matches, how).drop(*[f"_r_{c}" for c in on])


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a narrow table only after its rows have been counted; a larger one is shuffled.

    The table is written once to the shared folder, so counting does not compute it twice.
    """
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
