"""Structure scores from tables of tokens and their boxes on the rendered page.

A box table is ``(*keys, side, seq, token, bbox, page_w, page_h)``: ``keys`` name a sample (an id,
with model, data set and subset where several runs share a table), ``side`` is ``gt`` or ``pred``,
``seq`` is the token's place in the formula from 0, unique per sample and side, and an empty
``bbox`` means that the token left no mark.

The score is an *aligned* variant of character-detection matching: tokens of equal normalised form
are matched one to one by alignment instead of by an optimal assignment over every pair. A pair of
different tokens never counts, so none is formed; the number of matched pairs before the residual
test is the largest possible, the sum over tokens of the smaller count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.markup import normalize_token
from ..plans.quantiles import exact_quantiles
from ..plans.ranks import (
    BLOCK, BLOCK_BITS, block_of, broadcast_if_small, by_sample, dealt_by, dense_ranks, mark_dealt, null_safe_join, numbered,
    numbered_by_sample, per_block, ranked,
)
from ..session import cut_lineage

KEYS = ["sample_id"]
MAX_RESIDUAL = 25.0  # pixels
MIN_FIT = 3  # a fit needs more matches than this
FIT_ROUNDS = 3
DIGITS = 3
TOKEN_COSTS = (0.0, 0.05)  # same spelling, same normalised form
POSITION_WEIGHT, ORDER_WEIGHT = 0.05, 0.15
NO_COST = 100.0  # of a pair whose cost is no number

# ---- Rows ------------------------------------------------------------------------------------


def visible_boxes(df: DataFrame) -> DataFrame:
    """Tokens that left a mark."""
    return df.filter(F.size("bbox") > 0)


def center(bbox: Column) -> tuple[Column, Column]:
    return (F.get(bbox, 0) + F.get(bbox, 2)) / 2, (F.get(bbox, 1) + F.get(bbox, 3)) / 2


def box_center(df: DataFrame) -> DataFrame:
    """Add the box centre ``x_c, y_c``."""
    x, y = center(F.col("bbox"))
    return df.withColumn("x_c", x).withColumn("y_c", y)


def stack_sides(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Both sides in one table, told apart by ``side``."""
    return gt.withColumn("side", F.lit("gt")).unionByName(pred.withColumn("side", F.lit("pred")))


def _fine_first(keys: list[str]) -> list[str]:
    """Keys are given from coarse to fine; sorting by the finest first compares least."""
    return keys[::-1]


def token_order(boxes: DataFrame, keys: list[str] = KEYS, bits: int | None = None) -> DataFrame:
    """Add ``order``: place among the visible tokens of the sample and side, over their number.

    Expects visible boxes only.
    """
    fine = _fine_first(keys)
    placed = numbered_by_sample(boxes, [*fine, "side"], "seq", "_place", fine, total="_count", bits=bits)
    out = placed.withColumn("order", F.col("_place") / F.col("_count")).drop("_place", "_count")
    return _as_dealt(out, placed)


def occurrence_rank(boxes: DataFrame, keys: list[str] = KEYS, bits: int | None = None) -> DataFrame:
    """Add ``norm_token``, ``k``: which occurrence of it in its sample and side this is, and ``n_same``: of how many."""
    fine = _fine_first(keys)
    group = [*fine, "side"]
    named = _as_dealt(_named(boxes), boxes)
    return numbered_by_sample(named, [*group, "norm_token"], "seq", "k", fine, total="n_same", longest=group, bits=bits)


def _as_dealt(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, rows of ``source`` with other columns, noted as dealt out if that is."""
    return mark_dealt(df, *note) if (note := dealt_by(source)) else df


def _named(boxes: DataFrame) -> DataFrame:
    """With ``norm_token``; never null, so that no join computes it again to test for nulls."""
    return boxes.withColumn("norm_token", F.coalesce(normalize_token(F.col("token")), F.lit("")))


def token_vocab(boxes: DataFrame) -> DataFrame:
    """Distinct tokens of both sides with their normalised form and counts."""
    on_side = lambda side: F.sum((F.col("side") == side).cast("bigint"))
    counts = boxes.groupBy("token").agg(on_side("gt").alias("gt_count"), on_side("pred").alias("pred_count"))
    return counts.select("token", normalize_token(F.col("token")).alias("norm_token"), "gt_count", "pred_count")


def token_ids(boxes: DataFrame) -> DataFrame:
    """The vocabulary of both sides in one id space: ids from 0 without a gap, in token order.

    ``token_id`` numbers the spellings, ``norm_id`` the normalised forms.
    """
    vocab = dense_ranks(token_vocab(boxes).withColumn("norm_token", F.coalesce("norm_token", F.lit(""))), [], ["token"], "token_id")
    forms = dense_ranks(vocab.select("norm_token").distinct(), [], ["norm_token"], "norm_id")
    return vocab.join(forms, "norm_token").select("token", "token_id", "norm_token", "norm_id", "gt_count", "pred_count")


# ---- Samples ---------------------------------------------------------------------------------


def pair_samples(boxes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Visible tokens per side, one row per sample that has any on the gt side."""
    on_side = lambda side: F.sum((F.col("side") == side).cast("bigint"))
    counts = visible_boxes(boxes).groupBy(*keys).agg(on_side("gt").alias("n_gt"), on_side("pred").alias("n_pred"))
    return counts.filter(F.col("n_gt") > 0)


# ---- Pairs -----------------------------------------------------------------------------------


def _sides(ranked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    shared = [*_fine_first(keys), "norm_token", "k"]
    own = [c for c in ranked.columns if c not in {*shared, "side"}]
    pick = lambda side: ranked.filter(F.col("side") == side).select(
        *shared, *[F.col(c).alias(f"{side}_{c}") for c in own]
    )
    return pick("gt"), pick("pred")


def _join_sides(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides are about as long as the box table, so they are merged and never broadcast."""
    return gt.join(pred.hint("merge"), [*_fine_first(keys), "norm_token", "k"])


def _meet(rows: DataFrame, group: list[str], own: list[str]) -> DataFrame:
    """The gt and the pred row of each group, where it has both; a group has at most one of each.

    A grouping of rows that lie together, where a join would move both sides again.
    """
    at = lambda side, c: F.first(F.when(F.col("side") == side, c), ignorenulls=True)
    flat = [at(side, F.col(c)).alias(f"{side}_{c}") for side in ("gt", "pred") for c in own]
    marks = [at(side, F.lit(True)).alias(f"_has_{side}") for side in ("gt", "pred")]
    met = rows.groupBy(*group).agg(*flat, *marks)
    return met.filter("_has_gt and _has_pred").drop("_has_gt", "_has_pred")


def pair_candidates(boxes: DataFrame, keys: list[str] = KEYS, bits: int | None = None) -> DataFrame:
    """One-to-one pairs of equal normalised tokens, equal spelling first.

    The k-th gt occurrence of a token as spelled takes the k-th pred one. What is left over is paired
    by the k-th occurrence of its normalised form. A token that repeats m times gives at most m pairs,
    and every token has its partner, however far apart the two are: the number of pairs is the
    largest possible. ``token_cost`` is 0 for the same spelling and 0.05 for the same form only.
    """
    fine = _fine_first(keys)
    own = [c for c in boxes.columns if c not in {*keys, "side"}]
    short, long_rows = by_sample(_as_dealt(boxes.dropna(subset=keys), boxes), fine, "seq", bits)
    spelled = ranked(short.withColumn("_spelled", F.coalesce("token", F.lit(""))), [*fine, "_spelled", "side"], "seq", "_k")
    same = Window.partitionBy(*fine, "_spelled")
    shared = F.least(*[F.count(F.when(F.col("side") == name, 1)).over(same) for name in ("gt", "pred")])
    form = F.coalesce(normalize_token(F.col("_spelled")), F.lit(""))
    tiers = spelled.withColumn("_exact", F.col("_k") < shared).withColumn("norm_token", form)
    rest = ranked(tiers, [*fine, "side", "norm_token", "_exact"], "seq", "_j")
    placed = rest.withColumn("_name", F.when(F.col("_exact"), F.col("_spelled")).otherwise(F.col("norm_token"))).withColumn(
        "_at", F.when(F.col("_exact"), F.col("_k")).otherwise(F.col("_j"))
    )
    met = _meet(placed, [*fine, "norm_token", "_exact", "_name", "_at"], own)
    cost = F.when(F.col("_exact"), F.lit(TOKEN_COSTS[0])).otherwise(F.lit(TOKEN_COSTS[1])).alias("token_cost")
    flat = [f"{side}_{c}" for side in ("gt", "pred") for c in own]
    pairs = met.select(*keys, "norm_token", *flat, cost)
    if long_rows is None:
        return mark_dealt(pairs, fine, bits)
    return pairs.unionByName(_pair_long(long_rows, keys, bits))


def _pair_long(boxes: DataFrame, keys: list[str], bits: int | None) -> DataFrame:
    """The same pairs in samples longer than a block."""
    fine = _fine_first(keys)
    side = [*fine, "side"]
    own = [c for c in boxes.columns if c not in {*keys, "side"}]
    spelled = numbered(boxes.withColumn("_spelled", F.coalesce("token", F.lit(""))), [*side, "_spelled"], "seq", "_k", sample=side, bits=bits)
    pick = lambda name: spelled.filter(F.col("side") == name).select(
        *fine, "_spelled", "_k", F.struct(*own).alias(name)
    )
    met = cut_lineage(pick("gt").join(pick("pred").hint("merge"), [*fine, "_spelled", "_k"], "full"))
    flat = lambda name: [F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in own]
    both = F.col("gt").isNotNull() & F.col("pred").isNotNull()
    form = F.coalesce(normalize_token(F.col("_spelled")), F.lit("")).alias("norm_token")
    exact = met.filter(both).select(*keys, form, *flat("gt"), *flat("pred"), F.lit(TOKEN_COSTS[0]).alias("token_cost"))
    free = met.filter(~both).select(
        *keys, F.when(F.col("gt").isNotNull(), "gt").otherwise("pred").alias("side"), F.coalesce("gt", "pred").alias("_own")
    )
    left, right = _sides(_ranked_rest(free.select(*keys, "side", "_own.*"), keys, bits), keys)
    alike = _join_sides(left, right, keys).drop("k").withColumn("token_cost", F.lit(TOKEN_COSTS[1]))
    return exact.unionByName(alike.select(*exact.columns))


def pair_cost(pairs: DataFrame) -> DataFrame:
    """Add ``position_cost``, ``order_cost`` and their weighted sum with the token cost, ``cost``.

    A cost that is no number (a page without size) is 100.
    """
    edges = []
    for i, page in ((0, "page_w"), (1, "page_h"), (2, "page_w"), (3, "page_h")):
        scaled = [F.try_divide(F.get(f"{s}_bbox", i), F.col(f"{s}_{page}")) for s in ("gt", "pred")]
        edges.append(F.abs(scaled[0] - scaled[1]))
    position = (edges[0] + edges[1] + edges[2] + edges[3]) / 4
    order = F.abs(F.col("gt_order") - F.col("pred_order"))
    total = F.col("token_cost") + POSITION_WEIGHT * F.col("position_cost") + ORDER_WEIGHT * F.col("order_cost")
    return (
        pairs.withColumn("position_cost", position)
        .withColumn("order_cost", order)
        .withColumn("cost", F.coalesce(F.round(F.nanvl(total, F.lit(NO_COST)), 9), F.lit(NO_COST)))
    )


# What a match carries beside its keys: places and centres, no arrays.
_MATCH = ["norm_token", "gt_seq", "pred_seq", "gt_x_c", "gt_y_c", "pred_x_c", "pred_y_c"]


def bare(matches: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The matches without their names: what a fit and a score need."""
    return _as_dealt(matches.select(*keys, "gt_seq", *[f"{s}_{a}_c" for s in ("gt", "pred") for a in ("x", "y")]), matches)


def align_by_occurrence(boxes: DataFrame, keys: list[str] = KEYS, bits: int | None = None) -> DataFrame:
    """One-to-one matches: the k-th occurrence of a token on one side with the k-th on the other.

    Linear in the number of boxes, which are moved once; in samples longer than a block both sides
    are joined, by a key that is unique per side, so no key is hot. A match has the place and the
    box centre of both its tokens.
    """
    fine = _fine_first(keys)
    narrow = box_center(boxes).select(*keys, "side", "seq", "token", "x_c", "y_c").dropna(subset=keys)
    short, long_rows = by_sample(_as_dealt(narrow, boxes), fine, "seq", bits)
    placed = ranked(_named(short), [*fine, "side", "norm_token"], "seq", "k")
    matches = _meet(placed, [*fine, "norm_token", "k"], ["seq", "x_c", "y_c"]).select(*keys, *_MATCH)
    if long_rows is None:
        return mark_dealt(matches, fine, bits)
    group = [*fine, "side"]
    numbers = numbered(_named(long_rows), [*group, "norm_token"], "seq", "k", sample=group, bits=bits)
    gt, pred = _sides(numbers.drop("token"), keys)
    return matches.unionByName(_join_sides(gt, pred, keys).select(*keys, *_MATCH))


def align_mutual_best(boxes: DataFrame, keys: list[str] = KEYS, bits: int | None = None) -> DataFrame:
    """The matches of :func:`pair_candidates`: equal spelling first, then equal normalised form.

    As many as :func:`align_by_occurrence` finds, at the lowest token cost. Expects visible boxes.
    """
    narrow = box_center(boxes).select(*keys, "side", "seq", "token", "x_c", "y_c")
    pairs = pair_candidates(_as_dealt(narrow, boxes), keys, bits)
    return _as_dealt(pairs.select(*keys, *_MATCH), pairs)


def _ranked_rest(boxes: DataFrame, keys: list[str], bits: int | None) -> DataFrame:
    """Leftovers with ``norm_token`` and ``k``. Their places have gaps, so they are numbered first."""
    side = [*_fine_first(keys), "side"]
    dense = numbered(_named(boxes), side, "seq", "_place", bits=bits)
    return numbered(dense, [*side, "norm_token"], "_place", "k", sample=side, bits=bits).drop("_place")


# ---- Residual test ---------------------------------------------------------------------------


def residual_inliers(
    matches: DataFrame,
    keys: list[str] = KEYS,
    max_residual: float = MAX_RESIDUAL,
    rounds: int = FIT_ROUNDS,
    bits: int | None = None,
) -> DataFrame:
    """Add ``inlier``: the match fits a shift and scale of its sample within ``max_residual`` pixels.

    The first round fits all matches by means, and a match that fits is settled. Each later round
    fits what is still outside, by medians and quartiles, which a few strays do not move. Samples
    with at most three matches keep all; with at most three left outside the sample is done. The
    fit is deterministic and takes the place of random consensus.

    Matches that lie together by sample are judged where they are, round by round. Those of samples
    longer than a block meet the fits by block.
    """
    fine = _fine_first(keys)
    dealt = dealt_by(matches) == (frozenset(fine), bits)
    short, long_rows = by_sample(matches if dealt else cut_lineage(matches), fine, "gt_seq", bits)
    judged = _residual_short(short.dropna(subset=keys), keys, max_residual, rounds)
    if long_rows is None:
        return mark_dealt(judged, fine, bits)
    return judged.unionByName(_residual_long(long_rows, keys, max_residual, rounds, bits))


def _misses(axis: str) -> Column:
    gt, mid, shift = F.col(f"gt_{axis}_c"), F.col(f"_mid_{axis}"), F.col(f"_shift_{axis}")
    return F.col("_scale") * (gt - mid) + mid + shift - F.col(f"pred_{axis}_c")


def _distance() -> Column:
    x, y = _misses("x"), _misses("y")
    return F.round(F.sqrt(x * x + y * y), 6)


def _residual_short(matches: DataFrame, keys: list[str], max_residual: float, rounds: int) -> DataFrame:
    """All rounds over samples whose rows lie in one task: sorted by sample there, and judged many samples at a time.

    A batch's last sample waits for the next batch, so a task holds a batch and one sample.
    """
    arrow = to_arrow_schema(T.StructType([*matches.schema, T.StructField("inlier", T.BooleanType())]))

    def judged(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [table[c].combine_chunks() for c in ("gt_x_c", "gt_y_c", "pred_x_c", "pred_y_c")]
        inlier, settled, kept = _inliers(
            [c.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for c in columns],
            [c.is_valid().to_numpy(zero_copy_only=False) for c in columns],
            np.r_[0, ends], max_residual, rounds,
        )
        flags = pa.array(inlier, mask=~settled)
        yield from pa.Table.from_arrays([*table.columns, flags], schema=arrow).filter(pa.array(kept)).to_batches()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            # the sample that is held began before this batch, so only its last row is compared
            first = sum(h.num_rows for h in held)
            ends = _sample_ends(table.select(keys).slice(max(first - 1, 0))) + max(first - 1, 0)
            if not len(ends):
                held.append(batch)
                continue
            yield from judged(table.slice(0, ends[-1]), ends)
            held = table.slice(ends[-1]).combine_chunks().to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from judged(table, np.array([table.num_rows]))

    schema = T.StructType([*matches.schema, T.StructField("inlier", T.BooleanType())])
    return matches.sortWithinPartitions(*_fine_first(keys)).mapInArrow(match, schema)


def _sample_ends(keys: pa.Table) -> np.ndarray:
    """Places at which another sample begins, the first row's left out."""
    ends = np.zeros(max(keys.num_rows - 1, 0), bool)
    for column in keys.columns:
        column = column.combine_chunks()
        differ = pc.not_equal(column[1:], column[:-1])
        if pa.types.is_floating(column.type):  # a group has one key that is no number
            nan = pc.is_nan(column)
            differ = pc.and_not(differ, pc.and_(nan[1:], nan[:-1]))
        ends |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(ends) + 1


def _inliers(
    places: list[np.ndarray], valid: list[np.ndarray], bounds: np.ndarray, max_residual: float, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a match is an inlier, whether that is known, and whether it stays: of samples between the bounds.

    ``places`` are x and y of gt and of pred. A match without one of them settles nothing: it is left
    out, unless its sample has few matches or no other round follows.
    """
    size = len(places[0])
    sample = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.logical_and.reduce(valid)
    inlier, known, kept = np.zeros(size, bool), np.zeros(size, bool), np.ones(size, bool)
    left = np.arange(size)
    for number in range(rounds):
        own = sample[left]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(left) else left
        count = np.diff(np.r_[start, len(left)])
        group = np.repeat(np.arange(len(start)), count)
        here, there = [p[left] for p in places], [v[left] for v in valid]
        if number == 0:
            means, spreads = zip(*(_mean_and_variance(v, ok, start, group) for v, ok in zip(here, there)))
            mids, shifts = means[:2], [means[2] - means[0], means[3] - means[1]]
            gt, pred = np.sqrt(spreads[0] + spreads[1]), np.sqrt(spreads[2] + spreads[3])
        else:
            quarters = [_quartiles(v, start, count, group) for v in here]
            mids = [quarters[0][1], quarters[1][1]]
            shifts = [_quartiles(here[a + 2] - here[a], start, count, group)[1] for a in (0, 1)]
            gt, pred = [sum(q[2] - q[0] for q in quarters[k : k + 2]) for k in (0, 2)]
        with np.errstate(all="ignore"):
            scale = np.where((gt <= 0) | (pred <= 0), 1.0, pred / gt)[group]
            misses = [scale * (here[a] - mids[a][group]) + mids[a][group] + shifts[a][group] - here[a + 2] for a in (0, 1)]
            distance = np.sqrt(misses[0] * misses[0] + misses[1] * misses[1])
            near = np.floor(distance * 1e6 + 0.5) / 1e6 < max_residual
        few = (count <= MIN_FIT)[group]
        sure = few | whole[left]
        fits = np.where(few, number == 0, near) & sure
        inlier[left], known[left] = fits, sure
        if number < rounds - 1:
            kept[left] = sure
            left = left[sure & ~fits & ~few]
    return inlier, known, kept


def _mean_and_variance(v: np.ndarray, ok: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the valid values of each group; no number where there is none."""
    if not len(v):
        return np.zeros(0), np.zeros(0)
    with np.errstate(all="ignore"):
        count = np.add.reduceat(ok, start, dtype=np.int64)
        mean = np.add.reduceat(np.where(ok, v, 0.0), start) / count
        apart = np.where(ok, v - mean[group], 0.0)
        return mean, np.add.reduceat(apart * apart, start) / count


def _quartiles(v: np.ndarray, start: np.ndarray, count: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """The exact quartiles of each group, between two values in proportion."""
    if not len(v):
        return [np.zeros(0)] * len(QUARTERS)
    v, out = v[np.lexsort((v, group))], []
    for share in QUARTERS:
        at = (count - 1) * share
        low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
        a, b = v[start + low], v[start + high]
        out.append(np.where(a == b, a, (high - at) * a + (at - low) * b))
    return out


def _spread(side: str) -> Column:
    return sum(F.get(f"_{side}_{a}", 2) - F.get(f"_{side}_{a}", 0) for a in ("x", "y"))


def _residual_long(matches: DataFrame, keys: list[str], max_residual: float, rounds: int, bits: int | None) -> DataFrame:
    """The same rounds for samples longer than a block, whose rows meet the fits block by block."""
    columns = [*matches.columns]
    still = cut_lineage(matches.withColumn(BLOCK, block_of(F.col("gt_seq"), bits)))
    settled = []
    for number in range(rounds):
        stats = _fit_by_means(still, keys) if number == 0 else _fit_by_quartiles(still, keys, bits)
        fitted = per_block(stats, "_last_seq", bits)
        joined = still.join(fitted.hint("merge"), [*_fine_first(keys), BLOCK])
        few = F.col("_matches") <= MIN_FIT
        judged = joined.withColumn("inlier", F.when(few, F.lit(number == 0)).otherwise(_distance() < max_residual))
        last = number == rounds - 1
        if not last:
            judged = cut_lineage(judged.select(*still.columns, few.alias("_few"), "inlier"))
            done = F.col("inlier") | F.col("_few")
            settled.append(judged.filter(done).select(*columns, "inlier"))
            still = judged.filter(~done).select(*still.columns)
        else:
            settled.append(judged.select(*columns, "inlier"))
    return reduce(DataFrame.unionByName, settled)


def _scale(pred_spread: Column, gt_spread: Column) -> Column:
    return F.when((gt_spread > 0) & (pred_spread > 0), pred_spread / gt_spread).otherwise(F.lit(1.0))


def _fit_by_means(points: DataFrame, keys: list[str]) -> DataFrame:
    """Shift: difference of the mean centres. Scale: ratio of the standard distances."""
    stats = points.groupBy(*_fine_first(keys)).agg(
        F.count(F.lit(1)).alias("_matches"),
        F.max("gt_seq").alias("_last_seq"),
        *[F.avg(f"{s}_{a}_c").alias(f"_{s}_{a}") for s in ("gt", "pred") for a in ("x", "y")],
        *[F.var_pop(f"{s}_{a}_c").alias(f"_{s}_v{a}") for s in ("gt", "pred") for a in ("x", "y")],
    )
    gt_spread, pred_spread = [F.sqrt(F.col(f"_{s}_vx") + F.col(f"_{s}_vy")) for s in ("gt", "pred")]
    return stats.select(
        *keys, "_matches", "_last_seq", _scale(pred_spread, gt_spread).alias("_scale"),
        *[F.col(f"_gt_{a}").alias(f"_mid_{a}") for a in ("x", "y")],
        *[(F.col(f"_pred_{a}") - F.col(f"_gt_{a}")).alias(f"_shift_{a}") for a in ("x", "y")],
    )


QUARTERS = [0.25, 0.5, 0.75]


def _fit_by_quartiles(points: DataFrame, keys: list[str], bits: int | None) -> DataFrame:
    """Shift: median difference. Scale: ratio of the interquartile ranges.

    A sample within one block has at most that many coordinates, which one aggregate buffer holds;
    the quantiles of longer samples are found by bins, without a buffer.
    """
    fine = _fine_first(keys)
    columns = {f"_{s}_{a}": F.col(f"{s}_{a}_c") for s in ("gt", "pred") for a in ("x", "y")}
    columns |= {f"_shift_{a}": F.col(f"pred_{a}_c") - F.col(f"gt_{a}_c") for a in ("x", "y")}
    counts = [F.count(F.lit(1)).alias("_matches"), F.max("gt_seq").alias("_last_seq")]
    size = 1 << (BLOCK_BITS if bits is None else bits)
    # as in ``numbered``: each of them has more places than a block, which bounds the list
    long_samples = cut_lineage(points.filter(F.col("gt_seq") >= size).select(*fine).distinct())
    if long_samples.isEmpty():
        stats = points.groupBy(*fine).agg(*counts, *[F.percentile(c, F.array(*map(F.lit, QUARTERS))).alias(n) for n, c in columns.items()])
    else:
        listed = broadcast_if_small(long_samples)
        short = points.join(listed, fine, "left_anti").groupBy(*fine)
        stats = short.agg(*counts, *[F.percentile(c, F.array(*map(F.lit, QUARTERS))).alias(n) for n, c in columns.items()])
        long_points = points.join(listed, fine, "left_semi")
        found = exact_quantiles(long_points, fine, columns, QUARTERS)
        stats = stats.unionByName(long_points.groupBy(*fine).agg(*counts).join(found, fine))
    return stats.select(
        *keys, "_matches", "_last_seq", _scale(_spread("pred"), _spread("gt")).alias("_scale"),
        *[F.get(f"_gt_{a}", 1).alias(f"_mid_{a}") for a in ("x", "y")],
        *[F.get(f"_shift_{a}", 1).alias(f"_shift_{a}") for a in ("x", "y")],
    )


# ---- Scores ----------------------------------------------------------------------------------


def _rates(df: DataFrame) -> DataFrame:
    hits = F.coalesce("n_match", F.lit(0))
    rate = lambda up, down: F.round(F.coalesce(F.try_divide(up, down), F.lit(0.0)), DIGITS)
    both = F.col("n_gt") + F.col("n_pred")
    return (
        df.withColumn("recall", rate(hits, F.col("n_gt")))
        .withColumn("precision", rate(hits, F.col("n_pred")))
        .withColumn("f1", rate(2 * hits, both))
        .withColumn("exact", (hits == F.col("n_gt")) & (hits == F.col("n_pred")))
    )


def score_samples(matches: DataFrame, counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Recall, precision and F1 per sample, 3 decimals; samples without a match score 0.

    ``counts`` comes from :func:`pair_samples`. If ``matches`` has an ``inlier`` column only
    inliers count. ``exact`` says that every token on both sides was matched.
    """
    kept = matches.filter("inlier") if "inlier" in matches.columns else matches
    hits = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_match"))
    return _rates(null_safe_join(counts, hits, keys, "left")).select(*keys, "recall", "precision", "f1", "exact")


def token_bag_f1(boxes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scores per sample from token counts alone, without boxes' places: an upper bound."""
    fine = _fine_first(keys)
    named = _named(visible_boxes(boxes)).select(*keys, "side", "seq", "norm_token")
    short, long_rows = by_sample(named, fine, "seq")
    sums = _bag_sums(short, fine)
    if long_rows is not None:
        sums = sums.unionByName(_bag_sums(long_rows, fine))
    return _rates(sums.filter(F.col("n_gt") > 0)).select(*keys, "recall", "precision", "f1", "exact")


def _bag_sums(named: DataFrame, fine: list[str]) -> DataFrame:
    on_side = lambda side: F.sum((F.col("side") == side).cast("bigint"))
    bag = named.groupBy(*fine, "norm_token").agg(on_side("gt").alias("g"), on_side("pred").alias("p"))
    return bag.groupBy(*fine).agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"), F.sum(F.least("g", "p")).alias("n_match"))


def score_corpus(samples: DataFrame, by: list[str], rounded_exact: bool = False) -> DataFrame:
    """Mean F1 and rate of exact samples per group.

    A sample is exact when all its tokens were matched; with ``rounded_exact`` when its rounded F1
    is 1, which a very long sample with one miss also reaches.
    """
    exact = (F.col("f1") == 1) if rounded_exact else F.col("exact")
    return samples.groupBy(*by).agg(
        F.round(F.avg("f1"), DIGITS).alias("cdm"),
        F.round(F.avg(exact.cast("int")), DIGITS).alias("exp_cdm"),
    )


def structure_score(
    boxes: DataFrame, by: list[str], keys: list[str] = KEYS, residual: bool = True, by_cost: bool = False
) -> DataFrame:
    """From a box table to aligned scores per group; ``keys`` must include ``by``."""
    from .alignment import align_by_cost

    seen = visible_boxes(boxes)
    matches = align_by_cost(seen, keys) if by_cost else align_by_occurrence(seen, keys)
    if residual:
        matches = residual_inliers(bare(matches, keys), keys)
    return score_corpus(score_samples(matches, pair_samples(boxes, keys), keys), by)
