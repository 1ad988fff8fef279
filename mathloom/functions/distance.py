"""Edit distance of long texts in time that follows their length, not its square.

Texts that differ in few places are compared along diagonals: with ``d`` edits a diagonal is followed
as far as the texts agree, which a search over halved steps finds, until the ends meet. That is exact
for every distance up to ``NEAR``. Farther texts are left to the built-in distance, band by band.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Below this length the built-in distance is cheapest.
LONG = 256
NEAR = 12
BANDS = (256, 4096)
_STEPS = 20  # texts of up to 2**20 characters are compared in that many steps at once
_NEVER = -(1 << 30)


def _agree(a: Column, b: Column, i: Column, j: Column, most: Column) -> Column:
    """How many characters agree from places ``i`` and ``j`` on (0-based), ``most`` at most."""
    steps = F.array(*[F.lit(1 << e) for e in range(_STEPS, -1, -1)])

    def longer(n: Column, step: Column) -> Column:
        fits = n + step <= most
        same = F.substr(a, i + n + 1, step) == F.substr(b, j + n + 1, step)
        return F.when(fits & same, n + step).otherwise(n)

    # runs longer than twice the greatest step are followed by taking that step again
    far = F.sequence(F.lit(0), F.floor(most / (2 << _STEPS)).cast("int"))
    start = F.aggregate(far, F.lit(0), lambda n, _: longer(longer(n, F.lit(1 << _STEPS)), F.lit(1 << _STEPS)))
    return F.aggregate(steps, F.when(most > (1 << _STEPS), start).otherwise(F.lit(0)), longer)


def _near(a: Column, b: Column, la: Column, lb: Column) -> Column:
    """The distance if it is ``NEAR`` at most, else null."""
    lanes = F.sequence(F.lit(-NEAR), F.lit(NEAR))
    never = F.lit(_NEVER)
    empty = F.struct(F.array_repeat(never, 2 * NEAR + 1).alias("reach"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, d: Column) -> Column:
        reach = state["reach"]
        at = lambda lane: F.coalesce(F.get(reach, lane + NEAR), never)

        def follow(lane: Column) -> Column:
            # one edit more: a character replaced, one added, one dropped
            begun = F.greatest(at(lane) + 1, F.when(lane > -NEAR, at(lane - 1)).otherwise(never), at(lane + 1) + 1)
            begun = F.when((d == 0) & (lane == 0), F.lit(0)).otherwise(begun)
            end = F.least(la, lb - lane)
            i = F.least(begun, end)
            out = (i < 0) | (i + lane < 0)
            return F.when(out, never).otherwise(let(i, lambda p: p + _agree(a, b, p, p + lane, end - p)))

        moved = F.transform(lanes, follow)
        next_ = let(moved, lambda r: F.struct(r.alias("reach"), F.when(F.get(r, lb - la + NEAR) == la, d).alias("found")))
        return F.when(state["found"].isNotNull(), state).otherwise(next_)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(NEAR)), empty, step, lambda s: s["found"])
    return F.when(F.abs(la - lb) <= NEAR, found)


def edit_distance(a: Column, b: Column, most: Column | None = None) -> Column:
    """Levenshtein distance in characters; null if a text is null.

    With ``most``, long texts that are farther apart than that may give ``most + 1``.
    """
    la, lb = F.length(a), F.length(b)

    def long_texts(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        p, q = F.length(x), F.length(y)
        near = _near(x, y, p, q)
        if most is not None:
            far = F.call_function("levenshtein", x, y, most)
            rest = [F.when(far >= 0, far).otherwise(most + 1)]
        else:
            bands = [F.levenshtein(x, y, k) for k in BANDS]
            rest = [*[F.when(band >= 0, band) for band in bands], F.levenshtein(x, y)]
        return F.when(F.least(p, q) == 0, F.greatest(p, q)).otherwise(F.coalesce(near, *rest))

    def cut(n: Column) -> Column:
        """The texts without what they share at the start."""
        return F.struct(F.substr(a, n + 1, la).alias("a"), F.substr(b, n + 1, lb).alias("b"))

    def cut_end(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        shared = _agree(F.reverse(x), F.reverse(y), F.lit(0), F.lit(0), F.least(F.length(x), F.length(y)))
        return let(shared, lambda n: F.struct(F.left(x, F.length(x) - n).alias("a"), F.left(y, F.length(y) - n).alias("b")))

    start = _agree(a, b, F.lit(0), F.lit(0), F.least(la, lb))
    slow = let(let(let(start, cut), cut_end), long_texts)
    return F.when(a == b, F.lit(0)).when(F.least(la, lb) < LONG, F.levenshtein(a, b)).otherwise(slow)
