"""The distance of long texts against the built-in one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mathloom.functions import distance
from mathloom.operators import text_metrics as m

LETTERS = "abcdefgh é漢🙂\\{}"


def _edited(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        i = draw.randrange(len(out) + 1)
        kind = draw.choice(["add", "drop", "swap"])
        if kind == "add":
            out.insert(i, draw.choice(LETTERS))
        elif out and i < len(out):
            out[i : i + 1] = [] if kind == "drop" else [draw.choice(LETTERS)]
    return "".join(out)


def _pairs(draw):
    pairs = [(None, "x"), ("x", None), ("", ""), ("", "abc"), ("a" * 500, "a" * 500), ("a" * 500, "a" * 503), ("ab" * 300, "ba" * 300)]
    for _ in range(60):
        text = "".join(draw.choices(LETTERS, k=draw.randint(200, 700)))
        pairs.append((text, _edited(draw, text, draw.randint(0, 20))))
    for _ in range(20):
        # repeats, shared ends, one text inside the other
        text = "".join(draw.choices("ab", k=draw.randint(250, 400)))
        pairs.append((text, _edited(draw, text, draw.randint(0, 9))))
        pairs.append((text + "x" * 300, text))
        pairs.append((text, "".join(draw.choices("ab", k=draw.randint(250, 400)))))
    return pairs


def test_same_as_the_built_in_distance(spark):
    df = spark.createDataFrame(_pairs(random.Random(1)), "a string, b string").repartition(4)
    found = df.select(F.levenshtein("a", "b").alias("x"), distance.edit_distance(F.col("a"), F.col("b")).alias("y"), "a", "b").collect()
    assert [r for r in found if r.x != r.y] == []
    assert sum(r.x is not None and 0 < r.x <= distance.NEAR for r in found) > 20
    assert sum(r.x is not None and r.x > distance.NEAR for r in found) > 20


@pytest.mark.parametrize("threshold", [0.5, 0.1])
def test_the_bounded_score_is_the_same(spark, threshold):
    df = spark.createDataFrame(_pairs(random.Random(2)), "gt string, pred string").repartition(4)
    d = F.levenshtein("gt", "pred") / F.greatest(F.length("gt"), F.length("pred"))
    plain = F.when(F.col("gt") == F.col("pred"), 1.0).when(d < threshold, 1 - d).otherwise(F.lit(0.0))
    found = df.select(plain.alias("x"), m.anls(F.col("gt"), F.col("pred"), threshold).alias("y")).collect()
    assert [r for r in found if r.x != r.y] == []


def test_time_follows_the_length(spark):
    draw = random.Random(3)
    seconds = []
    for n in (20_000, 80_000):
        text = "".join(draw.choices(LETTERS, k=n))
        other = list(text)
        for i in (n // 9, n // 2, n - 99):
            other[i] = "#"
        df = spark.createDataFrame([(text, "".join(other))] * 4, "a string, b string").repartition(1).cache()
        df.count()
        find = df.select(distance.edit_distance(F.col("a"), F.col("b")).alias("d"))
        assert {r.d for r in find.collect()} == {3}
        start = time.perf_counter()
        find.collect()
        seconds.append(time.perf_counter() - start)
    # four times the length; the built-in distance takes sixteen times as long
    assert seconds[1] < 8 * seconds[0] + 0.5
