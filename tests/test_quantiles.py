"""Exact quantiles by bins against the built-in aggregate, and the residual test in long samples."""

import random

from pyspark.sql import functions as F

from mathloom.operators import structure
from mathloom.plans import quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def _groups(draw):
    yield "normal", [draw.gauss(0, 1) for _ in range(3000)]
    yield "halves", [draw.randrange(100) / 2 for _ in range(2500)]
    yield "one value", [7.5] * 400
    yield "one row", [3.25]
    yield "two", [1.0, 2.0]
    yield "wide", [draw.choice([-1e300, 1e300, 1e-300, 0.0, 5e-324, 1.0]) * draw.random() for _ in range(900)]
    yield "close", [1.0 + i * 2.0**-52 for i in range(50)] * 3 + [-1e18]
    yield "some null", [None if draw.random() < 0.5 else draw.random() for _ in range(500)]


def test_as_the_built_in_aggregate(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 16)
    rows = [(name, i, v) for name, values in _groups(random.Random(1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5, "i")
    columns = {"a": F.col("v"), "b": -F.col("v") / 3}
    found = quantiles.exact_quantiles(df, ["g"], columns, SHARES)
    shares = F.array(*map(F.lit, SHARES))
    plain = df.groupBy("g").agg(*[F.percentile(c, shares).alias(n) for n, c in columns.items()])
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert quantiles.exact_quantiles(df.filter("false"), ["g"], columns, SHARES).count() == 0


def test_long_samples_fit_as_short_ones_do(spark):
    draw = random.Random(2)
    rows = []
    for sample, n in (("short", 12), ("long", 700), ("longer", 900)):
        for i in range(n):
            x, y = float(20 * i), float(draw.randrange(40))
            stray = draw.choice([0, 0, 0, 60, 200]) if i % 3 == 0 else 0
            rows.append((sample, "t", i, i, x, y, 1.1 * x + 5 + stray, y - stray))
    columns = "sample_id string, norm_token string, gt_seq int, pred_seq int, gt_x_c double, gt_y_c double, pred_x_c double, pred_y_c double"
    matches = spark.createDataFrame(rows, columns)
    whole = structure.residual_inliers(matches)
    blocked = structure.residual_inliers(matches, bits=6)
    key = lambda df: sorted((r.sample_id, r.gt_seq, r.inlier) for r in df.collect())
    assert key(whole) == key(blocked)
    assert len({r.inlier for r in whole.collect()}) == 2
