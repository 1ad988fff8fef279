import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mathloom.functions import bags
from mathloom.operators import text_metrics as m


def test_ngram_overlap_is_the_multiset_intersection(spark):
    rng = random.Random(7)
    rows = [tuple([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    orders = range(1, 5)
    out = df.select("a", "b", *[bags.ngram_overlap(F.col("a"), F.col("b"), n).alias(f"n{n}") for n in orders]).collect()
    for row in out:
        for n in orders:
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (row.a, row.b))
            assert row[f"n{n}"] == (a & b).total()


def _scores(spark, rows):
    df = spark.createDataFrame(rows, "g string, gt string, pred string")
    return {r.g: r.asDict() for r in m.evaluate_text(df, ["g"]).collect()}


def test_known_scores(spark):
    scores = _scores(
        spark,
        [
            ("same", "a b c d e", "a b c d e"),
            ("empty", "", ""),
            ("far", "abcd", "wxyz"),
            ("half", "ab", "ac"),
            ("near", "abcde", "abcdx"),
            ("unicode", "é", "e"),
            ("short", "a b c d e f", "a b c d e"),
        ],
    )
    assert scores["same"] == {"g": "same", "bleu": 1.0, "edit": 0.0, "anls": 1.0, "exp": 1.0}
    assert scores["empty"] == {"g": "empty", "bleu": 0.0, "edit": 0.0, "anls": 1.0, "exp": 1.0}
    assert scores["far"] == {"g": "far", "bleu": 0.0, "edit": 1.0, "anls": 0.0, "exp": 0.0}
    # a distance of exactly the threshold scores nothing
    assert (scores["half"]["edit"], scores["half"]["anls"]) == (0.5, 0.0)
    assert (scores["near"]["edit"], scores["near"]["anls"]) == (0.2, 0.8)
    assert scores["unicode"]["edit"] == 1.0
    assert scores["short"]["bleu"] == pytest.approx(2.718281828 ** (1 - 6 / 5), abs=1e-6)


def test_null_groups_keep_their_scores(spark):
    df = spark.createDataFrame([("m", None, "a", "a")], "model string, subset string, gt string, pred string")
    structure = spark.createDataFrame([("m", None, 0.9, 0.5)], "model string, subset string, cdm double, exp_cdm double")
    row = m.evaluate(df, structure, ["model", "subset"]).first()
    assert (row.exp, row.cdm) == (1.0, 0.9)


def test_masked_rates_without_a_valid_row(spark):
    df = spark.createDataFrame(
        [("m", "a", "a", False, True, True)],
        "model string, gt string, pred string, gt_rendered boolean, pred_rendered boolean, image_match boolean",
    )
    row = m.masked_rates(df, ["model"]).first()
    assert row.asDict() == {
        "model": "m", "total_samples": 1, "render_success_rate": 0.0, "render_exact_match_accuracy": 0.0,
        "latex_exact_match_accuracy": 0.0, "anls_score": 0.0,
    }


def test_a_missing_image_is_no_match(spark):
    df = spark.createDataFrame(
        [(1, 2, "x", 1, 2, "x"), (1, 2, "x", 1, 2, "y"), (None, None, None, None, None, None)],
        "gt_width int, gt_height int, gt_digest string, pred_width int, pred_height int, pred_digest string",
    )
    assert [r.image_match for r in m.image_exact_match(df).collect()] == [True, False, False]


def test_a_report_computes_its_metrics_once(spark):
    """They are met twice, and were scored again for the baseline."""
    from mathloom.operators import text_metrics as m

    rows = [("base", "d", "a b", "a b"), ("tuned", "d", "a b", "a c")]
    metrics = m.exact_rate(spark.createDataFrame(rows, "model string, dataset string, gt string, pred string"), ["model", "dataset"])
    report = m.model_report(metrics, "base", ["exp"], ["dataset"])
    assert "Aggregate" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.model: r.exp_delta for r in report.collect()} == {"base": 0.0, "tuned": -1.0}


def test_overlap_numbers_only_what_repeats_on_both_sides(spark, monkeypatch):
    draw = random.Random(2)
    pick = lambda n, words: [draw.choice(words) for _ in range(n)]
    rows = [(pick(draw.randint(0, 8), "abcd"), pick(draw.randint(0, 8), "abcd")) for _ in range(200)]
    rows += [(["a", "b", "c"], ["c", "c", "a"]), ([], ["a", "a"]), ([], []), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    count = lambda: [r.n for r in df.select("a", "b", bags.overlap(F.col("a"), F.col("b")).alias("n")).collect()]
    wanted = [sum((Counter(r.a) & Counter(r.b)).values()) if r.a is not None else None for r in df.collect()]
    assert count() == wanted
    monkeypatch.setattr(bags, "_numbered", lambda c: F.raise_error(F.lit("numbered")).cast("array<string>"))
    df = df.filter(F.size(F.array_distinct("b")) == F.size("b"))
    assert count() == [n for n, (a, b) in zip(wanted, rows) if len(set(b)) == len(b)]
