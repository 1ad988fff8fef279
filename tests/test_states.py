"""Stored states of scores: parts added are the whole, and a report reads states only."""

import random

from pyspark.sql import functions as F

from mathloom.operators import metric_states as states
from mathloom.operators import text_metrics as m

BY = ["model", "dataset"]


def _rows(spark, n):
    draw = random.Random(5)
    word = lambda: draw.choice(["x", "y", "+", "\\frac", "{", "}", "1", "2", "z"])
    rows = []
    for i in range(n):
        gt = [word() for _ in range(draw.randint(0, 12))]
        pred = [t if draw.random() < 0.8 else word() for t in gt] if draw.random() < 0.9 else None
        rows.append((i, draw.choice(["a", "b"]), draw.choice(["p", None]), " ".join(gt), pred and " ".join(pred)))
    return spark.createDataFrame(rows, "id int, model string, dataset string, gt string, pred string").repartition(3, "id")


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_states_of_parts_add_up_to_the_whole(spark):
    rows = _rows(spark, 400)
    whole = states.text_states(rows, BY)
    parts = [states.text_states(rows.filter(F.col("id") % 3 == i), BY) for i in range(3)]
    added = states.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), BY)
    assert _sorted(added.select(*whole.columns)) == _sorted(whole)
    assert _sorted(states.scores(added, BY)) == _sorted(m.evaluate_text(rows, BY))
    # coarser groups from finer states
    coarse = states.scores(states.merge(whole, ["model"]), ["model"])
    assert _sorted(coarse) == _sorted(m.evaluate_text(rows, ["model"]))


def test_a_report_reads_states_only(spark, tmp_path):
    predictions, path = str(tmp_path / "predictions"), str(tmp_path / "states")
    _rows(spark, 200).write.parquet(predictions)
    rows = spark.read.parquet(predictions)
    for run in ("1", "2", "2"):  # the second one again: it replaces itself
        states.write_states(states.text_states(rows.filter(F.col("id") % 2 == int(run) - 1), BY), path, run)
    stored = states.read_states(spark, path)
    report = m.model_report(states.scores(states.merge(stored, BY), BY), "a", ["bleu", "exp"], ["dataset"])
    assert report.inputFiles() and all("/states/" in f for f in report.inputFiles())
    assert _sorted(states.scores(states.merge(stored, BY), BY)) == _sorted(m.evaluate_text(rows, BY))
    one = states.read_states(spark, path, ["1"])
    assert _sorted(states.scores(one, BY)) == _sorted(m.evaluate_text(rows.filter("id % 2 = 0"), BY))


def test_structure_states(spark):
    samples = spark.createDataFrame(
        [("a", 0.333, False), ("a", 1.0, True), ("a", 0.1, False), ("b", 0.0, False)], "model string, f1 double, exact boolean"
    )
    text = states.text_states(_rows(spark, 50), ["model"])
    both = states.with_structure(text, states.structure_states(samples, ["model"]), ["model"])
    found = {r.model: (r.cdm, r.exp_cdm) for r in states.scores(states.merge(both, ["model"]), ["model"]).collect()}
    assert found == {"a": (0.478, 0.333), "b": (0.0, 0.0)}


def test_no_rows(spark):
    assert states.scores(states.text_states(_rows(spark, 5).filter("false"), BY), BY).count() == 0
