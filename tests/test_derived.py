import os

from mathloom.plans import derived
from mathloom.session import shared_dir

SF_DIR = "/root/testdata/sf0.001"


def test_boxes_are_neither_sorted_nor_stored(spark):
    """A write by side sorted all rows of a task, which spilled many times what was written."""
    stored = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("boxes")}
    before = stored()
    boxes = derived.boxes(spark, SF_DIR)
    assert boxes.filter("side = 'pred'").count() > 0 and boxes.filter("side = 'gt'").count() > 0
    assert stored() == before
    assert "Sort" not in boxes._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A few compressed megabytes of keys are one split, but hours of text work."""
    rows = derived.table(spark, SF_DIR, "orders").count()
    monkeypatch.setattr(derived, "ROWS_PER_TASK", -(-rows // 9), raising=False)
    formulas = derived.formulas(spark, SF_DIR)
    assert formulas.rdd.getNumPartitions() == 9
    assert formulas.count() == rows
