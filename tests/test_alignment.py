"""Alignment by cost against every possible choice, and against pairing by spelling."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mathloom.operators import alignment as al
from mathloom.operators import structure as s
from mathloom.plans.registered import structure as registered

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "sample_id string, side string, seq int, token string, bbox array<int>, page_w int, page_h int"


def _side(draw, n):
    return [(draw.choice(["a", "b"]), i / max(n, 1), [draw.random() for _ in range(4)]) for i in range(n)]


def _total(gt, pred, pairs):
    return sum(al.costs([gt[i]], [pred[j]])[0, 0] for i, j in pairs)


def test_least_cost_of_all_choices_in_order():
    draw = random.Random(1)
    for _ in range(300):
        gt, pred = _side(draw, draw.randint(1, 6)), _side(draw, draw.randint(1, 6))
        few, many = sorted((len(gt), len(pred)))
        pick = lambda c: list(zip(range(few), c)) if len(gt) <= len(pred) else list(zip(c, range(few)))
        least = min(_total(gt, pred, pick(c)) for c in itertools.combinations(range(many), few))
        found = al.in_order(gt, pred)
        assert len(found) == few and abs(_total(gt, pred, found) - least) < 1e-9
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == few
        best = al.cheapest(gt, pred)
        assert len(best) == few
        assert _total(gt, pred, best) <= min(least, _total(gt, pred, al.spelled_first(gt, pred))) + 1e-9


def test_a_page_without_size():
    gt, pred = [("a", 0.0, [None] * 4)], [("a", 0.0, [0.1] * 4), ("a", 0.5, [None, 1.0, 1.0, 1.0])]
    assert al.costs(gt, pred).tolist() == [[s.NO_COST, s.NO_COST]]
    assert len(al.cheapest(gt, pred)) == 1


def _boxes(spark, draw, samples):
    rows = []
    for n in range(samples):
        for side in ("gt", "pred"):
            words = [draw.choice(["x", "y", "\\leq", "\\le", "\\hat", "\\widehat"]) for _ in range(draw.randint(0, 9))]
            rows += [(f"s{n}", side, i, t, [20 * i, 0, 20 * i + 12, 16], 400, 40) for i, t in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def _cost(boxes, matches, keys):
    """Total cost per sample of matches, from the box table."""
    ordered = s.token_order(boxes, keys)
    side = lambda name: ordered.filter(F.col("side") == name).select(
        *keys, *[F.col(c).alias(f"{name}_{c}") for c in ("seq", "token", "order", "bbox", "page_w", "page_h")]
    )
    met = matches.join(side("gt"), [*keys, "gt_seq"]).join(side("pred"), [*keys, "pred_seq"])
    spelled = F.when(F.col("gt_token") == F.col("pred_token"), s.TOKEN_COSTS[0]).otherwise(s.TOKEN_COSTS[1])
    costed = s.pair_cost(met.withColumn("token_cost", spelled))
    return {tuple(r[k] for k in keys): (r.n, r.c) for r in costed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c")).collect()}


@pytest.mark.parametrize("bits", [2, None])
def test_never_above_pairing_by_spelling(spark, bits):
    boxes = _boxes(spark, random.Random(4), 60)
    by_cost = _cost(boxes, al.align_by_cost(boxes, bits=bits), s.KEYS)
    by_spelling = _cost(boxes, s.align_mutual_best(boxes), s.KEYS)
    assert by_cost.keys() == by_spelling.keys() and len(by_cost) > 40
    assert all(by_cost[k][0] == by_spelling[k][0] and by_cost[k][1] <= by_spelling[k][1] + 1e-9 for k in by_cost)
    assert sum(by_cost[k][1] < by_spelling[k][1] - 1e-9 for k in by_cost) > 10


def test_every_match_against_brute_force(spark):
    boxes = _boxes(spark, random.Random(6), 40)
    groups = {}
    for r in s._named(s.token_order(boxes)).orderBy("seq").collect():
        own = groups.setdefault((r.sample_id, r.norm_token), {"gt": [], "pred": []})
        edges = [r.bbox[0] / r.page_w, r.bbox[1] / r.page_h, r.bbox[2] / r.page_w, r.bbox[3] / r.page_h]
        own[r.side].append((r.token, r.order, edges, r.seq))
    expected = {
        (*name, own["gt"][i][3], own["pred"][j][3])
        for name, own in groups.items()
        for i, j in al.cheapest(own["gt"], own["pred"])
    }
    found = al.align_by_cost(boxes).collect()
    assert {(r.sample_id, r.norm_token, r.gt_seq, r.pred_seq) for r in found} == expected and len(found) == len(expected)
    assert al.align_by_cost(boxes.filter("false")).count() == 0


def test_the_registered_query(spark):
    boxes = registered._seen(spark, SF_DIR)
    by_cost = _cost(boxes, registered.align_by_cost(spark, SF_DIR), registered.KEYS)
    by_spelling = _cost(boxes, registered.align_mutual_best(spark, SF_DIR), registered.KEYS)
    assert by_cost.keys() == by_spelling.keys()
    assert all(by_cost[k][0] == by_spelling[k][0] and by_cost[k][1] <= by_spelling[k][1] + 1e-9 for k in by_cost)
    assert any(by_cost[k][1] < by_spelling[k][1] - 1e-9 for k in by_cost)


def test_scores_by_cost(spark):
    boxes = _boxes(spark, random.Random(8), 30).withColumn("model", F.lit("m"))
    keys = ["model", "sample_id"]
    rows = s.structure_score(boxes, ["model"], keys, residual=False, by_cost=True).collect()
    assert rows == s.structure_score(boxes, ["model"], keys, residual=False).collect()


def test_boxes_are_moved_once_for_each_way_to_pair(spark):
    """Once for tokens without a choice and once for the others; no table is written between."""
    schema = "sample_id string, side string, seq int, token string, bbox array<int>, page_w int, page_h int"
    rows = [("s", side, i, "a", [i, 0, i + 1, 1], 100, 10) for side in ("gt", "pred") for i in range(4)]
    matches = al.align_by_cost(spark.createDataFrame(rows, schema))
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.split("== Initial Plan ==")[0].splitlines()) == 2
    assert sorted((r.gt_seq, r.pred_seq) for r in matches.collect()) == [(i, i) for i in range(4)]


def test_both_ways_to_pair_read_one_shuffle(spark):
    matches = registered.align_by_cost(spark, SF_DIR)
    matches.collect()
    plan = matches._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0].splitlines()
    moved = [line for line in final if "Exchange hashpartitioning(sample_id" in line]
    assert len(moved) == 2 and sum("ReusedExchange" in line for line in moved) == 1
