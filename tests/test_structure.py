import random
from collections import Counter

import pytest

from mathloom.operators import structure as s

SCHEMA = "sample_id string, side string, seq int, token string, bbox array<int>, page_w int, page_h int"


def _box(sample, side, seq, token, x, y=0, seen=True):
    return (sample, side, seq, token, [x, y, x + 10, y + 10] if seen else [], 1000, 100)


@pytest.fixture(scope="module")
def boxes(spark):
    """Random samples, one of them much longer than the rest."""
    rng = random.Random(11)
    rows = []
    for i in range(30):
        n = 150 if i == 0 else rng.randint(1, 12)
        for side in ("gt", "pred"):
            for seq in range(n + rng.randint(0, 3)):
                token = rng.choice(["a", "b", r"\leq", r"\le", "x"])
                rows.append(_box(f"s{i}", side, seq, token, 20 * seq + rng.randint(0, 9), seen=rng.random() > 0.1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _largest(rows):
    """Per sample the sum over normalised tokens of the smaller count."""
    name = {r"\leq": r"\le"}
    bags = {}
    for sample, side, _, token, bbox, *_ in rows:
        if bbox:
            bags.setdefault(sample, {"gt": Counter(), "pred": Counter()})[side][name.get(token, token)] += 1
    return {k: (v["gt"] & v["pred"]).total() for k, v in bags.items()}


@pytest.mark.parametrize("bits", [2, None])
@pytest.mark.parametrize("align", [s.align_by_occurrence, s.align_mutual_best])
def test_matches_are_one_to_one_and_as_many_as_possible(boxes, align, bits):
    rows, df = boxes
    got = align(s.visible_boxes(df), bits=bits).collect()
    for side in ("gt", "pred"):
        places = [(r.sample_id, r[f"{side}_seq"]) for r in got]
        assert len(places) == len(set(places))
    counts = Counter(r.sample_id for r in got)
    assert {k: counts.get(k, 0) for k in _largest(rows)} == _largest(rows)


def test_blocks_do_not_change_results(boxes):
    _, df = boxes
    seen = s.visible_boxes(df)
    for run in (
        lambda bits: s.token_order(seen, bits=bits).select("sample_id", "side", "seq", "order"),
        lambda bits: s.align_mutual_best(seen, bits=bits),
        lambda bits: s.residual_inliers(s.align_by_occurrence(seen, bits=bits), bits=bits),
    ):
        whole, cut = ({tuple(r) for r in run(bits).collect()} for bits in (None, 2))
        assert whole == cut


def test_equal_spelling_comes_first_at_any_distance(spark):
    """``\\leq`` and ``\\le`` are alike; each takes its own spelling, the surplus takes what is left."""
    rows = [_box("s", "gt", 0, "\\le", 800)] + [_box("s", "pred", i, "\\leq", 10 * i) for i in range(5)]
    rows += [_box("s", "pred", 5, "\\le", 800), _box("s", "gt", 1, "\\leq", 0), _box("s", "gt", 2, "\\le", 0)]
    pairs = s.pair_candidates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.gt_seq, r.pred_seq, r.token_cost) for r in pairs} == {(0, 5, 0.0), (1, 0, 0.0), (2, 1, 0.05)}


def test_a_repeated_token_gives_linear_pairs(spark):
    rows = [_box("s", side, i, "a", i) for side in ("gt", "pred") for i in range(300)]
    assert s.pair_candidates(spark.createDataFrame(rows, SCHEMA), bits=4).count() == 300


def test_same_page_scores_one(spark):
    rows = [_box("s", side, i, t, 20 * i) for side in ("gt", "pred") for i, t in enumerate("abcab")]
    df = spark.createDataFrame(rows, SCHEMA)
    for by_cost in (False, True):
        matches = s.residual_inliers(s.align_mutual_best(df) if by_cost else s.align_by_occurrence(df))
        row = s.score_samples(matches, s.pair_samples(df)).first()
        assert (row.recall, row.precision, row.f1, row.exact) == (1.0, 1.0, 1.0, True)


def test_a_stray_token_is_no_inlier(spark):
    rows = [_box("s", "gt", i, "a", 20 * i) for i in range(9)]
    rows += [_box("s", "pred", i, "a", 20 * i + 3 if i != 4 else 700) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    matches = s.residual_inliers(s.align_by_occurrence(df)).collect()
    assert {r.gt_seq for r in matches if not r.inlier} == {4}


def test_few_matches_are_all_kept(spark):
    rows = [_box("s", "gt", i, "abc"[i], 20 * i) for i in range(3)] + [_box("s", "pred", i, "abc"[i], 300 * i) for i in range(3)]
    matches = s.residual_inliers(s.align_by_occurrence(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all(r.inlier for r in matches) and len(matches) == 3


def test_samples_with_one_side(spark):
    rows = [_box("only_gt", "gt", 0, "a", 0), _box("only_pred", "pred", 0, "a", 0), _box("hidden", "gt", 0, "a", 0, seen=False)]
    df = spark.createDataFrame(rows, SCHEMA)
    scores = s.score_samples(s.align_by_occurrence(s.visible_boxes(df)), s.pair_samples(df)).collect()
    assert [(r.sample_id, r.recall, r.precision, r.f1) for r in scores] == [("only_gt", 0.0, 0.0, 0.0)]
    assert [(r.sample_id, r.f1) for r in s.token_bag_f1(df).collect()] == [("only_gt", 0.0)]


def test_rounded_exact(spark):
    samples = spark.createDataFrame([("m", 1.0, False), ("m", 0.5, False)], "model string, f1 double, exact boolean")
    assert s.score_corpus(samples, ["model"]).first().exp_cdm == 0.0
    assert s.score_corpus(samples, ["model"], rounded_exact=True).first().exp_cdm == 0.5


def test_a_page_without_size_costs_100(spark):
    rows = [_box("s", "gt", 0, "a", 0), _box("s", "pred", 0, "a", 0)]
    df = s.token_order(spark.createDataFrame([r[:5] + (0, 0) for r in rows], SCHEMA))
    assert s.pair_cost(s.pair_candidates(df)).first().cost == 100.0


def _moves(df):
    """Shuffles of the plan before any is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line for line in plan.split("== Initial Plan ==")[0].splitlines())


@pytest.mark.parametrize("align", [s.align_by_occurrence, s.align_mutual_best, s.pair_candidates, s.token_bag_f1])
def test_boxes_are_moved_once(boxes, align):
    """Sides, ranks, fits and sums of a sample meet where its rows lie: each shuffle moved the whole table."""
    _, df = boxes
    assert _moves(align(s.visible_boxes(df))) == 1


def test_fits_follow_without_another_move(boxes):
    _, df = boxes
    seen = s.visible_boxes(df)
    assert _moves(s.residual_inliers(s.align_by_occurrence(seen))) == 1
    assert _moves(s.pair_cost(s.pair_candidates(s.token_order(seen)))) == 1


def _matches(spark, draw, samples):
    schema = "sample_id string, norm_token string, gt_seq int, pred_seq int, gt_x_c double, gt_y_c double, pred_x_c double, pred_y_c double"
    rows = []
    for n in range(samples):
        shift, stretch, strays = draw.randint(-40, 40), draw.choice([1.0, 1.5, 0.5]), draw.choice([0, 0.1, 0.4])
        for i in range(draw.choice([1, 3, 4, 9, 40])):
            x, y = 20.0 * i, float(draw.randint(0, 60))
            far = draw.choice([60, 300, -90]) if draw.random() < strays else 0
            end = None if draw.random() < 0.02 else x * stretch + shift + far
            rows.append((f"s{n}", "a", i, i, x, y, end, y * stretch + draw.randint(0, 9)))
    return spark.createDataFrame(rows, schema)


def test_fits_of_many_samples_at_once(spark):
    """As by blocks, where each round is a join; and no window holds a sample's rows once for each round."""
    import random

    matches = _matches(spark, random.Random(7), 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        judged = s.residual_inliers(matches)
        found = sorted(map(repr, judged.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted(map(repr, s.residual_inliers(matches, bits=0).collect()))
    assert sum("inlier=False" in r for r in found) > 50 and len(found) > 1000
    assert "Window" not in judged._jdf.queryExecution().executedPlan().toString()
    one = s.residual_inliers(matches, rounds=1)
    assert one.count() == matches.count() and one.filter("inlier is null").count() > 0
    assert s.residual_inliers(matches.filter("false")).count() == 0


@pytest.mark.parametrize("bits", [2, None])
def test_rows_without_a_sample_have_no_partner(spark, bits):
    rows = [_box(name, side, i, "a", 20 * i) for name in (None, "s") for side in ("gt", "pred") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for align in (s.align_by_occurrence, s.align_mutual_best):
        matches = align(df, bits=bits)
        assert sorted((r.sample_id, r.gt_seq, r.pred_seq) for r in matches.collect()) == [("s", i, i) for i in range(6)]
        assert s.residual_inliers(matches, bits=bits).filter("inlier").count() == 6


@pytest.mark.parametrize("bits", [2, None])
def test_sums_of_a_bag_do_not_depend_on_length(boxes, monkeypatch, bits):
    from mathloom.plans import ranks

    rows, df = boxes
    if bits:
        monkeypatch.setattr(ranks, "BLOCK_BITS", bits)
    wanted = _largest(rows)
    counts = {r.sample_id: r.n_gt for r in s.pair_samples(df).collect()}
    got = {r.sample_id: r.recall for r in s.token_bag_f1(df).collect()}
    assert got == {k: pytest.approx(wanted[k] / n, abs=6e-4) for k, n in counts.items()}
