"""Skew-safe plans against brute force, with blocks of four rows so that many are crossed."""

import random

import pytest
from pyspark.sql import functions as F

from mathloom.operators import curate
from mathloom.plans.ranks import broadcast_if_small, null_safe_join, numbered, smallest_by_key


@pytest.fixture(scope="module")
def hot(spark):
    """One sample holds most rows; places have no gaps, tokens repeat."""
    rng = random.Random(3)
    rows = [("hot", i, rng.choice("ab")) for i in range(200)]
    rows += [(f"s{j}", i, rng.choice("ab")) for j in range(20) for i in range(rng.randint(1, 6))]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "s string, seq int, t string")


def test_numbered_over_a_whole_sample(hot):
    rows, df = hot
    got = {(r.s, r.seq): (r.k, r.n) for r in numbered(df, ["s"], "seq", "k", total="n", bits=2).collect()}
    size = {s: sum(1 for r in rows if r[0] == s) for s, _, _ in rows}
    assert got == {(s, seq): (seq, size[s]) for s, seq, _ in rows}


def test_numbered_within_tokens_of_a_sample(hot):
    rows, df = hot
    got = {(r.s, r.seq): r.k for r in numbered(df, ["s", "t"], "seq", "k", sample=["s"], bits=2).collect()}
    expected = {
        (s, seq): sum(1 for s2, seq2, t2 in rows if (s2, t2) == (s, t) and seq2 < seq) for s, seq, t in rows
    }
    assert got == expected


def test_smallest_by_key_is_exact_for_hot_and_small_groups(spark):
    rows = [("hot", f"{i}") for i in range(3000)] + [("small", f"{i}") for i in range(5)] + [(None, "x")]
    df = spark.createDataFrame(rows, "g string, id string").withColumn("key", F.md5("id"))
    got = smallest_by_key(df, "key", 20, ["g"], ["id"]).collect()
    import hashlib

    digest = lambda i: hashlib.md5(i.encode()).hexdigest()
    for group in ("hot", "small", None):
        ids = sorted((r[1] for r in rows if r[0] == group), key=digest)[:20]
        assert sorted(r.id for r in got if r.g == group) == sorted(ids)


def test_sample_n_fails_on_a_short_group(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "g string, id string")
    assert curate.sample_n(df, 1, by=["g"]).count() == 2
    with pytest.raises(Exception, match="not enough rows in b"):
        curate.sample_n(df, 2, by=["g"]).collect()


def test_copies_of_one_id_are_counted_not_lost(spark):
    df = spark.createDataFrame([("same",)] * 500 + [("other",)] * 3, "id string")
    assert curate.take_shuffled(df, 100).count() == 100
    assert curate.take_shuffled(df, 1000).count() == 503


def test_broadcast_only_when_small(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    rows = spark.range(100)
    assert "Broadcast" in plan(rows.join(broadcast_if_small(spark.range(5)), "id"))
    large = broadcast_if_small(spark.range(50), max_rows=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" not in plan(rows.join(large, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_safe_join_keeps_the_null_group(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "g string, a int")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "g string, b int")
    assert {(r.g, r.a, r.b) for r in null_safe_join(a, b, ["g"]).collect()} == {(None, 1, 3), ("x", 2, 4)}


def test_a_hot_id_is_split_in_a_merge(spark):
    """A third of the originals carry one id: the join splits that partition at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        original = spark.range(0, 30000, 1, 8).select(ids.alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("latex_formula"))
        tokenized = spark.range(30000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("latex"))
        tokenized = tokenized.union(spark.createDataFrame([("hot", "x")], "id string, latex string"))
        merged = curate.merge_tokenized(original, tokenized)
        assert len(merged.collect()) == 30000
        assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_dense_ranks_with_a_hot_key(spark):
    from mathloom.plans.ranks import dense_ranks

    rows = [("hot", i) for i in range(3000)] + [(None, i) for i in range(20)] + [(f"k{i % 7}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    found = {(r.k, r.i): (r.n, r.size) for r in dense_ranks(df, ["k"], ["i"], "n", total="size").collect()}
    expected = {}
    for key in {k for k, _ in rows}:
        own = sorted(i for k, i in rows if k == key)
        expected |= {(key, i): (n, len(own)) for n, i in enumerate(own)}
    assert found == expected
    whole = dense_ranks(df.select(F.concat_ws("-", "k", "i").alias("t")), [], ["t"], "n").orderBy("t").collect()
    assert [r.n for r in whole] == list(range(len(rows)))
    assert dense_ranks(df.filter("false"), ["k"], ["i"], "n").count() == 0


def test_pairs_by_rank(spark):
    from collections import Counter

    from mathloom.operators.registry import pair_by_rank

    good = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 100), (None, 101), ("c", 102)], "s string, id int")
    poor = spark.createDataFrame([("a", i) for i in range(1000, 1007)] + [("b", 2000), ("b", 2001), (None, 3000)], "s string, id int")
    found = pair_by_rank(good, poor, ["s"], "id").collect()
    assert sorted(r.chosen_id for r in found) == [*range(50), 100, 101]
    used = Counter(r.rejected_id for r in found if r.s == "a")
    assert set(used) == set(range(1000, 1007)) and max(used.values()) - min(used.values()) <= 1


def test_files_that_differ_in_a_byte(spark, tmp_path):
    from mathloom.operators import text_metrics as m
    from mathloom.sources import readers

    content = {"same": b"\x89PNG\x00\xff", "byte": b"\x89PNG\x00\xff", "longer": b"a", "gone": b"b", "empty": b""}
    other = content | {"byte": b"\x89PNG\x00\xfe", "longer": b"ab", "new": b"c"}
    del other["gone"]
    digests = []
    for side, files in (("gt", content), ("pred", other)):
        (tmp_path / side).mkdir()
        for name, data in files.items():
            (tmp_path / side / f"{name}.png").write_bytes(data)
        listed = readers.list_files(spark, str(tmp_path / side), with_content=True)
        digests.append(m.file_digests(listed, F.col("name")))
    found = {r.key.removesuffix(".png"): r.image_match for r in m.image_files_match(*digests).collect()}
    assert found == {"same": True, "byte": False, "longer": False, "gone": False}  # an empty file is no image
