import json

from mathloom.streaming.incremental import curate_batch, curate_incremental


def _lines(folder, name, rows):
    text = "\n".join(r if isinstance(r, str) else json.dumps({"id": r[0], "latex": r[1], "ok": r[2]}) for r in rows)
    (folder / name).write_text(text + "\n")


def _state(spark, good, bad):
    kept = {(r.id, r.latex) for r in spark.read.parquet(good).collect()}
    refused = {(r.id, r.reason) for r in spark.read.parquet(bad).collect()}
    return kept, refused


def test_resume_takes_only_new_ids(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
    run = lambda: curate_incremental(spark, str(source), good, bad, state, rendered="ok", files_per_batch=1).awaitTermination()
    _lines(source, "1.json", [("1", "x+1", True), ("2", " ", True), ("3", "{ a", True), ("4", "y", False), '{"id": "5", "la'])
    run()
    first = _state(spark, good, bad)
    assert first == ({("1", "x + 1")}, {("2", "blank"), ("3", "tokenize"), ("4", "render"), ("5", "error")})
    run()
    assert _state(spark, good, bad) == first
    # ids that were done or refused stay as they are; only the new one is judged
    _lines(source, "2.json", [("1", "changed", True), ("4", "y", True), ("6", "z", True)])
    run()
    assert _state(spark, good, bad) == (first[0] | {("6", "z")}, first[1])
    assert spark.read.parquet(good).count() == 2


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    schema = "id string, latex string, _corrupt_record string"
    batch = spark.createDataFrame([("1", "x", None), ("2", "", None), ("1", "x", None)], schema)
    for _ in range(2):
        curate_batch(batch, "batch-0", good, bad)
    assert _state(spark, good, bad) == ({("1", "x")}, {("2", "blank")})
    assert spark.read.parquet(good).count() == 1


def test_lines_without_an_id_are_refused_with_their_text(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    rows = [("1", "x", None), (None, "y", None), (None, "z", None), (None, "z", None), (None, None, "{oops"), (None, None, '{"id": "7", "la')]
    batch = spark.createDataFrame(rows, "id string, latex string, _corrupt_record string")
    curate_batch(batch, "batch-0", good, bad)
    found = {(r.id, r.reason, r.line) for r in spark.read.parquet(bad).collect()}
    assert found == {
        (None, "no_id", '{"latex":"y"}'), (None, "no_id", '{"latex":"z"}'), (None, "error", "{oops"), ("7", "error", None)
    }


def test_a_replay_after_a_lost_index_write(spark, tmp_path, monkeypatch):
    from mathloom.streaming import id_index

    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    schema = "id string, latex string, _corrupt_record string"
    batch = spark.createDataFrame([("1", "x", None), ("2", "", None)], schema)
    add = id_index.IdIndex.add
    monkeypatch.setattr(id_index.IdIndex, "add", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    try:
        curate_batch(batch, "batch-0", good, bad)
    except OSError:
        pass
    monkeypatch.setattr(id_index.IdIndex, "add", add)
    for _ in range(2):
        curate_batch(batch, "batch-0", good, bad)
    curate_batch(spark.createDataFrame([("1", "y", None), ("2", "y", None), ("3", "y", None)], schema), "batch-1", good, bad)
    assert _state(spark, good, bad) == ({("1", "x"), ("3", "y")}, {("2", "blank")})


def test_an_index_is_made_from_older_output(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    spark.createDataFrame([("1", "x", "old")], "id string, latex string, run_id string").write.parquet(good)
    spark.createDataFrame([("2", "blank", None, "old")], "id string, reason string, line string, run_id string").write.parquet(bad)
    schema = "id string, latex string, _corrupt_record string"
    curate_batch(spark.createDataFrame([("1", "y", None), ("2", "y", None), ("3", "y", None)], schema), "new", good, bad)
    found = spark.read.option("mergeSchema", True).parquet(f"{good}/run_id=new")
    assert [(r.id, r.latex) for r in found.collect()] == [("3", "y")]


def _scanned(df):
    """Files and bytes that the scan has opened."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return [metrics.apply(name).value() for name in ("numFiles", "filesSize")]


def test_a_batch_reads_no_more_when_more_is_stored(spark, tmp_path):
    """Equal batches open no more files and bytes at the end than before."""
    from mathloom.streaming.id_index import IdIndex

    index = IdIndex(spark, str(tmp_path / "ids"), ids_per_bucket=6)
    first = [str(i) for i in range(-40, 0)]
    index.start(spark.createDataFrame([(i, "old") for i in first], "id string, run_id string"))
    scanned, seen = [], set(first)
    for n in range(12):
        own = [str(i) for i in range(8 * n, 8 * n + 8)] + [str(3 * n - 20)]
        ids = spark.createDataFrame([(i,) for i in own], "id string")
        scanned.append(_scanned(index.candidates(ids)))
        assert sorted(r.id for r in index.seen(ids, f"run-{n}").collect()) == sorted(seen & set(own))
        for _ in range(1 + (n % 5 == 0)):  # a replay changes nothing
            index.add(ids, f"run-{n}")
        seen |= set(own)
    stored = spark.read.parquet(f"{index.path}/buckets={index.buckets()}")
    assert index.buckets() == 64 and {r.id for r in stored.collect()} == seen
    # a batch of 9 ids opens 9 buckets at most, of a few ids each, and not the whole table
    assert max(files for files, _ in scanned[8:]) < len(stored.inputFiles()) / 2
    assert sum(size for _, size in scanned[8:]) <= 1.2 * sum(size for _, size in scanned[4:8])


def test_only_touched_buckets_are_read(spark, tmp_path):
    from mathloom.streaming.id_index import IdIndex

    index = IdIndex(spark, str(tmp_path / "ids"), ids_per_bucket=4)
    index.start(spark.range(1000).selectExpr("cast(id AS string) AS id", "'old' AS run_id"))
    assert index.buckets() == 256
    files, _ = _scanned(index.candidates(spark.createDataFrame([("7",), ("8",), ("x",)], "id string")))
    assert 2 <= files <= 3
