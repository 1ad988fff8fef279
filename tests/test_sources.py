import json

import pytest
from pyspark.sql import functions as F

from mathloom.operators import curate, registry
from mathloom.session import shared_dir
from mathloom.sources import readers, schemas, writers


def test_the_shared_folder_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_line_numbers_over_many_blocks_of_one_file(spark, tmp_path):
    lines = [f"word{i} tail" if i % 7 else "  " for i in range(5000)]
    (tmp_path / "labels.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_line_labels(spark, str(tmp_path / "labels.txt"))
        assert spark.read.text(str(tmp_path / "labels.txt")).rdd.getNumPartitions() > 4
        got = {r.line_no: r.value for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: line for i, line in enumerate(lines) if line.strip()}


def test_line_numbers_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n")
    path = str(tmp_path)
    assert {(r.line_no, r.value) for r in readers.read_line_labels(spark, path).collect()} == {(0, "one"), (2, "two"), (3, "three")}
    by_file = readers.read_line_labels(spark, path, by_file=True).collect()
    assert {(r.line_no, r.value) for r in by_file} == {(0, "one"), (2, "two"), (0, "three")}


def test_captions_last_line_wins(spark, tmp_path):
    (tmp_path / "caption.txt").write_text("k1  a \t b\nk2 c\nk1 d\nk3\n")
    captions = readers.read_keyed_captions(spark, str(tmp_path))
    assert {(r.key, r.caption) for r in captions.collect()} == {("k1", "a b"), ("k2", "c"), ("k1", "d"), ("k3", "")}
    kept = curate.keep_last(captions, "key", "line_no").collect()
    assert {(r.key, r.caption) for r in kept} == {("k1", "d"), ("k2", "c"), ("k3", "")}


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "latex": "a"}\n{"id": "q7", "lat\n{"id": "2", "latex": "é"}\n')
    path = str(tmp_path / "x.jsonl")
    assert {r.id for r in readers.read_jsonl(spark, path, schemas.GT_EXTRACT).collect()} == {"1", "2"}
    errors = curate.row_errors(readers.read_jsonl(spark, path, schemas.GT_EXTRACT, corrupt=True)).collect()
    assert [(r.id, r.reason) for r in errors] == [("q7", "error")]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_jsonl(spark, path, schemas.GT_EXTRACT, strict=True).collect()


def test_results_by_file_name(spark, tmp_path):
    rows = [{"id": 5, "gt": "a", "pred": "b"}, {"id": "x/1.png", "gt": "c", "pred": "d"}]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("r.json", "r.jsonl"):
        got = readers.read_results(spark, str(tmp_path / name)).collect()
        assert {tuple(r) for r in got} == {("5", "a", "b"), ("x/1.png", "c", "d")}


def test_subset_document_and_registry_as_whole_files(spark, tmp_path):
    document = {"Simple(SPE)": [{"image": "a/1.png", "latex_formula": "x"}], "Plain": [{"image": "b/2.png", "latex_formula": "y"}]}
    (tmp_path / "subset.json").write_text(json.dumps(document, indent=2))
    rows = readers.read_subset_document(spark, str(tmp_path / "subset.json")).collect()
    assert {(r.subset_name, r.subset, r.image) for r in rows} == {("Simple(SPE)", "SPE", "a/1.png"), ("Plain", None, "b/2.png")}
    entries = {"d1": {"hf_hub_url": "u", "formatting": "sharegpt", "columns": {"messages": "m"}, "ranking": True}, "d2": {"file_name": "f.json"}}
    (tmp_path / "info.json").write_text(json.dumps(entries, indent=2))
    got = {r.name: r for r in readers.read_registry(spark, str(tmp_path / "info.json")).collect()}
    assert got["d1"].columns == {"messages": "m"} and got["d1"].ranking and got["d2"].file_name == "f.json"


def test_split_reads_only_its_folder(spark, tmp_path):
    df = curate.split(spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("latex_formula")))
    writers.write_splits(df, str(tmp_path / "s"))
    train = readers.read_split(spark, str(tmp_path / "s"), "train", ["id"])
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:string>" in plan
    counts = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(counts.values()) == 1000 and 740 < counts["train"] < 860


def test_row_index_over_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    got = {(r.id, r.idx) for r in readers.with_row_index(spark, path).collect()}
    assert got == {(i, i) for i in range(100)}


def test_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "q")
    bad = spark.createDataFrame([("1", "blank"), ("2", "render")], "id string, reason string")
    for run in ("a", "b", "b"):
        writers.append_quarantine(bad, path, run)
    assert spark.read.parquet(path).count() == 4


def test_existing_files_and_missing_images(spark, tmp_path):
    for name in ("0000000.png", "0000002.png"):
        (tmp_path / name).write_bytes(b"img" + name.encode())
    files = readers.list_files(spark, str(tmp_path), with_content=True, glob="*.png")
    assert {r.name: bytes(r.content)[:3] for r in files.collect()} == {"0000000.png": b"img", "0000002.png": b"img"}
    labels = spark.createDataFrame([(0, " a "), (1, "b"), (2, " ")], "line_no long, value string")
    assert [tuple(r) for r in curate.with_existing_file(labels, files, "d").collect()] == [("d/0000000.png", "a")]
    sample = spark.createDataFrame([("0000000.png",), ("none.png",)], "name string")
    with pytest.raises(Exception, match="no image for none.png"):
        curate.attach_images(sample, files.select("name", "content")).collect()


def test_path_ids(spark):
    paths = spark.createDataFrame([("d/hwe/1.2.png",), ("x.png",), ("a/.hidden",), ("/r.png",)], "p string")
    got = [tuple(r) for r in paths.select(*[curate.path_id(F.col("p"), m) for m in ("subset", "stem", "short")]).collect()]
    assert got == [("hwe/1.2.png", "1.2", "1"), ("x.png", "x", "x"), ("a/.hidden", ".hidden", ""), ("r.png", "r", "r")]


def test_layouts(spark):
    chat = spark.createDataFrame(
        [([("human", "q"), ("gpt", "a"), ("observation", "o")],)], "conversations array<struct<`from`:string,value:string>>"
    )
    got = registry.canonical(chat, {"formatting": "sharegpt"}).first().messages
    assert [tuple(m) for m in got] == [("user", "q"), ("assistant", "a"), ("observation", "o")]
    rows = spark.createDataFrame(
        [("p", "in", "r", [["q0", "a0"]], "s"), ("p", "", "r", None, None)],
        "instruction string, input string, output string, past array<array<string>>, sys string",
    )
    entry = {"columns": {"prompt": "instruction", "query": "input", "response": "output", "history": "past", "system": "sys"}}
    got = [[tuple(m) for m in r.messages] for r in registry.canonical(rows, entry).collect()]
    assert got == [
        [("system", "s"), ("user", "q0"), ("assistant", "a0"), ("user", "p\nin"), ("assistant", "r")],
        [("user", "p"), ("assistant", "r")],
    ]


def test_turns_of_a_long_conversation_stay_rows(spark):
    turns = spark.range(2500).select(F.lit("c").alias("conv"), F.col("id").alias("turn"), F.lit("gpt").alias("from"), F.col("id").cast("string").alias("value"))
    got = registry.canonical_turns(turns, {"formatting": "sharegpt"}).select("turn", "message.*").collect()
    assert {(r.turn, r.role, r.content) for r in got} == {(i, "assistant", str(i)) for i in range(2500)}


def test_a_repeated_run_of_metrics_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.7)], "model string, dataset string, bleu double")
    for only in ("a", "b", "a"):
        writers.write_metrics(rows.filter(rows.model == only), path)
    assert sorted((r.model, r.bleu) for r in spark.read.json(path).collect()) == [("a", 0.5), ("b", 0.7)]
