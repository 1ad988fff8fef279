"""Large JSON documents, cut into many splits, against the standard library's parser."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from mathloom.sources import json_documents, readers

MARKS = ['{', '}', '[', ']', '"', '\\', ',', ':', '\n', '\t', 'é', '漢', '🙂', '\\"', '}\\', ' ', 'a', '{"x": [', '\\\\']


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _text(draw):
    return "".join(draw.choices(MARKS, k=draw.randint(0, 25)))


def _rows(draw, n):
    return [{"id": i if draw.random() < 0.5 else str(i), "gt": _text(draw), "pred": draw.choice([None, _text(draw)])} for i in range(n)]


def _key(rows):
    return sorted(map(repr, rows))


def _shown(v):
    return None if v is None else str(v)


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_array_in_many_tasks(spark, small_splits, tmp_path, style):
    draw = random.Random(1)
    expected = []
    for name, n in (("a.json", 150), ("b.json", 1), ("c.json", 0), ("d.json", 40)):
        rows = _rows(draw, n)
        (tmp_path / name).write_text(json.dumps(rows, **style) + "\n" * (name == "a.json"), encoding="utf-8")
        expected += [(_shown(r["id"]), r["gt"], r["pred"]) for r in rows]
    assert json_documents._fragments(spark, f"{tmp_path}/a.json").rdd.getNumPartitions() >= 8
    found = readers.read_results(spark, str(tmp_path))
    assert _key(tuple(r) for r in found.collect()) == _key(expected)
    whole = spark.read.schema(found.schema).option("multiLine", True).option("mode", "FAILFAST").json(str(tmp_path))
    assert _key(whole.collect()) == _key(found.collect())


def test_pieces_are_numbered_in_order(spark, small_splits, tmp_path):
    draw = random.Random(2)
    rows = _rows(draw, 120)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    found = json_documents.array_records(spark, str(tmp_path)).orderBy("piece_no").collect()
    assert [r.piece_no for r in found] == list(range(120))
    assert [json.loads(r.text) for r in found] == rows


@pytest.mark.parametrize("indent", [None, 3])
def test_subset_documents(spark, small_splits, tmp_path, monkeypatch, indent):
    monkeypatch.setattr(json_documents, "_NAME_BLOCK", 3)
    draw = random.Random(3)
    expected = []
    for file in range(2):
        document = {}
        for i in range(25):
            rows = [{"image": _text(draw), "latex_formula": _text(draw)} for _ in range(draw.choice([0, 1, 2, 30]))]
            document[f"Set {i} {_text(draw)}(s{i})"] = rows
        (tmp_path / f"{file}.json").write_text(json.dumps(document, indent=indent))
        expected += [(name, r["image"], r["latex_formula"]) for name, rows in document.items() for r in rows]
    found = readers.read_subset_document(spark, str(tmp_path))
    assert _key((r.subset_name, r.image, r.latex_formula) for r in found.collect()) == _key(expected)


def test_registry_documents(spark, small_splits, tmp_path):
    draw = random.Random(4)
    document = {f"set {i} {_text(draw)}": {"hf_hub_url": _text(draw), "columns": {"prompt": _text(draw)}, "extra": [{"a": [1]}]} for i in range(80)}
    (tmp_path / "r.json").write_text(json.dumps(document, indent=1))
    found = readers.read_registry(spark, str(tmp_path)).collect()
    expected = [(n, e["hf_hub_url"], e["columns"]["prompt"]) for n, e in document.items()]
    assert _key((r.name, r.hf_hub_url, r.columns["prompt"]) for r in found) == _key(expected)


@pytest.mark.parametrize("text", ['[{"id": "1"}, {"id": "2"', '[{"id": "1"}', '[{"id": "1}]', '[{"id": "1"}]]'])
def test_a_cut_document_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(PySparkException):
        readers.read_results(spark, str(tmp_path)).collect()


def test_empty_documents(spark, tmp_path):
    for i, text in enumerate(["[]", "{}", " [ ]\n"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert readers.read_results(spark, str(tmp_path)).count() == 0
    assert readers.read_registry(spark, str(tmp_path)).count() == 0
