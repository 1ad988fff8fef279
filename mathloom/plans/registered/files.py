"""Readers and writers: tables written by Spark to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import curate
from ...operators import text_metrics as m
from ...session import new_folder
from ...sources import readers, schemas, writers
from ...streaming.incremental import curate_incremental
from ..derived import ROWS_PER_TASK, formulas, predictions, table, with_tables
from . import curation
from . import sqltext as q

SPLIT_ROWS = ["id", "latex_formula", "split"]


def _written_splits(spark, sf):
    path = new_folder(spark, "splits")
    writers.write_splits(curation.split(spark, sf).select(*SPLIT_ROWS), path)
    return path


def read_split(spark, sf):
    return readers.read_split(spark, _written_splits(spark, sf), "validation", ["id", "latex_formula"])


def write_splits(spark, sf):
    return readers.read_split(spark, _written_splits(spark, sf), columns=SPLIT_ROWS)


def _lines(spark, sf, *columns):
    """Formula lines of which those of low priority are cut in half."""
    rows = formulas(spark, sf)
    record = F.to_json(F.struct("id", F.col("latex_formula").alias("latex"), *columns))
    half = F.left(record, (F.length(record) / 2).cast("int"))
    return rows.select(F.when(F.col("priority") == curation.LOW, half).otherwise(record).alias("value"))


def _written_lines(spark, sf):
    path = new_folder(spark, "lines")
    _lines(spark, sf).write.text(path)
    return path


def read_jsonl(spark, sf):
    return readers.read_jsonl(spark, _written_lines(spark, sf), schemas.GT_EXTRACT)


def row_errors(spark, sf):
    rows = readers.read_jsonl(spark, _written_lines(spark, sf), schemas.GT_EXTRACT, corrupt=True)
    return curate.row_errors(rows)


def read_results(spark, sf):
    path = new_folder(spark, "results-jsonl")
    writers.write_jsonl(predictions(spark, sf).select(F.col("key").alias("id"), "gt", "pred"), path)
    return readers.read_results(spark, path)


# Keys whose rows share one document.
DOCUMENT_KEYS = 8192


def _written_documents(spark, rows, name):
    """One whole document per file: ``rows`` has ``document`` and the number of its file."""
    path = new_folder(spark, name)
    rows.select("file_no", F.col("document").alias("value")).write.partitionBy("file_no").text(path)
    return path


def _by_file(rows, n_rows):
    """Rows of a file in one task, and few files in each: a task holds the documents that it sorts and writes."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_TASK))
    return rows.repartition(tasks, "file_no")


def _file_no(key):
    return F.floor(F.col(key) / DOCUMENT_KEYS).alias("file_no")


def read_results_array(spark, sf):
    """The results as JSON arrays over many lines."""
    record = F.to_json(F.struct(F.col("key").alias("id"), "gt", "pred"))
    records = predictions(spark, sf).select(_file_no("key"), record.alias("record"))
    rows = _by_file(records, table(spark, sf, "orders").count()).groupBy("file_no").agg(F.collect_list("record").alias("r"))
    arrays = rows.select("file_no", F.concat(F.lit("[\n  "), F.array_join("r", ",\n  "), F.lit("\n]")).alias("document"))
    return readers.read_results(spark, _written_documents(spark, arrays, "results-arrays"))


def read_subset_document_whole(spark, sf):
    """Documents with a list of rows for each subset."""
    row = F.struct(F.format_string("%s/%s.png", "status", "id").alias("image"), "latex_formula")
    named = formulas(spark, sf).select(_file_no("key"), F.format_string("Set %s(%s)", "priority", "status").alias("name"), row.alias("row"))
    lists = _by_file(named, table(spark, sf, "orders").count()).groupBy("file_no", "name").agg(F.collect_list("row").alias("rows"))
    whole = lists.groupBy("file_no").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "rows")))).alias("document"))
    return readers.read_subset_document(spark, _written_documents(spark, whole, "subset-documents"))


def _in_order(df, key):
    """Files whose names sort in the order of the key."""
    ranges = df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(ranges, key).sortWithinPartitions(key)


def read_line_labels(spark, sf):
    path = new_folder(spark, "labels")
    _in_order(curation._labels(spark, sf), "line_no").select("value").write.text(path)
    return readers.read_line_labels(spark, path).select("line_no", "value")


def read_keyed_captions(spark, sf):
    path = new_folder(spark, "captions")
    line = F.concat(F.lit(" "), F.concat_ws("  ", "user_id", "event_type", "props"))
    rows = table(spark, sf, "events").select("event_id", line.alias("value"))
    _in_order(rows, "event_id").select("value").write.text(path)
    return readers.read_keyed_captions(spark, path).select("line_no", "key", "caption")


def list_files(spark, sf):
    """One folder per part type and brand; name, length and digest of every file in them."""
    path = new_folder(spark, "parts")
    line = F.concat_ws("\t", F.format_string("%010d", "p_partkey"), "p_name").alias("value")
    rows = table(spark, sf, "part").select("p_type", "p_brand", line)
    # one file per folder, its lines in order of the key
    dealt = rows.repartition("p_type", "p_brand").sortWithinPartitions("p_type", "p_brand", "value")
    dealt.write.partitionBy("p_type", "p_brand").text(path)
    files = readers.list_files(spark, path, with_content=True, glob="part-*")
    folder = F.regexp_extract("path", "p_type=([^/]+)/p_brand=([^/]+)/part-[^/]+$", 1)
    brand = F.regexp_extract("path", "p_type=([^/]+)/p_brand=([^/]+)/part-[^/]+$", 2)
    named = F.col("path").endswith(F.col("name")).cast("int")
    return files.filter(F.col("length") > 0).select(
        folder.alias("p_type"), F.replace(brand, F.lit("%23"), F.lit("#")).alias("p_brand"), named.alias("named"),
        "length", F.sha2("content", 256).alias("digest"),
    )


def image_files_match(spark, sf):
    """Two folders of files, of which some differ in a byte and some are missing on one side."""
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", F.format_string("%010d %s", "p_partkey", "p_name").alias("value"))
    changed = F.when(F.col("p_partkey") % 31 == 0, F.translate("value", "0", "O")).otherwise(F.col("value"))
    sides = {"gt": rows, "pred": rows.filter(~F.col("p_brand").endswith("7")).withColumn("value", changed)}
    found = []
    for side, lines in sides.items():
        path = new_folder(spark, f"{side}-renders")
        dealt = lines.select("p_brand", "value").repartition("p_brand").sortWithinPartitions("p_brand", "value")
        dealt.write.partitionBy("p_brand").text(path)
        files = readers.list_files(spark, path, with_content=True, glob="part-*").filter(F.col("length") > 0)
        found.append(m.file_digests(files, F.replace(F.regexp_extract("path", "p_brand=([^/]+)", 1), F.lit("%23"), F.lit("#"))))
    return m.image_files_match(*found).select(F.col("key").alias("p_brand"), F.col("image_match").cast("int").alias("image_match"))


def read_subset_document(spark, sf):
    path = new_folder(spark, "subsets")
    name = F.format_string("Set %s(%s)", "priority", "status")
    row = F.struct(F.format_string("%s/%s.png", "status", "id").alias("image"), "latex_formula")
    document = F.to_json(F.create_map(name, F.array(row)))
    formulas(spark, sf).select(document.alias("value")).write.text(path)
    return readers.read_subset_document(spark, path, whole_file=False)


def _registry_entries(spark, sf):
    entry = F.struct(
        F.concat_ws("/", F.lit("hub"), "source").alias("hf_hub_url"),
        F.when(F.col("lang") == "en", F.lit("sharegpt")).alias("formatting"),
        F.col("lang").alias("subset"),
        (F.col("n_chars") > 1000).alias("ranking"),
        F.create_map(F.lit("prompt"), F.col("source")).alias("columns"),
    )
    name = F.concat(F.lit("set_"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(_file_no("doc_id"), name.alias("name"), entry.alias("entry"))


def _registry(spark, sf):
    path = new_folder(spark, "registry")
    _registry_entries(spark, sf).select(F.to_json(F.create_map("name", "entry")).alias("value")).write.text(path)
    return path


def read_registry_whole(spark, sf):
    """Registry documents with many entries each."""
    entries = _registry_entries(spark, sf).groupBy("file_no").agg(F.collect_list(F.struct("name", "entry")).alias("e"))
    whole = entries.select("file_no", F.to_json(F.map_from_entries("e")).alias("document"))
    return _shown_registry(readers.read_registry(spark, _written_documents(spark, whole, "registry-documents")))


def read_registry(spark, sf):
    return _shown_registry(readers.read_registry(spark, _registry(spark, sf), whole_file=False))


def _shown_registry(rows):
    return rows.select(
        "name", "hf_hub_url", "formatting", "subset", F.col("ranking").cast("int").alias("ranking"),
        F.col("columns")["prompt"].alias("prompt_column"),
    )


def write_jsonl(spark, sf):
    path = new_folder(spark, "documents")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("latex"))
    writers.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, schemas.GT_EXTRACT, strict=True)


def append_quarantine(spark, sf):
    """Two runs, the second one repeated: it replaces itself."""
    path = new_folder(spark, "quarantine")
    rows = formulas(spark, sf).withColumn("reason", curate.gate_reason(F.col("latex_formula"), F.col("rendered")))
    bad = rows.filter("reason is not null")
    writers.append_quarantine(bad, path, "run-1")
    for _ in range(2):
        writers.append_quarantine(bad.filter("reason = 'render'"), path, "run-2", reason="again")
    return spark.read.schema("id string, reason string, run_id string").parquet(path)


def write_metrics(spark, sf):
    path = new_folder(spark, "metrics")
    scores = m.exact_rate(predictions(spark, sf), ["model", "dataset", "subset"])
    for name in ("base", "tuned"):
        writers.write_metrics(scores.filter(F.col("model") == name), path)
    return spark.read.schema("subset string, exp double, model string, dataset string").json(path)


def write_records_json(spark, sf):
    path = new_folder(spark, "records")
    writers.write_records_json(curation.flag_existing(spark, sf), path)
    return spark.read.schema("line_no long, renderable int").json(path)


def curate_stream(spark, sf):
    """An incremental run over formula lines, then a second run that finds nothing new."""
    source, good, refused, state = (new_folder(spark, n) for n in ("source", "good", "refused", "state"))
    # one file a core: each batch takes three files
    _lines(spark, sf, "rendered").coalesce(spark.sparkContext.defaultParallelism).write.text(source)
    for _ in range(2):
        curate_incremental(spark, source, good, refused, state, rendered="rendered", files_per_batch=3).awaitTermination()
    kept = spark.read.schema("id string, latex string, run_id string").parquet(good)
    bad = spark.read.schema("id string, reason string, run_id string").parquet(refused)
    return kept.select("id", "latex", F.lit("kept").alias("outcome")).unionByName(
        bad.select("id", F.lit(None).cast("string").alias("latex"), F.col("reason").alias("outcome"))
    )


QUERIES = {
    "s01_read_split": read_split,
    "s02_read_jsonl": read_jsonl,
    "s03_read_results": read_results,
    "s03_read_results_array": read_results_array,
    "s04_read_line_labels": read_line_labels,
    "s05_read_keyed_captions": read_keyed_captions,
    "s06_list_files": list_files,
    "s07_read_subset_document": read_subset_document,
    "s07_read_subset_document_whole": read_subset_document_whole,
    "s08_read_registry": read_registry,
    "s08_read_registry_whole": read_registry_whole,
    "k01_write_splits": write_splits,
    "k02_write_jsonl": write_jsonl,
    "k03_append_quarantine": append_quarantine,
    "k04_write_metrics": write_metrics,
    "k05_write_records_json": write_records_json,
    "f06_row_errors": row_errors,
    "m06_image_files_match": image_files_match,
    "x01_curate_incremental": curate_stream,
}

_SPLIT = curation.ORACLES["l05_split"]


def _sql(body: str) -> str:
    return with_tables(["formulas"], body)


def _stream_sql() -> str:
    from .latex import tokenized_formula_sql

    reason = curation._gate_sql("latex")
    return _sql(
        f"WITH readable AS (SELECT id, rendered, {q.strip('latex_formula')} AS t FROM formulas WHERE priority <> '{curation.LOW}'), "
        f"wrapped AS (SELECT id, rendered, {curation._JUDGED_TEXT} AS latex FROM readable), "
        f"judged AS (SELECT id, {tokenized_formula_sql('latex')} AS latex, {reason} AS reason FROM wrapped) "
        "SELECT id, CASE WHEN reason IS NULL THEN latex END AS latex, coalesce(reason, 'kept') AS outcome FROM judged "
        f"UNION ALL SELECT id, NULL, 'error' FROM formulas WHERE priority = '{curation.LOW}'"
    )


ORACLES = {
    "s01_read_split": f"SELECT id, latex_formula FROM ({_SPLIT}) WHERE split = 'validation'",
    "s02_read_jsonl": _sql(f"SELECT id, latex_formula AS latex FROM formulas WHERE priority <> '{curation.LOW}'"),
    "s03_read_results": with_tables(["predictions"], "SELECT id, gt, pred FROM predictions"),
    "s04_read_line_labels": (
        "SELECT p_partkey AS line_no, p_name || ' ' || p_brand AS value FROM part WHERE p_type <> 'ECONOMY'"
    ),
    "s05_read_keyed_captions": (
        "SELECT event_id AS line_no, user_id::varchar AS key, event_type || ' ' || "
        "regexp_replace(props, '\\s+', ' ', 'g') AS caption FROM events"
    ),
    "s06_list_files": (
        "WITH files AS (SELECT p_type, p_brand, string_agg(printf('%010d', p_partkey) || chr(9) || p_name, chr(10) ORDER BY p_partkey) "
        "|| chr(10) AS content FROM part GROUP BY ALL) "
        "SELECT p_type, p_brand, 1 AS named, strlen(content) AS length, sha256(content) AS digest FROM files"
    ),
    "m06_image_files_match": (
        "SELECT p_brand, (p_brand NOT LIKE '%7' AND sum((p_partkey % 31 = 0 "
        "AND contains(printf('%010d', p_partkey) || ' ' || p_name, '0'))::int) = 0)::int AS image_match FROM part GROUP BY p_brand"
    ),
    "s07_read_subset_document": _sql(
        "SELECT 'Set ' || priority || '(' || status || ')' AS subset_name, status AS subset, "
        "status || '/' || id || '.png' AS image, latex_formula FROM formulas"
    ),
    "s08_read_registry": (
        "SELECT 'set_' || doc_id AS name, 'hub/' || source AS hf_hub_url, CASE WHEN lang = 'en' THEN 'sharegpt' END AS formatting, "
        "lang AS subset, (n_chars > 1000)::int AS ranking, source AS prompt_column FROM documents"
    ),
    "k01_write_splits": _SPLIT,
    "k02_write_jsonl": "SELECT doc_id::varchar AS id, text AS latex FROM documents",
    "k03_append_quarantine": _sql(
        f"WITH bad AS (SELECT id, {curation._gate_sql('latex_formula')} AS reason FROM formulas) "
        "SELECT id, reason, 'run-1' AS run_id FROM bad WHERE reason IS NOT NULL "
        "UNION ALL SELECT id, 'again', 'run-2' FROM bad WHERE reason = 'render'"
    ),
    "k04_write_metrics": with_tables(
        ["predictions"],
        "SELECT model, dataset, subset, round(avg((gt = pred)::int), 6) AS exp FROM predictions GROUP BY ALL",
    ),
    "k05_write_records_json": curation.ORACLES["j06_flag_existing"],
    "f06_row_errors": _sql(f"SELECT id, 'error' AS reason FROM formulas WHERE priority = '{curation.LOW}'"),
    "x01_curate_incremental": _stream_sql(),
}

for _whole, _lines_of in (
    ("s03_read_results_array", "s03_read_results"),
    ("s07_read_subset_document_whole", "s07_read_subset_document"),
    ("s08_read_registry_whole", "s08_read_registry"),
):
    ORACLES[_whole] = ORACLES[_lines_of]
