"""Readers for formula tables, label files, result files and the dataset registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOT_SPACE, SPACE, strip
from . import schemas
from .json_documents import array_records, list_entries, map_entries


def read_split(
    spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """A parquet corpus; ``split`` prunes partitions and ``columns`` prunes the scan."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select(*columns) if columns else df


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, corrupt: bool = False
) -> DataFrame:
    """JSON lines under a schema.

    ``strict`` fails on a bad line. Otherwise bad lines are skipped, or, with ``corrupt``, kept
    with their raw text in ``_corrupt_record``.
    """
    reader = spark.read
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    if not corrupt:
        return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)
    marked = T.StructType(schema.fields + [T.StructField(schemas.CORRUPT, T.StringType())])
    return reader.schema(marked).option("mode", "PERMISSIVE").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    """A prediction file: JSON lines if the path says ``jsonl``, else JSON arrays, one per file.

    Integer ids are read as strings. An array is read in as many tasks as the file has splits.
    """
    if "jsonl" in path:
        return read_jsonl(spark, path, schema, strict=True)
    return array_records(spark, path).select(_parsed("text", schema).alias("row")).select("row.*")


def _parsed(text: str, schema: T.DataType) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def _line_numbers(lines: DataFrame, by_file: bool) -> DataFrame:
    """Number the lines of a text scan from 0, in file-name and file order.

    A block of a file is read by one task from front to back, so a line's place in its block is
    the distance to the block's first running id. Blocks are then placed by the number of lines
    before them; that table has one row per block, not per line.
    """
    marked = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = marked.groupBy("file", "_start").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy("file").orderBy("_start") if by_file else Window.orderBy("file", "_start")
    placed = blocks.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    line_no = F.col("_before") + F.col("_mid") - F.col("_first")
    return marked.join(placed, ["file", "_start"]).select("file", line_no.alias("line_no"), "value")


def read_line_labels(spark: SparkSession, path: str, by_file: bool = False) -> DataFrame:
    """Labels by line: ``(file, line_no, value)``. Blank lines use up a number but give no row.

    A folder counts as one label file cut into parts, in name order; with ``by_file`` every file
    is numbered on its own.
    """
    numbered = _line_numbers(spark.read.text(path), by_file)
    return numbered.filter(F.col("value").rlike(NOT_SPACE)).withColumn("value", strip(F.col("value")))


def split_caption(value: Column) -> tuple[Column, Column]:
    """First word as key, the other words joined by one space as caption."""
    words = F.split(strip(value), rf"{SPACE}+")
    rest = F.slice(words, F.lit(2), F.size(words))
    return F.element_at(words, 1), F.array_join(rest, " ")


def read_keyed_captions(spark: SparkSession, path: str, by_file: bool = False) -> DataFrame:
    """Caption lines: ``(file, line_no, key, caption)``."""
    lines = read_line_labels(spark, path, by_file)
    key, caption = split_caption(F.col("value"))
    return lines.select("file", "line_no", key.alias("key"), caption.alias("caption"))


def list_files(spark: SparkSession, path: str, with_content: bool = False, glob: str = "*") -> DataFrame:
    """Files below a folder: ``(path, name, length)`` and the bytes only on request.

    Empty files are not listed.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    name = F.substring_index("path", "/", -1)
    extra = ["content"] if with_content else []
    return files.select("path", name.alias("name"), "length", *extra)


def read_subset_document(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Nested ``{subset: [rows]}`` documents as rows, with the set id from the parentheses.

    ``whole_file`` reads one document per file, in as many tasks as it has splits; otherwise every
    line is a document.
    """
    if whole_file:
        rows = list_entries(spark, path, schemas.SUBSET_ROW).select(F.col("name").alias("subset_name"), F.col("entry").alias("row"))
    else:
        lists = spark.read.text(path).select(F.explode(_parsed("value", schemas.SUBSET_DOCUMENT)).alias("subset_name", "rows"))
        rows = lists.select("subset_name", F.explode("rows").alias("row"))
    return rows.select("subset_name", set_id(F.col("subset_name")).alias("subset"), "row.*")


def set_id(name: Column) -> Column:
    """The text in parentheses; null without parentheses."""
    pattern = r"(?d)\((.*?)\)"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1))


def read_registry(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Registry documents ``{name: entry}`` as one row per entry; ``whole_file`` as above."""
    documents = map_entries(spark, path) if whole_file else spark.read.text(path).withColumnRenamed("value", "text")
    entries = documents.select(F.explode(_parsed("text", schemas.REGISTRY)).alias("name", "entry"))
    return entries.select("name", "entry.*")


def with_row_index(spark: SparkSession, path: str, column: str = "idx") -> DataFrame:
    """A parquet corpus with a running row number over its files, in name order.

    Only per-file row counts are summed; no row is moved.
    """
    df = spark.read.parquet(path)
    names = df.columns
    placed = df.select(
        *names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").count()
    before = F.sum("count").over(Window.orderBy("_file")) - F.col("count")
    offsets = counts.select("_file", before.alias("_before"))
    return placed.join(offsets, "_file").select(*names, (F.col("_before") + F.col("_row")).alias(column))
