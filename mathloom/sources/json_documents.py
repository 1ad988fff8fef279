"""Large JSON documents read by many tasks.

A document is cut at every closing brace, by the text reader with the brace as line separator, so a
file is read in as many byte ranges as it has splits. What a fragment is, code or the inside of a
string, depends on all quotes before it, and its depth on all brackets before it that are code. Both
are sums: a fragment adds its unescaped quotes, and it changes the depth by one number if it begins
in code and by another if it begins in a string. Sums run inside a split, and over the splits of a
file, which is a table of one row per split. A piece ends where a brace brings the document back to
a given depth; its fragments meet by the number of pieces before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import broadcast_if_small
from ..session import cut_lineage

_SPLIT = ["_file", "_start"]


def _level(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    count = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    return count("{[") - count("}]")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to a closing brace, with their quotes and the depth they add from code and from a string.

    A backslash never reaches past the brace: what it escapes there is the brace itself, in a string.
    """
    read = spark.read.option("lineSep", "}").text(path)
    marked = read.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"),
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    side = lambda odd: _level(F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), ""))
    quotes = F.size(parts) - 1
    ends_in_code = lambda begins: (quotes + begins) % 2 == 0
    return marked.select(
        *marked.columns,
        quotes.alias("_quotes"),
        # the brace that ends the fragment counts where it is code
        (side(0) - ends_in_code(0).cast("int")).alias("_from_code"),
        (side(1) - ends_in_code(1).cast("int")).alias("_from_string"),
    )


def _before(value: str, split: bool) -> Column:
    """The sum of a column over earlier rows of a split, or over earlier splits of a file."""
    order = Window.partitionBy(*_SPLIT).orderBy("_at") if split else Window.partitionBy("_file").orderBy("_start")
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _met(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Fragments with their split's row: a broadcast if that table has been counted as small."""
    return rows.join(broadcast_if_small(splits), _SPLIT)


def pieces(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """``(file, piece_no, text)``: what lies between closing braces that lead to ``depth``.

    With depth 1, the pieces of ``[{..}, {..}]`` are ``[{..}`` and ``, {..}``. What follows the last
    piece has no row. A file that does not end as a whole document fails the job.
    """
    rows = _fragments(spark, path)
    begins = F.col("_quotes_before") % 2
    change = lambda flip: F.when(begins == flip, F.col("_from_code")).otherwise(F.col("_from_string"))
    rows = rows.withColumn("_quotes_before", _before("_quotes", split=True))
    rows = rows.withColumn("_if_code", change(0)).withColumn("_if_string", change(1))
    rows = rows.withColumn("_depth_if_code", _before("_if_code", split=True))
    # computed once, for it is met twice; the text lies beside its sums
    rows = cut_lineage(rows.withColumn("_depth_if_string", _before("_if_string", split=True)))
    splits = rows.groupBy(*_SPLIT).agg(
        *[F.sum(c).alias(c) for c in ("_quotes", "_if_code", "_if_string")],
        F.sum(F.octet_length("value") + 1).alias("_bytes"),
        F.max("_size").alias("_size"),
    )
    splits = splits.withColumn("_string", _before("_quotes", split=False) % 2)
    splits = splits.withColumn("_change", F.when(F.col("_string") == 0, F.col("_if_code")).otherwise(F.col("_if_string")))
    splits = splits.withColumn("_depth", _before("_change", split=False))
    # a file without a brace at its end has one byte less than its fragments and braces
    file = Window.partitionBy("_file")
    brace = (F.sum("_bytes").over(file) == F.col("_size")).cast("int")
    whole = (F.sum("_change").over(file) + 1 - brace == 0) & (F.sum("_quotes").over(file) % 2 == 0)
    broken = F.raise_error(F.concat(F.lit("no whole JSON document: "), F.col("_file")))
    splits = splits.select(*_SPLIT, "_string", F.when(whole, F.col("_depth")).otherwise(broken.cast("long")).alias("_depth"))

    placed = _met(rows.select("value", *_SPLIT, "_at", "_quotes", "_quotes_before", "_if_code", "_if_string", "_depth_if_code", "_depth_if_string"), splits)
    pick = lambda a, b: F.when(F.col("_string") == 0, F.col(a)).otherwise(F.col(b))
    after = F.col("_depth") + pick("_depth_if_code", "_depth_if_string") + pick("_if_code", "_if_string")
    code = (F.col("_string") + F.col("_quotes_before") + F.col("_quotes")) % 2 == 0
    ended = placed.select("value", *_SPLIT, "_at", (code & (after == depth)).cast("int").alias("_ends"))
    ended = cut_lineage(ended.withColumn("_ends_before", _before("_ends", split=True)))
    counts = ended.groupBy(*_SPLIT).agg(F.sum("_ends").alias("_n"))
    counts = counts.select(*_SPLIT, _before("_n", split=False).alias("_pieces"))
    numbered = _met(ended, counts).withColumn("piece_no", F.col("_pieces") + F.col("_ends_before"))
    joined = numbered.groupBy("_file", "piece_no").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_at", "value"))).alias("_parts"), F.max("_ends").alias("_ends")
    )
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), "}"), F.lit("}"))
    return joined.filter("_ends = 1").select(F.col("_file").alias("file"), "piece_no", text.alias("text"))


_BLANK = "\\s\ufeff"
# Pieces of one file among which a name is handed on by one task.
_NAME_BLOCK = 16


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, piece_no, text)`` of the objects in arrays ``[{..}, ..]``, as JSON."""
    found = pieces(spark, path, 1)
    return found.withColumn("text", F.regexp_replace("text", rf"\A[{_BLANK}]*(?:\[|,)[{_BLANK}]*", ""))


def map_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, piece_no, text)`` of the entries of ``{"name": {..}, ..}``, each as an object with one name."""
    found = pieces(spark, path, 1)
    return found.withColumn("text", F.concat(F.lit("{"), F.regexp_replace("text", rf"\A[{_BLANK}]*(?:\{{|,)", ""), F.lit("}")))


def list_entries(spark: SparkSession, path: str, row: T.DataType) -> DataFrame:
    """``(file, piece_no, name, entry)`` of the objects in ``{"name": [{..}, ..], ..}``.

    The piece of a list's first object holds the list's name; the objects after it take it from
    there, inside blocks of pieces and then over blocks. Lists without objects give no rows.
    """
    found = pieces(spark, path, 2)
    blank = rf"\A[{_BLANK}]*"
    text = F.col("text")
    first, next_list = F.col("piece_no") == 0, text.rlike(blank + r"\]")
    named = F.when(first, F.regexp_replace(text, blank + r"\{", "")).when(next_list, F.regexp_replace(text, blank + rf"\][{_BLANK}]*,", ""))
    same_list = F.concat(F.lit('"": ['), F.regexp_replace(text, blank + ",", ""))
    document = F.concat(F.lit("{"), F.coalesce(named, same_list), F.lit("]}"))
    lists = F.from_json(document, T.MapType(T.StringType(), T.ArrayType(row)), {"mode": "FAILFAST"})
    held = F.element_at(F.filter(F.map_entries(lists), lambda e: F.size(e["value"]) > 0), -1)
    rows = cut_lineage(
        found.select(
            "file",
            "piece_no",
            F.when(first | next_list, held["key"]).alias("_name"),
            F.element_at(held["value"], 1).alias("entry"),
            F.shiftright("piece_no", _NAME_BLOCK).alias("_block"),
        )
    )
    in_block = Window.partitionBy("file", "_block").orderBy("piece_no")
    blocks = rows.groupBy("file", "_block").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("piece_no"))).alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    filled = rows.withColumn("_own", F.last("_name", ignorenulls=True).over(in_block))
    met = filled.join(broadcast_if_small(carried), ["file", "_block"])
    return met.select("file", "piece_no", F.coalesce("_own", "_carried").alias("name"), "entry")
