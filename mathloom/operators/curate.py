"""From raw image-and-formula tables to chat messages, splits and a quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex, markup
from ..functions.text import not_blank, strip
from ..plans.ranks import shuffle_key, smallest_by_key

# The chat text that models are trained and prompted with.
SYSTEM = "You are a helpful assistant."
INSTRUCTION = "Extract the formulas in the image, and output in Latex format."
IMAGE_MARK = "<image>"
PROMPT = (
    "<|im_start|>system\n{system}<|im_end|>\n"
    "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>{instruction}<|im_end|>\n"
    "<|im_start|>assistant\n"
)

# ---- Projections -----------------------------------------------------------------------------


def message(role: str | Column, content: str | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(role).alias("role"), as_column(content).alias("content"))


def to_messages(
    df: DataFrame, system: str = SYSTEM, instruction: str = INSTRUCTION, answer: str = "latex_formula"
) -> DataFrame:
    """Add ``messages``: system, marked instruction, answer."""
    return df.withColumn(
        "messages",
        F.array(
            message("system", system),
            message("user", IMAGE_MARK + instruction),
            message("assistant", F.col(answer)),
        ),
    )


def to_prompt(df: DataFrame, system: str = SYSTEM, instruction: str = INSTRUCTION) -> DataFrame:
    """Add ``prompt``: the chat-template text up to where the model answers."""
    return df.withColumn("prompt", F.lit(PROMPT.format(system=system, instruction=instruction)))


def assign_id(df: DataFrame, prefix: str = "", index: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Fill missing ids with ``prefix`` and a running number, or a hash of ``keys``.

    Ids that are there stay. Running numbers come with the reader (``with_row_index``,
    ``read_line_labels``), so no row is moved to number it.
    """
    if index is not None:
        new = F.concat(F.lit(prefix), F.col(index).cast("string"))
    else:
        new = F.concat(F.lit(prefix), F.md5(F.concat_ws("\x1f", *keys)))
    old = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("id", F.coalesce(old, new))


def path_id(c: Column, mode: str) -> Column:
    """An id from an image path.

    ``subset``: last folder and file name. ``stem``: file name without its last extension.
    ``short``: last part up to the first dot.
    """
    name = F.substring_index(c, "/", -1)
    if mode == "subset":
        folder = F.element_at(F.split(c, "/"), -2)
        return F.when(c.contains("/") & (folder != ""), F.concat_ws("/", folder, name)).otherwise(name)
    if mode == "stem":
        return F.regexp_replace(name, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    if mode == "short":
        return F.substring_index(name, ".", 1)
    raise ValueError(f"unknown mode {mode!r}")


def override_column(df: DataFrame, target: str, source: str) -> DataFrame:
    """``source`` takes the place of ``target``."""
    return df.withColumn(target, F.col(source)).drop(source)


def id_as_string(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string"))


def subset_code(c: Column) -> Column:
    """The first part of a path-like id."""
    return F.substring_index(c, "/", 1)


# ---- Filters and routing ---------------------------------------------------------------------


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is null, empty or whitespace go; the null test reaches the scan."""
    return df.filter(F.col(column).isNotNull() & not_blank(F.col(column)))


def min_chars(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    return df.filter(F.length(column) >= n)


def only_subset(df: DataFrame, code: str) -> DataFrame:
    return df.filter(subset_code(F.col("id")) == code)


def gate_reason(text: Column, rendered: Column | None = None) -> Column:
    """Why a formula is refused: ``blank``, ``tokenize`` or ``render``; null where it is good."""
    tokens_fit = F.coalesce(markup.braces_balanced(latex.tokenize(text)), F.lit(False))
    reason = F.when(~not_blank(text), F.lit("blank")).when(~tokens_fit, F.lit("tokenize"))
    if rendered is not None:
        reason = reason.when(~F.coalesce(rendered, F.lit(False)), F.lit("render"))
    return reason


def gate(df: DataFrame, text: str = "latex", rendered: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and refused rows with their ``reason``."""
    judged = df.withColumn("reason", gate_reason(F.col(text), F.col(rendered) if rendered else None))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def shown_id(line: Column) -> Column:
    """The id that an unreadable line still shows, or nothing."""
    return F.regexp_extract(line, r'"id"\s*:\s*"?([^",}\s]*)', 1)


def row_errors(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """Rows that could not be read, once per id, as ``(id, reason)``.

    The id is taken from the raw line where the line still shows one.
    """
    shown = shown_id(F.col(corrupt))
    ids = df.filter(F.col(corrupt).isNotNull()).select(
        F.coalesce(F.col("id"), F.when(shown != "", shown)).alias("id")
    )
    return ids.distinct().withColumn("reason", F.lit("error"))


# ---- Joins -----------------------------------------------------------------------------------


def merge_tokenized(original: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Originals whose cleaned text exists, with the text replaced and the messages rebuilt.

    ``tokenized`` is ``(id, latex)``. Originals without a partner drop out.
    """
    cleaned = id_as_string(tokenized).select("id", F.col("latex").alias("_cleaned"))
    merged = id_as_string(original).join(cleaned, "id")
    return to_messages(override_column(merged, "latex_formula", "_cleaned"))


def reground(results: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Predictions with ``gt`` replaced by the cleaned text of the same id."""
    cleaned = id_as_string(tokenized).select("id", F.col("latex").alias("_cleaned"))
    return override_column(id_as_string(results).join(cleaned, "id"), "gt", "_cleaned")


def seen_ids(done: DataFrame, broken: DataFrame) -> DataFrame:
    """Ids that need no more work: done with non-blank text, or broken. Each id once."""
    return id_as_string(drop_blank(done, "latex")).select("id").union(id_as_string(broken).select("id")).distinct()


def unprocessed(rows: DataFrame, done: DataFrame, broken: DataFrame) -> DataFrame:
    """Rows whose id was neither done nor found broken before."""
    return id_as_string(rows).join(seen_ids(done, broken), "id", "left_anti")


def image_name(line_no: Column) -> Column:
    """The image that a numbered label line belongs to."""
    return F.format_string("%07d.png", line_no)


def with_existing_file(labels: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Numbered labels whose image is among ``files``, as ``(image, latex_formula)``."""
    named = drop_blank(labels, "value").withColumn("name", image_name(F.col("line_no")))
    found = named.join(files.select("name").distinct(), "name", "left_semi")
    return found.select(
        F.concat_ws("/", F.lit(folder), "name").alias("image"), strip(F.col("value")).alias("latex_formula")
    )


def attach_images(sample: DataFrame, images: DataFrame, key: str = "name") -> DataFrame:
    """Sampled rows with their image; the job fails on a key that the image store lacks."""
    stored = images.withColumn("_found", F.lit(True))
    joined = sample.join(stored, key, "left")
    missing = F.raise_error(F.concat(F.lit("no image for "), F.col(key).cast("string")))
    return joined.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(missing)).drop("_found")


def flag_existing(df: DataFrame, artifacts: DataFrame, key: str = "name", flag: str = "renderable") -> DataFrame:
    """0/1 flag: an output exists for the row."""
    there = artifacts.select(key).distinct().withColumn("_there", F.lit(1))
    return df.join(there, key, "left").withColumn(flag, F.coalesce("_there", F.lit(0))).drop("_there")


# ---- Counts, duplicates, sets ----------------------------------------------------------------


def run_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per outcome; good rows count as ``kept``."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """For a repeated key the row with the greatest ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return last.select(key, "_row.*")


def concat(*dfs: DataFrame) -> DataFrame:
    """Corpora one after the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ---- Order, samples, splits ------------------------------------------------------------------


def seeded_shuffle(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A permutation fixed by the seed. Ids must be unique, or equal ids end up side by side."""
    return df.orderBy(shuffle_key(F.col(id_col), seed), id_col)


def sample_n(
    df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None, id_col: str = "id", strict: bool = True
) -> DataFrame:
    """Exactly ``n`` rows per group without replacement; a smaller group is an error if ``strict``."""
    keyed = df.withColumn("_key", shuffle_key(F.col(id_col), seed))
    return smallest_by_key(keyed, "_key", n, by or [], [id_col], strict).drop("_key")


def take_shuffled(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows of the seeded shuffle."""
    return sample_n(df, n, seed, id_col=id_col, strict=False)


def sample_errors(df: DataFrame, wrong: Column, n: int = 10, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """At most ``n`` ids of rows that are wrong."""
    by = by or []
    return sample_n(df.filter(wrong).select(*by, "id"), n, seed, by=by, strict=False)


def cap_rows(df: DataFrame, n: int, text: str = "latex", seed: int = 42) -> DataFrame:
    """At most ``n`` rows with text."""
    return take_shuffled(drop_blank(df, text), n, seed)


def split(
    df: DataFrame, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Add ``split``: train, validation or test, by a hash of the id.

    No shuffle and no counting, and a row keeps its split when the corpus grows. Sizes are
    approximate; where they must be exact, use :func:`sample_n`.
    """
    bucket = F.conv(F.left(shuffle_key(F.col(id_col), seed), F.lit(7)), 16, 10).cast("bigint") % 1000
    train, validation = round(1000 * fractions[0]), round(1000 * (fractions[0] + fractions[1]))
    name = F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")
    return df.withColumn("split", name)


# ---- The batch as a whole --------------------------------------------------------------------


def judge(extract: DataFrame, rendered: str | None = None) -> DataFrame:
    """``(id, latex)`` with the tokenised text and a ``reason`` where the row is refused."""
    wrapped = extract.withColumn("latex", latex.wrap_align(strip(F.col("latex"))))
    flag = F.col(rendered) if rendered else None
    judged = wrapped.withColumn("reason", gate_reason(F.col("latex"), flag))
    return judged.select("id", markup.tokenized_formula(F.col("latex")).alias("latex"), "reason")


def extract_gt(df: DataFrame) -> DataFrame:
    """``(id, latex)`` of a corpus: rows with a formula, environments stripped."""
    has_text = F.col("latex_formula").isNotNull() & (F.col("latex_formula") != "")
    text = latex.strip_env(F.col("latex_formula")).alias("latex")
    return df.filter(has_text).select(F.col("id").cast("string").alias("id"), text)
