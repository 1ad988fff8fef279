"""Curation operators over formulas derived from orders, events, parts, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import latex
from ...operators import curate
from ...sources import readers
from ..derived import formulas, image_names, predictions, quoted, table, with_tables
from . import sqltext as q

DONE, BROKEN, LOW = "1-URGENT", "2-HIGH", "5-LOW"
SEED = 42


def _cleaned(spark, sf):
    """Cleaned text of the formulas that are not pending."""
    rows = formulas(spark, sf).filter("status <> 'P'")
    return rows.select("id", latex.tokenize(F.col("latex_formula")).alias("latex"))


_CLEANED = f"SELECT id, {q.tokenized('latex_formula')} AS latex FROM formulas WHERE status <> 'P'"


def _flat_messages(df, *columns):
    """Messages as plain columns."""
    flat = [
        F.get("messages", i)[part].alias(f"m{i}_{part}") for i in range(3) for part in ("role", "content")
    ]
    return df.select(*columns, *flat)


def _messages_sql(answer: str) -> str:
    return (
        f"'system' AS m0_role, {quoted(curate.SYSTEM)} AS m0_content, 'user' AS m1_role, "
        f"{quoted(curate.IMAGE_MARK + curate.INSTRUCTION)} AS m1_content, 'assistant' AS m2_role, {answer} AS m2_content"
    )


# ---- Projections -----------------------------------------------------------------------------


def to_messages(spark, sf):
    return _flat_messages(curate.to_messages(formulas(spark, sf)), "id")


def to_prompt(spark, sf):
    return curate.to_prompt(formulas(spark, sf)).select("id", "prompt")


def assign_id(spark, sf):
    """Running ids, hashed ids and the fall-back for pending orders, side by side."""
    rows = readers.with_row_index(spark, f"{sf}/orders.parquet")
    pending = rows.withColumn("id", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    fallback = curate.assign_id(pending, "sample_", index="idx").withColumnRenamed("id", "fallback_id")
    running = curate.assign_id(fallback, "crohme_", index="idx").withColumnRenamed("id", "running_id")
    hashed = curate.assign_id(running, "h_", keys=["o_orderkey", "o_orderdate"])
    return hashed.select("o_orderkey", "fallback_id", "running_id", F.col("id").alias("hash_id"))


def path_id(spark, sf):
    ids = [curate.path_id(F.col("url"), mode).alias(f"{mode}_id") for mode in ("subset", "stem", "short")]
    return table(spark, sf, "pages").select("page_id", *ids)


def override_column(spark, sf):
    rows = formulas(spark, sf).select("id", "latex_formula", latex.tokenize(F.col("latex_formula")).alias("new"))
    return curate.override_column(rows, "latex_formula", "new")


def id_as_string(spark, sf):
    return curate.id_as_string(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def _image_ids(spark, sf):
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    return table(spark, sf, "documents").select(path.alias("id"), "lang", "n_chars")


def subset_code(spark, sf):
    return _image_ids(spark, sf).select("id", curate.subset_code(F.col("id")).alias("code"))


# ---- Filters and routing ---------------------------------------------------------------------


def drop_blank(spark, sf):
    return curate.drop_blank(formulas(spark, sf), "latex_formula").select("id", "latex_formula")


def min_chars(spark, sf):
    return curate.min_chars(formulas(spark, sf), "latex_formula").select("id", "latex_formula")


def only_subset(spark, sf):
    return curate.only_subset(_image_ids(spark, sf), "src3")


def gate(spark, sf):
    rows = formulas(spark, sf).select("id", F.col("latex_formula").alias("latex"), "rendered")
    good, bad = curate.gate(rows, "latex", "rendered")
    return curate.concat(good, bad).select("id", F.coalesce("reason", F.lit("kept")).alias("outcome"))


def judge(spark, sf):
    """The whole batch from formula, or table with a formula in it, to tokenised text or refusal."""
    rows = formulas(spark, sf).filter(F.col("latex_formula") != "")
    in_table = F.concat(F.lit("\\begin{tabular}{l c} "), "latex_formula", F.lit(" & 5\\% \\\\ % note"))
    text = F.when(F.col("key") % 7 == 0, in_table).otherwise(latex.strip_env(F.col("latex_formula")))
    extract = rows.select("id", text.alias("latex"), "rendered")
    return curate.judge(extract, "rendered")


# ---- Joins -----------------------------------------------------------------------------------


def merge_tokenized(spark, sf):
    merged = curate.merge_tokenized(formulas(spark, sf).select("id", "latex_formula"), _cleaned(spark, sf))
    return _flat_messages(merged, "id", "latex_formula")


def reground(spark, sf):
    rows = predictions(spark, sf).select("model", "id", "gt", "pred")
    return curate.reground(rows, _cleaned(spark, sf)).select("model", "id", "gt", "pred")


def _done_broken(spark, sf):
    rows = formulas(spark, sf)
    text = F.when(F.col("status") == "P", "  ").otherwise(F.col("latex_formula"))
    done = rows.filter(F.col("priority") == DONE).select("id", text.alias("latex"))
    return done, rows.filter(F.col("priority") == BROKEN).select("id")


_DONE = f"SELECT id FROM formulas WHERE priority = '{DONE}' AND status <> 'P' AND regexp_matches(latex_formula, '\\S')"
_BROKEN = f"SELECT id FROM formulas WHERE priority = '{BROKEN}'"


def unprocessed(spark, sf):
    return curate.unprocessed(formulas(spark, sf).select("id", "latex_formula"), *_done_broken(spark, sf))


def seen_ids(spark, sf):
    return curate.seen_ids(*_done_broken(spark, sf))


def _labels(spark, sf):
    text = F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), text.alias("value"))


def with_existing_file(spark, sf):
    return curate.with_existing_file(_labels(spark, sf), image_names(spark, sf), "images/spe")


def attach_images(spark, sf):
    """Documents with quality labels, each with the stored text of its document as image bytes."""
    sample = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), "quality")
    images = table(spark, sf, "documents").select(
        F.col("doc_id").alias("name"), F.encode("text", "utf-8").alias("content")
    )
    joined = curate.attach_images(sample, images)
    return joined.select("name", "quality", F.md5("content").alias("digest"), F.octet_length("content").alias("n_bytes"))


def flag_existing(spark, sf):
    rows = _labels(spark, sf).select("line_no", curate.image_name(F.col("line_no")).alias("name"))
    return curate.flag_existing(rows, image_names(spark, sf)).select("line_no", "renderable")


# ---- Counts, duplicates, sets ----------------------------------------------------------------


def run_counts(spark, sf):
    reason = curate.gate_reason(F.col("latex_formula"), F.col("rendered")).alias("reason")
    return curate.run_counts(formulas(spark, sf).select(reason))


def keep_last(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), F.col("event_type").alias("caption")
    )
    return curate.keep_last(rows, "key", "line_no")


def concat(spark, sf):
    printed = formulas(spark, sf).select("id", "latex_formula", "status")
    captions = table(spark, sf, "events").select(
        F.concat(F.lit("hme_"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("latex_formula")
    )
    return curate.concat(printed, captions)


# ---- Order, samples, splits ------------------------------------------------------------------


def seeded_shuffle(spark, sf):
    shuffled = curate.seeded_shuffle(formulas(spark, sf).select("id", "latex_formula"), SEED)
    return shuffled.withColumn("shuffle_key", curate.shuffle_key(F.col("id"), SEED))


def take_shuffled(spark, sf):
    return curate.take_shuffled(formulas(spark, sf).select("id", "latex_formula"), 1100, SEED)


def sample_n(spark, sf):
    rows = formulas(spark, sf).select("id", "latex_formula", "status")
    return curate.sample_n(rows, 100, SEED, by=["status"])


def sample_errors(spark, sf):
    rows = predictions(spark, sf)
    return curate.sample_errors(rows, F.col("gt") != F.col("pred"), 10, SEED, by=["model", "dataset"])


def split(spark, sf):
    return curate.split(formulas(spark, sf).select("id", "latex_formula"), seed=SEED)


def cap_rows(spark, sf):
    rows = formulas(spark, sf).select("id", F.col("latex_formula").alias("latex"))
    return curate.cap_rows(rows, 1000, seed=SEED)


QUERIES = {
    "p01_to_messages": to_messages,
    "p02_to_prompt": to_prompt,
    "p03_assign_id": assign_id,
    "p04_path_id": path_id,
    "p05_override_column": override_column,
    "p06_id_as_string": id_as_string,
    "p07_subset_code": subset_code,
    "f01_drop_blank": drop_blank,
    "f02_min_chars": min_chars,
    "f03_only_subset": only_subset,
    "f05_gate": gate,
    "f05_judge_batch": judge,
    "j01_merge_tokenized": merge_tokenized,
    "j02_reground": reground,
    "j03_unprocessed": unprocessed,
    "j04_with_existing_file": with_existing_file,
    "j05_attach_images": attach_images,
    "j06_flag_existing": flag_existing,
    "a10_run_counts": run_counts,
    "w02_keep_last": keep_last,
    "l01_seeded_shuffle": seeded_shuffle,
    "l02_take_shuffled": take_shuffled,
    "l03_sample_n": sample_n,
    "l04_sample_errors": sample_errors,
    "l05_split": split,
    "l06_cap_rows": cap_rows,
    "u01_concat": concat,
    "u02_seen_ids": seen_ids,
}

# ---- SQL -------------------------------------------------------------------------------------


def _gate_sql(text: str) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({text}, '\\S') THEN 'blank' WHEN NOT {q.balanced(q.tokenized(text))} "
        "THEN 'tokenize' WHEN NOT rendered THEN 'render' END"
    )


def _key_sql(id_column: str) -> str:
    return f"md5('{SEED}:' || {id_column})"


def _rank_sql(by: str = "") -> str:
    return f"row_number() OVER ({by} ORDER BY {_key_sql('id')}, id)"


_STEM = r"^(\.*[^.].*)\.[^.]*$"
_JUDGED_TEXT = r"CASE WHEN contains(t, '\\') OR contains(t, '&') THEN '\begin{align*} ' || t || ' \end{align*}' ELSE t END"


def _judge_sql() -> str:
    from .latex import tokenized_formula_sql

    row = quoted("\\begin{tabular}{l c} "), quoted(" & 5\\% \\\\ % note")
    return with_tables(
        ["formulas"],
        f"WITH stripped AS (SELECT id, rendered, CASE WHEN key % 7 = 0 THEN {row[0]} || latex_formula || {row[1]} ELSE "
        + q.strip(q.sub("latex_formula", r"\\begin\{.*?\}|\s*\\end\{.*?\}", ""))
        + f" END AS t FROM formulas WHERE latex_formula <> ''), trimmed AS (SELECT id, rendered, {q.strip('t')} AS t FROM stripped), "
        f"wrapped AS (SELECT id, rendered, {_JUDGED_TEXT} AS latex FROM trimmed) "
        f"SELECT id, {tokenized_formula_sql('latex')} AS latex, {_gate_sql('latex')} AS reason FROM wrapped",
    )


def _formulas_sql(body: str) -> str:
    return with_tables(["formulas"], body)


ORACLES = {
    "p01_to_messages": _formulas_sql(f"SELECT id, {_messages_sql('latex_formula')} FROM formulas"),
    "p02_to_prompt": _formulas_sql(
        "SELECT id, "
        + quoted(curate.PROMPT.format(system=curate.SYSTEM, instruction=curate.INSTRUCTION))
        + " AS prompt FROM formulas"
    ),
    "p03_assign_id": (
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey::varchar ELSE 'sample_' || idx END AS fallback_id, "
        "'crohme_' || idx AS running_id, 'h_' || md5(o_orderkey::varchar || chr(31) || o_orderdate::varchar) AS hash_id "
        "FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)"
    ),
    "p04_path_id": (
        "WITH parts AS (SELECT page_id, string_split(url, '/') AS p FROM pages) SELECT page_id, "
        "CASE WHEN len(p) > 1 AND p[-2] <> '' THEN p[-2] || '/' || p[-1] ELSE p[-1] END AS subset_id, "
        f"regexp_replace(p[-1], {q.pattern(_STEM)}, {q.pattern(chr(92) + '1')}) AS stem_id, "
        "string_split(p[-1], '.')[1] AS short_id FROM parts"
    ),
    "p05_override_column": _formulas_sql(f"SELECT id, {q.tokenized('latex_formula')} AS latex_formula FROM formulas"),
    "p06_id_as_string": "SELECT doc_id::varchar AS id, text FROM documents",
    "p07_subset_code": "SELECT source || '/' || doc_id || '.png' AS id, source AS code FROM documents",
    "f01_drop_blank": _formulas_sql("SELECT id, latex_formula FROM formulas WHERE trim(latex_formula) <> ''"),
    "f02_min_chars": _formulas_sql("SELECT id, latex_formula FROM formulas WHERE length(latex_formula) >= 30"),
    "f03_only_subset": (
        "SELECT source || '/' || doc_id || '.png' AS id, lang, n_chars FROM documents WHERE source = 'src3'"
    ),
    "f05_gate": _formulas_sql(f"SELECT id, coalesce({_gate_sql('latex_formula')}, 'kept') AS outcome FROM formulas"),
    "f05_judge_batch": _judge_sql(),
    "j01_merge_tokenized": _formulas_sql(
        f"WITH cleaned AS ({_CLEANED}) SELECT f.id, c.latex AS latex_formula, {_messages_sql('c.latex')} "
        "FROM formulas f JOIN cleaned c ON f.id = c.id"
    ),
    "j02_reground": with_tables(
        ["predictions"],
        f"WITH cleaned AS ({_CLEANED}) SELECT model, p.id, c.latex AS gt, pred FROM predictions p JOIN cleaned c ON p.id = c.id",
    ),
    "j03_unprocessed": _formulas_sql(
        f"SELECT id, latex_formula FROM formulas WHERE id NOT IN ({_DONE}) AND id NOT IN ({_BROKEN})"
    ),
    "j04_with_existing_file": (
        "SELECT 'images/spe/' || printf('%07d.png', p_partkey) AS image, p_name || ' ' || p_brand AS latex_formula FROM part "
        "WHERE p_type <> 'ECONOMY' AND p_partkey IN (SELECT l_partkey FROM lineitem)"
    ),
    "j05_attach_images": (
        "SELECT l.doc_id AS name, quality, md5(text) AS digest, strlen(text) AS n_bytes "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
    ),
    "j06_flag_existing": (
        "SELECT p_partkey AS line_no, (p_partkey IN (SELECT l_partkey FROM lineitem))::int AS renderable FROM part"
    ),
    "a10_run_counts": _formulas_sql(
        f"SELECT coalesce({_gate_sql('latex_formula')}, 'kept') AS outcome, count(*) AS rows FROM formulas GROUP BY 1"
    ),
    "w02_keep_last": (
        "SELECT user_id AS key, event_id AS line_no, event_type AS caption FROM events "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
    ),
    "l01_seeded_shuffle": _formulas_sql(f"SELECT id, latex_formula, {_key_sql('id')} AS shuffle_key FROM formulas"),
    "l02_take_shuffled": _formulas_sql(
        f"SELECT id, latex_formula FROM formulas QUALIFY {_rank_sql()} <= 1100"
    ),
    "l03_sample_n": _formulas_sql(
        f"SELECT id, latex_formula, status FROM formulas QUALIFY {_rank_sql('PARTITION BY status')} <= 100"
    ),
    "l04_sample_errors": with_tables(
        ["predictions"],
        "SELECT model, dataset, id FROM predictions WHERE gt <> pred "
        f"QUALIFY {_rank_sql('PARTITION BY model, dataset')} <= 10",
    ),
    "l05_split": _formulas_sql(
        f"SELECT id, latex_formula, CASE WHEN b < 800 THEN 'train' WHEN b < 900 THEN 'validation' ELSE 'test' END AS split "
        f"FROM (SELECT *, ('0x' || substr({_key_sql('id')}, 1, 7))::bigint % 1000 AS b FROM formulas)"
    ),
    "l06_cap_rows": _formulas_sql(
        "SELECT id, latex_formula AS latex FROM formulas WHERE trim(latex_formula) <> '' "
        f"QUALIFY {_rank_sql()} <= 1000"
    ),
    "u01_concat": _formulas_sql(
        "SELECT id, latex_formula, status FROM formulas UNION ALL SELECT 'hme_' || event_id, event_type, NULL FROM events"
    ),
    "u02_seen_ids": _formulas_sql(f"{_DONE} UNION {_BROKEN}"),
}
