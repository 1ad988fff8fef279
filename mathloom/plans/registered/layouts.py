"""Chat and preference layouts over conversations, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import registry as r
from ...session import new_folder
from ..derived import table

CHAT = {
    "formatting": "sharegpt",
    "columns": {"messages": "turns"},
    "tags": {"role_tag": "role", "content_tag": "text", "user_tag": "user", "assistant_tag": "assistant"},
}


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _pairs(spark, sf):
    """User turns with the assistant turn that follows."""
    pairs = r.previous_turns(_turns(spark, sf), "conv_id", "turn", ["role", "text"])
    return pairs.filter("before_role = 'user' AND role = 'assistant'").select(
        "conv_id", "turn", F.col("before_text").alias("question"), F.col("text").alias("answer")
    )


_PAIRS = (
    "SELECT b.conv_id, b.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b "
    "ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"
)


def _flat(df, keys, size=3):
    columns = [F.get("messages", i)[p].alias(f"m{i}_{p}") for i in range(size) for p in ("role", "content")]
    return df.select(*keys, F.size("messages").alias("n_messages"), *columns)


def _flat_sql(*messages: str) -> str:
    """Messages given as pairs of role and content expressions."""
    cells = []
    for i in range(0, len(messages), 2):
        cells += [f"{messages[i]} AS m{i // 2}_role", f"{messages[i + 1]} AS m{i // 2}_content"]
    return ", ".join(cells)


def canonical_chat(spark, sf):
    """Every turn of every conversation in the message model."""
    turns = r.canonical_turns(_turns(spark, sf), CHAT)
    return turns.select("conv_id", "turn", "message.role", "message.content")


def canonical_chat_default_tags(spark, sf):
    """Foreign names for the roles, as in files that carry no tags."""
    human = F.struct(F.lit("human").alias("from"), F.col("question").alias("value"))
    gpt = F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value"))
    rows = _pairs(spark, sf).withColumn("conversations", F.array(human, gpt))
    return _flat(r.canonical_chat(rows, {"formatting": "sharegpt"}), ["conv_id", "turn"], 2)


def canonical_prompt(spark, sf):
    entry = {"columns": {"prompt": "question", "response": "answer", "system": "intro"}}
    system = _turns(spark, sf).filter("role = 'system'").select("conv_id", F.col("text").alias("intro"))
    first = system.groupBy("conv_id").agg(F.min("intro").alias("intro"))
    return _flat(r.canonical_prompt(_pairs(spark, sf).join(first, "conv_id", "left"), entry), ["conv_id", "turn"])


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def canonical_pairs(spark, sf):
    """Every good document beside a poor one of the same source and language."""
    rows = _labelled(spark, sf)
    side = lambda quality: rows.filter(F.col("quality") == quality)
    pairs = r.pair_by_rank(side(1), side(0), ["source", "lang"], "doc_id")
    text = lambda side, name: table(spark, sf, "documents").select(
        F.col("doc_id").alias(f"{side}_id"), F.col("text").alias(name)
    )
    named = pairs.join(text("chosen", "better"), "chosen_id").join(text("rejected", "worse"), "rejected_id")
    entry = {"ranking": True, "columns": {"prompt": "source", "chosen": "better", "rejected": "worse"}}
    return _flat(r.canonical(named, entry), ["source", "lang", "chosen_id", "rejected_id", "chosen", "rejected"], 1)


def canonical_preference(spark, sf):
    entry = {"columns": {"prompt": "source", "response": "text", "kto_tag": "quality"}}
    flat = r.canonical(_labelled(spark, sf), entry)
    return _flat(flat.withColumn("label", F.col("label").cast("int")), ["doc_id", "label"], 2)


def canonical_text(spark, sf):
    return r.canonical(table(spark, sf, "documents"), {"columns": {"prompt": "text"}})


def with_history(spark, sf):
    """Each answered question with the question and answer before it."""
    pairs = _pairs(spark, sf)
    before = pairs.select(
        "conv_id", (F.col("turn") + 2).alias("turn"), F.array(F.array("question", "answer")).alias("history")
    )
    entry = {"columns": {"prompt": "question", "response": "answer", "history": "history"}}
    return _flat(r.canonical(pairs.join(before, ["conv_id", "turn"], "left"), entry), ["conv_id", "turn"], 4)


def with_side_columns(spark, sf):
    entry = {"columns": {"prompt": "lang", "response": "source", "images": "n_chars", "tools": "text"}}
    return r.canonical(table(spark, sf, "documents"), entry).select("doc_id", "images", "tools")


def select_source(spark, sf):
    """A local copy partitioned by subset and split, narrowed to one of each."""
    root = new_folder(spark, "hub")
    rows = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("subset"),
        F.when(F.col("n_chars") > 1000, "train").otherwise("test").alias("split"),
    )
    rows.write.partitionBy("subset", "split").parquet(f"{root}/corpus/web")
    entry = {"hf_hub_url": "corpus", "folder": "web", "subset": "en", "split": "train"}
    return r.select_source(spark, root, entry).select("doc_id", "text")


QUERIES = {
    "r01_canonical_chat": canonical_chat,
    "r01_canonical_chat_default_tags": canonical_chat_default_tags,
    "r02_canonical_prompt": canonical_prompt,
    "r03_canonical_pairs": canonical_pairs,
    "r04_canonical_preference": canonical_preference,
    "r05_canonical_text": canonical_text,
    "r06_with_history": with_history,
    "r07_with_side_columns": with_side_columns,
    "r08_select_source": select_source,
}

ORACLES = {
    "r01_canonical_chat": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "r01_canonical_chat_default_tags": (
        f"SELECT conv_id, turn, 2 AS n_messages, {_flat_sql(chr(39) + 'user' + chr(39), 'question', chr(39) + 'assistant' + chr(39), 'answer')} "
        f"FROM ({_PAIRS})"
    ),
    "r02_canonical_prompt": (
        f"WITH pairs AS ({_PAIRS}), intros AS (SELECT conv_id, min(text) AS intro FROM conversations WHERE role = 'system' GROUP BY 1), "
        "j AS (SELECT pairs.*, CASE WHEN regexp_matches(intro, '\\S') THEN intro END AS intro FROM pairs LEFT JOIN intros USING (conv_id)) "
        "SELECT conv_id, turn, CASE WHEN intro IS NULL THEN 2 ELSE 3 END AS n_messages, "
        "CASE WHEN intro IS NULL THEN 'user' ELSE 'system' END AS m0_role, coalesce(intro, question) AS m0_content, "
        "CASE WHEN intro IS NULL THEN 'assistant' ELSE 'user' END AS m1_role, CASE WHEN intro IS NULL THEN answer ELSE question END AS m1_content, "
        "CASE WHEN intro IS NOT NULL THEN 'assistant' END AS m2_role, CASE WHEN intro IS NOT NULL THEN answer END AS m2_content FROM j"
    ),
    "r03_canonical_pairs": (
        "WITH ranked AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY source, lang, quality) AS n "
        "FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source, lang, quality ORDER BY doc_id)) "
        "SELECT g.source, g.lang, g.doc_id AS chosen_id, p.doc_id AS rejected_id, g.text AS chosen, p.text AS rejected, "
        "1 AS n_messages, 'user' AS m0_role, g.source AS m0_content "
        "FROM ranked g JOIN ranked p ON g.source IS NOT DISTINCT FROM p.source AND g.lang IS NOT DISTINCT FROM p.lang "
        "AND g.k % p.n = p.k WHERE g.quality = 1 AND p.quality = 0"
    ),
    "r04_canonical_preference": (
        "SELECT doc_id, (quality = 1)::int AS label, 2 AS n_messages, 'user' AS m0_role, source AS m0_content, "
        "'assistant' AS m1_role, text AS m1_content FROM documents JOIN labels USING (doc_id)"
    ),
    "r05_canonical_text": "SELECT text FROM documents",
    "r06_with_history": (
        f"WITH pairs AS ({_PAIRS}) SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN 2 ELSE 4 END AS n_messages, "
        "'user' AS m0_role, coalesce(b.question, a.question) AS m0_content, "
        "'assistant' AS m1_role, coalesce(b.answer, a.answer) AS m1_content, "
        "CASE WHEN b.turn IS NOT NULL THEN 'user' END AS m2_role, CASE WHEN b.turn IS NOT NULL THEN a.question END AS m2_content, "
        "CASE WHEN b.turn IS NOT NULL THEN 'assistant' END AS m3_role, CASE WHEN b.turn IS NOT NULL THEN a.answer END AS m3_content "
        "FROM pairs a LEFT JOIN pairs b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2"
    ),
    "r07_with_side_columns": "SELECT doc_id, n_chars AS images, text AS tools FROM documents",
    "r08_select_source": "SELECT doc_id, text FROM documents WHERE lang = 'en' AND n_chars > 1000",
}
