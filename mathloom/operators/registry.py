"""Foreign chat and preference layouts mapped to one message model.

An entry is a mapping with the keys ``columns`` and ``tags`` of a registry row; what it leaves out
takes the customary names below. The result has ``messages`` (an array of role and content) and,
where the layout has them, ``chosen``, ``rejected``, ``label`` and the side columns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..plans.ranks import dense_ranks, null_safe_join
from .curate import message

# Customary column names and role names of the layouts.
TAGS = {
    "role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt",
    "system_tag": "system", "observation_tag": "observation", "function_tag": "function_call",
}
ROLES = {
    "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system",
    "observation_tag": "observation", "function_tag": "function",
}
PROMPT_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output"}
SIDE_COLUMNS = ("tools", "images", "audios", "videos")

Entry = dict[str, Any]


def _columns(entry: Entry) -> dict[str, str]:
    return entry.get("columns") or {}


def _role(tag: Column, tags: dict[str, str]) -> Column:
    """The canonical role; an unknown tag passes through."""
    role = tag
    for name, canonical in ROLES.items():
        role = F.when(tag == tags[name], F.lit(canonical)).otherwise(role)
    return role


def chat_messages(column: Column, entry: Entry) -> Column:
    """An array of tagged turns in the message model."""
    tags = {**TAGS, **(entry.get("tags") or {})}
    turn = lambda m: message(_role(m[tags["role_tag"]], tags), m[tags["content_tag"]])
    return F.transform(column, turn)


def canonical_turns(df: DataFrame, entry: Entry) -> DataFrame:
    """Chat stored one turn per row: each turn in the message model as ``message``.

    No row is gathered, so a conversation may have any number of turns.
    """
    tags = {**TAGS, **(entry.get("tags") or {})}
    return df.withColumn("message", message(_role(F.col(tags["role_tag"]), tags), F.col(tags["content_tag"])))


def canonical_chat(df: DataFrame, entry: Entry) -> DataFrame:
    """Chat rows: the turn array becomes ``messages``."""
    name = _columns(entry).get("messages", "conversations")
    return df.withColumn("messages", chat_messages(F.col(name), entry))


def prompt_messages(df: DataFrame, entry: Entry, answer: bool = True) -> Column:
    """Prompt columns in the message model: system, user, assistant, those that exist."""
    columns = _columns(entry) or PROMPT_COLUMNS
    user = F.col(columns["prompt"])
    if columns.get("query") in df.columns:
        query = F.col(columns["query"])
        user = F.when(not_blank(query), F.concat_ws("\n", user, query)).otherwise(user)
    parts = [message("user", user)]
    if "system" in columns:
        system = F.col(columns["system"])
        parts.insert(0, F.when(not_blank(system), message("system", system)))
    if answer and "response" in columns:
        response = F.col(columns["response"])
        parts.append(F.when(response.isNotNull(), message("assistant", response)))
    return F.array_compact(F.array(*parts))


def canonical_prompt(df: DataFrame, entry: Entry) -> DataFrame:
    """Prompt and response columns as ``messages``."""
    return df.withColumn("messages", prompt_messages(df, entry))


def _context(df: DataFrame, entry: Entry) -> Column:
    columns = _columns(entry)
    if "messages" in columns:
        return chat_messages(F.col(columns["messages"]), entry)
    return prompt_messages(df, entry, answer=False)


def canonical_pairs(df: DataFrame, entry: Entry) -> DataFrame:
    """Ranked pairs: the context as ``messages`` beside ``chosen`` and ``rejected``."""
    columns = _columns(entry)
    return (
        df.withColumn("messages", _context(df, entry))
        .withColumn("chosen", F.col(columns.get("chosen", "chosen")))
        .withColumn("rejected", F.col(columns.get("rejected", "rejected")))
    )


def pair_by_rank(good: DataFrame, poor: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """Every good row's id beside a poor one's of the same ``on``: ``(*on, chosen_id, rejected_id)``.

    The good row of rank r takes the poor row of rank r modulo the number of poor ones, so poor rows
    are used evenly; good rows without a poor one in their group have no pair. Ids must be unique
    within a group and side; null groups pair like others.
    """
    ranked = dense_ranks(good.select(*on, F.col(id_col).alias("chosen_id")), on, ["chosen_id"], "_rank")
    against = dense_ranks(poor.select(*on, F.col(id_col).alias("rejected_id")), on, ["rejected_id"], "_k", total="_size")
    sizes = against.groupBy(*on).agg(F.max("_size").alias("_size"))
    dealt = null_safe_join(ranked, sizes, on).withColumn("_k", F.col("_rank") % F.col("_size"))
    met = null_safe_join(dealt.drop("_size"), against.drop("_size"), [*on, "_k"])
    return met.select(*on, "chosen_id", "rejected_id")


def canonical_preference(df: DataFrame, entry: Entry) -> DataFrame:
    """Rows with a thumbs-up flag: ``messages`` and a boolean ``label``."""
    columns = _columns(entry)
    messages = _context(df, entry) if "messages" in columns else prompt_messages(df, entry)
    return df.withColumn("messages", messages).withColumn("label", F.col(columns["kto_tag"]).cast("boolean"))


def canonical_text(df: DataFrame, entry: Entry) -> DataFrame:
    """Plain-text corpora: one column, ``text``."""
    return df.select(F.col(_columns(entry)["prompt"]).alias("text"))


def with_history(df: DataFrame, entry: Entry) -> DataFrame:
    """Earlier question-and-answer pairs go before the prompt.

    Expects ``messages``; a system message stays first.
    """
    history = F.coalesce(F.col(_columns(entry)["history"]), F.array().cast("array<array<string>>"))
    turns = F.flatten(
        F.transform(history, lambda h: F.array(message("user", F.get(h, 0)), message("assistant", F.get(h, 1))))
    )
    of_system = lambda m: m["role"] == "system"
    head = F.filter("messages", of_system)
    body = F.filter("messages", lambda m: ~of_system(m))
    return df.withColumn("messages", F.concat(head, turns, body))


def with_side_columns(df: DataFrame, entry: Entry) -> DataFrame:
    """Tools and media under their canonical names."""
    columns = _columns(entry)
    carried = {name: F.col(columns[name]) for name in SIDE_COLUMNS if name in columns}
    return df.withColumns(carried) if carried else df


def canonical(df: DataFrame, entry: Entry) -> DataFrame:
    """The mapping that the entry asks for, with history and side columns."""
    columns = _columns(entry)
    if entry.get("ranking"):
        out = canonical_pairs(df, entry)
    elif "kto_tag" in columns:
        out = canonical_preference(df, entry)
    elif entry.get("formatting") == "sharegpt" or "messages" in columns:
        out = canonical_chat(df, entry)
    elif list(columns) == ["prompt"]:
        return canonical_text(df, entry)
    else:
        out = canonical_prompt(df, entry)
    if "history" in columns:
        out = with_history(out, entry)
    return with_side_columns(out, entry)


def previous_turns(df: DataFrame, key: str, turn: str, columns: list[str], back: int = 1) -> DataFrame:
    """Each turn beside the one ``back`` turns before it, by an equi-join on the turn number."""
    earlier = df.select(
        key, (F.col(turn) + back).alias(turn), *[F.col(c).alias(f"before_{c}") for c in columns]
    )
    return df.join(earlier, [key, turn])


def select_source(spark: SparkSession, root: str, entry: Entry) -> DataFrame:
    """A local parquet copy of the entry's source, narrowed to its folder, subset and split.

    Folder narrows the path; subset and split are partition columns, so other files are not read.
    """
    source = entry.get("hf_hub_url") or entry.get("ms_hub_url") or entry.get("file_name") or entry.get("script_url")
    path = "/".join([root.rstrip("/"), source] + ([entry["folder"]] if entry.get("folder") else []))
    df = spark.read.parquet(path)
    for name in ("subset", "split"):
        if entry.get(name):
            df = df.filter(F.col(name) == entry[name])
    return df
