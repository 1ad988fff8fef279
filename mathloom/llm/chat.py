"""Conversations as training windows under a token budget, with loss masks.

Prefix sums of turn tokens place each turn on its conversation's axis, which is cut at every
``STRETCH`` turn numbers and there into cells as long as the room for new turns: the budget less the
history and less the system turn. The turns that
begin in a cell and end within that room after its first one are a window; of a cell at most the last
turn does not, and it is a window of its own. So windows are turn-aligned spans, no turn is cut and
no window waits for the one before. A window opens with the conversation's system turn and the last
turns before it that fit in ``history`` tokens, however many windows back they lie; these are
repeats, and their assistant texts are outside the loss mask, so that each target is learnt once.
Only a turn that is itself longer than the room stands alone, without system turn and history, and
only such a window can be above the budget. A system turn that takes more than half of what the
history leaves is a turn like others and not repeated.

Template: ``<|im_start|>`` role, newline, text, ``<|im_end|>`` newline. In roles and texts every
``<|`` becomes ``<||``, and in roles a newline becomes ``<|n``, so no control string remains; both
are undone by the reverse replacement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut_lineage
from .common import WORD

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 256, 64  # tokens of a window, and of them at most for repeated turns
OVERHEAD = 4  # tokens of the template around a turn
# Turns of a conversation whose prefix sums one task takes at a time.
STRETCH = 4_096


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<|n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<|n"), F.lit("\n")))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the tokens before each turn and the tokens of the system turn that opens the conversation (0: none).

    A conversation is summed by stretches, so no task takes a whole one. Texts move once, to their
    stretch; of all else that follows only a row for each stretch moves.
    """
    own = Window.partitionBy("conv", "_s")
    order = own.orderBy("turn", "role", "text")
    rows = rows.withColumn("_in", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_pos", F.row_number().over(order))
    opens = F.when((F.col("_pos") == 1) & (F.col("role") == "system"), F.col("tokens"))
    sums = rows.groupBy("conv", "_s").agg(F.sum("tokens").alias("_sum"), F.max(opens).alias("_opens"))
    by_stretch = Window.partitionBy("conv").orderBy("_s")
    before = F.coalesce(F.sum("_sum").over(by_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    system = F.coalesce(F.first("_opens").over(by_stretch), F.lit(0))
    after = F.lead("_s").over(by_stretch).alias("_next")
    sums = sums.select("conv", "_s", before.alias("_before"), system.alias("system"), after)
    # a merge join keeps the texts where they are: both sides are dealt by conversation and stretch
    return rows.join(sums.hint("merge"), ["conv", "_s"]).withColumn("begin", F.col("_before") + F.col("_in"))


def windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: ``conv, window, formatted, n_repeated, loss`` (spans in code points).

    ``n_repeated`` turns at the start of ``formatted`` are repeats. Windows sort by ``window``. Null
    roles and texts are empty; null turns come first; equal turn numbers are ordered by role and text,
    and repeated rows are turns of their own; a null conversation is one conversation. An empty table
    gives no rows; other columns are not read.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    # as fields of a row, null conversations and stretches are equal to each other
    stretch = F.struct(F.floor(F.col("turn") / STRETCH).alias("s"))
    rows = turns.select(
        F.struct(turns[conv].alias("c")).alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"),
        F.coalesce(turns[text], F.lit("")).alias("text"),
    )
    rows = rows.withColumn("_s", stretch).withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + OVERHEAD)
    retains = (F.col("system") > 0) & (2 * F.col("system") <= budget - history)
    placed = _placed(rows).withColumn("retains", retains)
    placed = placed.withColumn("room", budget - history - F.when(F.col("retains"), F.col("system")).otherwise(F.lit(0)))
    # cells of a stretch, of which each holds no more turns than its room holds template tokens
    placed = placed.withColumn("cell", F.floor(F.col("_in") / F.col("room")))
    in_cell = Window.partitionBy("conv", "_s", "cell")
    placed = placed.withColumn("first", F.min("begin").over(in_cell))
    crosses = F.col("begin") + F.col("tokens") - F.col("first") > F.col("room")
    window = F.struct("_s", (2 * F.col("cell") + crosses.cast("int")).alias("n"))
    placed = placed.withColumn("window", window)
    # each window by its first turn; one that stands alone has no repeats, the conversation's first neither
    starts = (crosses | (F.col("begin") == F.col("first"))) & (F.col("begin") > 0) & (F.col("tokens") <= F.col("room"))
    is_system = F.col("retains") & (F.col("begin") == 0)
    placed = placed.withColumns({"starts": starts, "is_system": is_system, "end": F.col("begin") + F.col("tokens")})

    own = Window.partitionBy("conv", "_s").orderBy("begin")
    place = F.struct("turn", "_s", "_pos")
    said = F.struct(place.alias("place"), "role", "text")
    piece = lambda part, window, what: F.struct(
        F.lit(part).alias("part"), window.alias("window"), *[what[c].alias(c) for c in ("place", "role", "text")]
    )
    # a turn is repeated in the windows that start after its end and within the history
    near = F.collect_list(F.when(F.col("starts"), F.struct(F.col("begin").alias("at"), "window"))).over(own.rangeBetween(1, max(1, history)))
    told = F.filter("_near", lambda w: (w["at"] >= F.col("end")) & (w["at"] - F.col("begin") <= history))
    may = ~F.col("is_system") & (F.col("tokens") <= history)
    repeats = F.transform(F.when(may, told).otherwise(F.array()), lambda w: piece(1, w["window"], F.col("_said")))
    # the system turn is told to every later window of its stretch
    system = F.first(F.when(F.col("is_system"), F.col("_said"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    retained = F.when(F.col("starts") & F.col("_system").isNotNull(), F.array(piece(0, F.col("window"), F.col("_system")))).otherwise(F.array())
    here = placed.withColumn("_said", said).withColumns({"_near": near, "_system": system})
    every = F.concat(F.array(piece(2, F.col("window"), F.col("_said"))), repeats, retained)
    pieces = here.select("conv", "_s", F.explode(every).alias("p")).select("conv", "_s", "p.*")
    if placed.filter("_next is not null").limit(1).count():
        pieces = pieces.unionByName(_from_earlier(placed, history, said, piece))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = pieces.select(
        "conv",
        "_s",
        "window",
        F.struct(
            "part",
            "place",
            head.alias("head"),
            escape(F.col("text")).alias("body"),
            ((F.col("part") == 2) & (F.col("role") == "assistant")).alias("learn"),
        ).alias("piece"),
    )
    # a window holds a budget of tokens: the group is bounded, and it lies in one stretch
    gathered = pieces.groupBy("conv", "_s", "window").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    whole = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + len(END)).cast("long").alias("at"),
            F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return gathered.select(
        F.col("conv.c").alias(conv),
        "window",
        whole.alias("formatted"),
        F.size(F.filter("p", lambda p: p["part"] < 2)).alias("n_repeated"),
        F.aggregate("p", first, step)["spans"].alias("loss"),
    )


def _from_earlier(placed: DataFrame, history: int, said: Column, piece) -> DataFrame:
    """What windows repeat from earlier stretches: turns from the end of one, and the system turn.

    Only conversations of more than one stretch have any; a stretch's end is met by its next one.
    """
    rows = placed.withColumn("_said", said)
    starts = placed.filter("starts").select("conv", "_s", "window", "retains", F.col("begin").alias("at"), "_before")
    last = rows.filter("not is_system and _next is not null").filter(F.col("tokens") <= history)
    last = last.select("conv", F.col("_next").alias("_s"), "begin", "end", "_said")
    # a stretch shorter than the history is passed on to the one after the next, and so on
    parts, follow = [], placed.groupBy("conv", "_s").agg(F.max("_next").alias("_then"), F.max("_before").alias("_from"))
    first = starts.filter(F.col("at") - F.col("_before") <= history)
    while True:
        last = last.join(follow, ["conv", "_s"]).filter(F.col("_from") - F.col("begin") <= history)
        last = cut_lineage(last)
        if last.isEmpty():
            break
        met = first.join(last.drop("_then", "_from"), ["conv", "_s"]).filter((F.col("at") >= F.col("end")) & (F.col("at") - F.col("begin") <= history))
        parts.append(met.select("conv", "_s", piece(1, F.col("window"), F.col("_said")).alias("p")))
        last = last.filter("_then is not null").select("conv", F.col("_then").alias("_s"), "begin", "end", "_said")
    system = rows.filter("is_system").select("conv", F.col("_s").alias("_own"), "_said")
    later = starts.filter("retains").join(system, "conv").filter("_s <> _own")
    parts.append(later.select("conv", "_s", piece(0, F.col("window"), F.col("_said")).alias("p")))
    return reduce(DataFrame.unionByName, parts).select("conv", "_s", "p.*")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What windows say, per conversation: turns once and in order, loss text, characters."""

    def turns_of(parts: Column) -> Column:
        def one(piece: Column) -> Column:
            cut = F.position(F.lit("\n"), piece)
            role = F.substr(piece, F.lit(len(START) + 1), cut - len(START) - 1)
            return F.concat(unescape_role(role), F.lit("\n"), unescape(F.substr(piece, cut + 1)), F.lit("\n"))

        return F.transform(parts, one)

    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    fresh = let(pieces, lambda p: F.slice(p, F.col("n_repeated") + 1, F.size(p) - 1 - F.col("n_repeated")))
    targets = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    rows = formatted.select(
        conv,
        F.length("formatted").cast("long").alias("chars"),
        F.size(fresh).cast("long").alias("n"),
        F.struct("window", F.array_join(turns_of(fresh), "").alias("turns"), F.array_join(targets, "").alias("loss")).alias("w"),
    )
    # the digest of a conversation needs its whole text in one row
    gathered = rows.groupBy(conv).agg(
        F.sum("chars").alias("formatted_chars"), F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w")
    )
    turns, loss = (F.array_join(F.transform("w", lambda w: w[name]), "") for name in ("turns", "loss"))
    return gathered.select(
        conv,
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
