"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with ``>`` are quoted, as deep as they have signs. Runs of lines of one depth are passages. Lines and
passages are normalised (case, punctuation and white space), hashed and joined to the messages of the same
conversation that said them first-hand in an earlier turn. A message answers the turn it quotes most of, the latest of
equals; messages that answer each other are a thread.

The join is one ordered pass over (conversation, hash): the last turn before the quote that said it, so a line that many
said and many quote makes no pairs. Only units that are quoted somewhere take part. Threads come from the links by
components, so a conversation of any length is never gathered in one place: rows ordered by (conv_id, thread, turn) are
the conversation in reply order.

Defined cases: repeated equal rows are one message; a null text is empty; messages with a null conversation or turn are
kept, without links; of messages that share conversation and turn each is kept and either can be quoted; a passage that
nobody said before stays unlinked and is removed all the same; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import settled
from trailmark.llm.components import components

QUOTED = r"^\s*>[>\s]*"


def normalised(text) -> F.Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """(message, conv_id, turn, at, depth, line) of every line."""
    out = messages.select("message", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    mark = F.regexp_extract("raw", f"({QUOTED})", 1)
    depth = F.length(F.regexp_replace(mark, "[^>]", ""))
    return out.select("message", "conv_id", "turn", "at", depth.alias("depth"), F.regexp_replace("raw", QUOTED, "").alias("line"))


def passages(lines: DataFrame) -> DataFrame:
    """(message, conv_id, turn, depth, at, unit): each passage as one text."""
    run = F.col("at") - F.row_number().over(Window.partitionBy("message", "depth").orderBy("at"))
    keyed = lines.withColumn("run", run)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return keyed.groupBy("message", "conv_id", "turn", "depth", "run").agg(F.min("at").alias("at"), F.array_join(whole, " ").alias("unit"))


def units(lines: DataFrame) -> DataFrame:
    """(message, conv_id, turn, depth, h, size): lines and passages, normalised and hashed."""
    single = lines.select("message", "conv_id", "turn", "depth", F.col("line").alias("unit"))
    both = single.unionByName(passages(lines).select("message", "conv_id", "turn", "depth", "unit"))
    both = both.withColumn("n", normalised(F.col("unit"))).filter("n <> '' and conv_id is not null and turn is not null")
    return both.select("message", "conv_id", "turn", "depth", F.xxhash64("n").alias("h"), F.length("n").alias("size")).distinct()


def link(messages: DataFrame) -> DataFrame:
    """(message, conv_id, turn, depth, origin_turn, size): what each message quotes, by depth and turn quoted."""
    found = settled(units(lines_of(messages)))
    quoted = found.filter("depth > 0")
    asked = quoted.select("conv_id", "h").distinct()
    said = found.filter("depth = 0").join(asked, ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn").distinct()
    line = said.withColumn("origin", F.col("turn")).unionByName(quoted, allowMissingColumns=True)
    # of one turn, what is said comes after what is quoted: a message never quotes its own turn
    w = Window.partitionBy("conv_id", "h").orderBy("turn", F.col("origin").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = line.withColumn("origin_turn", F.last("origin", ignorenulls=True).over(w)).filter("origin is null and origin_turn is not null")
    return met.groupBy("message", "conv_id", "turn", "depth", "origin_turn").agg(F.sum("size").alias("size"))


def conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per message: its text without quotes, the turn it answers, its thread and what it quoted."""
    messages = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    messages = messages.withColumn("message", F.xxhash64("conv_id", "turn", "role", "text"))
    mine = messages.filter(F.col("text").contains(">"))  # only their quotes need parsing; any message may be quoted
    chats = mine.select("conv_id").distinct()
    linked = settled(link(messages.join(chats, "conv_id", "left_semi")))
    best = linked.groupBy("message", "conv_id", "turn").agg(
        F.max(F.struct((-F.col("depth")).alias("near"), "size", "origin_turn")).alias("b"), F.count(F.lit(1)).alias("linked"),
    ).select("message", "conv_id", "turn", F.col("b.origin_turn").alias("answers"), "linked")
    # a turn as one number for the components: equal turns of a conversation are one node, ordered by turn
    node = lambda t: F.struct("conv_id", F.col(t).alias("turn"))
    roots = components(best.select(node("turn").alias("a"), node("answers").alias("b")))
    roots = roots.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.turn").alias("thread"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(QUOTED))
    out = messages.withColumn("clean", F.btrim(F.array_join(kept, "\n"))).withColumn("quoted_lines", F.size(F.split("text", "\n")) - F.size(kept))
    out = out.join(best.select("message", "answers", "linked"), "message", "left").join(roots, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("clean").alias("text"), F.col("answers").alias("answers_turn"),
        F.coalesce("thread", "turn").alias("thread"), F.col("quoted_lines").cast("long").alias("quoted_lines"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked_passages"),
    )
