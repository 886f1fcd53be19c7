"""Quotation linking: chat messages freed of their quotes and ordered by what they reply to.

Only DataFrame functions.  The quote level of a line is the number of ``>`` before its text.  Lines of
one level without a blank line between them are a passage; passages and their single lines are normalised
(markers gone, white space folded, lower case) and hashed.  A quoted passage comes from the latest
earlier message of its conversation that holds the same passage as its own text.  A message
replies to the latest origin of its level-1 quotes; replies are followed to the message that replies to none,
which names the thread.  ``thread, depth, turn`` is the reply order of a conversation.

A conversation may hold a third of all messages: no step gathers it.  The origin is looked up in blocks of
``TURNS`` turns for each passage, with the blocks before summed up first, and replies are followed by doubling.

Defined results: a null text has a null body and no quotes.  A message of a null conversation or turn links
to nothing and has null thread and depth 0.  Messages that share a turn may be quoted each;
a thread follows the latest reply of a turn.  Repeated rows are all returned.  Surrounding columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.session import stored

TURNS = 1024
MARKS = r"^[ \t]*>[ \t>]*"


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is worked out once, also where lambdas read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``body`` (text without quoted lines) and ``passages`` (level and hash, each once)."""
    def line(text: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(text, MARKS, 0), "[^>]", ""))
        return F.struct(level.alias("level"), normalised(F.regexp_replace(text, MARKS, "")).alias("words"), text.alias("text"))

    df = held(messages, "lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line))
    at = lambda i: F.get("lines", i)
    opens = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (at(i)["words"] != "") & ((i == 0) | (at(i - 1)["words"] == "") | (at(i - 1)["level"] != at(i)["level"])))
    df = held(df, "opens", opens)

    def passage(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("opens", k + 1), F.size("lines"))
        words = F.transform(F.slice("lines", start + 1, after - start), lambda x: F.when(x["level"] == at(start)["level"], x["words"]))
        return F.struct(at(start)["level"].alias("level"), F.trim(F.array_join(words, " ")).alias("words"))

    whole = F.transform("opens", passage)
    single = F.transform(F.filter("lines", lambda x: x["words"] != ""), lambda x: F.struct(x["level"], x["words"]))
    hashed = F.transform(F.concat(whole, single), lambda x: F.struct(x["level"].alias("level"), F.md5(x["words"].cast("binary")).alias("hash")))
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return df.select(
        "conv_id", "turn", "role", F.when(F.col("text").isNotNull(), body).alias("body"), F.array_distinct(hashed).alias("passages"))


def origins(passages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, hash, origin)`` of each quoted passage; a null origin is unknown."""
    own = passages.filter("level = 0").select("conv_id", "hash", "turn").distinct()
    quoted = passages.filter("level > 0")
    both = (
        own.select("conv_id", "hash", "turn", F.col("turn").alias("source"), F.lit(0).alias("level"))
        .unionAll(quoted.select("conv_id", "hash", "turn", F.lit(None).cast("bigint").alias("source"), "level"))
        .join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
        .withColumn("block", F.floor(F.col("turn") / TURNS))
    )
    before = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("conv_id", "hash", "block").agg(F.max("source").alias("latest"))
        .select("conv_id", "hash", "block", F.max("latest").over(before).alias("carried"))
    )
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return (
        both.withColumn("near", F.max("source").over(inside)).join(carried, ["conv_id", "hash", "block"])
        .filter("level > 0").select("conv_id", "turn", "level", "hash", F.coalesce("near", "carried").alias("origin"))
    )


def threads(replies: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread, depth)`` of the turns that reply to another, by doubling the way up."""
    up = stored(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        over = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        if up.join(over, ["conv_id", "thread"], "left_semi").isEmpty():
            return up
        up = stored(up.join(over, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("further", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def reply_ordered(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row for each message: body, quotes and where it stands in the reply order of its conversation."""
    named = messages.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = parsed(named)
    rows = cut.select("conv_id", "turn", "passages").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    each = stored(rows.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash").distinct(),
                  "passages")
    linked = stored(origins(each), "origins")
    by_turn = stored(linked.groupBy("conv_id", "turn").agg(
        F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("reply_to")), "replies")
    placed = threads(by_turn.filter("reply_to IS NOT NULL"))
    found = by_turn.join(placed, ["conv_id", "turn"], "left")
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    return cut.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.size(quoted).cast("bigint").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("bigint").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to",
        F.when(F.col("conv_id").isNotNull(), F.coalesce("thread", "turn")).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))
