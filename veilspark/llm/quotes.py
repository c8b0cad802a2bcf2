"""Conversations without quotes: quoted passages are linked to the messages they come from.

Each message's lines are told apart by their level (how many `>` they begin with). Lines of one level in a row are a
passage. Normalised passages and their lines, of any length, are hashed and joined, inside their conversation, to the hashed own
passages and lines of earlier messages; those are aggregated to their first holder before the join. A message replies to
the latest message that its outermost quotes come from. Threads are found by doubling pointers to what is replied to.

DataFrame functions only. Nothing is gathered by conversation, so one that holds a third of all rows is like the others.

Defined cases: a null or empty text has no lines and an empty own text; a message without a linked quote begins a thread;
a quote without an earlier origin stays out of the own text but links nothing; rows with a null conv_id or turn aren't
linked; repeated rows are linked alike. A reply path is as long as its message is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable

MARK = r"^((?:[ \t]*>)*)[ \t]?(.*)$"


def lines(text: Column) -> Column:
    """The lines of a text: level and body."""
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"), F.regexp_extract(x, MARK, 2).alias("body")))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_passages(rows: DataFrame) -> DataFrame:
    """`rows` (lines) with `passages`: runs of lines of one level (level, body); blank lines end a run. Linear in the lines."""
    at = lambda i: F.get("lines", i)
    blank = lambda x: F.trim(x["body"]) == ""
    begins = lambda x, i: ~blank(x) & F.coalesce(blank(at(i - 1)) | (at(i - 1)["level"] != x["level"]), F.lit(True))
    begin = F.filter(F.transform("lines", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("begin", begin)

    def run(i: Column, r: Column) -> Column:
        upto = F.coalesce(F.get("begin", r + 1), F.size("lines"))
        body = F.transform(F.filter(F.slice("lines", i + 1, upto - i), lambda x: ~blank(x)), lambda x: x["body"])
        return F.struct(at(i)["level"].alias("level"), F.array_join(body, "\n").alias("body"))

    return rows.withColumn("passages", F.transform("begin", run)).drop("begin")


def linked(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """A row for each message (conv_id, turn, role, text): conv_id, turn, role, own (its text without quotes), n_quotes,
    n_linked, reply_to, thread (the turn that its thread begins with), depth, reply_path (the turns from there to it)."""
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("lines", lines(F.coalesce("text", F.lit(""))))
    rows = with_passages(rows)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    base = rows.select("conv_id", "turn", "role", F.trim(own).alias("own"), F.size(quoted).cast("long").alias("n_quotes"), "lines", "passages")

    def bits(level: Column) -> DataFrame:
        keep = lambda p: level(p["level"])
        both = F.concat(F.filter("passages", keep), F.filter("lines", keep))
        # the outer form, since for the other one the optimizer adds a filter that computes the array again
        got = base.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode_outer(both).alias("x"))
        got = got.select("conv_id", "turn", F.col("x.level").alias("level"), F.trim("x.body").alias("body"), normal(F.col("x.body")).alias("text"))
        got = got.withColumn("text", F.when(F.col("text") == "", F.col("body")).otherwise(F.col("text")))  # signs only
        return got.where("text <> ''").select("conv_id", "turn", "level", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))

    origin = durable(bits(lambda v: v == 0).groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("origin")))
    quotes = bits(lambda v: v > 0)
    found = quotes.join(origin, ["conv_id", "h1", "h2"]).where("origin < turn").groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("reply_to"), F.countDistinct("level", "h1", "h2").alias("n_linked"))
    found = durable(found)
    up = durable(found.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.array(F.col("turn")).alias("path")))
    for _ in range(rounds):  # each doubles the length of what a pointer skips
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("far"), F.col("path").alias("before"))
        new = up.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        new = durable(new.select("conv_id", "turn", F.coalesce("far", "thread").alias("thread"), F.concat(F.coalesce("before", F.slice("path", 1, 0)), "path").alias("path"), F.col("far").isNotNull().alias("moved")))
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"replies were left after {rounds} rounds")
    links = durable(found.join(up, ["conv_id", "turn"]).select("conv_id", "turn", "reply_to", "n_linked", "thread", F.size("path").cast("long").alias("depth"), F.concat(F.array("thread"), "path").alias("reply_path")).dropDuplicates(["conv_id", "turn"]))
    out = base.drop("lines", "passages").join(links, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "own", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("reply_path", F.array("turn")).alias("reply_path"))


def conversations(messages: DataFrame) -> DataFrame:
    """The messages of `linked`, without their quotes, in reply order: each reply stands below what it answers, before later
    replies to the same message. The order is one range sort, so a conversation may span many tasks."""
    return linked(messages).select("conv_id", "turn", "role", "own", "reply_to", "depth", "reply_path").orderBy("conv_id", "reply_path")
