"""Quotation linking: conversations in reply order, without the quotes that linked them.

A line's quote level is the number of ``>`` at its start (blanks between them allowed). Consecutive lines
of one level form a passage. Passages are normalised (markers off, white space collapsed, lower-cased)
and hashed. Level-0 passages, and each of their lines, are what a message says itself; each quoted
passage, or its single lines where clients have cut it, is looked up among those of earlier turns of the
conversation, and goes to the latest that says it. The reply's parent is the message to which most of its
level-1 lines go (whole passages count each of their lines), then most of its deeper lines, which quote
what the parent itself quoted; of equals, the latest. A message without a linked quote answers the turn
before it, if that exists; otherwise it begins a thread.

All of it is DataFrame expressions, joins, windows and aggregates. The latest earlier turn that says a line
is found by stacking those who say it and those who quote it, in stretches of ``STRETCH`` turns of a
(conv_id, hash), and across stretches by their greatest turns: a line that n turns say and n turns quote
costs 2 n rows and no pairs, and neither it nor one huge conversation meets in a task. Threads are resolved
by pointer doubling, not by collecting a conversation.

Null texts are empty. Rows of one (conv_id, turn) with equal texts are one message (with the least role);
with different texts they are messages of their own, of which the one with the least hash stands for the
turn where the next turn answers it. Rows without conv_id or turn come back as threads of their own.
Attribution lines ("On ... wrote:") directly before a quote go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

STRETCH = 1024
_MARK = r"^[\x20\t]*>[>\x20\t]*"
_ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.+\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def _lines(text):
    """array<struct<level, body, said>> of a text's lines."""

    def of(line):
        mark = F.regexp_extract(line, _MARK, 0)
        return F.struct(F.length(F.translate(mark, " \t", "")).alias("level"), F.substr(line, F.length(mark) + 1).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), of)


def _normal(body):
    return F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """messages with ``reply`` (the text without quotes), ``quote_levels`` (the deepest level), ``passages``
    (array of level, first, hashes of the lines, hash of the whole), in order.
    """
    lines = messages.withColumn("_lines", _lines(F.col("text")))
    count = F.size("_lines")
    level = lambda i: F.coalesce(F.get("_lines", i)["level"], F.lit(-1))
    introduces = lambda x, i: (x["level"] == 0) & (level(i + 1) > 0) & x["body"].rlike(_ATTRIBUTION)
    marked = lines.withColumn("_lines", F.transform("_lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), introduces(x, i).alias("intro"))))
    starts = F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    marked = marked.withColumn("_starts", starts)

    def passage(begin, k):
        end = F.coalesce(F.get("_starts", k + 1), count)
        own = F.filter(F.slice("_lines", begin + 1, end - begin), lambda x: ~x["intro"])
        said = F.filter(F.transform(own, lambda x: _normal(x["body"])), lambda s: s != "")
        return F.struct(level(begin).alias("level"), begin.alias("first"), F.transform(said, lambda s: F.sha2(s, 256)).alias("lines"), F.sha2(F.array_join(said, " "), 256).alias("whole"))

    passages = F.filter(F.transform("_starts", passage), lambda p: F.size(p["lines"]) > 0)
    reply = F.array_join(F.transform(F.filter("_lines", lambda x: (x["level"] == 0) & ~x["intro"]), lambda x: x["body"]), "\n")
    return (
        marked.withColumn("passages", passages)
        .withColumn("reply", F.regexp_replace(reply, r"^\s+|\s+$", ""))
        .withColumn("quote_levels", F.array_max(F.transform("_lines", lambda x: x["level"])))
        .drop("_lines", "_starts")
    )


def _latest(said: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, hash, turn, origin): for each row of asked, the latest row (turn, mid) of said of an earlier turn."""
    line = ["conv_id", "hash"]
    part = F.floor(F.col("turn") / STRETCH).alias("part")
    own = F.struct("turn", "mid").alias("own")
    stacked = said.select(*line, "turn", part, own).unionByName(asked.select(*line, "turn", part, F.lit(None).alias("own")))
    earlier = Window.partitionBy(*line, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = stacked.withColumn("near", F.max("own").over(earlier)).filter("own is null").drop("own")
    before = Window.partitionBy(*line).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stacked.groupBy(*line, "part").agg(F.max("own").alias("top"))
    parts = parts.select(*line, "part", F.max("top").over(before).alias("far"))
    found = near.join(parts, [*line, "part"]).withColumn("origin", F.coalesce("near", "far"))
    return found.filter("origin is not null").select(*line, "turn", "origin")


def _parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, mid, origin, linked) of the messages that quote an earlier one."""
    keys = ["conv_id", "turn", "mid"]
    flat = parsed.select(*keys, F.explode("passages").alias("p"))
    quoted = flat.filter("p.level > 0").select(*keys, "p.level", "p.first", "p.lines", "p.whole")
    kept = [*keys, "first", (F.col("level") == 1).alias("direct")]
    whole = quoted.select(*kept, F.size("lines").alias("weight"), F.col("whole").alias("hash"))
    single = quoted.filter(F.size("lines") > 1).select(*kept, F.lit(1).alias("weight"), F.explode("lines").alias("hash"))
    votes = cut(whole.unionAll(single))
    asked = votes.select("conv_id", "hash", "turn").distinct()
    said = flat.filter("p.level = 0").select(*keys, F.explode(F.array_append(F.col("p.lines"), F.col("p.whole"))).alias("hash")).distinct()
    said = said.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    found = votes.join(_latest(said, asked), ["conv_id", "hash", "turn"])
    score = found.groupBy(*keys, "origin").agg(F.sum(F.when(F.col("direct"), F.col("weight")).otherwise(0)).alias("direct"), F.sum("weight").alias("all"), F.countDistinct("first").alias("linked"))
    best = score.groupBy(*keys).agg(F.max(F.struct("direct", "all", "origin", "linked")).alias("b"))
    return best.select(*keys, F.col("b.origin").alias("origin"), F.col("b.linked").cast("int").alias("linked"))


def link(messages: DataFrame) -> DataFrame:
    """Per message (conv_id, turn): role, parent_turn, thread_turn (where its thread begins), depth (replies
    up to there), n_quoted (passages), n_linked (to the parent), quote_levels and reply.
    Sorted by conv_id, thread_turn, turn, every message comes after the one it answers.
    """
    keys = ["conv_id", "turn", "mid"]
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    single = rows.filter(whole).groupBy("conv_id", "turn", "text").agg(F.min("role").alias("role")).withColumn("mid", F.xxhash64("text"))
    parsed = cut(parse(single))
    quotes = _parents(parsed)
    before = parsed.groupBy("conv_id", "turn").agg(F.min(F.struct("turn", "mid")).alias("previous")).withColumn("turn", F.col("turn") + 1)
    base = parsed.join(quotes, keys, "left").join(before, ["conv_id", "turn"], "left").withColumn("parent", F.coalesce("origin", "previous"))
    n_quoted = F.size(F.filter("passages", lambda p: p["level"] > 0))
    base = cut(base.select(*keys, "role", "parent", n_quoted.alias("n_quoted"), F.coalesce("linked", F.lit(0)).alias("n_linked"), "quote_levels", "reply"))

    # pointer doubling: after k rounds each message knows its ancestor 2**k replies up
    up = cut(base.select(*keys, F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"), F.coalesce("parent.turn", "turn").alias("top")))
    while up.filter("up is not null").limit(1).count():
        there = up.select("conv_id", F.struct("turn", "mid").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("top").alias("above"))
        done, going = up.filter("up is null"), up.filter("up is not null")
        moved = going.join(there, ["conv_id", "up"]).select(*keys, F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("above").alias("top"))
        up = cut(done.unionAll(moved))
    linked = base.join(up.select(*keys, F.col("top").alias("thread_turn"), F.col("steps").alias("depth")), keys)
    linked = linked.select("conv_id", "turn", "role", F.col("parent.turn").alias("parent_turn"), "thread_turn", "depth", "n_quoted", "n_linked", "quote_levels", "reply")
    alone = parse(rows.filter(~whole)).select(
        "conv_id",
        "turn",
        "role",
        F.lit(None).cast("long").alias("parent_turn"),
        F.col("turn").alias("thread_turn"),
        F.lit(0).alias("depth"),
        n_quoted.alias("n_quoted"),
        F.lit(0).alias("n_linked"),
        "quote_levels",
        "reply",
    )
    return linked.unionAll(alone)


def conversations(messages: DataFrame) -> DataFrame:
    """link()'s rows in reply order over the whole table, range-partitioned by conversation and thread."""
    return link(messages).orderBy("conv_id", "thread_turn", "turn")
