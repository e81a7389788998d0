"""Quotation linking for conversations, with DataFrame functions only.

A line that begins with ``>`` marks, at any depth, is quoted; an attribution line right before a quotation (one that ends in
a colon after a word such as "wrote") belongs to it. Runs of quoted lines of equal depth are passages. A passage is
normalised (lower case, white space and marks collapsed) and hashed, and joined within its conversation to the original
messages: to the earliest message whose own words, as a whole, one of its paragraphs or one of its lines, are the passage, or
else one of the passage's paragraphs, or else one of its lines. Paragraphs are parted by blank lines, so that a paragraph
links however its lines are broken.
A message answers the latest message that its shallowest linked passages quote. Threads follow the answers to their roots by
pointer doubling, and conversations come out in reply order: sorted by conversation, thread and turn, each message without
its quotations.

Rows are handled one by one or by keys of conversation and text hash, of which only the least turn is used, so a
conversation that holds a third of all rows is never gathered in a task. Edge cases: null and empty texts have no lines of
their own; null conversations or turns are kept, unlinked; equal rows give equal rows; a message never answers a later one or
itself; quotations that match nothing are cut and counted, not linked; empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.linededup import bind
from voxframe.llm.scratch import stored

# Java repeats groups by recursion, so long runs would exhaust the stack of an executor: only single characters repeat here
MARKS = r"^[\x20\t>]*>[\x20\t]?"
PARAGRAPH = r"\n[\x20\t]*\n"
ATTRIBUTION = r"(?i)(?:wrote|writes|said|schrieb|escribió|écrit|a écrit)[\x20\t]*:[\x20\t]*$"


def _to_the_end(pattern: str) -> str:
    """pattern with its last $ for the very end, in Unicode case: alone, Java's also matches before a last line separator."""
    return pattern.replace("(?i)", "(?iu)").removesuffix("$") + r"\z"


def lines(text: Column) -> Column:
    """array of (depth, body, cited): depth 0 and cited false are the message's own lines."""
    parsed = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda line: bind(F.regexp_extract(line, MARKS, 0), lambda m: F.struct(F.length(F.regexp_replace(m, "[^>]", "")).alias("depth"), F.substring(line, F.length(m) + 1, F.length(line)).alias("body"))))
    return F.when(text.isNotNull(), bind(parsed, lambda a: F.transform(a, lambda x, k: F.struct(x.depth.alias("depth"), x.body.alias("body"), ((x.depth > 0) | (F.coalesce(F.get(a, k + 1).depth > 0, F.lit(False)) & x.body.rlike(_to_the_end(ATTRIBUTION)))).alias("cited")))))


def own_text(parsed: Column) -> Column:
    """The uncited lines; blank lines at both ends, and all but one of several in a row, go with the quotations."""

    def joined(body: Column) -> Column:
        def kept(blank: Column, end: Column) -> Column:
            parts = lambda x, k: F.when(~F.get(blank, k), x).when((k > 0) & (k < end) & ~F.get(blank, k - 1), F.when(F.get(blank, k + 1), F.lit("")).otherwise(x))
            some = F.array_join(F.filter(F.transform(body, parts), lambda x: x.isNotNull()), "\n")
            return F.when(F.exists(blank, lambda x: ~x), some).otherwise(F.coalesce(F.get(body, F.size(body) - 1), F.lit("")))

        last = lambda blank: F.size(blank) - F.array_position(F.reverse(blank), False)  # noqa: E731  place of the last line that is not blank
        return bind(F.transform(body, lambda x: F.translate(x, " \t", "") == ""), lambda blank: bind(last(blank), lambda end: kept(blank, end)))

    return F.when(parsed.isNotNull(), bind(F.transform(F.filter(parsed, lambda x: ~x.cited), lambda x: x.body), joined))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def digest(text: Column) -> Column:
    """128 bits of the normalised text; null where nothing is left."""
    return bind(normal(text), lambda t: F.when(t != "", F.md5(t)))


def units_of(text: Column) -> tuple[Column, Column, Column]:
    """What can be quoted of a text, or found of a quotation: the whole, its paragraphs, its lines."""
    return F.array(text), F.split(text, PARAGRAPH), F.split(text, "\n")


def passages(parsed: Column) -> Column:
    """array of (depth, body): runs of quoted lines of one depth, deeper lines within a run aside."""
    quoted = F.filter(F.transform(parsed, lambda x, k: F.struct(k.alias("k"), x.depth.alias("depth"), x.body.alias("body"))), lambda x: x.depth > 0)

    def runs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | F.coalesce((F.get(a, i - 1).depth != F.get(a, i).depth) | (F.get(a, i - 1).k + 1 != F.get(a, i).k), F.lit(True)))
        return bind(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i).depth.alias("depth"), F.array_join(F.transform(F.slice(a, i + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - i), lambda x: x.body), "\n").alias("body"))))

    return F.when(F.size(quoted) > 0, bind(quoted, runs))


def parsed(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> conv_id, turn, role, own, quotes: the own text and the quoted passages."""
    split = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines(F.col("text").cast("string")).alias("lines"))
    return split.select("conv_id", "turn", "role", F.coalesce(own_text(F.col("lines")), F.lit("")).alias("own"), passages(F.col("lines")).alias("quotes"))


def links(messages: DataFrame) -> DataFrame:
    """parsed() -> conv_id, turn, reply_to, n_linked of the messages whose quotations are found in earlier ones."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quoting = messages.where(known & F.col("quotes").isNotNull()).select("conv_id", "turn", F.posexplode("quotes").alias("q", "quote"))
    ranked = lambda rank, units: F.transform(units, lambda x: F.struct(F.lit(rank).alias("rank"), digest(x).alias("key")))
    keys = F.concat(*(ranked(rank, units) for rank, units in enumerate(units_of(F.col("quote.body")))))
    asked = quoting.select("conv_id", "turn", "q", F.col("quote.depth").alias("depth"), F.explode(keys).alias("x")).select("conv_id", "turn", "q", "depth", "x.rank", "x.key").where("key is not null")
    conversations = asked.select("conv_id").distinct()
    originals = messages.where(known).join(conversations, "conv_id", "left_semi")
    offered = originals.select("conv_id", F.col("turn").alias("origin"), F.explode(F.array_distinct(F.transform(F.concat(*units_of(F.col("own"))), digest))).alias("key")).where("key is not null")
    # of the many messages that may hold a text only the first counts, so the join has one row a quotation
    firsts = stored(offered.groupBy("conv_id", "key").agg(F.min("origin").alias("origin")), "quoting-originals")
    found = asked.join(firsts, ["conv_id", "key"]).where("origin < turn")
    each = found.groupBy("conv_id", "turn", "q", "depth").agg(F.min(F.struct("rank", (-F.col("origin")).alias("late"))).alias("best"))
    return each.groupBy("conv_id", "turn").agg((-F.min(F.struct("depth", "best.late")).getField("late")).alias("reply_to"), F.count("*").alias("n_linked"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to -> and thread (turn of the root) and depth (answers up to it), by pointer doubling."""
    up = stored(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "quoting-up")
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("root"), F.col("depth").alias("more"))
        step = stored(up.join(above, ["conv_id", "thread"], "left"), "quoting-up")
        if step.where("root is not null").isEmpty():
            break
        up = step.select("conv_id", "turn", F.coalesce("root", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return replies.join(up, ["conv_id", "turn"])


def linked(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) in reply order: conv_id, thread, turn, role, reply_to, depth, n_quotes, n_linked,
    text (own words) and chat (the turn as a template writes it)."""
    held = stored(parsed(messages), "quoting-messages")
    known = threads(stored(links(held), "quoting-links"))
    out = held.join(known, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce(F.size("quotes"), F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("chat"),
    )
    return out.repartitionByRange("conv_id", "thread", "turn", "text").sortWithinPartitions("conv_id", "thread", "turn", "text")
