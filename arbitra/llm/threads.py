"""Conversations without quotations, in the order of replies, by DataFrame operations alone.

* Lines that start with ``>`` marks are quoted, as deep as there are marks.
  Consecutive lines of one depth are a passage.
* Quoted passages of every depth, and their single lines, are normalised (marks off,
  lower case, white space as one blank) and hashed; so are the messages' own texts and
  lines. Both sides are reduced to one row per hash before they are joined, so text
  that many messages share doesn't multiply anything. A unit of a few characters
  counts only if it is a whole passage and a whole message of the same conversation.
* A message replies to the earliest message of its conversation that holds what it
  quotes on the shallowest level that is found, and belongs to the thread of that one;
  threads are found by pointer jumping along reply links, for quoting messages alone.
* Order: conversation, thread (the turn that starts it), turn. There are no groups to
  collect: a conversation of any length is just many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .session import materialize

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Units of fewer characters than this tell a message only as a whole, and only in its conversation.
SHORTEST = 8
WHOLE = "\u0001"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n\f\u000b]+", " ")))


def _hash(text: Column) -> Column:
    return F.sha2(_normal(text), 256)


def quoted_lines(messages: DataFrame) -> DataFrame:
    """The lines of messages that quote: ``conv_id, turn, same, pos, depth, line`` without marks."""
    lines = (
        messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
        .select("conv_id", "turn", "same", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .dropDuplicates(["conv_id", "turn", "same", "pos"])
    )
    marks = F.regexp_extract("raw", MARKS, 1)
    return lines.select(
        "conv_id", "turn", "same", "pos", F.length(F.translate(marks, " \t", "")).alias("depth"), F.regexp_replace("raw", MARKS, "").alias("line")
    )


def passages(lines: DataFrame) -> DataFrame:
    """Runs of lines of one depth: ``conv_id, turn, same, start, depth, passage``."""
    message = Window.partitionBy("conv_id", "turn", "same").orderBy("pos")
    run = F.sum(F.when(F.col("depth") == F.lag("depth").over(message), 0).otherwise(1)).over(message)
    return (
        lines.withColumn("run", run)
        .groupBy("conv_id", "turn", "same", "run", "depth")
        .agg(F.min("pos").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("passage"))
        .drop("run")
    )


def _units(texts: DataFrame, text: str) -> DataFrame:
    """The text and its lines as (hash, size), with all other columns; a short text is marked as a whole one."""
    others = [c for c in texts.columns if c != text]
    lines = F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: F.length(x) >= SHORTEST)
    whole = F.element_at(
        F.transform(F.array(_normal(F.col(text))), lambda x: F.when(F.length(x) >= SHORTEST, F.array(x)).when(F.length(x) > 0, F.array(F.concat(F.lit(WHOLE), x))).otherwise(F.array().cast("array<string>"))), 1
    )
    out = texts.select(*others, F.explode(F.array_union(whole, lines)).alias("unit"))
    return out.select(*others, F.sha2("unit", 256).alias("hash"), F.length("unit").alias("size"), F.col("unit").startswith(WHOLE).alias("short"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, body, thread, reply_to, source_conv, source_turn, n_quoted, n_linked, depth``.

    ``body`` is the text without quoted lines (a null text stays null), trimmed only
    if something was quoted. ``reply_to`` is the turn that the message quotes, of
    the same conversation and earlier; ``thread`` the first turn of the chain of
    replies, the message's own turn without a quotation that is found. A quotation
    found only in other conversations gives ``source_conv`` and ``source_turn`` (the
    least). ``n_quoted`` counts quoted passages, ``n_linked`` those of any depth
    whose text or a line of it is found, ``depth`` is the deepest level. Messages of
    one (conv_id, turn) are told apart by their text; repeated rows give repeated
    results, no rows none; other columns are ignored.
    """
    messages = conversations.select("conv_id", "turn", "role", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    lines = materialize(quoted_lines(messages), "quoted-lines")
    runs = materialize(passages(lines), "passages")
    own = runs.filter("depth = 0").groupBy("conv_id", "turn", "same").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "passage"))), lambda x: x["passage"]), "\n")).alias("own")
    )
    counts = runs.groupBy("conv_id", "turn", "same").agg(F.count_if(F.col("depth") > 0).alias("n_quoted"), F.max("depth").alias("depth"))
    # what is quoted, and where messages say it themselves
    quoted = materialize(_units(runs.filter("depth > 0").select("conv_id", "turn", "same", "start", "depth", "passage"), "passage"), "quoted-units")
    wanted = quoted.select("hash").distinct()
    said = messages.filter(~F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "text").unionByName(
        own.select("conv_id", "turn", F.col("own").alias("text"))
    )
    said = _units(said, "text").select("hash", "conv_id", "turn").join(wanted, "hash", "left_semi")
    here = materialize(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("at")), "originals")
    first = here.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("at").alias("turn"))).alias("first"))
    found = (
        quoted.join(here, ["hash", "conv_id"], "left")
        .join(first, "hash", "left")
        .withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at")))
        .withColumn("first", F.when((F.col("first.conv_id") != F.col("conv_id")) & ~F.col("short"), F.col("first")))
    )
    # of several found units, the shallowest, then the longest, then the earliest message
    linked = materialize(
        found.groupBy("conv_id", "turn", "same").agg(
            F.min(F.when(F.col("at").isNotNull(), F.struct("depth", (-F.col("size")).alias("size"), "at")))["at"].alias("reply_to"),
            F.min(F.when(F.col("first").isNotNull(), F.struct("depth", (-F.col("size")).alias("size"), "first")))["first"].alias("first"),
            F.count_distinct(F.when(F.col("at").isNotNull() | F.col("first").isNotNull(), F.col("start"))).alias("n_linked"),
        ),
        "linked",
    )
    # threads: from each reply along the links, twice as far each time
    up = materialize(linked.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("thread")), "threads")
    left = up.count()
    while left:
        step = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        up = materialize(
            up.join(step, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")),
            "threads",
        )
        left = up.filter("moved").count()
        up = up.drop("moved")
    key = ["conv_id", "turn", "same"]
    return (
        messages.join(counts, key, "left")
        .join(own, key, "left")
        .join(linked, key, "left")
        .join(up, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role",
            F.when(F.col("n_quoted") > 0, F.coalesce("own", F.lit(""))).otherwise(F.col("text")).alias("body"),
            F.coalesce("thread", "turn").alias("thread"),
            "reply_to",
            F.when(F.col("reply_to").isNull(), F.col("first.conv_id")).alias("source_conv"),
            F.when(F.col("reply_to").isNull(), F.col("first.turn")).alias("source_turn"),
            F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """The result of :func:`link_quotations` in the order of conversations, threads and turns."""
    return link_quotations(conversations).orderBy("conv_id", "thread", "turn")


def quoting(conversations: DataFrame) -> DataFrame:
    """Conversations in which every third message quotes the one before it, and every sixth also the one before that, a level deeper.

    A fixture for conversations without quotations: a conversation's messages are
    numbered, so that a quotation's source is one join away.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", (F.col("turn") - 1).alias("_b"), (F.col("turn") - 2).alias("_c"))
    of = lambda name, text: conversations.select("conv_id", F.col("turn").alias(name), F.col("text").alias(text))
    both = rows.join(of("_b", "b"), ["conv_id", "_b"], "left").join(of("_c", "c"), ["conv_id", "_c"], "left")
    mark = lambda c, m: F.concat(F.lit(m), F.replace(F.col(c), F.lit("\n"), F.lit(f"\n{m}")), F.lit("\n"))
    third = F.col("turn") % 3 == 2
    text = (
        F.when(third & (F.col("turn") % 6 == 5) & F.col("b").isNotNull() & F.col("c").isNotNull(), F.concat(mark("c", ">> "), mark("b", "> "), F.col("text")))
        .when(third & F.col("b").isNotNull(), F.concat(mark("b", "> "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return both.select("conv_id", "turn", "role", text.alias("text"))
