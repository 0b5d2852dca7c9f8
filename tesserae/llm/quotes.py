"""Quotation linking: quoted passages joined to the messages that they come from.

Each line's leading ">" marks give its quote level; lines of one level that
follow each other are a passage, and a message's own lines are its text. Both
are cut at blank lines into paragraphs and at ends of sentences into sentences,
normalised across line ends (lower case, runs of white space as one space) and
hashed: as a whole, by paragraph, by sentence and by line. So a passage that was
wrapped anew, or quoted in part, still meets its original. A hash is linked to
the earliest earlier message of its conversation that wrote it, else to the
first other conversation that did, if it is distinctive: of ``LONG`` words, or of
two words and ``FEW_CHARS`` characters that no more than ``FEW_CONVERSATIONS``
wrote ("Thanks" links to no stranger).

The parent of a message is the one that most words at its lowest linked level
come from; words at the next level count too where the candidate itself quotes
the message that they come from, so nested quotes decide between equal ones. A
conversation is then given as reply trees without quotes: trees by their first
message, and each message after what it answers. Attribution lines ("... wrote:")
before a quote go with it.

All in DataFrame functions. Originals are one row for each hash and conversation
before the join, so a line that everybody quotes matches once a row, never all
with all; roots of reply trees come by pointer doubling, which ends after
log(depth) rounds and needs none where nothing is linked. Positions come from a
sort by ranges, so a conversation with a third of all rows is many tasks' work.

Edge cases: null or empty text is a message without lines; a quote of an
unknown message keeps its text out but links nothing; a message never is its
own parent, nor is a later one of its conversation; equal (conv_id, turn) rows
each stay a message, and links go to the first of them; rows without conv_id or
turn link nothing, are nobody's parent and come out with null there; blank
quoted lines link nothing; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Stash

_MARK = r"^((?:[ \t]*>)+)[ \t]?(.*)$"
_ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.*\bwrote|.*\bschrieb.*|.*\ba écrit|.*\bescribió)\s*:\s*$"
_SENTENCE = r"(?<=[.!?])\s+"
MAX_ROUNDS = 40
LONG = 8
FEW_CHARS = 12
FEW_CONVERSATIONS = 3


def lines(df: DataFrame) -> DataFrame:
    """Adds ``ls``: the message's lines as (depth, body, attribution), whole text, in order."""
    one = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), r"[ \t]", "")).alias("depth"), F.when(x.rlike(_MARK), F.regexp_extract(x, _MARK, 2)).otherwise(x).alias("body"))
    split = F.when(F.length("text") > 0, F.split("text", r"\r\n|\r|\n", -1)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("raw", F.transform(split, one)).withColumn("ls", F.transform("raw", lambda x, i: F.struct(x["depth"].alias("depth"), x["body"].alias("body"), ((x["depth"] == 0) & x["body"].rlike(_ATTRIBUTION) & (F.get(F.col("raw"), i + 1)["depth"] > 0)).alias("attribution"))))


def _norm(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def units(text: Column) -> Column:
    """(h, words, chars) of a text as a whole and of its paragraphs, sentences and lines; each hash once, blank ones not at all."""
    paragraphs = F.transform(F.split(text, r"\n[ \t]*(?:\n[ \t]*)+", -1), _norm)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, _SENTENCE, -1)))
    parts = F.concat(F.array(_norm(text)), paragraphs, sentences, F.transform(F.split(text, r"\n", -1), _norm))
    kept = F.array_distinct(F.filter(parts, lambda x: F.length(x) > 0))
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ", -1)).alias("words"), F.length(x).alias("chars")))


def passages(ls: str = "ls") -> Column:
    """(depth, text) of each run of lines of one quote level."""
    x = F.col(ls)
    depth = lambda i: F.get(x, i)["depth"]
    places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (depth(i) > 0) & ((i == 0) | (depth(i) != depth(i - 1))))
    last = F.filter(places, lambda i: (depth(i) > 0) & ((i == F.size(x) - 1) | (depth(i) != depth(i + 1))))
    return F.zip_with(first, last, lambda a, b: F.struct(depth(a).alias("depth"), F.array_join(F.transform(F.slice(x, a + 1, b - a + 1), lambda q: q["body"]), "\n").alias("text")))


def link(df: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Messages without quotes, and links (conv_id, turn, depth) to (to_conv, to_turn) with the number of words in linked parts.

    Of ``df`` conv_id, turn, role and text are used.
    """
    src = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    parsed = lines(src)
    own = F.filter("ls", lambda x: (x["depth"] == 0) & ~F.coalesce(x["attribution"], F.lit(False)))
    body = F.array_join(F.transform(own, lambda x: x["body"]), "\n")
    messages = parsed.select("conv_id", "turn", "role", body.alias("body"), F.size(F.filter("ls", lambda x: x["depth"] > 0)).cast("long").alias("quoted_lines"), F.coalesce(F.array_max(F.transform("ls", lambda x: x["depth"])), F.lit(0)).cast("long").alias("quote_depth"), passages().alias("passages"))
    messages = stash.write(messages, "messages")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    said = messages.where(known & (F.size("passages") > 0)).select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.depth", F.explode(units(F.col("p.text"))).alias("u"))
    quoted = stash.write(said.groupBy("conv_id", "turn", "depth", "u.h").agg(F.max("u.words").alias("words"), F.max("u.chars").alias("chars")), "quoted")
    if quoted.isEmpty():
        return messages, messages.sparkSession.createDataFrame([], "conv_id long, turn long, depth int, to_conv long, to_turn long, words long")
    wanted = quoted.select("h").distinct()
    wrote = messages.where(known).select("conv_id", "turn", F.explode(units(F.col("body"))).alias("u")).select("conv_id", "turn", "u.h")
    wrote = stash.write(wrote.join(wanted, "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("here")), "wrote")
    first = wrote.groupBy("h").agg(F.min(F.struct("conv_id", "here")).alias("first"), F.count(F.lit(1)).alias("conversations"))
    found = stash.write(quoted.join(wrote, ["h", "conv_id"], "left").join(first, "h"), "found")
    inside = F.col("here").isNotNull() & (F.col("here") < F.col("turn"))
    distinctive = (F.col("words") >= LONG) | ((F.col("words") >= 2) & (F.col("chars") >= FEW_CHARS) & (F.col("conversations") <= FEW_CONVERSATIONS))
    # the first writer may be the quoting conversation itself, too late: then the first of the others
    own_first = found.where(~F.coalesce(inside, F.lit(False)) & distinctive & (F.col("first.conv_id") == F.col("conv_id")) & (F.col("conversations") > 1)).select("h", F.col("conv_id").alias("_conv")).distinct()
    others = wrote.join(own_first, "h").where(F.col("conv_id") != F.col("_conv")).groupBy("h", F.col("_conv").alias("conv_id")).agg(F.min(F.struct("conv_id", "here")).alias("second"))
    found = found.join(others, ["h", "conv_id"], "left")
    out = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    to = F.when(inside, F.struct("conv_id", "here")).when(distinctive, out)
    links = found.select("conv_id", "turn", "depth", to.alias("to"), "words").where("to is not null")
    links = links.groupBy("conv_id", "turn", "depth", F.col("to.conv_id").alias("to_conv"), F.col("to.here").alias("to_turn")).agg(F.sum("words").alias("words"))
    return messages, stash.write(links, "links")


def parents(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv and parent_turn of every message that quotes a known one."""
    lowest = links.groupBy("conv_id", "turn").agg(F.min("depth").alias("low"))
    near = links.join(lowest, ["conv_id", "turn"]).where(F.col("depth") == F.col("low"))
    deeper = links.join(lowest, ["conv_id", "turn"]).where(F.col("depth") == F.col("low") + 1).select("conv_id", "turn", F.col("to_conv").alias("o_conv"), F.col("to_turn").alias("o_turn"), F.col("words").alias("deep"))
    quotes_it = links.where("depth = 1").select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("o_conv"), F.col("to_turn").alias("o_turn")).distinct()
    both = near.join(deeper, ["conv_id", "turn"]).join(quotes_it, ["to_conv", "to_turn", "o_conv", "o_turn"]).groupBy("conv_id", "turn", "to_conv", "to_turn").agg(F.sum("deep").alias("more"))
    scored = near.join(both, ["conv_id", "turn", "to_conv", "to_turn"], "left").withColumn("words", F.col("words") + F.coalesce("more", F.lit(0)))
    best = F.max_by(F.struct("to_conv", "to_turn"), F.struct("words", F.col("to_conv") == F.col("conv_id"), "to_turn", -F.col("to_conv")))
    return scored.groupBy("conv_id", "turn").agg(best.alias("p")).select("conv_id", "turn", F.col("p.to_conv").alias("parent_conv"), F.col("p.to_turn").alias("parent_turn"))


def _positions(df: DataFrame, order: list[str], stash: Stash) -> DataFrame:
    """``df`` with ``position`` (from 0) of each row in its conversation, by ``order``: ranges are sorted side by side, and a conversation that spans several goes on from what comes before."""
    placed = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    placed = stash.write(placed, "placed")
    counts = placed.groupBy("conv_id", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = counts.select(F.col("conv_id").alias("_c"), F.col("_p").alias("_q"), (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_start"))
    return placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q"))).withColumn("position", (F.col("_m") - F.col("_start")).cast("long")).drop("_p", "_m", "_c", "_q", "_start")


def conversations(df: DataFrame) -> DataFrame:
    """One row per message: its text without quotes, its parent and its place in the reply order.

    Columns: conv_id, turn, role, text, quoted_lines, quote_depth, parent_conv,
    parent_turn (null if nothing is quoted), root_turn, position (from 0).
    """
    stash = Stash(df.sparkSession)
    messages, links = link(df, stash)
    up_to = stash.write(parents(links), "parents")
    roots = up_to.where(F.col("parent_conv") == F.col("conv_id")).select("conv_id", "turn", F.col("parent_turn").alias("root_turn"))
    if not roots.isEmpty():
        roots = stash.write(roots, "roots")
        for _ in range(MAX_ROUNDS):  # doubles the reach each time: 2^40 replies deep at least
            up = roots.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"))
            new = stash.write(roots.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), F.col("higher").isNotNull().alias("moved")), "roots")
            more = not new.where("moved").isEmpty()
            stash.drop(roots)
            roots = new.drop("moved")
            roots.stash_path = new.stash_path
            if not more:
                break
    out = messages.drop("passages").join(up_to, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn"))
    out = _positions(out, ["root_turn", "turn", "body", "role"], stash)
    return out.select("conv_id", "turn", "role", F.col("body").alias("text"), "quoted_lines", "quote_depth", "parent_conv", "parent_turn", "root_turn", "position")
