"""Chat formatting by quotation linking.

A message's lines have a quote level: the number of `>` marks that they begin with. Lines of level 0 are the message's
own; each quoted line, normalised (marks and outer white space gone, inner white space as one space, lower case), is a
passage with a hash. A passage's original is the first message of the conversation that has it as a line of its own.
The parent of a message is the earlier message with most originals of its passages of one level, the latest if several
have as many; the shallowest level that has an original decides, so that deeper levels are the fallback. Parents give
each message its root and depth by pointer jumping, and conversations are put in reply order: root, depth, turn, with
the quotes taken out.

Defined results: a null text is empty; a message without quotes, or whose quotes have no earlier original, is a root;
a quote never links to its own or a later turn; rows without conv_id or turn are roots of their own with a null order;
rows that repeat (conv_id, turn) are all kept and share parents found by either; very long texts are parsed whole; an
empty table gives an empty table. Other columns stay; added columns replace those of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cascade import let
from .store import Tables

#: What a quoted line begins with: blanks, a mark, then marks and blanks of which no two stand side by side. Each step of
#: the loop takes one character for good, so that a line of any length is read in one go.
MARKS = r"^[ \t]*+>(?:[> \t](?<![ \t]{2}))*+"
#: White space that is cut from both ends of an own text.
BLANKS = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def passages(text: Column) -> Column:
    """Structs of level and hash (16 bytes) of the normalised text of each line that isn't blank."""

    def of(line: Column) -> Column:
        marks = F.when(F.contains(line, F.lit(">")), F.regexp_extract(line, MARKS, 0)).otherwise(F.lit(""))
        return let(marks, lambda m: let(normal(F.substring(line, F.length(m) + F.lit(1), F.length(line))), lambda x: F.struct(F.length(F.translate(m, " \t", "")).alias("level"), F.when(F.length(x) > 0, F.unhex(F.md5(x))).alias("passage"))))

    return F.filter(F.transform(split_lines(text), of), lambda x: x["passage"].isNotNull())


def normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The lines that aren't quoted, without outer blank lines."""
    joined = F.array_join(F.filter(split_lines(text), lambda x: ~F.rlike(x, F.lit(MARKS))), "\n")
    return F.btrim(joined, F.lit(BLANKS))


def parents(found: DataFrame) -> DataFrame:
    """conv_id, turn and parent of messages that quote. found: conv_id, turn, level, passage."""
    originals = found.filter("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("original"))
    quoted = found.filter("level > 0").select("conv_id", "turn", "level", "passage").distinct()
    votes = quoted.join(originals, ["conv_id", "passage"]).filter("original < turn").groupBy("conv_id", "turn", "level", "original").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct((-F.col("level")).alias("near"), "n", "original")).alias("parent"))


def rooted(nodes: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, turn, parent, root, depth by pointer jumping: the rounds are the logarithm of the deepest reply. Rows go on
    only until their pointer is at a root; each round's table goes when the next is written."""
    pointer = F.coalesce("parent", "turn")
    state = nodes.select("conv_id", "turn", "parent", pointer.alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("ended"))
    state = tables.written(state, "roots")
    ended, moving = [state.filter("ended")], state.filter("not ended")
    while not moving.isEmpty():
        all_ = reduce(DataFrame.union, [*ended, moving])
        up = all_.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("ended").alias("up_ended"))
        jumped = moving.drop("ended").join(up, ["conv_id", "root"])
        state = tables.written(jumped.select("conv_id", "turn", "parent", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("up_ended").alias("ended")), "roots")
        ended, moving = [*ended, state.filter("ended")], state.filter("not ended")
    return reduce(DataFrame.union, ended).drop("ended")


def linked(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Adds own_text, parent_turn, root_turn and reply_depth, in reply order."""
    tables = Tables(messages.sparkSession)
    keyed = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text")).filter("conv_id is not null and turn is not null")
    found = tables.written(keyed.select("conv_id", "turn", F.inline(passages(F.col("text")))), "passages")
    tree = rooted(keyed.select("conv_id", "turn").distinct().join(parents(found), ["conv_id", "turn"], "left"), tables)
    tables.drop(found)
    tree = tree.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), F.col("depth").alias("reply_depth"))
    added = ("own_text", "parent_turn", "root_turn", "reply_depth")
    # own_text is made before the shuffles, so that the whole text moves only if it is asked for
    kept = messages.select(*(c for c in messages.columns if c not in added), own_text(F.col(text)).alias("own_text"))
    out = kept.join(tree, (kept[conversation] == tree["__conv"]) & (kept[turn] == tree["__turn"]), "left").drop("__conv", "__turn")
    return out.repartitionByRange(conversation, "root_turn", "reply_depth", turn).sortWithinPartitions(conversation, "root_turn", "reply_depth", turn)


def replies(conversations: DataFrame) -> DataFrame:
    """Turns as replies that quote what they answer: turn t answers t - 1, or t - 2 where conv_id + t is a multiple of 3.
    The answered turn is quoted at level 1 and what that answered at level 2."""
    said = conversations.select("conv_id", "turn", "role", "text").withColumn("answers", F.when(F.col("turn") > 0, F.col("turn") - F.when(((F.col("conv_id") + F.col("turn")) % 3 == 0) & (F.col("turn") > 1), 2).otherwise(1)))
    first = said.select("conv_id", F.col("turn").alias("answers"), F.col("text").alias("first"), F.col("answers").alias("before"))
    second = said.select("conv_id", F.col("turn").alias("before"), F.col("text").alias("second"))
    joined = said.join(first, ["conv_id", "answers"], "left").join(second, ["conv_id", "before"], "left")
    quote = lambda c, mark: F.when(F.col(c).isNotNull(), F.concat(F.regexp_replace(c, r"(?m)^", mark), F.lit("\n"))).otherwise(F.lit(""))
    return joined.select("conv_id", "turn", "role", F.concat(quote("second", "> > "), quote("first", "> "), F.coalesce("text", F.lit(""))).alias("text"))
