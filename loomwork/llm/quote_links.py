"""Conversations from messages that quote each other, with DataFrame functions only.

Lines that begin with ``>`` are quoted, once for each ``>``. The quoted text of a level
is normalised and hashed, and joined to the message that has it as its own text; links
then lead to the first message of each conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import SPACE, written

MARKS = r"^(?:> ?)+"


def level_text(body: Column, level: int) -> Column:
    """The lines of one quote level without their marks, joined by line ends; null where a level above 0 has no line."""
    of = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.replace(F.regexp_extract(x, MARKS, 0), F.lit(" "), F.lit(""))) == level)
    return F.when((F.size(of) > 0) | (F.lit(level) == 0), F.array_join(F.transform(of, lambda x: F.regexp_replace(x, MARKS, "")), "\n"))


def passage_hash(text: Column) -> Column:
    """128 bits of a passage with white space as single spaces and in lower case, as text; null for a passage without words."""
    plain = F.btrim(F.regexp_replace(F.lower(text), SPACE + "+", " "))
    return F.when(F.length(plain) > 0, F.substring(F.sha2(F.encode(plain, "UTF-8"), 256), 1, 32))


def level_hashes(body: Column) -> Column:
    """``level, hash`` of each quote level that has words, own text (level 0) first."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.struct(F.length(F.replace(F.regexp_extract(x, MARKS, 0), F.lit(" "), F.lit(""))).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))
    of = lambda k: F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == k), lambda x: x["text"]), "\n")
    levels = F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["level"])))
    return F.filter(F.transform(levels, lambda k: F.struct(k.alias("level"), passage_hash(of(k)).alias("hash"))), lambda x: x["hash"].isNotNull())


def _chain(above: int) -> Column:
    """What lies below level ``above`` as texts, the levels counted from there."""
    return F.transform(F.filter("levels", lambda x: x["level"] > above), lambda x: F.concat((x["level"] - above).cast("string"), F.lit(":"), x["hash"]))


def _keyed(rows: DataFrame, about: str, chain: str) -> DataFrame:
    """A row for each length of the chain, from none to all, and one for all and its end: ``key`` and ``rank``, larger for longer ones."""
    key = lambda k: F.concat_ws("|", F.slice(chain, F.lit(1), k))
    some = F.transform(F.sequence(F.lit(0), F.size(chain)), lambda k: F.struct(key(k).alias("key"), (2 * k).alias("rank")))
    whole = F.array(F.struct(F.concat(key(F.size(chain)), F.lit("|.")).alias("key"), (2 * F.size(chain) + 1).alias("rank")))
    out = rows.select("*", F.explode(F.concat(some, whole)).alias("__at")).select("*", "__at.rank", F.sha2(F.concat_ws("|", about, "__at.key"), 256).substr(1, 32).alias("key"))
    return out.drop("__at", chain, about)


def _answers(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """``id, quotes, parent`` for each ask with an earlier offer about the same: the one with the best score, then the longest common chain, then the smallest id.

    asks: id, quotes, about, chain; offers: id, about, chain, score.
    """
    # one row a key: what thousands of messages share is one candidate, found before the shuffle by partial minima
    few = _keyed(offers, "about", "chain").groupBy("key", "score").agg(F.min("id").alias("parent"))
    found = _keyed(asks, "about", "chain").join(few, "key").where(F.col("parent") < F.col("id"))
    return found.groupBy("id", "quotes").agg(F.max_by("parent", F.struct("score", "rank")).alias("parent"))


def passages(body: Column) -> Column:
    """The level-1 lines without their marks; lines of other levels between them are blank lines."""
    level = lambda x: F.length(F.replace(F.regexp_extract(x, MARKS, 0), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.split(body, "\n", -1), lambda x: F.when(level(x) == 1, F.regexp_replace(x, MARKS, "")).otherwise("")), "\n")


def line_hashes(text: Column) -> Column:
    """The different lines and paragraphs of a passage as hashes; a blank line ends a paragraph."""
    parts = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[\x20\x09-\x0D]*\n", -1))
    return F.array_distinct(F.filter(F.transform(parts, passage_hash), lambda x: x.isNotNull()))


def _from_parts(asks: DataFrame, known: DataFrame) -> DataFrame:
    """The offers for quotes that are no whole text: about, id, chain, score (how many of the quoted lines and paragraphs the original has).

    Of the quoted lines that some original has, the one in the fewest different originals decides which are looked at. Equal quotes are one ask, equal messages one
    original, so a common line makes as many pairs as there are different originals with it, for each different quote that has no rarer line.
    """
    asked = written(asks.select("about", "lines").distinct(), "quoted-lines")
    wanted = asked.select("about", F.explode("lines").alias("line"))
    # one row for equal messages; a message's own text and its quotes decide
    same = F.sha2(F.concat_ws("|", "about", F.concat_ws("|", "chain")), 256).substr(1, 32)
    own = known.select("id", "chain", same.alias("same"), line_hashes(F.col("text")).alias("own"))
    lines = own.select("same", F.explode("own").alias("line")).join(wanted.select("line").distinct(), "line", "left_semi").distinct()
    lines = written(lines, "own-lines")
    rarest = (wanted.join(lines.groupBy("line").agg(F.count("*").alias("n")), "line").groupBy("about").agg(F.min_by("line", F.struct("n", "line")).alias("line")))
    pairs = rarest.join(lines, "line").select("about", "same")
    # what a pair shares is counted on hashes
    shared = pairs.join(wanted, "about").join(lines, ["same", "line"]).groupBy("about", "same").agg(F.count("*").alias("score"))
    first = own.join(lines.select("same").distinct(), "same", "left_semi").groupBy("same", "chain").agg(F.min("id").alias("id"))
    return shared.join(first, "same").select("about", "id", "chain", "score")


def linked(messages: DataFrame, id_col: str = "message_id", body_col: str = "body", passed: tuple[str, ...] = ()) -> DataFrame:
    """``id, text, parent, root, depth`` for each message: its own text without quotes, the message it answers, and its conversation.

    A message answers a message of smaller id whose own text is the quoted passage of level 1: the one whose own quotes are the deeper passages here, level by level; else
    the one that agrees in the most levels from the top (a quote that was shortened); of equal ones the smallest id. A quote that is no message's whole text (trimmed, or of two messages) is looked up by its lines and paragraphs: of the earlier messages that
    have its rarest known one, that with the most of them, then by the deeper levels in the same way. So links lead back and never form a circle.
    Messages that answer nothing, or whose original is absent or empty, are roots of depth 0. In the order of (root, depth, id) each message comes after the
    one it answers. A null body is empty. Rows that repeat an id are all passed on and share their links; rows with a null id are roots of their own. Empty tables
    give an empty result. Ids may be of any type that can be ordered. The columns named in ``passed`` follow, each row with its own; others are ignored.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    parsed = written(messages.select(F.col(id_col).alias("id"), F.struct(F.lit(0), *passed).alias("passed"), level_text(body, 0).alias("text"), level_hashes(body).alias("levels"),
                                      line_hashes(passages(body)).alias("lines")), "messages")
    at = lambda k: F.get(F.filter("levels", lambda x: x["level"] == k), F.lit(0))["hash"]
    known = parsed.where("id is not null").select("id", at(0).alias("about"), _chain(0).alias("chain"), "text").where("about is not null")
    quotes = F.sha2(F.concat_ws("|", _chain(0)), 256).substr(1, 32)
    asks = parsed.where("id is not null").select("id", quotes.alias("quotes"), at(1).alias("about"), _chain(1).alias("chain"), F.array_sort("lines").alias("lines")).where("about is not null").distinct()
    asks = asks.withColumn("quotes", F.sha2(F.concat_ws("|", "quotes", F.concat_ws("|", "lines")), 256).substr(1, 32))
    found = written(_answers(asks.drop("lines"), known.drop("text").withColumn("score", F.lit(0))), "answers")
    open_asks = written(asks.join(found, ["id", "quotes"], "left_anti"), "open-asks")
    if open_asks.limit(1).count():
        # equal sets of lines are one ask
        open_asks = open_asks.withColumn("about", F.sha2(F.concat_ws("|", "lines"), 256).substr(1, 32))
        found = found.unionByName(_answers(open_asks.drop("lines"), _from_parts(open_asks, known)))
    # rows that repeat an id may quote differently: the smallest original counts
    links = written(found.groupBy("id").agg(F.min("parent").alias("parent")), "reply-links")
    # pointers double their reach in each round; ids fall along a pointer, so all end at a root, and those that have go no further
    moving, done = links.select("id", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), None
    while done is None or moving.limit(1).count():
        step = (moving if done is None else done.unionByName(moving)).select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        after = written(moving.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                                                 F.col("next").isNotNull().alias("moved")), "reach")
        ended = after.where(~F.col("moved")).drop("moved")
        done, moving = ended if done is None else done.unionByName(ended), after.where("moved").drop("moved")
    ends = links.join(done, "id")
    return (parsed.select("id", "passed", "text").join(ends, "id", "left")
            .select("id", "text", "parent", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), *[F.col("passed")[c].alias(c) for c in passed]))


def quoting_messages(turns: DataFrame, levels: int = 3) -> DataFrame:
    """Mail-like messages from conversation turns: each quotes the turn before it, with that turn's quotes, up to ``levels`` levels.

    ``message_id`` is (conv_id, turn), null where either is: such rows are no turn of a conversation that others could answer. Own lines that begin with ``>`` get a space before them. Of rows that repeat a turn the smallest text is quoted.
    """
    plain = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "(?m)^>", " >")
    rows = turns.select("conv_id", "turn", "role", plain.alias("body"))
    quoted = turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(plain).alias("said"))
    for k in range(1, levels + 1):
        before = quoted.select("conv_id", (F.col("turn") + k).alias("turn"), F.concat(F.lit("> " * k), F.replace("said", F.lit("\n"), F.lit("\n" + "> " * k))).alias(f"q{k}"))
        rows = rows.join(before, ["conv_id", "turn"], "left")
    said, parts = F.lit(True), []
    for k in range(1, levels + 1):  # a gap in the turns ends the quotes
        said = said & F.col(f"q{k}").isNotNull()
        parts.append(F.when(said, F.col(f"q{k}")))
    return rows.select(F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct("conv_id", "turn")).alias("message_id"), "conv_id", "turn", "role", F.concat_ws("\n", "body", *parts).alias("body"))
