"""Conversations from quoted messages: nested quotes are parsed, linked to their originals and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.common import rank_of, text_or_empty
from goldweave.session import materialise

_MARK = r"\A(?:[\x20\t]{0,3}>)++"
#: A line that announces a quote.
_ANNOUNCES = r"(?i)\A(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\s?:?\s*\z"
#: Spans of sending time in which originals are looked up together; at most so many are cut.
SLOTS = 1024
#: Share of a passage's characters that earlier messages must hold.
COVERAGE = 0.8
#: What ends a sentence.
SENTENCE_END = r"[.!?]+(?:\s|\z)|[。！？]+"


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only, single spaces: what re-wrapping and punctuation leave alone."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _distinct(parts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != ""))


def sentences(text: Column) -> Column:
    """The distinct normalised sentences of a text, read across line ends, so wrapping moves none of their bounds."""
    return _distinct(F.split(F.regexp_replace(text, SENTENCE_END, "\u0001"), "\u0001"))


def pieces(text: Column) -> Column:
    """The distinct normalised pieces between ends of sentences and lines, for quotes that begin or end inside a sentence."""
    return _distinct(F.split(F.regexp_replace(text, rf"{SENTENCE_END}|\n", "\u0001"), "\u0001"))


def _passages(lines: DataFrame) -> DataFrame:
    """``node, sent, passage, level, text``: consecutive lines of one quote level, joined; numbered by their first line."""
    order = Window.partitionBy("node").orderBy("n")
    starts = F.when(F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level"), F.col("n"))
    numbered = lines.withColumn("passage", F.last(starts, ignorenulls=True).over(order)).filter("level > 0")
    return numbered.groupBy("node", "sent", "passage", "level").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("l")).select(
        "node", "sent", "passage", "level", F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("text"))


def _wanted(passages: DataFrame) -> DataFrame:
    """A row per passage and sentence (``kind`` 0) or piece (1): ``hash`` and ``size``, its characters."""
    def rows(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("hash"), F.length(x).cast("long").alias("size")))
    parts = passages.withColumn("s", sentences(F.col("text"))).withColumn("p", pieces(F.col("text")))
    either = F.when(F.col("s") == F.col("p"), rows(0, F.col("s"))).otherwise(F.concat(rows(0, F.col("s")), rows(1, F.col("p"))))
    return parts.select("node", "sent", "passage", "level", F.inline(either))


def _linked(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``node, passage, level, kind`` of the passages whose sentences, or else pieces, earlier messages hold."""
    keys = ["node", "passage", "level", "kind"]
    whole = wanted.groupBy(*keys).agg(F.sum("size").alias("size"))
    held = found.groupBy(*keys).agg(F.sum("size").alias("held"))
    enough = whole.join(held, keys).filter(F.col("held") >= COVERAGE * F.col("size"))
    return enough.groupBy("node", "passage", "level").agg(F.min("kind").alias("kind"))


def _lines(messages: DataFrame) -> DataFrame:
    """``node, sent, n, level, body`` of every line; the level is the number of leading quote marks."""
    mark = F.regexp_extract("line", _MARK, 0)
    return (messages.select("node", "sent", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line"))
            .withColumn("mark", mark)
            .select("node", "sent", "n", F.length(F.regexp_replace("mark", "[^>]", "")).alias("level"),
                    F.substring("line", F.length("mark") + 1, F.lit((1 << 31) - 1)).alias("body")))


def _latest_original(wanted: DataFrame, originals: DataFrame, cuts: list) -> DataFrame:
    """For every wanted ``hash, sent`` the latest original sent before, ``found`` (sent, node), beside ``asked``.

    An as-of lookup in two steps, so that a passage that many messages hold is neither paired up nor
    met in one task: the latest original of each span of time is found by aggregation and
    carried to later spans, and only the rows of one span and hash are put in order.
    """
    def slot(sent: Column) -> Column:
        return rank_of(sent, cuts).alias("slot")

    both = originals.select("hash", "sent", slot(F.col("sent")), F.struct("sent", "node").alias("own"),
                            F.lit(None).cast(wanted.schema["asked"].dataType).alias("asked")).unionByName(
        wanted.select("hash", "sent", slot(F.col("sent")), F.lit(None).cast("struct<sent:long,node:long>").alias("own"),
                      "asked"))
    line = Window.partitionBy("hash", "slot").orderBy("sent").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max("own").over(line)).filter("asked is not null")
    per_slot = both.filter("own is not null").groupBy("hash", "slot").agg(F.max("own").alias("top"))
    asked = inside.filter("near is null").select("hash", "slot").distinct()
    steps = per_slot.unionByName(asked.withColumn("top", F.lit(None).cast("struct<sent:long,node:long>"))).groupBy(
        "hash", "slot").agg(F.max("top").alias("top"))
    past = F.max("top").over(Window.partitionBy("hash").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    carried = steps.select("hash", "slot", past.alias("far"))
    return (inside.join(carried, ["hash", "slot"], "left")
            .select("asked.*", F.coalesce("near", "far").alias("found")).filter("found is not null"))


def link(messages: DataFrame, id_column: str = "msg_id", sent_column: str = "sent", text_column: str = "text") -> DataFrame:
    """``msg_id, thread_id, position, depth, parent_id, n_quoted, n_linked, text`` per message.

    A line's quote level is its number of leading ``>``. The lines of level 0, without the line that
    announces a quote, are the message's own text. Consecutive lines of one level are a passage; its sentences,
    read across line ends and normalised, are hashed and joined to the sentences of messages sent earlier, so a
    re-wrapped quote finds its original. A sentence held by several goes to the latest of them. A passage is linked if
    earlier messages hold ``COVERAGE`` of its characters, by sentences or else, for quotes cut inside a sentence, by
    pieces between ends of sentences and lines. The parent is the message that supplied most characters of the linked
    level-1 passages (ties: the latest). ``n_quoted`` and ``n_linked`` count passages of all levels, without such as hold no letter or digit.
    ``thread_id`` is the id of
    the message at the end of the parents, ``depth`` the number of parents above, ``position`` the
    place in the thread by sending time, from 0: a reply comes after what it answers. ``text`` has no quotes.

    Rows of equal id and text count once; null ids and times come first (time 0 for null); a null or empty
    text is a message without quotes; a very long text is one row, and a long quote of it one passage. Messages whose
    quotes match nothing start a thread. Other columns are ignored; an empty table gives no rows.
    """
    own = messages.select(F.col(id_column).cast("long").alias("msg_id"), F.coalesce(F.col(sent_column).cast("long"), F.lit(0)).alias("sent"),
                          text_or_empty(text_column).alias("text"))
    own = own.withColumn("node", F.xxhash64("msg_id", "text")).dropDuplicates(["node"])
    own, _ = materialise(own, "quote-messages")

    quoted = own.filter(F.col("text").rlike(r"(?m)^[\x20\t]{0,3}>"))
    lines, _ = materialise(_lines(quoted), "quote-lines")
    after = F.lead("level").over(Window.partitionBy("node").orderBy("n"))
    kept = (lines.withColumn("after", after).filter("level = 0")
            .filter(~((F.coalesce("after", F.lit(0)) > 0) & F.col("body").rlike(_ANNOUNCES))))
    bare = kept.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("l")).select(
        "node", F.trim(F.array_join(F.transform("l", lambda x: x["body"]), "\n"), F.lit(" \t\r\n")).alias("bare"))
    unquoted = own.join(quoted.select("node"), "node", "left_anti").select("node", "msg_id", "sent", "text")
    stripped = quoted.join(bare, "node", "left").select("node", "msg_id", "sent", F.coalesce("bare", F.lit("")).alias("text"))
    clean, _ = materialise(unquoted.unionByName(stripped), "quote-clean")

    shares = [i / SLOTS for i in range(1, SLOTS)]
    cuts = clean.agg(F.percentile_approx("sent", shares, 10 * SLOTS)).first()[0] or []  # at most SLOTS numbers
    cuts = sorted(set(cuts))
    units = F.array_union(sentences(F.col("text")), pieces(F.col("text")))
    originals = clean.select("node", "sent", F.explode(F.transform(units, lambda x: F.xxhash64(x))).alias("hash"))
    wanted, _ = materialise(_wanted(_passages(lines)), "quote-passages")
    asked = wanted.select("hash", "sent", F.struct("node", "passage", "level", "kind", "size").alias("asked"))
    found, _ = materialise(_latest_original(asked, originals, cuts), "quote-links")
    linked, _ = materialise(_linked(wanted, found), "quote-linked")
    passages = wanted.select("node", "passage").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_quoted"))
    counts = passages.join(linked.groupBy("node").agg(F.count(F.lit(1)).alias("n_linked")), "node", "left")
    votes = found.join(linked.filter("level = 1"), ["node", "passage", "level", "kind"], "left_semi")
    parents = (votes.groupBy("node", "found").agg(F.sum("size").alias("size"))
               .groupBy("node").agg(F.max(F.struct("size", "found")).alias("best"))
               .select("node", F.col("best.found.node").alias("parent")))

    rooted = _roots(clean.select("node").join(parents, "node", "left"))
    ids = clean.select(F.col("node").alias("other"), F.col("msg_id").alias("other_id"))
    whole = (clean.join(rooted, "node").join(counts, "node", "left")
             .join(ids.withColumnsRenamed({"other": "root", "other_id": "thread_id"}), "root")
             .join(ids.withColumnsRenamed({"other": "parent", "other_id": "parent_id"}), "parent", "left"))
    whole, _ = materialise(whole, "quote-threads")
    return _positioned(whole, cuts).select(
        "msg_id", "thread_id", "position", "depth", "parent_id", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text")


def _roots(parents: DataFrame) -> DataFrame:
    """``node, parent, root, depth``: pointers doubled until every node points at its root.

    A parent was sent earlier, so there are no cycles and the rounds are the logarithm of the depth.
    """
    jumps, _ = materialise(parents.select("node", "parent", F.coalesce("parent", "node").alias("root"),
                                          F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")),
                           "quote-roots")
    while True:
        up = jumps.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = jumps.join(up, "root").select("node", "parent", F.col("above").alias("root"),
                                              (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        after, seen = materialise(moved, "quote-roots", moved=F.sum(F.col("moved").cast("long")))
        jumps = after.drop("moved")
        if not seen["moved"]:
            return jumps


def _positioned(rows: DataFrame, cuts: list) -> DataFrame:
    """Adds the place in the thread by time; rows of one thread and span of time are put in order together."""
    cut = rows.withColumn("span", rank_of(F.col("sent"), cuts))
    sizes = cut.groupBy("root", "span").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("root").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("root", "span", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("root", "span").orderBy("sent", "msg_id", "node"))
    return (cut.withColumn("inner", inner).join(starts, ["root", "span"])
            .withColumn("position", F.col("start") + F.col("inner") - 1))
