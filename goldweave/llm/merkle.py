"""Document fingerprints as Merkle trees over paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.common import rank_of, text_or_empty

#: A piece of a paragraph: to the first mark and space after 16 characters, or the rest of the
#: line, or up to 64 characters. The pieces of a text join to the text.
PIECE = r"""[^\n]{16,64}?[.,;:!?|)$%&*#"'-] |[^\n]{0,64}\n|[^\n]{1,64}\z|[^\n]{1,64} |[^\n]{1,64}"""
#: Text of about this many bytes is put in order together.
RANGE_BYTES = 8 << 20
#: Quantiles of the ids that are collected; an upper bound on the number of ranges.
QUANTILES = 4096


def tree(text: Column) -> Column:
    """The leaves of a text, an array: a hash per piece with the mark of what ends after it.

    ``,`` ends a piece, ``;`` a paragraph (a line), ``/`` a section. A section ends after a paragraph whose last
    hash begins with 0 to 3, so an edit moves no other section's bounds.
    """
    def leaf(piece: Column) -> Column:
        digest = F.md5(piece)
        return F.concat(digest, F.when(~piece.endswith("\n"), ",").when(digest < "4", "/").otherwise(";"))
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), leaf)


def sections(leaves: Column) -> Column:
    """The sections of joined leaves, each with its end mark."""
    return F.regexp_extract_all(leaves, F.lit("[^/]+/?"), F.lit(0))


def paragraphs(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit("[^;/]+[;/]?"), F.lit(0))


def section_hash(section: Column) -> Column:
    """The hash of a section's node: of its paragraphs' hashes, each of its pieces' hashes."""
    return F.md5(F.array_join(F.transform(paragraphs(section), F.md5), ""))


def fingerprint(leaves: Column) -> Column:
    """``root|leaves``: the root is the SHA-256 of the section hashes, so roots tell equal texts.

    The root is made from whole leaf hashes; of these the print keeps eight digits each, enough to
    compare two documents.
    """
    root_ = F.sha2(F.array_join(F.transform(sections(F.array_join(leaves, "")), section_hash), ""), 256)
    short = F.transform(leaves, lambda leaf: F.concat(F.substring(leaf, 1, 8), F.substring(leaf, 33, 1)))
    return F.concat(root_, F.lit("|"), F.array_join(short, ""))


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def _leaves(print_: Column) -> Column:
    return F.substring(print_, 66, (1 << 31) - 1)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the two prints' distinct leaves: 0 to 1."""
    x, y = (F.array_distinct(F.regexp_extract_all(_leaves(p), F.lit("[0-9a-f]{8}"), F.lit(0))) for p in (a, b))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1)))


def _first_unequal(x: Column, y: Column) -> Column:
    """The place, from 0, of the first nodes that differ or that one side lacks; null if there are none."""
    place = F.array_position(F.zip_with(x, y, lambda l, r: l.eqNullSafe(r)), F.lit(False))
    return F.when(place > 0, place - 1).cast("long")


def first_difference(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``section`` and ``paragraph`` (from 0), where the trees of two prints first part.

    Descends from the roots: equal roots stop there, else the first differing section is entered and in it the
    first differing paragraph found. Both are null for equal or null prints; a section that one
    side lacks differs in its first paragraph.
    """
    entered = [F.when(root(F.col(a)) != root(F.col(b)), sections(_leaves(F.col(p)))) for p in (a, b)]
    at = pairs.withColumn("_x", entered[0]).withColumn("_y", entered[1]).withColumn("section", _first_unequal(F.col("_x"), F.col("_y")))
    below = [paragraphs(F.coalesce(F.get(F.col(c), F.col("section").cast("int")), F.lit(""))) for c in ("_x", "_y")]
    return at.withColumn("paragraph", F.when(F.col("section").isNotNull(), _first_unequal(*below))).drop("_x", "_y")


def differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The branches that differ: ``pairs`` with ``side`` (a or b), ``section``, ``paragraph`` (both from 0).

    Descends from the roots: equal roots give no rows, a section whose hash the other tree has is not
    entered, and of the other sections the paragraphs whose hash the other tree lacks are returned.
    A null print gives no rows.
    """
    def lacking(side: str, mine: str, other: str) -> DataFrame:
        here = pairs.filter(root(F.col(a)) != root(F.col(b))).withColumn("side", F.lit(side))
        theirs, ours = sections(_leaves(F.col(other))), sections(_leaves(F.col(mine)))
        here = (here.withColumn("_nodes", F.transform(theirs, section_hash))
                .withColumn("_below", F.flatten(F.transform(theirs, lambda s: F.transform(paragraphs(s), F.md5))))
                .select("*", F.posexplode(ours).alias("section", "_section"))
                .filter(~F.array_contains("_nodes", section_hash(F.col("_section")))))
        return (here.select("*", F.posexplode(paragraphs(F.col("_section"))).alias("paragraph", "_paragraph"))
                .filter(~F.array_contains("_below", F.md5("_paragraph"))).drop("_nodes", "_below", "_section", "_paragraph"))
    return lacking("a", a, b).unionByName(lacking("b", b, a))


def with_next_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, text, next_text``: every text beside that of the next document by descending id.

    The document after the last is the first. Ranges of ids, cut at quantiles, are put in order each by
    itself; a range's last document takes the first of the next range. Equal ids are ordered by
    a hash of the text; null ids come last, in ranges of that hash. A null text is empty.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    facts = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx(
        "doc_id", shares, 10 * QUANTILES).alias("cuts")).first()
    n_ranges = min(QUANTILES, max(1, -(-(facts["bytes"] or 0) // range_bytes)))
    cuts = sorted({(facts["cuts"] or [0])[i * len(facts["cuts"] or [0]) // n_ranges] for i in range(1, n_ranges)})
    bits = max(1, n_ranges.bit_length())
    above = len(cuts) - rank_of(F.col("doc_id"), cuts, inclusive=True)  # cuts above the id
    unknown = F.shiftright("hash", 64 - bits).cast("int") + (1 << (bits - 1)) + len(cuts) + 1
    placed = own.withColumn("range", F.when(F.col("doc_id").isNull(), unknown).otherwise(above))

    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    inside = placed.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))

    # The first document of every range, for the last of the range before it; a row per range.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.bitwise_not("doc_id").alias("turned"),
                           F.col("hash").alias("hash"))).alias("head")
    heads = placed.groupBy("range").agg(first)
    line = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = heads.select("range", F.coalesce(F.lead("head").over(line), F.first("head").over(whole)).alias("head")).select(
        "range", F.bitwise_not(F.col("head.turned")).alias("head_id"), F.col("head.hash").alias("head_hash"))
    texts = (own.join(F.broadcast(turn), own["doc_id"].eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash")))
             .groupBy("range").agg(F.first("text").alias("head_text")))
    return inside.join(texts, "range").select("doc_id", "text", F.coalesce("next", "head_text").alias("next_text"))


def edited_and_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row the fingerprints of its text and of an edited text, their likeness and where the edit begins.

    The edited text has the last third of the code points replaced by as many of the next document's
    first. Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edit_section, edit_paragraph`` (the first branch that differs, null if none does). Equal texts have equal fingerprints; two empty texts are alike (1); a null text is
    empty; a table of one row is its own next document. Repeated rows stay, other columns are ignored.
    """
    beside = with_next_text(docs, id_column, text_column, range_bytes).withColumn("n_chars", F.length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next_text", F.lit(1), third))
    prints = beside.withColumn("edited", edited).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(tree(F.col("text"))).alias("fingerprint"),
        fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"),
        fingerprint(tree(F.col("next_text"))).alias("next_fingerprint"))
    located = first_difference(prints, "fingerprint", "edited_fingerprint")
    return located.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("section").alias("edit_section"), F.col("paragraph").alias("edit_paragraph"))
