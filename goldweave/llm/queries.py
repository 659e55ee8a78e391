"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm import (
    bpe_words, class_lm, html_blocks, merkle, pii_votes, quality, quotes, shards, simhash_bk, templates, token_groups,
    vector_codes, vector_graph,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@registered
def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under a class bigram model of those outside fold 2 of 7."""
    return class_lm.score(table(spark, sf_dir, "documents"), held_out=2, folds=7)


@registered
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: three-word shingles, at most two differing bits."""
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text and its site; the source is the host, the language the path."""
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a mailbox, made by Spark, in which all conversations run at the same time.

    A turn quotes the whole turn before last at level 2 and the whole turn before at level 1. Every second mail has its
    quotes re-wrapped; every third answers inside the quote, after its first line. Repeats of a turn are one text.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = turns.groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("said"), F.min("role").alias("by"))
    one, two = (said.select("conv_id", (F.col("turn") + k).alias("turn"), *[F.col(c).alias(f"{c}{k}") for c in ("said", "by")])
                for k in (1, 2))
    place = F.col("conv_id") + F.col("turn")

    def quoted(text: Column, mark: str) -> Column:
        wrapped = F.when((place % 2 == 1) & (place % 3 != 0), F.regexp_replace(text, "(.{1,60}) ", "$1\n")).otherwise(text)
        return F.concat(F.lit(mark), F.replace(wrapped, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    deeper = F.coalesce(quoted(F.col("said2"), ">> "), F.lit(""))
    head = F.concat(F.lit("On turn "), F.col("turn") - 1, F.lit(", "), F.coalesce("by1", F.lit("")), F.lit(" wrote:\n"), deeper)
    whole = F.concat(head, quoted(F.col("said1"), "> "), "text")
    first, rest = (F.regexp_extract("said1", r"(?s)\A([^\n]*)\n(.*)\z", g) for g in (1, 2))
    own, more = (F.regexp_extract("text", r"(?s)\A([^\n]*)(.*)\z", g) for g in (1, 2))
    inside = F.concat(head, quoted(first, "> "), own, F.lit("\n"), quoted(rest, "> "), F.substring(more, 2, F.lit((1 << 31) - 1)))
    text = F.when(F.col("said1").isNull(), F.col("text")).when((place % 3 == 0) & F.col("said1").contains("\n"), inside).otherwise(whole)
    return turns.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1048576 + F.col("turn")).alias("msg_id"), (F.col("turn") * 1099511627776 + F.col("conv_id")).alias("sent"),
        text.alias("text"))


@registered
def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the mailbox made from the conversations, found by the quoted passages alone."""
    return quotes.link(mails(spark, sf_dir))


def _units_sql(parts: str) -> str:
    return (f"list_distinct(list_filter(list_transform({parts}, lambda l: trim(regexp_replace(lower(l), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), "
            "lambda l: l <> ''))")


_SENTENCES_SQL = _units_sql(f"string_split(regexp_replace(text, '{quotes.SENTENCE_END}', chr(1), 'g'), chr(1))")
_PIECES_SQL = _units_sql(f"string_split(regexp_replace(text, '{quotes.SENTENCE_END}|\\n', chr(1), 'g'), chr(1))")
# Passages are what the mailbox quotes, before it is wrapped; each unit goes to the latest earlier message that holds it.
SQL["op4_quotes"] = rf"""
WITH RECURSIVE turns AS (SELECT conv_id * 1048576 + turn AS msg_id, turn * 1099511627776 + conv_id AS sent, conv_id, turn, text FROM conversations),
before AS (SELECT t.msg_id, t.sent, k.k AS level, p.text, (t.conv_id + t.turn) % 3 = 0 AND k.k = 1 AND contains(p.text, chr(10)) AS cut
           FROM turns t CROSS JOIN (VALUES (1), (2)) k(k) JOIN turns p ON p.conv_id = t.conv_id AND p.turn = t.turn - k.k
           JOIN turns q ON q.conv_id = t.conv_id AND q.turn = t.turn - 1),
passages AS (SELECT msg_id, sent, level, 0 AS part, CASE WHEN cut THEN string_split(text, chr(10))[1] ELSE text END AS text FROM before
             UNION ALL SELECT msg_id, sent, level, 1, array_to_string(string_split(text, chr(10))[2:], chr(10)) FROM before WHERE cut),
units AS (SELECT msg_id, sent, level, part, 0 AS kind, unnest({_SENTENCES_SQL}) AS unit FROM passages
          UNION ALL SELECT msg_id, sent, level, part, 1, unnest({_PIECES_SQL}) FROM passages),
originals AS (SELECT DISTINCT sent, msg_id AS source, unit FROM (SELECT *, unnest(list_concat({_SENTENCES_SQL}, {_PIECES_SQL})) AS unit FROM turns)),
found AS (SELECT u.*, o.sent AS source_sent, source FROM units u ASOF LEFT JOIN originals o ON u.unit = o.unit AND u.sent > o.sent),
linked AS (SELECT msg_id, level, part, min(kind) AS kind FROM (
    SELECT msg_id, level, part, kind FROM found GROUP BY ALL
    HAVING sum(CASE WHEN source IS NULL THEN 0 ELSE length(unit) END) >= {quotes.COVERAGE} * sum(length(unit))) GROUP BY ALL),
parents AS (SELECT msg_id, arg_max(source, (size, source_sent)) AS parent FROM (
    SELECT f.msg_id, source, source_sent, sum(length(unit)) AS size FROM found f JOIN linked USING (msg_id, level, part, kind)
    WHERE level = 1 AND source IS NOT NULL GROUP BY ALL) GROUP BY 1),
threads(msg_id, thread_id, depth) AS (
    SELECT msg_id, msg_id, CAST(0 AS BIGINT) FROM turns WHERE msg_id NOT IN (SELECT msg_id FROM parents)
    UNION ALL SELECT p.msg_id, thread_id, depth + 1 FROM threads t JOIN parents p ON p.parent = t.msg_id)
SELECT t.msg_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY sent, t.msg_id) - 1 AS position, depth, parent AS parent_id,
       (SELECT count(DISTINCT (level, part)) FROM units u WHERE u.msg_id = t.msg_id) AS n_quoted,
       (SELECT count(*) FROM linked l WHERE l.msg_id = t.msg_id) AS n_linked,
       CASE WHEN EXISTS (FROM before b WHERE b.msg_id = t.msg_id) THEN trim(text, chr(32) || chr(9) || chr(13) || chr(10)) ELSE text END AS text
FROM turns t JOIN threads USING (msg_id) LEFT JOIN parents p ON p.msg_id = t.msg_id
"""


@registered
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 16 shards of equal counts."""
    return shards.shuffled(table(spark, sf_dir, "documents"), n_shards=16)


@registered
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values in its slots."""
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def _list_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# A token keeps the sentence end before it; ``w`` is its type as a word, ``n`` its type where an open one is a name.
_TOKEN_SQL = r"""(?:[.!?:\n]["'')\]]{0,2}\s{0,4}|^\s*)?[\p{L}\p{N}]+(?:[.,][0-9]+)*"""
_EDGE_SQL = "(left(t, 1) < 'A' AND (left(t, 1) < '0' OR left(t, 1) >= ':'))"
_CAPITAL_SQL = "(NOT ends_with(t, v) AND ends_with(t, substring(v, 2)) AND length(v) > 1)"
_TYPE_SQL = f"""CASE WHEN v IN ({_list_sql(templates.UNIT_WORDS)}) THEN '<unit>'
    WHEN left(v, 1) BETWEEN '0' AND '9' OR v IN ({_list_sql(templates.NUMBER_WORDS)}) THEN '<num>'
    WHEN {_CAPITAL_SQL} AND ({{opens}}) THEN '<name>' ELSE v END"""
_OPEN_SQL = f"i = 1 OR {_EDGE_SQL}"


def _windows_sql(readings: str) -> str:
    """Windows of five: the types, or the values behind '=' where all five are placeholders."""
    return f"""SELECT side, id, text, i, types, vals, CASE WHEN len(list_filter(types, lambda x: x NOT LIKE '<%')) > 0 THEN types
        ELSE list_transform(vals, lambda x: '=' || x) END AS key
    FROM (SELECT side, id, text, i, list(ty) OVER w AS types, list(v) OVER w AS vals FROM ({readings})
          WINDOW w AS (PARTITION BY side, id, text, reading ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE len(types) = 5"""


_ITEM_READINGS_SQL = " UNION ALL ".join(
    f"SELECT side, id, text, i, v, {k} AS reading, CASE WHEN i = 1 THEN {first} ELSE {rest} END AS ty FROM typed WHERE side = 'b'"
    for k, (first, rest) in enumerate((("w", "w"), ("n", "n"), ("n", "w"), ("w", "n"))))
_TEXT_READINGS_SQL = " UNION ALL ".join(
    f"SELECT side, id, text, i, v, {k} AS reading, {c} AS ty FROM typed WHERE side = 'd'" for k, c in enumerate("wn"))
# Every item of the table has at least five tokens, so the oracle knows windows of five only.
SQL["op6_decontaminate"] = f"""
WITH texts AS (SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark),
raw AS (SELECT side, id, text, regexp_extract_all(text, '{_TOKEN_SQL}') AS raw FROM texts),
tok AS (SELECT side, id, text, unnest(raw) AS t, generate_subscripts(raw, 1) AS i FROM raw),
low AS (SELECT *, lower(CASE WHEN {_EDGE_SQL} THEN ltrim(t, ' .!?:"'')]' || chr(9) || chr(10) || chr(13)) ELSE t END) AS v FROM tok),
typed AS MATERIALIZED (SELECT side, id, text, i, v, {_TYPE_SQL.format(opens=f"NOT ({_OPEN_SQL})")} AS w, {_TYPE_SQL.format(opens="true")} AS n FROM low),
ours AS MATERIALIZED (SELECT DISTINCT * FROM ({_windows_sql(_TEXT_READINGS_SQL)})),
theirs AS MATERIALIZED (SELECT DISTINCT * FROM ({_windows_sql(_ITEM_READINGS_SQL)})),
sizes AS (SELECT id, text, count(DISTINCT i) AS n_windows FROM theirs GROUP BY ALL),
met AS (SELECT d.id AS doc_id, d.text, b.id AS item_id, b.text AS item_text, b.i AS place, d.i - b.i AS offs,
          list_filter(list_transform(range(1, 6), lambda k: {{'type': d.types[k], 'theirs': b.vals[k], 'ours': d.vals[k]}}), lambda s: s.type LIKE '<%') AS slots
        FROM ours d JOIN theirs b ON d.key = b.key),
once AS MATERIALIZED (SELECT doc_id, text, item_id, item_text, offs, place, arg_min(slots, len(slots)) AS slots FROM met GROUP BY ALL),
said AS (SELECT doc_id, text, item_id, item_text, offs, place, unnest(slots) AS s FROM once),
voted AS (SELECT *, s.type AS type, s.theirs AS theirs, s.ours AS ours, s.theirs = s.ours AS same,
            count(*) OVER (PARTITION BY doc_id, text, item_id, item_text, offs, s.type, s.theirs, s.ours) AS votes FROM said),
mapped AS (SELECT *, ours = (max(row(votes, same, ours)) OVER (PARTITION BY doc_id, text, item_id, item_text, offs, type, theirs))[3] AS fits FROM voted),
back AS (SELECT *, (max(CASE WHEN fits THEN row(votes, same, theirs) END) OVER (PARTITION BY doc_id, text, item_id, item_text, offs, type, ours))[3] AS chosen FROM mapped),
agreed AS (SELECT doc_id, text, item_id, item_text, offs, place, bool_and(fits AND (type <> '<name>' OR theirs = chosen)) OR bool_and(same) AS stays FROM back GROUP BY ALL),
kept AS (SELECT o.* FROM once o LEFT JOIN agreed a ON o.doc_id IS NOT DISTINCT FROM a.doc_id AND o.text = a.text AND o.item_id IS NOT DISTINCT FROM a.item_id
           AND o.item_text = a.item_text AND o.offs = a.offs AND o.place = a.place WHERE coalesce(a.stays, true)),
aligned AS (SELECT doc_id, text, item_id, item_text, offs, list(DISTINCT place) AS places, list_distinct(flatten(list(slots))) AS slots FROM kept GROUP BY ALL)
SELECT doc_id, item_id, n_windows, CAST(len(list_distinct(flatten(list(places)))) AS BIGINT) AS n_matched,
       CAST(sum(len(slots)) AS BIGINT) AS n_slots, CAST(sum(len(list_filter(slots, lambda s: s.theirs <> s.ours))) AS BIGINT) AS n_changed
FROM aligned JOIN sizes z ON item_id = z.id AND item_text = z.text GROUP BY doc_id, aligned.text, item_id, item_text, n_windows
HAVING n_matched >= n_windows * 0.8 - 1e-9
"""


@registered
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@registered
def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of an edited one, and their likeness."""
    return merkle.edited_and_next(table(spark, sf_dir, "documents"))


def _tree_sql(text: str) -> str:
    piece = merkle.PIECE.replace("'", "''")
    return (f"list_transform(regexp_extract_all({text}, '{piece}'), lambda p: md5(p) || CASE WHEN right(p, 1) <> chr(10) "
            f"THEN ',' WHEN md5(p) < '4' THEN '/' ELSE ';' END)")


_ROOT_SQL = ("sha256(array_to_string(list_transform(regexp_extract_all(array_to_string({0}, ''), '[^/]+/?'), lambda s: "
             "md5(array_to_string(list_transform(regexp_extract_all(s, '[^;/]+[;/]?'), lambda q: md5(q)), ''))), ''))")
_PRINT_SQL = _ROOT_SQL + " || '|' || array_to_string(list_transform({0}, lambda l: left(l, 8) || right(l, 1)), '')"
_SET_SQL = "list_distinct(list_transform({0}, lambda l: left(l, 8)))"
_NEAR_SQL = ("CASE WHEN " + _ROOT_SQL + " = " + _ROOT_SQL.replace("{0}", "{1}") + " THEN 1.0 ELSE CAST(2.0 * len(list_intersect("
             + _SET_SQL + ", " + _SET_SQL.replace("{0}", "{1}") + ")) AS DOUBLE) / greatest(len(" + _SET_SQL + ") + len("
             + _SET_SQL.replace("{0}", "{1}") + "), 1) END")
_SECTIONS_SQL = "regexp_extract_all(array_to_string(list_transform({0}, lambda l: left(l, 8) || right(l, 1)), ''), '[^/]+/?')"
_PARAGRAPHS_SQL = "regexp_extract_all(coalesce({0}[edit_section + 1], ''), '[^;/]+[;/]?')"
_FIRST_SQL = ("(SELECT min(i) - 1 FROM (SELECT unnest(range(1, greatest(len({0}), len({1})) + 1)) AS i) "
              "WHERE {0}[i] IS DISTINCT FROM {1}[i])")
SQL["op8_merkle"] = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
beside AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, length(text) AS n FROM own
           WINDOW w AS (ORDER BY doc_id DESC)),
edited AS (SELECT *, substring(text, 1, n - n // 3) || substring(next_text, 1, n // 3) AS edited FROM beside),
trees AS (SELECT doc_id, n, edited, {_tree_sql("text")} AS a, {_tree_sql("edited")} AS b, {_tree_sql("next_text")} AS c FROM edited)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_PRINT_SQL.format("a")} AS fingerprint,
       {_PRINT_SQL.format("b")} AS edited_fingerprint, CAST({_NEAR_SQL.format("a", "b")} AS DOUBLE) AS near_edited,
       CAST({_NEAR_SQL.format("a", "c")} AS DOUBLE) AS near_next, edit_section,
       CASE WHEN edit_section IS NOT NULL THEN {_FIRST_SQL.format(_PARAGRAPHS_SQL.format("x"), _PARAGRAPHS_SQL.format("y"))} END AS edit_paragraph
FROM (SELECT *, CASE WHEN {_ROOT_SQL.format("a")} <> {_ROOT_SQL.format("b")} THEN {_FIRST_SQL.format("x", "y")} END AS edit_section
      FROM (SELECT *, {_SECTIONS_SQL.format("a")} AS x, {_SECTIONS_SQL.format("b")} AS y FROM trees))
"""


@registered
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    return bpe_words.encode(table(spark, sf_dir, "documents"), with_ids=False)


@registered
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base counts and digest, and all spans."""
    return pii_votes.digests(table(spark, sf_dir, "documents"))


@registered
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 8 parts, 16 entries each, 6 rounds."""
    found, book = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)
    return found.drop("label").withColumn("codebooks_sha256", F.lit(vector_codes.digest_of(book, 8)))


def _assign_sql(n: int) -> str:
    """Distances of all parts to the entries of round ``n``; the lowest entry of the least distance."""
    return f"""near{n} AS MATERIALIZED (
  SELECT vec_id, p.part, v, min(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT * 16 + entry) AS best
  FROM parts p JOIN book{n} b ON p.part = b.part GROUP BY vec_id, p.part, v)"""


def _moved_sql(n: int) -> str:
    """Entries of round ``n`` from the assignment of the round before."""
    return f"""mean{n} AS (
  SELECT part, entry, list(m ORDER BY place) AS c FROM (
    SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (
      SELECT part, best % 16 AS entry, unnest(v) AS x, unnest(range(8)) AS place FROM near{n - 1}) GROUP BY ALL) GROUP BY ALL),
book{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{n - 1} b LEFT JOIN mean{n} m ON m.part = b.part AND m.entry = b.entry)"""


_ROUNDS_SQL = ", ".join(f"{_assign_sql(n)}, {_moved_sql(n + 1)}" for n in range(6))
SQL["op11_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, whole[part * 8 + 1:part * 8 + 8] AS v FROM kept, range(8) r(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, v AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
  WHERE entry < 16),
{_ROUNDS_SQL},
{_assign_sql(6)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM near6 GROUP BY vec_id),
said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM book6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), said
"""


@registered
def op12_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every whole text, linked by the byte ranges they share."""
    return token_groups.align(table(spark, sf_dir, "documents"))[0]


@registered
def op13_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of a label: cosine of at least 0.93, components and links."""
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
