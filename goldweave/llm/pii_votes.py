"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.llm.common import text_or_empty
from goldweave.session import materialise

# The kinds in the order results list them, each with its pattern. The quantifiers are
# possessive and the starts bound to run starts (or the end of the last match), which changes no match and keeps the search
# linear in very long runs.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms, which the method may add: disguised addresses, numbers without a country code.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?[(\[]at[)\]]\s?[a-z0-9-]{1,63}(?:\s?(?:\.|[(\[]dot[)\]])\s?[a-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+.,/-])(?:\([0-9]{3}\)\s?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.,/-])",
}
#: What a text must hold for a pattern to be worth running; each is implied by its pattern.
_HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "loose email": lambda t: t.rlike(r"(?i)[(\[]at[)\]]"),
    "loose phone": lambda t: t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"),
}
# Gazetteers of top-level domains, country calling codes and words that announce or deny personal data.
TOP_DOMAINS = "com org net edu gov io info biz de fr es uk us eu ch at it nl be ca au jp in br ru cn pl se no".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split()
ANNOUNCING = {"email": "email e-mail mail contact write correo courriel an", "ip": "ip host server address addr from client",
              "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
              "phone": "phone tel telephone call fax mobile cell telefon tél teléfono"}
DENYING = "version release license licence isbn issn doi section chapter page order ticket invoice token id no nr".split()

#: EM rounds over the vote patterns, and buckets of the classifier's hashed features.
ROUNDS = 30
BUCKETS = 4096
#: Posterior from which the classifier adds a span that the base rules lack.
ADD_FROM = 0.9


def _alternating(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match of a strict pattern passes its kind's check."""
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits, n = _digits(match), F.length(_digits(match))
    return (F.when(kind == "email", True).when(kind == "ip", match.rlike(rf"\A{byte}(?:\.{byte}){{3}}\z"))
            .when(kind == "card", F.when(n.between(16, 19), F.call_function("luhn_check", digits)).otherwise(False))
            .otherwise(n.between(8, 15)))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, base, start, end, match, before, after`` of every strict or loose match.

    ``docs`` has ``doc_id, text_hash, text``. Offsets are code points, the end exclusive. A text is cut by
    its matches; the lengths of matches and gaps add up to the offsets.
    """
    sources = [(k, STRICT[k], k, False) for k in KINDS] + [(k, p, f"loose {k}", True) for k, p in LOOSE.items()]
    # One scan for all patterns: matches and gaps per pattern, null where the text lacks what the pattern needs.
    parts = {}
    for n, (_, pattern, hint, _) in enumerate(sources):
        matches, gaps = _alternating(F.col("text"), pattern)
        hinted = _HINT[hint](F.col("text"))
        parts |= {f"m{n}": F.when(hinted, matches), f"g{n}": F.when(hinted, gaps)}

    def found(n: int, kind: str, loose: bool) -> Column:
        gaps = F.col(f"g{n}")
        rows = F.transform(f"m{n}", lambda m, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), m.alias("match"), F.length(m).alias("n"),
            F.length(F.get(gaps, i)).alias("gap"), F.right(F.get(gaps, i), F.lit(32)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(8)).alias("after")))
        return F.coalesce(rows, F.array().cast(
            "array<struct<kind:string,loose:boolean,i:int,match:string,n:int,gap:int,before:string,after:string>>"))

    every = F.concat(*[found(n, kind, loose) for n, (kind, _, _, loose) in enumerate(sources)])
    rows = docs.select("doc_id", "text_hash", *[c.alias(n) for n, c in parts.items()]).select(
        "doc_id", "text_hash", F.inline(every))
    key = ["doc_id", "text_hash", "kind", "loose"]
    run = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = (rows.repartition(*key).dropDuplicates([*key, "i"])
             .withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)))
    base = ~F.col("loose") & _valid(F.col("kind"), F.col("match"))
    return ended.select(*key, base.alias("base"), (F.col("end") - F.col("n")).cast("long").alias("start"),
                        F.col("end").cast("long").alias("end"), "match", "before", "after")


def votes(found: DataFrame) -> DataFrame:
    """Adds each labeler's vote: 1 personal data, 0 not, null abstains."""
    kind, match, digits = F.col("kind"), F.col("match"), _digits(F.col("match"))
    word = F.lower(F.regexp_extract("before", r"([\p{L}-]+)[^\p{L}]*\z", 1))
    announced = F.lit(False)
    for k, words in ANNOUNCING.items():
        announced = announced | ((kind == k) & word.isin(words.split()))
    suffix = F.lower(F.regexp_extract(match, r"([A-Za-z-]+)\)?\z", 1))
    code = F.regexp_extract(match, r"\A\+([0-9]{1,3})", 1)
    gazetteer = (F.when(kind == "email", suffix.isin(TOP_DOMAINS))
                 .when((kind == "phone") & (code != ""), F.array_contains(
                     F.lit(CALLING_CODES), F.substring(code, 1, 1)) | F.substring(code, 1, 2).isin(CALLING_CODES))
                 .when(kind == "card", F.substring(digits, 1, 1).isin("2", "3", "4", "5", "6"))
                 .when(kind == "ip", ~match.rlike(r"\A0+\.|\.0+\z")))
    context = F.when(announced, True).when(word.isin(DENYING), False)
    plain = F.length(F.array_join(F.array_distinct(F.split(digits, "")), "")) > 2
    shape = F.when(kind == "email", ~match.contains("..")).otherwise(plain)
    edges = ~(F.right("before", F.lit(1)).rlike(r"[\p{L}\p{N}]") | F.left("after", F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    return found.withColumns({
        "v_regex": F.col("base").cast("int"), "v_gazetteer": gazetteer.cast("int"),
        "v_context": context.cast("int"), "v_shape": shape.cast("int"), "v_edges": edges.cast("int"), "word": word})


VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape", "v_edges")


def estimate_reliabilities(patterns: list[tuple], rounds: int = ROUNDS) -> dict[tuple, float]:
    """EM over counted vote patterns ``(kind, votes..., n)``: the posterior of each pattern by its kind.

    Every labeler has a rate of voting 1 on personal data and one on the rest, learned with one
    pseudo-count a side and started at 0.8 and 0.2, which says which class is which. The work is
    that of the patterns, a few hundred at most, however many spans there are.
    """
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        own = [(p[1:-1], p[-1]) for p in patterns if p[0] == kind]
        prior, hit, miss = 0.5, [0.8] * len(VOTES), [0.2] * len(VOTES)
        for _ in range(rounds):
            post = {}
            for pattern, _n in own:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(pattern):
                    if v is not None:
                        a += math.log(hit[j] if v else 1 - hit[j])
                        b += math.log(miss[j] if v else 1 - miss[j])
                post[pattern] = 1 / (1 + math.exp(min(max(b - a, -500), 500)))
            total = sum(n for _, n in own)
            prior = (sum(post[p] * n for p, n in own) + 1) / (total + 2)
            for j in range(len(VOTES)):
                for rates, side, one in ((hit, lambda x: x, 0.8), (miss, lambda x: 1 - x, 0.2)):
                    voted = sum(side(post[p]) * n for p, n in own if p[j] is not None)
                    yes = sum(side(post[p]) * n for p, n in own if p[j])
                    rates[j] = (yes + one) / (voted + 1)
        out.update({(kind, *p): q for p, q in post.items()})
    return out


def _features() -> Column:
    """Hashed features of a span for the classifier: kind with form, neighbours and length."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("match", "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    said = [F.concat(F.lit("shape "), shape), F.concat(F.lit("word "), F.col("word")),
            F.concat(F.lit("after "), F.left("after", F.lit(1))), F.concat(F.lit("before "), F.right("before", F.lit(1))),
            F.concat(F.lit("length "), F.length("match").cast("string")),
            F.concat(F.lit("digits "), F.length(_digits(F.col("match"))).cast("string"))]
    return F.array(*[F.pmod(F.xxhash64(F.col("kind"), s), F.lit(BUCKETS)).cast("int") for s in said])


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_hash, kind, start, end, base, posterior`` of the personal data in every text.

    Strict matches that pass their checks are base spans and always stay; those that fail are no
    personal data and show the classifier what that looks like. Loose matches are added where the
    span classifier is sure (``ADD_FROM``) and they overlap no base span. Labelers vote by pattern and check, gazetteer, context, form and
    edges; EM estimates their reliabilities from the counts of vote patterns; the posteriors
    train a naive Bayes classifier on hashed features of all spans by one grouped aggregation.

    A null or empty text has no spans. Rows of equal id and text give their spans once.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    voted, _ = materialise(votes(candidates(own.withColumn("text_hash", F.xxhash64("text")))), "pii-votes")
    counted = voted.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()  # patterns, not spans
    learned = estimate_reliabilities([tuple(r) for r in counted])
    posterior = docs.sparkSession.createDataFrame(
        [(*k, p) for k, p in learned.items()], "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", p double")
    left, right = voted.alias("l"), F.broadcast(posterior).alias("r")  # at most 4 x 3^5 rows
    same = F.col("l.kind") == F.col("r.kind")
    for v in VOTES:
        same = same & F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}"))
    labelled = left.join(right, same).select("l.*", "r.p").withColumn("features", _features())
    labelled = labelled.withColumn("span", F.xxhash64("doc_id", "text_hash", "kind", "loose", "start"))

    sums = labelled.select("p", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = labelled.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("yes"), F.count(F.lit(1)).alias("n")).first()
    yes, no = total["yes"] + 1, total["n"] - total["yes"] + 1
    weights = sums.select("feature", (F.log((F.col("yes") + 0.5) / yes) - F.log((F.col("no") + 0.5) / no)).alias("weight"))
    prior = math.log(yes / no)
    scored = (labelled.filter("loose").select("span", F.explode("features").alias("feature"))
              .join(F.broadcast(weights), "feature").groupBy("span")  # at most BUCKETS rows
              .agg((1 / (1 + F.exp(-(F.sum("weight") + prior)))).alias("posterior")))
    base = labelled.filter("base").select("doc_id", "text_hash", "kind", "start", "end", "base", F.lit(1.0).alias("posterior"))
    more = (labelled.filter("loose").join(scored, "span").filter(F.col("posterior") >= ADD_FROM)
            .select("doc_id", "text_hash", "kind", "start", "end", "base", "posterior"))
    return base.unionByName(_clear_of(more, base))


def _clear_of(more: DataFrame, base: DataFrame) -> DataFrame:
    """The spans of ``more`` that overlap no base span and no earlier span of ``more`` in the same text."""
    key = ["doc_id", "text_hash"]
    line = Window.partitionBy(*key).orderBy("start", F.col("base").desc(), "kind", "end")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    ahead = line.rowsBetween(1, Window.unboundedFollowing)
    both = more.unionByName(base)
    ended = F.coalesce(F.max("end").over(past), F.lit(-1))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
    return (both.withColumn("_clear", (F.col("start") >= ended) & (next_base.isNull() | (F.col("end") <= next_base)))
            .filter(~F.col("base") & F.col("_clear")).drop("_clear"))


def _rank(kind: Column) -> Column:
    rank = F.lit(len(KINDS))
    for i, k in reversed(list(enumerate(KINDS))):
        rank = F.when(kind == k, i).otherwise(rank)
    return rank


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row of ``docs``.

    Counts and the digest are those of the base spans; ``spans`` lists all, ``kind:start:end`` by kind and
    start. A text without spans has zeros, the digest of the empty string and an empty list. Repeated rows stay.
    """
    found = spans(docs, id_column, text_column)
    said = F.concat_ws(":", "kind", "start", "end")
    item = F.struct(_rank(F.col("kind")).alias("rank"), "start", "end", "base", "kind", said.alias("said"))
    lists = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(item)).alias("list"))
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_column)).alias("text_hash"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "list")
    same = own["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    joined = own.join(lists, same, "left").withColumn("base", F.filter("list", lambda s: s["base"]))

    def count_of(kind: str) -> Column:
        own_kind = F.filter("base", lambda s: s["kind"] == kind)
        return F.when(F.col("base").isNull(), 0).otherwise(F.size(own_kind)).cast("long").alias(f"n_{kind}")

    def text_of(column: str) -> Column:
        return F.coalesce(F.array_join(F.transform(column, lambda s: s["said"]), ","), F.lit(""))

    return joined.select("doc_id", *[count_of(k) for k in KINDS], F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("list").alias("spans"))


def _merged(found: DataFrame) -> DataFrame:
    """Spans of a text that overlap become one, of the kind of the first."""
    line = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "kind")
    past = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(past.isNull() | (F.col("start") >= past), 1).otherwise(0)
    numbered = found.withColumn("_opens", opens).withColumn(
        "_group", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc_id", "text_hash", "_group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced together.

    All columns stay, in order; texts without spans stay as they are (null too). A column ``n_chars`` is set to
    the new length where the text changed.
    """
    found = _merged(spans(docs, id_column, text_column))
    item = F.struct("start", "end", "kind")
    lists = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(item)).alias("_list"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_list")
    own = docs.select(F.struct("*").alias("_row"), F.col(id_column).cast("long").alias("_own_id"),
                      F.xxhash64(text_or_empty(text_column)).alias("_own_hash"))
    same = own["_own_id"].eqNullSafe(F.col("_id")) & (own["_own_hash"] == F.col("_hash"))
    text = F.col(f"_row.{text_column}").cast("string")
    def between(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    last = F.col("_list")[F.size("_list") - 1]["end"]
    pieces = F.transform("_list", lambda s, i: F.concat(
        between(F.when(i > 0, F.get("_list", i - 1)["end"]).otherwise(0), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    done = F.concat(F.array_join(pieces, ""), between(last, F.length(text)))
    joined = own.join(lists, same, "left").withColumn("_masked", done)
    changed = F.col("_list").isNotNull()
    columns = []
    for c, kind in docs.dtypes:
        old = F.col("_row")[c]
        new = {text_column: F.col("_masked"), "n_chars": F.length("_masked").cast(kind)}.get(c)
        columns.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return joined.select(*columns)
