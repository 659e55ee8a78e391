"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goldweave.llm.common import text_or_empty
from goldweave.session import materialise

# Words that stand for a number or a unit.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                "hundred thousand million billion half dozen").split()
UNIT_WORDS = ("mm cm km kg mg ml lb lbs oz mph kmh kwh metre metres meter meters kilometre kilometres kilometer "
              "kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds "
              "ounce ounces litre litres liter liters second seconds minute minutes hour hours day days week weeks "
              "month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt "
              "volts joule joules newton newtons").split()

#: A word or number, with the end of the sentence or line before it if there is one.
_TOKEN = r"""(?:[.!?:\n]["')\]]{0,2}\s{0,4}|^\s*+)?[\p{L}\p{N}]++(?:[.,][0-9]++)*+"""
_EDGE = " \t\r\n.!?:\"')]"
#: Before the type of a capitalised word that starts a sentence, a line or the text: a name, or a word as any other.
_OPENS = "^"
#: Benchmark windows up to which the window table is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 1_000_000


def tokens(text: Column) -> Column:
    """Words and numbers in order; a token keeps the sentence end before it, which tells names from first words."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _after_edge(token: Column) -> Column:
    return (token < "A") & ((token < "0") | (token >= ":"))


def slot_value(token: Column) -> Column:
    """The word itself, in lower case."""
    return F.lower(F.when(_after_edge(token), F.ltrim(token, F.lit(_EDGE))).otherwise(token))


def canonical(token: Column, low: Column, place: Column) -> Column:
    """``<num>``, ``<unit>`` or ``<name>`` for a number, unit or name; else ``low``, the word in lower case.

    A name is a capitalised word that does not start a sentence, a line or the text. One that does may be a
    name or not, and is the word in lower case behind a ``^``.
    """
    capital = ~token.endswith(low) & token.endswith(F.substring(low, 2, 1 << 30)) & (F.length(low) > 1)
    return (F.when(low.isin(UNIT_WORDS), "<unit>")
            .when(((low < ":") & (low >= "0")) | low.isin(NUMBER_WORDS), "<num>")
            .when(capital, F.when((place == 0) | _after_edge(token), F.concat(F.lit(_OPENS), low)).otherwise("<name>"))
            .otherwise(low))


def _read(kind: Column, as_name: Column | bool) -> Column:
    """A type; if it is open, as a name or as a word."""
    return F.when(kind.startswith(_OPENS), F.when(F.lit(as_name), "<name>").otherwise(F.substring(kind, 2, 1 << 30))).otherwise(kind)


#: How texts are read: all open types as words, or all as names. What an item starts with may stand inside a
#: sentence of the document, so an item is read both ways there.
_TEXT_READINGS = ((False, False), (True, True))
_ITEM_READINGS = ((False, False), (True, True), (True, False), (False, True))


_KINDS = ("<num>", "<unit>", "<name>")


@functools.lru_cache(maxsize=8)
def _slots_only(width: int) -> list[int]:
    """The hashes of all windows of ``width`` placeholders, computed by Spark without a job."""
    kinds = SparkSession.active().sql("SELECT " + ", ".join(f"xxhash64('{k}')" for k in _KINDS)).first()
    runs = ", ".join(f"xxhash64({', '.join(f'{k}L' for k in run)})" for run in itertools.product(kinds, repeat=width))
    return SparkSession.active().sql(f"SELECT array({runs})").first()[0]


def _windows(hashes: str, values: str, width: int, short: bool, *more: str) -> Column:
    """All runs of ``width`` tokens, in order: the key of each, or a struct with it and the runs of other columns.

    The key is the hash of the types. A run of placeholders only would agree with any other, so its key is the
    hash of its values; so is that of a ``short`` run (an item below the width) with fewer than two words.
    """
    def run(_, i: Column) -> Column:
        parts = [F.get(hashes, i + k) for k in range(width)]
        key, exact = F.xxhash64(*parts), F.xxhash64(F.lit("="), *[F.get(values, i + k) for k in range(width)])
        if short:
            words = sum((F.when(p.isin(*[F.xxhash64(F.lit(k)) for k in _KINDS]), 0).otherwise(1) for p in parts), F.lit(0))
            key = F.when(words >= 2, key).otherwise(exact)
        else:
            key = F.when(key.isin(_slots_only(width)), exact).otherwise(key)
        return F.struct(key.alias("hash"), *[F.array(*[F.get(m, i + k) for k in range(width)]).alias(m) for m in more]) if more else key
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))), run)


def _runs(hashes: str, width: int) -> Column:
    """The hash of every run of ``width`` tokens, in order."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
                       lambda _, i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def _open_runs(hashes: str, opens: str, width: int) -> Column:
    """The hash of every run of ``width`` tokens that holds one of the places ``opens``."""
    last = F.size(hashes) - width
    starts = F.flatten(F.transform(opens, lambda p: F.sequence(F.greatest(p - (width - 1), F.lit(0)), F.least(p, last))))
    runs = F.transform(F.array_distinct(starts), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<long>"))


def _exact_runs(slots: str, values: str, width: int) -> Column:
    """The keys of the runs of placeholders only; ``slots`` has a 1 per token that may be one. Most texts have none."""
    full = F.lit("1" * width)
    starts = F.filter(F.sequence(F.lit(0), F.length(slots) - width), lambda i: F.col(slots).substr(i + 1, F.lit(width)) == full)
    keys = F.transform(starts, lambda i: F.xxhash64(F.lit("="), *[F.get(values, i + k) for k in range(width)]))
    return F.when(F.contains(F.col(slots), full), keys).otherwise(F.array().cast("array<long>"))


def _typed(table: DataFrame, text: str) -> DataFrame:
    """Adds ``raw``, ``values`` and ``types`` of the tokens; types may be open."""
    own = table.withColumn("raw", tokens(F.col(text))).withColumn("values", F.transform("raw", slot_value))
    return own.withColumn("types", F.transform("values", lambda low, i: canonical(F.get("raw", i), low, i)))


def _places(table: DataFrame, keep: list[str], width: int, short: bool, readings: tuple) -> DataFrame:
    """One row per template window and way to read it: ``place``, ``hash`` and its tokens' types and values."""
    read = F.explode(F.array(*[F.transform("types", lambda t, i: _read(t, F.when(i == 0, r[0]).otherwise(r[1])))
                               for r in readings]))
    parts = table.withColumn("types", read).withColumn("_hashes", F.transform("types", lambda t: F.xxhash64(t)))
    return parts.select(*keep, F.posexplode(_windows("_hashes", "values", width, short, "types", "values")).alias("place", "w")).select(
        *keep, "place", "w.*")


def benchmark_windows(benchmark: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """``item, item_id, width, n_windows, place, hash, types, values``: the template windows of every item.

    An item of fewer tokens than ``width`` is one window of its own length; one without tokens has none.
    A window with a capitalised word that starts a sentence or the item has a row for each way to read it.
    """
    own = benchmark.select(F.col(id_column).alias("item_id"), text_or_empty(text_column).alias("text")).distinct()
    typed = _typed(own, "text").withColumn("item", F.xxhash64("item_id", "text")).filter(F.size("raw") > 0)
    parts = None
    for w in range(1, width + 1):
        fits = typed.filter(F.size("raw") == w if w < width else F.size("raw") >= w).withColumns(
            {"width": F.lit(w), "n_windows": (F.size("raw") - (w - 1)).cast("long")})
        part = _places(fits, ["item", "item_id", "width", "n_windows"], w, w < width, _ITEM_READINGS)
        parts = part if parts is None else parts.unionByName(part)
    return parts.distinct()


def _agreeing(windows: DataFrame, line: list[str], place: str) -> DataFrame:
    """The windows of each alignment ``line`` whose slots agree with its mapping, or all have equal values.

    An item value maps to the document value that most windows give it (ties: the equal one, then the last by
    order), and a document name stands for one item name, chosen alike. Windows without slots agree.
    """
    def best(value: str) -> Column:
        return F.struct("votes", "same", value)

    slots = windows.select("*", F.explode_outer("slots").alias("_slot")).select(
        *line, place, "slots", "_slot.*", F.coalesce(F.col("_slot.theirs") == F.col("_slot.ours"), F.lit(True)).alias("same"))
    by_item, by_text = Window.partitionBy(*line, "type", "theirs"), Window.partitionBy(*line, "type", "ours")
    voted = slots.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*line, "type", "theirs", "ours")))
    fits = voted.withColumn("fits", F.col("ours").eqNullSafe(F.max(best("ours")).over(by_item)["ours"]))
    back = F.max(F.when(F.col("fits"), best("theirs"))).over(by_text)["theirs"]
    fits = fits.withColumn("fits", F.col("fits") & (~F.col("type").eqNullSafe("<name>") | F.col("theirs").eqNullSafe(back)))
    return (fits.groupBy(*line, place).agg(F.first("slots").alias("slots"), F.bool_and("fits").alias("fits"), F.bool_and("same").alias("same"))
            .filter("fits or same").drop("fits", "same"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8,
                 id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                 item_text_column: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed`` per contaminated text and item.

    Numbers, names and units become typed placeholders, so an item whose values were replaced
    still gives the same windows of ``width`` tokens. A window of placeholders only, and one of a shorter item
    with fewer than two words, has to have equal values. Windows of documents and items join by hash. The
    matched windows of a text and an item that lie at one offset form an alignment. It maps each item value to
    the document value that most of its windows give, and no two names to one; windows that agree with that or
    have equal values in all slots stay. A capitalised word that starts a sentence, a line or the text matches
    the same word and other names. A text is contaminated by an item if the windows that stay cover at least
    ``coverage`` of the item's windows.
    ``n_slots`` counts the distinct placeholder values met there, ``n_changed`` those with another value.

    A null or empty text or item matches nothing; null ids stay null. Rows of equal id and text count
    once. Other columns are ignored. An empty table on either side gives no rows.
    """
    items, seen = materialise(benchmark_windows(benchmark, width, item_column, item_text_column), "templates")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    keyed = (docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
             .withColumn("text_hash", F.xxhash64("text")))

    # Hashes alone, over all rows; the items' side is broadcast while it is small.
    typed = _typed(keyed, "text").select("doc_id", "text_hash", "values", *[
        F.transform("types", lambda t: F.xxhash64(_read(t, r[1]))).alias(f"read{n}") for n, r in enumerate(_TEXT_READINGS)],
        F.array_compact(F.transform("types", lambda t, i: F.when(t.startswith(_OPENS), i))).alias("opens"),
        F.array_join(F.transform("types", lambda t: F.when(t.startswith("<") | t.startswith(_OPENS), "1").otherwise("0")), "").alias("slots"))
    hashed = None
    for w in widths or [width]:  # usually one; the second and later are for items shorter than a window
        if w < width:
            found = F.concat(*[_windows(f"read{n}", "values", w, True) for n in range(len(_TEXT_READINGS))])
        else:
            # Both readings differ only in the windows of an open type.
            found = F.concat(_runs("read0", w), _open_runs("read1", "opens", w), _exact_runs("slots", "values", w))
        part = typed.select("doc_id", "text_hash", F.lit(w).alias("width"), F.explode(F.array_distinct(found)).alias("hash"))
        part = part if w < width else part.filter(~F.col("hash").isin(_slots_only(w)))
        hashed = part if hashed is None else hashed.unionByName(part)
    known = items.select("width", "hash", "item", "n_windows", "place")
    known = F.broadcast(known) if seen["rows"] <= broadcast_windows else known
    hits = (hashed.join(known, ["width", "hash"]).groupBy("doc_id", "text_hash", "item", "n_windows")
            .agg(F.collect_set("place").alias("places"))
            .filter(F.size("places") >= F.col("n_windows") * coverage - 1e-9).select("doc_id", "text_hash", "item"))
    hits, _ = materialise(hits, "template-hits")

    # The few texts with enough matching windows once more, now with places and slot values.
    texts = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    again = keyed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
                       "left_semi").dropDuplicates(["doc_id", "text_hash"])
    again = _typed(again, "text")
    theirs = None
    for w in widths or [width]:
        part = _places(again, ["doc_id", "text_hash"], w, w < width, _TEXT_READINGS).withColumn("width", F.lit(w))
        theirs = part if theirs is None else theirs.unionByName(part)
    mine = items.select("item", "item_id", "width", "n_windows", F.col("place").alias("item_place"), "hash",
                        F.col("values").alias("item_values"))
    # A text meets the windows of its own items only; those that no item has go before anything is shuffled.
    theirs = theirs.join(mine.select("width", "hash").distinct(), ["width", "hash"], "left_semi")
    wanted = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item").join(mine, "item")
    met = theirs.join(wanted, theirs["doc_id"].eqNullSafe(wanted["_id"]) & (theirs["text_hash"] == wanted["_hash"])
                      & (theirs["width"] == wanted["width"]) & (theirs["hash"] == wanted["hash"])).drop("_id", "_hash")
    pairs = F.filter(F.arrays_zip(F.col("types").alias("type"), F.col("item_values").alias("theirs"),
                                  F.col("values").alias("ours")), lambda s: s["type"].startswith("<"))
    key = ["doc_id", "text_hash", "item", "item_id", "n_windows"]
    # Of the ways to read a window that match, the one with the fewest placeholders counts.
    once = met.withColumn("slots", pairs).groupBy(*key, "item_place", "place").agg(
        F.min(F.struct(F.size("slots").alias("n"), "slots"))["slots"].alias("slots"))
    once = once.withColumn("offset", F.col("place") - F.col("item_place"))
    line = [*key, "offset"]
    kept = _agreeing(once, line, "item_place")
    aligned = kept.groupBy(*line).agg(F.collect_set("item_place").alias("places"),
                                      F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    changed = F.size(F.filter("slots", lambda s: s["theirs"] != s["ours"]))
    return (aligned.withColumn("changed", changed).groupBy(*key)
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"),
                 F.sum(F.size("slots")).cast("long").alias("n_slots"), F.sum("changed").cast("long").alias("n_changed"))
            .filter(F.col("n_matched") >= F.col("n_windows") * coverage - 1e-9)
            .select("doc_id", "text_hash", "item_id", "n_windows", "n_matched", "n_slots", "n_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no benchmark item contaminates; see ``contaminated``."""
    found = contaminated(docs, benchmark, width, coverage, id_column, text_column)
    bad = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(F.struct("*").alias("_row"), F.col(id_column).cast("long").alias("_own_id"),
                      F.xxhash64(text_or_empty(text_column)).alias("_own_hash"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    return own.join(bad, same, "left_anti").select("_row.*")
