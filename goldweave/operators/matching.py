"""Fuzzy, cascaded and hybrid matching; score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.similarity import jaro_winkler
from goldweave.operators.components import assign_clusters, connected_components
from goldweave.operators.exact_match import exact_groups, key_part
from goldweave.operators.similarity_join import blocked_value_pairs, similar_by_jaro_winkler, value_members
from goldweave.operators.skew import attach
from goldweave.session import materialise

# Fixed values: (auto, review) thresholds of the three presets, closed below.
BAND_PRESETS = {
    "config": (0.85, 0.70),
    "resolution": (0.95, 0.80),
    "review": (0.90, 0.70),
}
DEFAULT_THRESHOLD = 0.85


def band(score: Column, auto: float, review: float) -> Column:
    return F.when(score >= auto, "AUTO_MERGE").when(score >= review, "REVIEW").when(score.isNotNull(), "NO_MATCH")


def preset_band(score: Column, preset: str = "config") -> Column:
    if preset not in BAND_PRESETS:
        raise ValueError(f"unknown band preset {preset!r}; known: {sorted(BAND_PRESETS)}")
    return band(score, *BAND_PRESETS[preset])


def band_action(label: Column) -> Column:
    """What happens to a pair in a band; a pair without a match leads to a new golden id."""
    return (F.when(label == "AUTO_MERGE", "merge into golden record")
            .when(label == "REVIEW", "send to steward").when(label == "NO_MATCH", "create new golden id"))


def strictness(threshold: Column) -> Column:
    """Below 0.5 lenient, below 0.8 moderate, else strict."""
    return F.when(threshold < 0.5, "lenient").when(threshold < 0.8, "moderate").otherwise("strict")


def band_summary(totals: DataFrame) -> DataFrame:
    """``band, n, percent, action`` from the counts per band (see ``band_totals``); bands without pairs stay."""
    total = F.sum("n").over(Window.partitionBy())  # over one row per band
    return totals.select("band", "n", (F.col("n") * 100.0 / F.nullif(total, F.lit(0))).alias("percent"),
                         band_action(F.col("band")).alias("action"))


def cascade(pairs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Ordered rules over scored pairs: the first rule that holds gives its name; others go."""
    rule = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])
    return pairs.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def weighted_score(fields: dict[str, float]) -> Column:
    """Weighted mean of the scores in columns ``score_<field>``; null scores drop out."""
    parts = [(F.col(f"score_{f}"), w) for f, w in fields.items()]
    top = reduce(lambda a, b: a + b, [F.coalesce(s * w, F.lit(0.0)) for s, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts])
    return top / F.nullif(weight, F.lit(0.0))


def similar_by_weighted_fields(df: DataFrame, blocks: list[str], primary: tuple[str, float],
                               secondary: tuple[str, float], threshold: float) -> DataFrame:
    """Pairs of distinct ``(primary, secondary)`` values in a block whose weighted mean
    Jaro-Winkler reaches ``threshold``.

    The mean is over the fields both sides know. Where both are known, a mean of at least t with
    weights w and 1 − w bounds the primary score from below by 1 − (1 − t)/w, so pairs with
    different primaries come from the similarity join at that bound, and pairs with equal primaries
    need a secondary score of (t − w)/(1 − w). A bound too low for the similarity join leaves the block
    alone (or block and primary) as the join key. Where only one field is known to both, that field
    has to reach the threshold by itself. Rows without any field, or without a block, match nothing.
    """
    (p, wp), (s, ws) = primary, secondary
    w = wp / (wp + ws)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in blocks]) if blocks else F.lit(True)
    blank = {c: F.when(F.col(c) != "", F.col(c)) for c in (p, s)}
    tuples = (df.select(*blocks, p, s).filter(known).withColumns(blank)
              .filter(F.col(p).isNotNull() | F.col(s).isNotNull()).distinct())
    full = tuples.filter(F.col(p).isNotNull() & F.col(s).isNotNull())

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*blocks, F.col(p).alias(f"{p}_{name}"), F.col(s).alias(f"{s}_{name}"))

    def score_of(field: str) -> Column:
        a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
        return F.when(a == b, 1.0).otherwise(F.round(jaro_winkler(f"{field}_a", f"{field}_b"), 6))

    # Both fields known, different primaries.
    bound = 1 - (1 - threshold) / w
    if bound >= 0.4:
        names = similar_by_jaro_winkler(full, p, bound, blocks)
        names = names.select(*blocks, F.col("value_a").alias(f"{p}_a"), F.col("value_b").alias(f"{p}_b"),
                             F.col("score").alias(f"score_{p}"))
        differ = names.join(side(full, "a"), [*blocks, f"{p}_a"]).join(side(full, "b"), [*blocks, f"{p}_b"])
    else:
        differ = (side(full, "a").join(side(full, "b"), blocks).filter(F.col(f"{p}_a") < F.col(f"{p}_b"))
                  .withColumn(f"score_{p}", score_of(p)))
    differ = differ.withColumn(f"score_{s}", score_of(s))
    # Both fields known, equal primaries.
    rest = (threshold - w) / (1 - w)
    if rest >= 0.4:
        inner = similar_by_jaro_winkler(full, s, rest, [*blocks, p])
        equal = inner.select(*blocks, F.col(p).alias(f"{p}_a"), F.col(p).alias(f"{p}_b"), F.col("value_a").alias(f"{s}_a"),
                             F.col("value_b").alias(f"{s}_b"), F.lit(1.0).alias(f"score_{p}"),
                             F.col("score").alias(f"score_{s}"))
    else:
        left = side(full, "a").withColumn(f"{p}_b", F.col(f"{p}_a"))
        equal = (left.join(side(full, "b"), [*blocks, f"{p}_b"]).filter(F.col(f"{s}_a") < F.col(f"{s}_b"))
                 .withColumns({f"score_{p}": F.lit(1.0), f"score_{s}": score_of(s)}))
    out = differ.unionByName(equal, allowMissingColumns=True)
    for field, other in ((p, s), (s, p)):
        out = out.unionByName(_by_one_field(tuples, blocks, field, other, threshold), allowMissingColumns=True)
    return (out.withColumn("score", F.round(weighted_score({p: w, s: 1 - w}), 6)).filter(F.col("score") >= threshold)
            .select(*blocks, f"{p}_a", f"{s}_a", f"{p}_b", f"{s}_b", f"score_{p}", f"score_{s}", "score"))


def _by_one_field(tuples: DataFrame, blocks: list[str], field: str, other: str, threshold: float) -> DataFrame:
    """Pairs whose ``field`` is known to both and whose ``other`` is not: similar or equal in ``field``."""
    known = tuples.filter(F.col(field).isNotNull())
    similar = _value_pairs(known, field, threshold, blocks).select(
        *blocks, F.col("value_a").alias(f"{field}_a"), F.col("value_b").alias(f"{field}_b"), F.col("score").alias(f"score_{field}"))
    a = known.select(*blocks, F.col(field).alias(f"{field}_a"), F.col(other).alias(f"{other}_a"))
    b = known.select(*blocks, F.col(field).alias(f"{field}_b"), F.col(other).alias(f"{other}_b"))
    lacking = F.col(f"{other}_a").isNull() | F.col(f"{other}_b").isNull()
    differ = similar.join(a, [*blocks, f"{field}_a"]).join(b, [*blocks, f"{field}_b"]).filter(lacking)
    # Equal in the field: the one tuple that lacks the other field against those that have it.
    bare = known.filter(F.col(other).isNull()).select(*blocks, F.col(field).alias(f"{field}_b"))
    rich = a.filter(F.col(f"{other}_a").isNotNull()).withColumn(f"{field}_b", F.col(f"{field}_a"))
    equal = rich.join(bare, [*blocks, f"{field}_b"]).withColumns(
        {f"{other}_b": F.lit(None).cast("string"), f"score_{field}": F.lit(1.0)})
    return differ.unionByName(equal).withColumn(f"score_{other}", F.lit(None).cast("double"))


def _value_pairs(known: DataFrame, field: str, threshold: float, blocks: list[str]) -> DataFrame:
    """Pairs of distinct values of a block that reach the threshold. Below what the similarity join can use, the block
    alone is the key: then nearly all of its pairs are wanted."""
    if threshold >= 0.4:
        return similar_by_jaro_winkler(known, field, threshold, blocks)
    values = known.select(*blocks, F.col(field).alias("v")).distinct()
    a, b = (values.withColumnRenamed("v", f"value_{side}") for side in ("a", "b"))
    pairs = a.join(b.hint("merge"), blocks).filter("value_a < value_b")
    return pairs.withColumn("score", F.round(jaro_winkler("value_a", "value_b"), 6)).filter(F.col("score") >= threshold)


def similar_by_fields(df: DataFrame, keys: list[str], fields: dict[str, float], threshold: float) -> DataFrame:
    """Pairs of distinct rows that share one of several keys and whose weighted mean Jaro-Winkler reaches ``threshold``.

    ``keys`` are alternatives: a column or a derivation (``soundex:last_name``, ``email_domain:email``). ``fields`` gives
    any number of fields and their weights; the mean is over those both sides know. Returns ``matched_key``, each field
    as ``<field>_a`` and ``<field>_b``, ``score_<field>`` and ``score``; rows are compared as the values they hold.

    A pair is formed once: in the first key it shares and by the first field, from the heaviest on, that both
    know. With weights w that add up to W from that field on, a mean of t asks for 1 − (1 − t)·W/w in the
    field, so its different values come from the similarity join inside the key at that bound, and its equal
    ones from an equi-join on key and value. Rows without a key or a field match nothing.
    """
    order = sorted(fields, key=lambda f: (-fields[f], f))
    names = [f"_key{k}" for k in range(len(keys))]
    blank = {f: F.nullif(F.col(f).cast("string"), F.lit("")) for f in order}
    rows = df.select(*[key_part(k).alias(n) for k, n in zip(keys, names)], *[c.alias(f) for f, c in blank.items()]).distinct()
    rows, _ = materialise(rows.withColumn("_node", F.monotonically_increasing_id()), "field-rows")
    placed = rows.select("*", F.posexplode(F.array(*names)).alias("_at", "_key")).filter(F.col("_key").isNotNull())

    def side(by: str, name: str) -> DataFrame:
        return placed.filter(F.col(by).isNotNull()).select("_at", "_key", *[F.col(c).alias(f"{c}_{name}") for c in ("_node", *names, *order)])

    def score_of(field: str) -> Column:
        a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
        return F.when(a == b, 1.0).otherwise(F.round(jaro_winkler(a, b), 6))

    out, tasks = None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n, field in enumerate(order):
        heaviest = sum(fields[f] for f in order[n:])
        bound = 1 - (1 - threshold) * heaviest / fields[field]
        a, b = side(field, "a"), side(field, "b")
        values = _value_pairs(placed.filter(F.col(field).isNotNull()), field, bound, ["_at", "_key"]).select(
            "_at", "_key", F.col("value_a").alias(f"{field}_a"), F.col("value_b").alias(f"{field}_b"), F.col("score").alias(f"score_{field}"))
        differ = values.join(a, ["_at", "_key", f"{field}_a"]).join(b, ["_at", "_key", f"{field}_b"])
        # The pairs are many times the rows, which adaptive execution does not see: a number of its own keeps all tasks.
        same_a, same_b = (rows.withColumn("_same", F.col(f"{field}_{s}")).repartition(tasks, "_at", "_key", "_same") for rows, s in ((a, "a"), (b, "b")))
        equal = (same_a.join(same_b.hint("merge"), ["_at", "_key", "_same"])
                 .filter("_node_a < _node_b").drop("_same").withColumn(f"score_{field}", F.lit(1.0)))
        met = differ.unionByName(equal)
        for earlier in order[:n]:  # formed by an earlier field if both know one
            met = met.filter(F.col(f"{earlier}_a").isNull() | F.col(f"{earlier}_b").isNull())
        for k, name in enumerate(names):  # formed in an earlier key if both share one
            met = met.filter((F.col("_at") <= k) | ~F.coalesce(F.col(f"{name}_a") == F.col(f"{name}_b"), F.lit(False)))
        met = met.withColumns({f"score_{f}": score_of(f) for f in order if f != field})
        out = met if out is None else out.unionByName(met)
    label = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("_at") + 1)
    return (out.withColumn("score", F.round(weighted_score(fields), 6)).filter(F.col("score") >= threshold)
            .select(label.alias("matched_key"), *[f"{f}_{s}" for f in order for s in ("a", "b")], *[f"score_{f}" for f in order], "score"))


def cascade_candidates(members: DataFrame, blocks: list[str], threshold: float, keys: dict[str, Column]) -> DataFrame:
    """Scored pairs for ``cascade``: every pair that some rule can take.

    Rules on the score need the pairs from the lowest score they accept; a rule on an equal key
    (``keys``: a name and an expression over ``value``) needs the pairs of values in a block with that key.
    Each source is an equi-join of its own, so no rule loses a pair to another rule's threshold.
    """
    out = blocked_value_pairs(members, blocks, threshold)
    for key in keys.values():
        keyed = members.withColumn("_key", key).filter(F.col("_key").isNotNull())
        a, b = (keyed.select(*blocks, "_key", *[F.col(c).alias(f"{c}_{side}") for c in ("value", "rep", "n")])
                for side in ("a", "b"))
        same = a.join(b, [*blocks, "_key"]).filter(F.col("value_a") < F.col("value_b")).drop("_key")
        out = out.unionByName(same.withColumn("score", F.round(jaro_winkler("value_a", "value_b"), 6)))
    return out.dropDuplicates([*blocks, "value_a", "value_b"])


def with_blocks(df: DataFrame, specs: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for every derived block (``phone_prefix:phone``), and the block columns' names."""
    names = [spec.replace(":", "_of_") for spec in specs]
    derived = {n: key_part(spec) for n, spec in zip(names, specs) if ":" in spec}
    return (df.withColumns(derived) if derived else df), names


def _without_placeholders(df: DataFrame, blocks: list[str], stop_values: list[str] | None) -> DataFrame:
    if not stop_values:
        return df
    return df.withColumns({b: F.when(~F.col(b).cast("string").isin(*stop_values), F.col(b)) for b in blocks})


def fuzzy_clusters(df: DataFrame, record_id: str, blocks: list[str], column: str,
                   threshold: float = DEFAULT_THRESHOLD, algorithm: str = "jaro_winkler",
                   dictionary: bool = False, stop_values: list[str] | None = None, phonetic: str | None = None) -> DataFrame:
    """Cluster records whose values are similar inside a block: ``record_id, cluster_id``.

    A block is a column or a derivation of one (``email_domain:email``). ``phonetic`` names a column whose
    equal Soundex is another way into the comparison: records outside a common block that
    sound alike there are compared too.

    The graph has one node per block and value, so its size does not depend on how many
    records share a value. Placeholders in ``stop_values`` make no block.
    """
    if phonetic:
        edges = similar_edges(df, record_id, blocks, column, threshold, algorithm, stop_values, phonetic)
        return assign_clusters(df, record_id, edges)
    df, blocks = with_blocks(df, blocks)
    df = _without_placeholders(df, blocks, stop_values)
    # Both sides of the pairs and the labels read the members: write this reduction once.
    members, _ = materialise(value_members(df, record_id, blocks, column), "members")
    pairs = blocked_value_pairs(members, blocks, threshold, algorithm, dictionary)
    parts = connected_components(pairs.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    labelled = (members.join(parts, members["rep"] == parts["node"], "left")
                .select(*blocks, F.col("value").alias(column), "n", F.coalesce("component", "rep").alias("_cluster")))
    keys = [*blocks, column]
    slim = df.select(record_id, *keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.col(column) != "")
    clustered = attach(slim.filter(known), labelled, keys, F.col(record_id)).select(record_id, "_cluster")
    # A record without a block or a value matches nothing and is its own cluster.
    single = slim.filter(~F.coalesce(known, F.lit(False))).select(record_id, F.col(record_id).alias("_cluster"))
    return clustered.unionByName(single).select(record_id, F.col("_cluster").cast("string").alias("cluster_id"))


def similar_edges(df: DataFrame, record_id: str, blocks: list[str], column: str, threshold: float = DEFAULT_THRESHOLD,
                  algorithm: str = "jaro_winkler", stop_values: list[str] | None = None,
                  phonetic: str | None = None) -> DataFrame:
    """Edges ``src, dst, score`` between records of similar value that share the blocks or, with
    ``phonetic``, the Soundex of that column. Records of equal value are a star around the smallest id."""
    ways = [blocks] if not phonetic else [blocks, [f"soundex:{phonetic}"]]
    out = None
    for way in ways:
        rows, names = with_blocks(df, way)
        rows = _without_placeholders(rows, names, stop_values)
        members, _ = materialise(value_members(rows, record_id, names, column), "members")
        slim = rows.select(record_id, *names, F.col(column).alias("value"))
        equal = (attach(slim, members.filter("n > 1"), [*names, "value"], F.col(record_id))
                 .select(F.col("rep").alias("src"), F.col(record_id).alias("dst"), F.lit(1.0).alias("score")))
        similar = blocked_value_pairs(members, names, threshold, algorithm).select(
            F.least("rep_a", "rep_b").alias("src"), F.greatest("rep_a", "rep_b").alias("dst"), "score")
        edges = equal.unionByName(similar).filter("src <> dst")
        out = edges if out is None else out.unionByName(edges)
    return out


def hybrid_edges(df: DataFrame, record_id: str, identifier: Column, blocks: list[str], column: str,
                 threshold: float = DEFAULT_THRESHOLD, algorithm: str = "jaro_winkler",
                 stop_values: list[str] | None = None, phonetic: str | None = None) -> DataFrame:
    """Edges of "same identifier, or same block and similar value", with the best score per pair.

    Records are tied to the smallest id of their identifier group and of their block and value,
    and these smallest ids are tied to each other where the values are similar: a number of
    edges linear in the records plus the similar values.
    """
    by_identifier = exact_groups(df, record_id, identifier).select(
        F.col("group_id").alias("src"), F.col(record_id).alias("dst"), F.lit(1.0).alias("score"))
    similar = similar_edges(df, record_id, blocks, column, threshold, algorithm, stop_values, phonetic)
    edges = by_identifier.unionByName(similar).filter("src <> dst")
    return edges.groupBy("src", "dst").agg(F.max("score").alias("score"))


def hybrid_clusters(df: DataFrame, record_id: str, identifier: Column, blocks: list[str], column: str,
                    threshold: float = DEFAULT_THRESHOLD, algorithm: str = "jaro_winkler",
                    stop_values: list[str] | None = None, phonetic: str | None = None) -> DataFrame:
    """Clusters over ``hybrid_edges``; every record exactly once."""
    edges = hybrid_edges(df, record_id, identifier, blocks, column, threshold, algorithm, stop_values, phonetic)
    return assign_clusters(df, record_id, edges)
