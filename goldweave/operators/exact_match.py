"""Matching on equal keys: one pass, and a waterfall of passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import cleansing
from goldweave.operators.skew import attach
from goldweave.session import materialise

# Derived blocking keys a caller may name besides plain columns.
_DERIVED_KEYS = {
    "phone_prefix": lambda c: F.substring(cleansing.digits(c), 1, 3),
    "email_domain": lambda c: F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1))),
    "soundex": cleansing.phonetic_key,
    "clean": cleansing.clean_text,
}


def key_part(spec: str) -> Column:
    """``column`` or ``derivation:column``, with blank values as null."""
    derivation, _, column = spec.rpartition(":")
    if derivation and derivation not in _DERIVED_KEYS:
        raise ValueError(f"unknown key derivation {derivation!r}; known: {sorted(_DERIVED_KEYS)}")
    value = _DERIVED_KEYS[derivation](F.col(column)) if derivation else F.col(column)
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def blocking_key(specs: list[str], stop_values: list[str] | None = None) -> Column:
    """A single text key from its parts; null when any part is null, blank or stop-listed."""
    parts = [key_part(s) for s in specs]
    if stop_values:
        parts = [F.when(~p.isin(*stop_values), p) for p in parts]
    if len(parts) == 1:
        return parts[0]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.to_json(F.array(*parts)))


def digest_key(specs: list[str], stop_values: list[str] | None = None) -> Column:
    """The blocking key as SHA-256, for keys made of long texts."""
    return F.sha2(blocking_key(specs, stop_values), 256)


def exact_groups(df: DataFrame, record_id: str, key: Column) -> DataFrame:
    """Records that share a key with another record: ``record_id, key, group_id, group_size``.

    Ids and keys are written once, so a costly key (a cleaned text, a digest) is computed once,
    and only ids and keys are shuffled. Groups are counted with map-side combine and the counts
    go back to the rows through a join that splits heavy keys: no task holds a whole group.
    """
    keyed, _ = materialise(df.select(record_id, key.alias("key")), "keys")
    return _groups(keyed, record_id, "key")


def _groups(keyed: DataFrame, record_id: str, key: str) -> DataFrame:
    known = keyed.select(record_id, key).filter(F.col(key).isNotNull())
    facts = (known.groupBy(key).agg(F.min(record_id).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
             .filter("group_size > 1"))
    return attach(known, facts, key, F.col(record_id), rows="group_size")


def block_members(df: DataFrame, record_id: str, key: Column) -> DataFrame:
    """Block membership as a star: every record with its block's smallest id and size.

    The pairs of a block are implied (``size·(size−1)/2`` of them) and never written out.
    """
    keyed = df.select(record_id, key.alias("key")).filter(F.col("key").isNotNull())
    facts = keyed.groupBy("key").agg(F.min(record_id).alias("block_id"), F.count(F.lit(1)).alias("block_size"))
    return attach(keyed, facts, "key", F.col(record_id), rows="block_size")


def waterfall(df: DataFrame, record_id: str, passes: list[dict]) -> DataFrame:
    """Run passes in order; rows a pass matches take no part in later ones.

    Each pass is ``{name, blocking_key: [specs], method, stop_values}``. Returns one row per
    input record: ``record_id, cluster_id, matched_by``; ``cluster_id`` is the smallest record
    id of the group as text, and a row no pass matches is its own cluster.
    """
    for p in passes:
        if p.get("method", "exact") != "exact":
            raise ValueError(f"pass {p['name']!r}: the waterfall takes exact passes; "
                             "use hybrid_clusters for fuzzy ones")
    names = {f"_k{i}": blocking_key(_as_list(p["blocking_key"]), p.get("stop_values"))
             for i, p in enumerate(passes)}
    remaining, _ = materialise(df.select(record_id, *[k.alias(n) for n, k in names.items()]), "keys")
    found: list[DataFrame] = []
    for i, p in enumerate(passes):
        matched = _groups(remaining, record_id, f"_k{i}").select(
            record_id, F.col("group_id").alias("_cluster"), F.lit(p["name"]).alias("matched_by"))
        # Later passes read the matches and what is left of the records: both are written once.
        matched, _ = materialise(matched, "waterfall")
        left = remaining.join(matched.select(record_id), record_id, "left_anti")
        remaining = materialise(left, "waterfall-left")[0] if i + 1 < len(passes) else left
        found.append(matched)
    # A row left over after all passes is its own cluster.
    single = remaining.select(record_id, F.col(record_id).alias("_cluster"),
                              F.lit(None).cast("string").alias("matched_by"))
    everything = reduce(DataFrame.unionByName, found + [single])
    return everything.select(record_id, F.col("_cluster").cast("string").alias("cluster_id"), "matched_by")


def _as_list(spec) -> list[str]:
    return [spec] if isinstance(spec, str) else list(spec)


def golden_id(cluster_id: str | Column) -> Column:
    """Stable id of a golden record from its cluster's smallest source key."""
    c = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    return F.sha2(c.cast("string"), 256)


def link_sources(records: DataFrame, reference: DataFrame, record_id: str, reference_id: str,
                 key: Column, reference_key: Column) -> DataFrame:
    """Match input records against a reference source on a key.

    One row per input record with a hit: ``record_id, reference_id, reference_count``. The
    reference is reduced to one row per key first, so a key that is frequent on both sides
    does not multiply.
    """
    ref = (reference.select(F.col(reference_id), reference_key.alias("key")).filter(F.col("key").isNotNull())
           .groupBy("key").agg(F.min(reference_id).alias(reference_id), F.count(F.lit(1)).alias("reference_count")))
    keyed = records.select(record_id, key.alias("key")).filter(F.col("key").isNotNull())
    load = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("records"))
    return attach(keyed, ref.join(load, "key"), "key", F.col(record_id), rows="records").drop("records")
