"""From several sources to golden records: ingest, cleanse, align, match, survive, publish, audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.operators.audit import append_events, stage_event
from goldweave.operators.exact_match import golden_id, waterfall
from goldweave.operators.masking import apply_policy
from goldweave.operators.matching import fuzzy_clusters
from goldweave.operators.normalize import INGEST_TIME, SOURCE, align_union
from goldweave.operators.review import apply_decisions
from goldweave.operators.ruleset import apply_rules, apply_ruleset
from goldweave.operators.survivorship import golden_fields, golden_rows, trust_of
from goldweave.session import materialise
from goldweave.sources.readers import ingest
from goldweave.sources.writers import export_csv, publish

RECORD_ID = "record_id"
COPIES = "copies"


@dataclass
class GoldenPlan:
    """What to do with the sources; everything a run needs is declared here.

    A pass is ``{name, blocking_key, stop_values}`` (equal keys) or also has ``method`` (jaro_winkler or
    edit_distance), ``column`` and ``threshold``: similar values inside the block. ``attributes`` asks
    for the best value per attribute under ``strategy`` instead of the best record. ``masking`` maps
    columns to actions taken before anything is published.
    """

    passes: list[dict]
    trust: dict[str, float]
    rules: dict[str, str] = field(default_factory=dict)
    ruleset: dict | None = None
    roles: dict[str, str] = field(default_factory=dict)
    recency: str | None = None
    key: list[str] | None = None
    attributes: list[str] | None = None
    strategy: dict = field(default_factory=lambda: {"primary": "Source Priority", "fallback": "Completeness"})
    masking: dict[str, str] = field(default_factory=dict)
    salt: str = ""


def identify(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Add a record id that is the same in every run, and different for different records.

    Exact repeats within a source are one record with a count (``copies``). The id is the source and the
    key as a JSON array; the digest of the record where the key has a null part or there is no
    key; and both where several different records of a source share a key.
    """
    content = [c for c in df.columns if c != INGEST_TIME]
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    once = df.groupBy(*content).agg(F.count(F.lit(1)).alias(COPIES), F.max(INGEST_TIME).alias(INGEST_TIME))
    if not key:
        return once.withColumn(RECORD_ID, digest)
    parts = [F.col(c).cast("string") for c in (SOURCE, *key)]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    named = once.withColumns({"_digest": digest, "_key": F.when(whole, F.to_json(F.array(*parts)))})
    shared = named.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_key is not null and _n > 1")
    both = F.to_json(F.array(*parts, F.col("_digest")))
    return (named.join(shared, "_key", "left")
            .withColumn(RECORD_ID, F.when(F.col("_key").isNull(), F.col("_digest"))
                        .when(F.col("_n").isNotNull(), both).otherwise(F.col("_key")))
            .drop("_key", "_n", "_digest"))


def combine(frames: list[DataFrame], plan: GoldenPlan) -> DataFrame:
    """Cleansed, aligned records with their ids. The frames carry the ingestion columns."""
    cleansed = [apply_rules(f, {c: r for c, r in plan.rules.items() if c in f.columns}) for f in frames]
    aligned = align_union(cleansed)
    if plan.ruleset is not None:
        kept = [c for c in aligned.columns if c not in (SOURCE, INGEST_TIME)]
        done = apply_ruleset(aligned.select(F.struct(SOURCE, INGEST_TIME).alias("_meta"), *kept), plan.ruleset, plan.roles)
        aligned = done.select("*", "_meta.*").drop("_meta")
    return identify(aligned, plan.key)


def _fuzzy(p: dict) -> bool:
    return p.get("method", "exact") != "exact"


def cluster(records: DataFrame, plan: GoldenPlan) -> DataFrame:
    """Records with ``cluster_id`` and ``matched_by``; rows a pass matches take no part in later ones."""
    if not any(_fuzzy(p) for p in plan.passes):
        return records.join(waterfall(records, RECORD_ID, plan.passes), RECORD_ID)
    remaining, found = records, None
    for p in plan.passes:
        if _fuzzy(p):
            blocks = p["blocking_key"] if isinstance(p["blocking_key"], list) else [p["blocking_key"]]
            groups = fuzzy_clusters(remaining, RECORD_ID, blocks, p["column"], p.get("threshold", 0.85), p["method"],
                                    stop_values=p.get("stop_values"), phonetic=p.get("phonetic"))
            sizes = groups.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            matched = groups.join(sizes, "cluster_id").select(RECORD_ID, "cluster_id", F.lit(p["name"]).alias("matched_by"))
        else:
            matched = waterfall(remaining, RECORD_ID, [p]).filter(F.col("matched_by").isNotNull())
        matched, _ = materialise(matched, "golden-pass")
        remaining, _ = materialise(remaining.join(matched.select(RECORD_ID), RECORD_ID, "left_anti"), "golden-left")
        found = matched if found is None else found.unionByName(matched)
    single = remaining.select(RECORD_ID, F.col(RECORD_ID).alias("cluster_id"), F.lit(None).cast("string").alias("matched_by"))
    return records.join(found.unionByName(single), RECORD_ID)


def survive(clustered: DataFrame, plan: GoldenPlan) -> DataFrame:
    """One golden row per cluster with a stable id: the best record, or the best value per attribute."""
    rated = clustered.withColumn("trust", trust_of(plan.trust))
    if plan.attributes:
        best = golden_fields(rated, "cluster_id", RECORD_ID, plan.attributes, plan.strategy, None, "trust", plan.recency)
    else:
        best = golden_rows(rated, "cluster_id", RECORD_ID, "trust", plan.recency)
    return best.withColumn("golden_id", golden_id("cluster_id"))


def _masked(df: DataFrame, plan: GoldenPlan) -> DataFrame:
    policy = {c: a for c, a in plan.masking.items() if c in df.columns}
    return apply_policy(df, policy, plan.salt) if policy else df


def run(spark: SparkSession, sources: list[dict], plan: GoldenPlan, out: str, decisions: DataFrame | None = None,
        proposals: DataFrame | None = None) -> dict[str, int]:
    """The whole run. Writes ``clusters`` and ``golden`` as parquet, ``golden_csv`` and ``audit``
    below ``out``; returns the row counts of the stages, taken while they are written.

    ``decisions`` of the review split rejected clusters and merge approved proposals before records
    survive. Columns with a masking action are masked in everything that is published.
    """
    audit = f"{out}/audit"

    def log(module: str, action: str, details: dict, status: str = "SUCCESS") -> None:
        append_events(stage_event(spark, module, action, status, details), audit)

    try:
        records, seen = materialise(combine([ingest(spark, s) for s in sources], plan), "records")
        counts = {"records": seen["rows"]}
        log("records", "combine", {"total_records": counts["records"]})
        clusters = cluster(records, plan)
        if decisions is not None:
            clusters = apply_decisions(clusters, decisions, RECORD_ID, proposals=proposals)
        clusters, seen = materialise(clusters, "clusters", matched=F.count("matched_by"))
        publish(_masked(clusters, plan), f"{out}/clusters", mode="overwrite")
        counts["clustered_records"] = seen["matched"]
        log("records", "cluster", {"clustered_records": counts["clustered_records"]})
        golden, seen = materialise(_masked(survive(clusters, plan), plan), "golden")
        publish(golden, f"{out}/golden", mode="overwrite")
        counts["golden_records"] = seen["rows"]
        export_csv(golden, f"{out}/golden_csv")
        log("records", "survive", {"golden_records": counts["golden_records"]})
        return counts
    except Exception as error:
        log("records", "run", {"error": str(error)}, "FAILED")
        raise
