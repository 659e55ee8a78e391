"""The steward's review: queue, discrepancies, confidence, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from goldweave.operators.components import connected_components
from goldweave.operators.skew import attach
from goldweave.operators.survivorship import descending

# Final decisions, the deferral, and the confidence formula.
APPROVED, REJECTED, DEFERRED = "Match Approved", "Match Rejected", "Deferred"
FINAL_ACTIONS = (APPROVED, REJECTED)
CONFIDENCE_TOP, CONFIDENCE_STEP, CONFIDENCE_FLOOR = 0.99, 0.08, 0.50


def is_final(action: str = "action") -> Column:
    return F.col(action).isin(*FINAL_ACTIONS)


def decided_ids(decisions: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters with a final decision; a deferral does not count."""
    return decisions.filter(is_final()).select(cluster).distinct()


def exclude_decided(df: DataFrame, decisions: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Rows of clusters without a final decision.

    An anti-join with one row per decided cluster on the right; adaptive execution splits a
    heavy cluster on the left.
    """
    return df.join(decided_ids(decisions, cluster), cluster, "left_anti")


def review_queue(df: DataFrame, decisions: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Undecided clusters with more than one record: ``cluster, records``.

    Counted first, so the anti-join sees one row per cluster on both sides.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("records")).filter("records > 1")
    return exclude_decided(sizes, decisions, cluster)


def _norm(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(col.cast("string"))), F.lit(""))


def discrepancies(df: DataFrame, fields: list[str], cluster: str = "cluster_id") -> DataFrame:
    """One flag per field: more than one distinct non-blank value, ignoring case and outer space.

    Smallest and largest value differ exactly when there is more than one, so a distinct count
    is not needed.
    """
    flags = [F.coalesce(F.min(_norm(f)) != F.max(_norm(f)), F.lit(False)).alias(f"{f}_differs") for f in fields]
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("records"), *flags)


def ambiguous_clusters(df: DataFrame, fields: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Clusters with any discrepancy and the names of the fields that differ."""
    flagged = discrepancies(df, fields, cluster)
    names = F.concat_ws(",", *[F.when(F.col(f"{f}_differs"), F.lit(f)) for f in fields])
    return flagged.select(cluster, names.alias("differing")).filter("differing <> ''")


def reference_records(df: DataFrame, record_id: str, confidence: str, cluster: str = "cluster_id") -> DataFrame:
    """The record with the highest confidence per cluster; ties go to the smallest id."""
    others = [c for c in df.columns if c != cluster]
    best = F.max_by(F.struct(*others), F.struct(F.col(confidence), descending(df, record_id).alias("id")))
    return df.groupBy(cluster).agg(best.alias("_r"), F.count(F.lit(1)).alias("n")).select(
        cluster, "n", *[F.col(f"_r.{c}").alias(c) for c in others])


def differs(value: Column, truth: Column) -> Column:
    """True where both sides are non-blank and differ, ignoring case and outer space."""
    return F.coalesce(_norm(value) != _norm(truth), F.lit(False))


def pair_conflicts(df: DataFrame, fields: list[str], record_id: str, confidence: str,
                   cluster: str = "cluster_id") -> DataFrame:
    """Every record against its cluster's reference, field by field.

    The reference is one row per cluster; a heavy cluster's rows are spread by the join.
    """
    ref = reference_records(df, record_id, confidence, cluster).select(
        cluster, "n", F.col(record_id).alias("reference_id"), *[F.col(f).alias(f"_ref_{f}") for f in fields])
    both = attach(df, ref, cluster, F.col(record_id))
    flags = [differs(F.col(f), F.col(f"_ref_{f}")).alias(f"{f}_conflict") for f in fields]
    return both.select(cluster, record_id, "reference_id", *flags)


def confidence_score(differences: Column) -> Column:
    """0.99 less 0.08 per differing field, at least 0.50, two decimals."""
    return F.round(F.greatest(F.lit(CONFIDENCE_FLOOR), CONFIDENCE_TOP - differences * CONFIDENCE_STEP), 2)


def count_differences(fields: list[str], truth_prefix: str = "truth_") -> Column:
    """Differing fields of a record against its truth; null or ``none`` on either side is none."""
    def one(f: str) -> Column:
        # Empty text is a value here, unlike in the conflict view.
        value, truth = (F.lower(F.trim(F.col(c).cast("string"))) for c in (f, f"{truth_prefix}{f}"))
        known = (value != "none") & (truth != "none")
        return F.coalesce((value != truth) & known, F.lit(False)).cast("int")
    return reduce(lambda a, b: a + b, [one(f) for f in fields])


def match_grade(score: Column) -> Column:
    """Grade of a confidence in [0, 1]. Fixed values on the percent scale: from 90, from 70."""
    percent = F.floor(F.round(score * 100, 6))
    return (F.when(percent >= 90, "Auto-Match").when(percent >= 70, "Review Requested")
            .when(percent.isNotNull(), "Conflict Detected"))


def comparison_matrix(df: DataFrame, fields: list[str], sources: list[str], record_id: str, source: str,
                      cluster: str = "cluster_id") -> DataFrame:
    """Attribute rows by source columns with a conflict flag.

    A source's value is that of its first record in the cluster. The source list is given, so
    the pivot needs no job to find it.
    """
    first = F.min_by(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), F.col(record_id))
    per_source = df.filter(F.col(source).isin(*sources)).groupBy(cluster, source).agg(first.alias("r"))
    cells = [F.struct(F.lit(f).alias("attribute"), F.col(f"r.{f}").alias("value")) for f in fields]
    long = per_source.select(cluster, source, F.inline(F.array(*cells)))
    values = [F.max(F.when(F.col(source) == s, F.col("value"))).alias(s) for s in sources]
    conflict = F.coalesce(F.min(_norm("value")) != F.max(_norm("value")), F.lit(False)).alias("conflict")
    return long.groupBy(cluster, "attribute").agg(*values, conflict)


# Decisions ------------------------------------------------------------------

def decision_rows(df: DataFrame, cluster: str, action: Column, user: Column, at: Column, comments: Column,
                  payload_fields: list[str]) -> DataFrame:
    """Rows for the decision table; an approval carries the golden record as JSON of strings."""
    body = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in payload_fields]),
                     {"ignoreNullFields": "false"})
    return df.select(at.alias("timestamp"), F.col(cluster).cast("string").alias("cluster_id"), action.alias("action"),
                     user.alias("user"), comments.alias("comments"),
                     F.when(action == APPROVED, body).alias("resolved_data"))


def append_decisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_decisions(decisions: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The last final decision per cluster; on equal times a rejection wins."""
    return (decisions.filter(is_final()).groupBy(cluster)
            .agg(F.max_by("action", F.struct("timestamp", "action")).alias("action")))


def apply_decisions(df: DataFrame, decisions: DataFrame, record_id: str, cluster: str = "cluster_id",
                    proposals: DataFrame | None = None) -> DataFrame:
    """Split rejected clusters into single records, and merge what approved proposals say.

    ``proposals`` has ``proposal, a, b``: pairs of clusters sent to review under the id that decisions
    name. An approved pair makes one cluster of the two (and of whatever else is tied to them), named
    after the smallest of the cluster ids as text. A rejected proposal changes nothing. A
    cluster that is rejected itself is split and takes part in no merge.
    """
    latest = latest_decisions(decisions, cluster)
    rejected = latest.filter(F.col("action") == REJECTED).select(F.col(cluster).cast("string").alias("_rejected"))
    named = df.withColumn(cluster, F.col(cluster).cast("string"))
    split = rejected.withColumn("_split", F.lit(True))
    out = named.join(split, named[cluster] == F.col("_rejected"), "left").drop("_rejected")
    if proposals is not None:
        approved = latest.filter(F.col("action") == APPROVED).select(F.col(cluster).cast("string").alias("_approved"))
        pairs = proposals.select(F.col("proposal").cast("string").alias("_proposal"), F.col("a").cast("string").alias("src"),
                                 F.col("b").cast("string").alias("dst"))
        pairs = pairs.join(approved, F.col("_proposal") == F.col("_approved"), "left_semi")
        for end in ("src", "dst"):
            pairs = pairs.join(rejected, F.col(end) == F.col("_rejected"), "left_anti")
        merged = connected_components(pairs.select("src", "dst"))
        out = (out.join(merged, out[cluster] == merged["node"], "left")
               .withColumn(cluster, F.coalesce("component", cluster)).drop("node", "component"))
    own = F.col(record_id).cast("string")
    return out.withColumn(cluster, F.when(F.col("_split"), own).otherwise(F.col(cluster))).drop("_split")


def parse_payloads(decisions: DataFrame, fields: list[str], column: str = "resolved_data") -> DataFrame:
    """Payload fields as string columns, so identifiers keep their digits."""
    schema = StructType([StructField(f, StringType()) for f in fields])
    return decisions.withColumn("_p", F.from_json(column, schema)).select(
        *[c for c in decisions.columns if c != column], *[F.col(f"_p.{f}").alias(f) for f in fields])
