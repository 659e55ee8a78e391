"""Review queue, discrepancies, confidence, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import review
from goldweave.operators.survivorship import golden_rows
from goldweave.plans.catalog import Tables, query
from goldweave.plans.matching_queries import _components_sql
from goldweave.plans.derived import DECISIONS_SQL, ORDER_FIELDS, REVIEW_SQL, decisions, review_records
from goldweave.session import scratch_dir

_FINAL = "action IN ('Match Approved', 'Match Rejected')"


@query("R1 R9 R10 M23 N8", f"""
    WITH r AS ({REVIEW_SQL}), d AS ({DECISIONS_SQL})
    SELECT cluster_id, count(*) AS records FROM r
    WHERE cluster_id NOT IN (SELECT cluster_id FROM d WHERE {_FINAL}) GROUP BY 1 HAVING count(*) > 1""")
def review_queue(t: Tables) -> DataFrame:
    return review.review_queue(review_records(t), decisions(t))


@query("R9 N8", f"WITH d AS ({DECISIONS_SQL}) SELECT DISTINCT cluster_id FROM d WHERE {_FINAL}")
def decided_ids(t: Tables) -> DataFrame:
    return review.decided_ids(decisions(t))


def _differs_sql(f: str) -> str:
    return f"count(DISTINCT nullif(lower(trim({f})), '')) > 1"


@query("R2", f"""
    WITH r AS ({REVIEW_SQL})
    SELECT cluster_id, count(*) AS records, {', '.join(f'{_differs_sql(f)} AS {f}_differs' for f in ORDER_FIELDS)}
    FROM r GROUP BY 1""")
def discrepancies(t: Tables) -> DataFrame:
    return review.discrepancies(review_records(t), ORDER_FIELDS)


@query("R13", f"""
    WITH r AS ({REVIEW_SQL}), f AS (SELECT cluster_id, concat_ws(',', {', '.join(
        f"CASE WHEN {_differs_sql(f)} THEN '{f}' END" for f in ORDER_FIELDS)}) AS differing FROM r GROUP BY 1)
    SELECT * FROM f WHERE differing <> ''""")
def ambiguous_clusters(t: Tables) -> DataFrame:
    return review.ambiguous_clusters(review_records(t), ORDER_FIELDS)


# The truth of a cluster is its most expensive order.
_COUNT = " + ".join(f"coalesce((lower(trim(r.{f})) <> lower(trim(t.{f})))::INT, 0)" for f in ORDER_FIELDS)
_SCORED_SQL = f"""
    r AS ({REVIEW_SQL}),
    t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY o_totalprice DESC, record_id) = 1),
    scored AS (SELECT r.cluster_id, r.record_id, {_COUNT} AS differences,
        round(greatest(0.5::DOUBLE, 0.99::DOUBLE - ({_COUNT}) * 0.08::DOUBLE), 2) AS confidence
        FROM r JOIN t ON r.cluster_id = t.cluster_id)"""


def _scored(t: Tables) -> DataFrame:
    records = review_records(t)
    truth = golden_rows(records, "cluster_id", "record_id", recency="o_totalprice")
    truth = truth.select("cluster_id", *[F.col(f).alias(f"truth_{f}") for f in ORDER_FIELDS])
    both = records.join(truth, "cluster_id")
    differences = review.count_differences(ORDER_FIELDS)
    return both.select("cluster_id", "record_id", *ORDER_FIELDS, differences.alias("differences"),
                       review.confidence_score(differences).alias("confidence"))


@query("R5 R6", f"""
    WITH {_SCORED_SQL}
    SELECT *, CASE WHEN floor(round(confidence * 100, 6)) >= 90 THEN 'Auto-Match'
        WHEN floor(round(confidence * 100, 6)) >= 70 THEN 'Review Requested' ELSE 'Conflict Detected' END AS grade
    FROM scored""")
def confidence_grade(t: Tables) -> DataFrame:
    return (_scored(t).select("cluster_id", "record_id", "differences", "confidence")
            .withColumn("grade", review.match_grade(F.col("confidence"))))


@query("R3", f"""
    WITH {_SCORED_SQL}
    SELECT cluster_id, record_id, confidence, count(*) OVER (PARTITION BY cluster_id) AS n FROM scored
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, record_id) = 1""")
def reference_records(t: Tables) -> DataFrame:
    return review.reference_records(_scored(t).select("cluster_id", "record_id", "confidence"), "record_id", "confidence")


@query("R4", f"""
    WITH {_SCORED_SQL},
    f AS (SELECT cluster_id, record_id AS reference_id FROM scored
          QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, record_id) = 1)
    SELECT r.cluster_id, r.record_id, f.reference_id,
        {', '.join(f"coalesce(nullif(lower(trim(r.{c})), '') <> nullif(lower(trim(x.{c})), ''), false) AS {c}_conflict" for c in ORDER_FIELDS)}
    FROM r JOIN f USING (cluster_id) JOIN r x ON x.record_id = f.reference_id""")
def pair_conflicts(t: Tables) -> DataFrame:
    return review.pair_conflicts(_scored(t), ORDER_FIELDS, "record_id", "confidence")


_SOURCES = ["click", "error", "purchase", "signup", "view"]
_MATRIX_FIELDS = {"value": "CAST(value AS VARCHAR)", "props": "props"}


@query("R7", " UNION ALL ".join(f"""
    SELECT user_id AS cluster_id, '{f}' AS attribute, {', '.join(f"max(v) FILTER (WHERE event_type = '{x}') AS {x}" for x in _SOURCES)},
        count(DISTINCT nullif(lower(trim(v)), '')) > 1 AS conflict
    FROM (SELECT user_id, event_type, {e} AS v FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) GROUP BY 1"""
    for f, e in _MATRIX_FIELDS.items()))
def compare_matrix(t: Tables) -> DataFrame:
    return review.comparison_matrix(t.events.withColumnRenamed("user_id", "cluster_id"), list(_MATRIX_FIELDS), _SOURCES,
                                    "event_id", "event_type")


@query("R11", f"""
    WITH r AS ({REVIEW_SQL}), d AS ({DECISIONS_SQL}),
    last AS (SELECT cluster_id, arg_max(action, (timestamp, action)) AS action FROM d WHERE {_FINAL} GROUP BY 1)
    SELECT r.record_id, CASE WHEN last.action = 'Match Rejected' THEN CAST(r.record_id AS VARCHAR)
        ELSE CAST(r.cluster_id AS VARCHAR) END AS cluster_id
    FROM r LEFT JOIN last USING (cluster_id)""")
def decisions_applied(t: Tables) -> DataFrame:
    return review.apply_decisions(review_records(t).select("record_id", "cluster_id"), decisions(t), "record_id")


# Proposals to merge the clusters of two customers; a steward approves those of one segment and rejects another's.
_PROPOSED_SQL = """SELECT 'P' || a.c_custkey AS proposal, CAST(a.c_custkey AS VARCHAR) AS a, CAST(b.c_custkey AS VARCHAR) AS b, a.c_mktsegment AS segment
    FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7"""


@query("R11 M13", f"""
    WITH RECURSIVE r AS ({REVIEW_SQL}), d AS ({DECISIONS_SQL}),
    last AS (SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, arg_max(action, (timestamp, action)) AS action FROM d WHERE {_FINAL} GROUP BY 1),
    rejected AS (SELECT cluster_id FROM last WHERE action = 'Match Rejected'),
    {_components_sql(f"SELECT a AS src, b AS dst FROM ({_PROPOSED_SQL}) WHERE segment = 'BUILDING' AND a NOT IN (FROM rejected) AND b NOT IN (FROM rejected)")}
    SELECT r.record_id, CASE WHEN CAST(r.cluster_id AS VARCHAR) IN (FROM rejected) THEN CAST(r.record_id AS VARCHAR)
        ELSE coalesce(component, CAST(r.cluster_id AS VARCHAR)) END AS cluster_id
    FROM r LEFT JOIN comp ON node = CAST(r.cluster_id AS VARCHAR)""")
def decisions_merged(t: Tables) -> DataFrame:
    """Rejected clusters are split, approved proposals merge theirs; only the edges of approved proposals are read."""
    one, two = (t.customer.select(F.col("c_custkey").alias(c), *more) for c, more in (("a", ["c_mktsegment"]), ("b", [])))
    proposals = one.join(two, F.col("b") == F.col("a") + 7).withColumn("proposal", F.concat(F.lit("P"), "a"))
    said = F.when(F.col("c_mktsegment") == "BUILDING", review.APPROVED).when(F.col("c_mktsegment") == "AUTOMOBILE", review.REJECTED)
    on_proposals = proposals.select(F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"), F.col("proposal").alias("cluster_id"),
                                    F.coalesce(said, F.lit("Deferred")).alias("action"))
    on_clusters = decisions(t).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("cluster_id").cast("string").alias("cluster_id"), "action")
    return review.apply_decisions(review_records(t).select("record_id", "cluster_id"), on_clusters.unionByName(on_proposals), "record_id",
                                  proposals=proposals.select("proposal", "a", "b"))


_ACTION = {"purchase": review.APPROVED, "error": review.REJECTED}
_ACTION_SQL = "CASE event_type WHEN 'purchase' THEN 'Match Approved' WHEN 'error' THEN 'Match Rejected' ELSE 'Deferred' END"


@query("R8 R12", f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS cluster_id, {_ACTION_SQL} AS action, 'steward' AS "user",
                      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS decided_at, CAST(value AS VARCHAR) AS value,
                      event_id, json_extract_string(props, '$.k') AS k FROM events)
    SELECT cluster_id, action, "user", decided_at, CASE WHEN action = 'Match Approved' THEN CAST(event_id AS VARCHAR) END AS event_id,
        CASE WHEN action = 'Match Approved' THEN value END AS value, CASE WHEN action = 'Match Approved' THEN k END AS k FROM e""")
def decision_payloads(t: Tables) -> DataFrame:
    """Decisions are appended to a table, read back and their payloads parsed."""
    action = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(a)) for e, a in _ACTION.items()], F.lit(review.DEFERRED))
    fields = ["event_id", "value", "k"]
    df = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    rows = review.decision_rows(df, "user_id", action, F.lit("steward"), F.col("ts"), F.lit(""), fields)
    path = scratch_dir(t.spark, "decisions")
    review.append_decisions(rows, path)
    parsed = review.parse_payloads(t.spark.read.parquet(path), fields)
    return parsed.select("cluster_id", "action", "user", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("decided_at"), *fields)
