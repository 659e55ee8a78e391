"""Audit, executive reports, keyed-table queries. Events stand in for audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import audit, exact_match, reporting
from goldweave.plans.catalog import Tables, query
from goldweave.plans.derived import stamp, stamp_sql

_STATUS_SQL = "CASE WHEN event_type = 'error' THEN 'Failed' WHEN event_type = 'signup' THEN 'Warning' ELSE 'Success' END"
_AUDIT_SQL = f"""SELECT event_id, ts, CAST(user_id AS VARCHAR) AS "user", event_type AS action, 'M' || CAST(user_id % 7 AS VARCHAR) AS module,
    {_STATUS_SQL} AS status, props AS details FROM events"""


def _audit(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("action"),
                           F.concat(F.lit("M"), (F.col("user_id") % 7).cast("string")).alias("module"),
                           F.expr(_STATUS_SQL).alias("status"), F.col("props").alias("details"))


@query("A3 A4 A5 N7", f"""
    WITH a AS ({_AUDIT_SQL})
    SELECT event_id, {stamp_sql('ts')} AS ts, "user", action, module, status, details FROM a
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY AND lower(status) IN ('failed', 'warning')
      AND contains(lower(concat_ws(chr(1), "user", action, module, status, details)), 'k": 7')""")
def audit_search(t: Tables) -> DataFrame:
    found = audit.search(_audit(t), 'K": 7', ["user", "action", "module", "status", "details"], ["FAILED", "Warning"],
                         "2024-01-05", "2024-01-20", time="ts")
    return audit.latest_first(found, "ts", "event_id").withColumn("ts", stamp("ts"))


@query("A6", f"""
    WITH a AS ({_AUDIT_SQL})
    SELECT count(*) AS total_events, round(count(*) FILTER (WHERE status = 'Success') * 100.0::DOUBLE / count(*), 6) AS health,
        count(*) FILTER (WHERE status <> 'Success') AS flags, count(DISTINCT "user") AS active_users FROM a""")
def audit_kpis(t: Tables) -> DataFrame:
    return audit.audit_kpis(_audit(t)).withColumn("health", F.round("health", 6))


@query("A8", f"""
    WITH a AS ({_AUDIT_SQL})
    SELECT strftime(ts, '%Y-%m-%d') AS day, module, action, status, count(*) AS events FROM a GROUP BY ALL""")
def audit_daily(t: Tables) -> DataFrame:
    return (audit.daily_activity(_audit(t), "ts", ["module", "action", "status"])
            .withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query("A1 A2", """
    SELECT 'ingested' AS stage, count(*) AS rows FROM part
    UNION ALL SELECT 'distinct entities', count(*) FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part)
    UNION ALL SELECT 'matched records', count(*) FROM (SELECT 1 FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_brand, p_type) > 1)""")
def stage_metrics(t: Tables) -> DataFrame:
    keys = ["p_name", "p_brand", "p_type"]
    matched = exact_match.exact_groups(t.part, "p_partkey", exact_match.blocking_key(keys))
    return audit.stage_counts({"ingested": t.part, "distinct entities": t.part.select(*keys).distinct(),
                               "matched records": matched})


@query("A1", f"""
    WITH a AS ({_AUDIT_SQL})
    SELECT "user", action, module, status, count(*) AS events, min(details) AS first_details FROM (
        SELECT "user", action, module, status, '{{"event_id":' || event_id || ',"rows":' || length(details) || '}}' AS details FROM a)
    GROUP BY ALL""")
def audit_event_rows(t: Tables) -> DataFrame:
    details = F.struct("event_id", F.length("details").alias("rows"))
    rows = audit.audit_events(_audit(t), F.col("ts"), F.col("user"), F.col("action"), F.col("module"), F.col("status"), details)
    return rows.groupBy("user", "action", "module", "status").agg(F.count(F.lit(1)).alias("events"),
                                                                  F.min("details").alias("first_details"))


@query("E1", """
    SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, round(avg(o_totalprice), 4) AS trust FROM orders GROUP BY 1""")
def trust_trend(t: Tables) -> DataFrame:
    return (reporting.monthly_average(t.orders, "o_orderdate", "o_totalprice", "trust")
            .select(F.date_format("month", "yyyy-MM").alias("month"), F.round("trust", 4).alias("trust")))


@query("E2", """
    WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderstatus = 'P' THEN 'manual' ELSE 'auto' END AS kind FROM orders),
    months AS (SELECT DISTINCT month FROM m), kinds(kind) AS (VALUES ('auto'), ('manual'))
    SELECT months.month, kinds.kind AS resolution, count(m.kind) AS resolved FROM months CROSS JOIN kinds
    LEFT JOIN m ON m.month = months.month AND m.kind = kinds.kind GROUP BY ALL""")
def auto_manual_long(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "manual").otherwise("auto")
    wide = reporting.counts_by_month(t.orders, "o_orderdate", kind, ["auto", "manual"])
    wide = wide.withColumn("month", F.date_format("month", "yyyy-MM"))
    return reporting.wide_to_long(wide, ["month"], ["auto", "manual"], "resolution", "resolved")


@query("E3", """
    SELECT o_orderpriority AS category, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'low' END AS severity,
        count(*) AS risks FROM orders GROUP BY ALL""")
def risk_counts(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    severity = F.when(price > 400000, "high").when(price > 200000, "medium").otherwise("low")
    return reporting.risk_counts(t.orders, F.col("o_orderpriority"), severity)


@query("E4", """
    SELECT source, count(*) AS records, CASE WHEN source = 'src1' THEN 90 ELSE 60 END AS trust_percent,
        CASE WHEN source = 'src1' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS trust, CASE WHEN source = 'src1' THEN 'high' ELSE 'medium' END AS level
    FROM documents GROUP BY source""")
def source_coverage(t: Tables) -> DataFrame:
    return reporting.source_coverage(t.documents, "source", F.when(F.col("source") == "src1", 90).otherwise(60))


@query("E5", """
    WITH c AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) = max(o_orderstatus) AS same FROM orders GROUP BY 1),
    h AS (SELECT date_diff('second', min(o_orderdate), max(o_orderdate)) / 3600.0::DOUBLE AS hours FROM orders)
    SELECT CAST(sum(n) AS BIGINT) AS records_governed, round(count(*) FILTER (WHERE same) / count(*), 6) AS golden_consistency,
        round((sum(n) - count(*)) / sum(n), 6) AS duplicate_risk, round(sum(n) / any_value(hours), 6) AS records_per_hour FROM c, h""")
def er_kpis(t: Tables) -> DataFrame:
    out = reporting.er_kpis(t.orders, "o_custkey", "o_orderstatus", "o_orderdate")
    return out.select("records_governed", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("E5", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS records FROM events GROUP BY 1")
def hourly_throughput(t: Tables) -> DataFrame:
    return reporting.hourly_throughput(t.events, "ts").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("E6", """
    WITH u AS (SELECT max(ts) AS until FROM events)
    SELECT event_type, count(*) AS events FROM events, u WHERE ts >= CAST(until AS DATE) - INTERVAL 7 DAY AND ts <= until GROUP BY 1""")
def time_window(t: Tables) -> DataFrame:
    until = t.events.agg(F.max("ts")).scalar()
    return (reporting.within_window(t.events, "ts", "7 days", until)
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("events")))


@query("K1", f"""
    SELECT user_id, event_id, {stamp_sql('ts')} AS ts, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return reporting.latest_per_key(t.events, "user_id", "ts", "event_id").withColumn("ts", stamp("ts"))


@query("K1", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 1")
def latest_overall(t: Tables) -> DataFrame:
    return reporting.latest_overall(t.events, "ts", "event_id").select("event_id", "user_id", "event_type")


@query("K2", f"SELECT * REPLACE ({stamp_sql('o_orderdate')} AS o_orderdate) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def lookup_by_id(t: Tables) -> DataFrame:
    newest = t.orders.agg(F.max("o_orderkey")).scalar()
    return t.orders.filter(F.col("o_orderkey") == newest).withColumn("o_orderdate", stamp("o_orderdate"))


@query("K3 N6", "SELECT count(*) AS matches FROM part WHERE lower(p_brand) = 'brand#7' AND lower(p_type) = 'economy'")
def exists_ci(t: Tables) -> DataFrame:
    return reporting.exists_ignoring_case(t.part, {"p_brand": "BRAND#7", "p_type": "economy"})


@query("K4", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def rows_of_owner(t: Tables) -> DataFrame:
    return reporting.rows_of_owner(t.events, "user_id", 7, "ts", "event_id").select("event_id", "user_id", "event_type")
