"""Golden records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import survivorship as s
from goldweave.plans.catalog import Tables, query
from goldweave.plans.derived import RECORDS_SQL, SOURCE_TRUST, source_records, stamp, stamp_sql

_ATTRIBUTES = ["amount", "payload", "rating"]
_GLOBAL = {"primary": s.SOURCE_PRIORITY, "fallback": s.RECENCY}
_OVERRIDES = [
    {"attr": "amount", "primary": s.MAXIMUM, "fallback": s.SOURCE_PRIORITY},
    {"attr": "payload", "primary": s.COMPLETENESS, "fallback": s.RECENCY},
    {"attr": "rating", "primary": s.FOLLOW_GLOBAL},
]


def _records(t: Tables) -> DataFrame:
    return source_records(t).withColumn("trust", s.trust_of(SOURCE_TRUST, "source"))


def _first(value: str, order: str, where: str | None = None) -> str:
    return f"first({value} ORDER BY {order}) FILTER (WHERE {where or value + ' IS NOT NULL'})"


@query("G1 G2", f"""
    WITH r AS ({RECORDS_SQL})
    SELECT cluster_id, record_id, source, {stamp_sql('updated_at')} AS updated_at, amount, payload, rating, trust
    FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY trust DESC, updated_at DESC, record_id) = 1""")
def golden_row(t: Tables) -> DataFrame:
    return (s.golden_rows(_records(t), "cluster_id", "record_id", "trust", "updated_at")
            .withColumn("updated_at", stamp("updated_at")))


@query("G2 G6", f"""
    WITH r AS ({RECORDS_SQL})
    SELECT cluster_id, record_id, source, amount, payload, rating,
        (amount IS NOT NULL)::INT + (payload IS NOT NULL)::INT + (rating IS NOT NULL)::INT AS filled
    FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY
        (amount IS NOT NULL)::INT + (payload IS NOT NULL)::INT + (rating IS NOT NULL)::INT DESC, record_id) = 1""")
def golden_row_most_complete(t: Tables) -> DataFrame:
    df = source_records(t).select("record_id", "cluster_id", "source", *_ATTRIBUTES)
    out = s.golden_rows(df, "cluster_id", "record_id", completeness=_ATTRIBUTES)
    return out.withColumn("filled", s.filled_fields(_ATTRIBUTES))


_BY_TRUST = "trust DESC, updated_at DESC, record_id"


@query("G3 G4 G5", f"""
    WITH r AS ({RECORDS_SQL})
    SELECT cluster_id, {', '.join(f"{_first(a, _BY_TRUST)} AS {a}" for a in _ATTRIBUTES)} FROM r GROUP BY 1""")
def golden_field(t: Tables) -> DataFrame:
    return s.golden_fields(_records(t), "cluster_id", "record_id", _ATTRIBUTES, _GLOBAL, None, "trust", "updated_at")


_WINNER_ORDER = {
    "amount": "amount DESC, trust DESC, record_id",
    "payload": "length(payload) DESC, updated_at DESC, record_id",
    "rating": _BY_TRUST,
}


@query("G6 G7 G8 G9", f"""
    WITH r AS ({RECORDS_SQL})
    SELECT cluster_id, {', '.join(f"{_first(a, o)} AS {a}" for a, o in _WINNER_ORDER.items())} FROM r GROUP BY 1""")
def golden_overrides(t: Tables) -> DataFrame:
    return s.golden_fields(_records(t), "cluster_id", "record_id", _ATTRIBUTES, _GLOBAL, _OVERRIDES, "trust", "updated_at")


@query("G7", f"""
    WITH r AS ({RECORDS_SQL})
    SELECT cluster_id, min(amount) AS amount, max(payload) AS payload, min(rating) AS rating FROM r GROUP BY 1""")
def golden_minmax(t: Tables) -> DataFrame:
    rules = [{"attr": "payload", "primary": s.MAXIMUM}]
    return s.golden_fields(source_records(t), "cluster_id", "record_id", _ATTRIBUTES, {"primary": s.MINIMUM}, rules)


@query("G8", f"""
    WITH r AS ({RECORDS_SQL}), top AS (SELECT *, rank() OVER (PARTITION BY cluster_id ORDER BY trust DESC) AS rk
        FROM r WHERE rating IS NOT NULL)
    SELECT cluster_id, CASE WHEN count(DISTINCT rating) = 1 THEN min(rating) END AS rating,
        count(DISTINCT rating) > 1 AS rating_review
    FROM top WHERE rk = 1 GROUP BY 1""")
def golden_manual_review(t: Tables) -> DataFrame:
    rule = {"primary": s.SOURCE_PRIORITY, "fallback": s.MANUAL_REVIEW}
    return s.golden_fields(_records(t), "cluster_id", "record_id", ["rating"], rule, trust="trust")


@query("G10 E4", """
    WITH m(event_type, pct) AS (VALUES ('purchase', 95), ('signup', 80), ('view', 65), ('click', 50), ('error', 20))
    SELECT event_type, pct / 100.0::DOUBLE AS trust, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 50 THEN 'medium' ELSE 'low' END AS level,
        count(*) AS records FROM events JOIN m USING (event_type) GROUP BY ALL""")
def trust_levels(t: Tables) -> DataFrame:
    percent = s.trust_of({"purchase": 95, "signup": 80, "view": 65, "click": 50}, "event_type", default=20)
    counted = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("records")).withColumn("p", percent)
    return counted.select("event_type", s.percent_trust(F.col("p")).alias("trust"),
                          s.trust_level(F.col("p")).alias("level"), "records")


_LINEAGE_SQL = " UNION ALL ".join(
    f"""SELECT cluster_id, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, record_id, source
    FROM r WHERE {a} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {o}) = 1"""
    for a, o in _WINNER_ORDER.items())


@query("G13", f"WITH r AS ({RECORDS_SQL}) {_LINEAGE_SQL}")
def golden_lineage(t: Tables) -> DataFrame:
    return s.golden_lineage(_records(t), "cluster_id", "record_id", _ATTRIBUTES, _GLOBAL, _OVERRIDES, "trust",
                            "updated_at", "source")


_PREVIEW_SQL = " UNION ALL ".join(
    f"""SELECT cluster_id, '{a}' AS attribute, source, CAST({a} AS VARCHAR) AS value,
        row_number() OVER (PARTITION BY cluster_id ORDER BY {o}) = 1 AS is_winner
    FROM r WHERE {a} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id, source ORDER BY {o}) = 1"""
    for a, o in _WINNER_ORDER.items())


@query("G11", f"WITH r AS ({RECORDS_SQL}) {_PREVIEW_SQL}")
def golden_preview(t: Tables) -> DataFrame:
    return s.golden_preview(_records(t), "cluster_id", "record_id", _ATTRIBUTES, _GLOBAL, _OVERRIDES, "trust",
                            "updated_at", "source")


@query("G12", f"""
    WITH r AS ({RECORDS_SQL}),
    f AS (SELECT cluster_id, source, amount, payload, record_id FROM r
          QUALIFY row_number() OVER (PARTITION BY cluster_id, source ORDER BY record_id) = 1),
    d AS (SELECT cluster_id, arg_min(source, record_id) AS first_source FROM r GROUP BY 1),
    c AS (SELECT DISTINCT user_id AS cluster_id, 'purchase' AS amount_source FROM events WHERE event_type = 'signup'),
    e AS (SELECT DISTINCT user_id AS cluster_id, 'click' AS payload_source FROM events WHERE event_type = 'error')
    SELECT d.cluster_id, x.amount, y.payload FROM d LEFT JOIN c USING (cluster_id) LEFT JOIN e USING (cluster_id)
    LEFT JOIN f x ON x.cluster_id = d.cluster_id AND x.source = coalesce(amount_source, first_source)
    LEFT JOIN f y ON y.cluster_id = d.cluster_id AND y.source = coalesce(payload_source, first_source)""")
def steward_compose(t: Tables) -> DataFrame:
    user = F.col("user_id").alias("cluster_id")
    amounts = t.events.filter("event_type = 'signup'").select(user, F.lit("amount").alias("attribute"),
                                                              F.lit("purchase").alias("source")).distinct()
    payloads = t.events.filter("event_type = 'error'").select(user, F.lit("payload").alias("attribute"),
                                                              F.lit("click").alias("source")).distinct()
    return s.compose(source_records(t), amounts.unionByName(payloads), "cluster_id", "record_id",
                     ["amount", "payload"], "source")
