"""Profiling and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.semantic import SEMANTIC_TYPES
from goldweave.operators import profile
from goldweave.plans.catalog import Tables, query
from goldweave.plans.derived import CONTACTS_SQL, RECORDS_SQL, contacts, source_records

_EMAIL = SEMANTIC_TYPES["EMAIL"].pattern


@query("P1", f"""
    WITH raw AS ({CONTACTS_SQL}),
    r AS (SELECT phone, email, zip_code, country, state FROM raw),
    m AS (SELECT count(*) AS n, count(phone) + count(email) + count(zip_code) + count(country) + count(state) AS filled,
            count(*) FILTER (WHERE regexp_matches(email, '{_EMAIL}')) AS ok, count(email) AS typed,
            count(*) FILTER (WHERE coalesce(state IS NULL OR country IS NOT NULL, false)) AS consistent FROM r),
    d AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM r)),
    q AS (SELECT n, filled / (n * 5) AS a, u / n AS b, ok / typed AS c, consistent / n AS e FROM m, d)
    SELECT 'contacts' AS "table", n AS total_rows, round(a, 6) AS completeness, round(b, 6) AS uniqueness,
        round(c, 6) AS validity, round(e, 6) AS consistency, round((a + b + c + e) / 4, 6) AS dq_score FROM q""")
def profile_table(t: Tables) -> DataFrame:
    df = contacts(t).select("phone", "email", "zip_code", "country", "state")
    checks = [F.col("state").isNull() | F.col("country").isNotNull()]
    out = profile.table_summary(df, "contacts", {"email": "EMAIL"}, checks)
    return out.select("table", "total_rows", *[F.round(x, 6).alias(x) for x in out.columns[2:]])


def _profile_sql(table: str, cte: str, types: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{col}' AS column_name, '{kind}' AS data_type, count(*) AS n, count({col}) AS f, "
        f"count(DISTINCT {col}) AS distinct_count FROM src" for col, kind in types.items())
    return f"""
    WITH src AS ({cte}), p AS ({rows}), q AS (SELECT *, (n - f) * 100.0::DOUBLE / n AS pct FROM p)
    SELECT '{table}' AS "table", column_name, data_type, round(pct, 6) AS null_percentage, distinct_count,
        CASE WHEN pct > 20 THEN 'red' WHEN pct > 5 THEN 'amber' ELSE 'green' END AS severity FROM q"""


@query("P2 P3", _profile_sql("records", RECORDS_SQL, {
    "record_id": "bigint", "cluster_id": "bigint", "source": "string", "amount": "double", "payload": "string"}))
def profile_columns(t: Tables) -> DataFrame:
    df = source_records(t).select("record_id", "cluster_id", "source", "amount", "payload")
    return profile.column_profile(df, "records").withColumn("null_percentage", F.round("null_percentage", 6))


@query("P2 P3", _profile_sql("documents", "SELECT * FROM documents", {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def profile_documents(t: Tables) -> DataFrame:
    return (profile.column_profile(t.documents, "documents")
            .withColumn("null_percentage", F.round("null_percentage", 6)))


@query("P2")
def profile_columns_approximate(t: Tables) -> DataFrame:
    """Sketches are engine-specific: no SQL oracle; a test bounds the error."""
    return profile.column_profile(t.lineitem, "lineitem", approximate=True)


@query("P4", f"""
    WITH src AS ({RECORDS_SQL})
    SELECT 'amount' AS column_name, count(*) FILTER (WHERE amount IS NULL) AS nulls FROM src
    UNION ALL SELECT 'payload', count(*) FILTER (WHERE payload IS NULL) FROM src
    UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM src""")
def null_check(t: Tables) -> DataFrame:
    return profile.null_check(source_records(t), ["amount", "payload", "source"])


@query("P5", f"""
    WITH raw AS ({CONTACTS_SQL})
    SELECT count(email) AS checked, count(*) FILTER (WHERE regexp_matches(email, '{_EMAIL}')) AS valid,
        count(*) FILTER (WHERE email IS NOT NULL AND NOT regexp_matches(email, '{_EMAIL}')) AS invalid FROM raw""")
def email_check(t: Tables) -> DataFrame:
    return profile.email_check(contacts(t), "email")


@query("P6", """
    WITH f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem, f
    WHERE l_extendedprice < q1 - 0.45 * (q3 - q1) OR l_extendedprice > q3 + 0.45 * (q3 - q1)""")
def outliers_iqr(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return profile.outliers(df, "l_extendedprice", "iqr", 0.45)


@query("P6", """
    WITH f AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
    SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice < m - 1.5 * s OR o_totalprice > m + 1.5 * s""")
def outliers_zscore(t: Tables) -> DataFrame:
    return profile.outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "zscore", 1.5)


@query("P7", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def orphans(t: Tables) -> DataFrame:
    return profile.orphans(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"),
                           t.orders.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")


@query("P8", """
    SELECT event_type, count(*) AS sampled, round(avg(CAST(value AS DOUBLE)), 6) AS mean_value FROM events
    WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 GROUP BY 1""")
def profile_sampled(t: Tables) -> DataFrame:
    sampled = profile.sample_rows(t.events.select("event_id", "event_type", "value"), "event_id", 20)
    return sampled.groupBy("event_type").agg(F.count(F.lit(1)).alias("sampled"),
                                             F.round(F.avg("value"), 6).alias("mean_value"))


@query("P9", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.part, "p_brand")


@query("P10", """
    SELECT regexp_replace(regexp_replace(regexp_replace(props, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')
        AS pattern, count(*) AS count FROM events WHERE props IS NOT NULL GROUP BY 1""")
def pattern_shapes(t: Tables) -> DataFrame:
    return profile.pattern_histogram(t.events, "props")
