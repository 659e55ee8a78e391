"""Inputs derived from the given tables. The texts are valid in Spark SQL and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Contact data in the many spellings that sources use, derived from the customer table.
CONTACT_COLUMNS = {
    "contact_id": "c_custkey",
    "phone": """CASE c_nationkey % 5
        WHEN 0 THEN '(' || CAST(200 + c_custkey % 700 AS STRING) || ') ' || CAST(200 + c_custkey % 790 AS STRING)
             || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
        WHEN 1 THEN '+1 ' || CAST(212 + c_custkey % 500 AS STRING) || '-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
        WHEN 2 THEN 'ext. ' || CAST(c_custkey % 1000 AS STRING)
        WHEN 3 THEN '' END""",
    "email": """CASE c_mktsegment
        WHEN 'BUILDING' THEN '  ' || replace(upper(c_name), '#', '.') || '@Example-Corp.COM '
        WHEN 'MACHINERY' THEN c_name || '@x'
        WHEN 'FURNITURE' THEN NULL
        ELSE replace(lower(c_name), '#', '+') || '@mail.example.org' END""",
    "website": """CASE c_nationkey % 3
        WHEN 0 THEN ' WWW.' || lower(c_mktsegment) || '.example.COM '
        WHEN 1 THEN 'HTTPS://' || lower(c_mktsegment) || '.example.org/' || CAST(c_custkey AS STRING)
        ELSE ' ' END""",
    "npi": """CASE c_nationkey % 4
        WHEN 0 THEN CAST(1000000000 + c_custkey AS STRING)
        WHEN 1 THEN ' 12-3456-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
        WHEN 2 THEN 'n/a' ELSE CAST(c_custkey AS STRING) END""",
    "dea": "CASE WHEN c_nationkey % 6 = 0 THEN '  ' ELSE ' ab' || CAST(c_custkey AS STRING) || ' ' END",
    "license_no": "CASE WHEN c_nationkey % 7 = 0 THEN '--' ELSE 'md-' || CAST(c_custkey AS STRING) || '/x ' || CAST(c_nationkey AS STRING) END",
    "full_name": "'  ' || lower(c_mktsegment) || '   o''BRIEN-' || CAST(c_nationkey AS STRING) || ' jr '",
    "address": "CAST(c_custkey % 9000 AS STRING) || '  NORTH   main st'",
    "city": "'new  ' || lower(c_mktsegment)",
    "state": "CASE WHEN c_nationkey % 8 = 0 THEN NULL ELSE ' s' || CAST(c_nationkey AS STRING) || ' ' END",
    "zip_code": "' 0' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' '",
    "country": "CASE WHEN c_acctbal < 0 THEN NULL ELSE 'ca' END",
    "tax_id": "lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey AS STRING), 7, '0')",
    "ssn": "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')",
}
CONTACTS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CONTACT_COLUMNS.items()) + " FROM customer"

# Records of several sources: the cluster is the user, the source the event type. Some values are missing.
SOURCE_TRUST = {"purchase": 1.0, "signup": 0.9, "view": 0.8, "click": 0.7}
RECORD_COLUMNS = {
    "record_id": "event_id",
    "cluster_id": "user_id",
    "source": "event_type",
    "updated_at": "ts",
    "amount": "CASE WHEN value >= 40 OR event_type = 'click' THEN value END",
    "payload": "CASE WHEN event_type <> 'purchase' THEN props END",
    "rating": "CAST(floor(value / 10) AS BIGINT)",
}
RECORDS_SQL = ("SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORD_COLUMNS.items())
               + ", CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.9::DOUBLE "
                 "WHEN 'view' THEN 0.8::DOUBLE WHEN 'click' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM events")

# Review records: a customer's orders are one cluster. Decisions: the urgent orders.
ORDER_FIELDS = ["o_orderstatus", "o_orderpriority", "o_month"]
REVIEW_COLUMNS = {
    "record_id": "o_orderkey",
    "cluster_id": "o_custkey",
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority",
    "o_month": "CAST(month(o_orderdate) AS STRING)",
    "o_totalprice": "o_totalprice",
}
REVIEW_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in REVIEW_COLUMNS.items()) + " FROM orders"
DECISION_COLUMNS = {
    "timestamp": "o_orderdate",
    "cluster_id": "o_custkey",
    "action": "CASE o_orderstatus WHEN 'F' THEN 'Match Approved' WHEN 'O' THEN 'Match Rejected' ELSE 'Deferred' END",
}
DECISIONS_SQL = ("SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in DECISION_COLUMNS.items())
                 + " FROM orders WHERE o_orderpriority = '1-URGENT'")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def contacts(t) -> DataFrame:
    return _project(t.customer, CONTACT_COLUMNS)


def source_records(t) -> DataFrame:
    return _project(t.events, RECORD_COLUMNS)


def review_records(t) -> DataFrame:
    return _project(t.orders, REVIEW_COLUMNS)


def decisions(t) -> DataFrame:
    return _project(t.orders.filter("o_orderpriority = '1-URGENT'"), DECISION_COLUMNS)


def initcap_sql(expression: str) -> str:
    """Oracle text for proper case."""
    return (f"array_to_string(list_transform(string_split(lower({expression}), ' '), "
            "lambda w: upper(w[1:1]) || w[2:]), ' ')")


def spaced_sql(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '\\s+', ' ', 'g'))"


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
