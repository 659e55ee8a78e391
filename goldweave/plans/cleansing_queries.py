"""Ingest, normalise, cleanse, type and mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions import cleansing as c
from goldweave.functions.semantic import SEMANTIC_TYPES, infer_type, is_valid
from goldweave.operators import column_types, masking, normalize, ruleset
from goldweave.plans.catalog import Tables, query
from goldweave.plans.derived import CONTACTS_SQL, contacts, initcap_sql, spaced_sql
from goldweave.sources import readers


@query("S1 S4 S5 N1 N2 N4 N5", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'CRM' AS _source_system
    FROM customer WHERE c_acctbal > 0""")
def ingest_normalize(t: Tables) -> DataFrame:
    df = readers.ingest(t.spark, {"type": "parquet", "name": "CRM", "path": t.path("customer")})
    return df.filter("c_acctbal > 0").drop(normalize.INGEST_TIME)


@query("N3 N2", """
    SELECT 'C' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, 'CRM' AS _source_system FROM customer
    UNION ALL
    SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, s_nationkey, s_acctbal, 'ERP' FROM supplier""")
def align_union(t: Tables) -> DataFrame:
    crm = t.customer.select(F.expr("'C' || cast(c_custkey as string)").alias("id"), F.col("c_name").alias("name"),
                            F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    erp = t.supplier.select(F.expr("'S' || cast(s_suppkey as string)").alias("id"), F.col("s_name").alias("name"),
                            F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    frames = [normalize.add_ingest_metadata(crm, "CRM"), normalize.add_ingest_metadata(erp, "ERP")]
    return normalize.align_union(frames).drop(normalize.INGEST_TIME)


@query("C1 C4", r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS text
    FROM documents""")
def clean_text_documents(t: Tables) -> DataFrame:
    return ruleset.apply_rules(t.documents.select("doc_id", "text"), {"text": "clean_text"})


@query("C2 C4", """
    SELECT doc_id, nullif(regexp_replace(text, '[^0-9]', '', 'g'), '') AS digits FROM documents""")
def clean_phone_digits(t: Tables) -> DataFrame:
    return ruleset.apply_rules(t.documents.select("doc_id", F.col("text").alias("digits")), {"digits": "clean_phone"})


# Letters to codes; H and W are removed before, a vowel or any other character separates equal codes.
_SOUNDEX_SQL = """
    WITH words AS (SELECT p_partkey, upper(trim(p_name)) AS w FROM part),
    coded AS (
        SELECT p_partkey, w, substr(w, 1, 1) AS head,
               regexp_replace(translate(
                   CASE WHEN substr(w, 1, 1) IN ('H', 'W') THEN '0' ELSE substr(w, 1, 1) END
                   || regexp_replace(substr(w, 2), '[HW]', '', 'g'),
                   'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202'), '[^0-6]', '0', 'g') AS d
        FROM words),
    collapsed AS (
        SELECT p_partkey, w, head, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'),
               '5+', '5', 'g'), '6+', '6', 'g') AS d
        FROM coded)
    SELECT p_partkey, CASE WHEN regexp_matches(w, '^[A-Z]') THEN
           substr(head || replace(substr(d, 2), '0', '') || '000', 1, 4) END AS name_soundex
    FROM collapsed"""


@query("C3", _SOUNDEX_SQL)
def soundex_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", c.phonetic_key(F.col("p_name")).alias("name_soundex"))


_EMAIL = SEMANTIC_TYPES["EMAIL"].pattern
_PHONE = SEMANTIC_TYPES["PHONE_US"].pattern


@query("C5 C6 C7 C8 C9 C10 C11 C12 C13 C14 C15 C16 C25 C26", rf"""
    WITH raw AS ({CONTACTS_SQL}), kept AS (
        SELECT *, regexp_replace(phone, '[^0-9+-]', '', 'g') AS p, regexp_replace(phone, '[^0-9]', '', 'g') AS pd,
               lower(trim(email)) AS e, nullif(lower(trim(website)), '') AS w,
               regexp_replace(npi, '[^0-9]', '', 'g') AS n FROM raw)
    SELECT contact_id,
        CASE WHEN length(p) >= 7 THEN p END AS phone,
        CASE WHEN regexp_matches(e, '{_EMAIL}') THEN e END AS email,
        CASE WHEN regexp_matches(w, '^https?://') THEN w ELSE 'https://' || w END AS website,
        CASE WHEN length(n) = 10 THEN n END AS npi,
        nullif(upper(trim(dea)), '') AS dea,
        nullif(regexp_replace(upper(license_no), '[^A-Z0-9]', '', 'g'), '') AS license_no,
        {initcap_sql(spaced_sql('full_name'))} AS full_name,
        {initcap_sql(spaced_sql('address'))} AS address,
        {initcap_sql(spaced_sql('city'))} AS city,
        upper(trim(state)) AS state,
        regexp_replace(zip_code, '\s+', '', 'g') AS zip_code,
        coalesce(upper(trim(country)), 'US') AS country,
        CASE WHEN regexp_matches(phone, '{_PHONE}') THEN '+1' || right(pd, 10) END AS phone_e164
    FROM kept""")
def contact_identifier_rules(t: Tables) -> DataFrame:
    raw = contacts(t).select("contact_id", "phone", "email", "website", "npi", "dea", "license_no", "full_name",
                             "address", "city", "state", "zip_code", "country",
                             c.e164_us(F.col("phone")).alias("phone_e164"))
    cleaned = ruleset.apply_mandatory_rules(raw, {"license_no": "license", "phone_e164": None})
    return cleaned.withColumn("country", c.default_country(F.col("country")))


@query("C4 C11 C16 C17 C18 C19 C20 C21 C23 C24", f"""
    SELECT c_custkey, {initcap_sql(spaced_sql('c_name'))} AS c_name,
        lower(upper(trim(c_mktsegment))) AS segment_code,
        round(c_acctbal, 1) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
        coalesce(TRY_CAST(right(c_name, 3) AS INTEGER), 0) AS name_tail,
        {initcap_sql(spaced_sql('c_name'))} || '/' || lower(upper(trim(c_mktsegment))) AS label
    FROM customer""")
def ruleset_customer(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment_code"), "c_acctbal",
                           "c_nationkey", F.expr("right(c_name, 3)").alias("name_tail"))
    config = {
        "cleansing_rules": [
            {"column_name": "segment_code", "rule_type": "TEXT_CASE", "rule_parameters": {"case_format": "lowercase"}},
            {"column_name": "c_acctbal", "rule_type": "DECIMAL_PRECISION", "rule_parameters": {"scale": 1}},
            {"column_name": "c_nationkey", "rule_type": "DATATYPE_CONVERSION",
             "rule_parameters": {"desired_datatype": "String"}},
            {"column_name": "name_tail", "rule_type": "DATATYPE_CONVERSION",
             "rule_parameters": {"desired_datatype": "Integer"}},
            {"rule_type": "NEW_COLUMN", "rule_parameters": {"new_column_name": "label",
                                                            "expression": "concat(c_name, '/', segment_code)"}},
        ],
        "global_settings": {"null_handling": "replace"},
    }
    return ruleset.apply_ruleset(df, config, {"c_name": "entity_name", "name_tail": None})


@query("C22 C24", """
    SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate, trim(o_orderstatus) AS o_orderstatus FROM orders""")
def date_format_orders(t: Tables) -> DataFrame:
    """The rule set's date format applies to every date column."""
    df = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    return ruleset.apply_ruleset(df, {"global_settings": {"date_format": "MM/DD/YYYY"}}, {"o_orderstatus": None})


@query("C22", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%m/%d/%Y') AS us_day,
        strftime(o_orderdate, '%d-%m-%Y') AS eu_day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_8601,
        strftime(o_orderdate, '%m/%d/%Y') = strftime(o_orderdate, '%m/%d/%Y') AS survives
    FROM orders""")
def date_styles_orders(t: Tables) -> DataFrame:
    """All styles side by side, and whether a text survives parsing."""
    day = F.col("o_orderdate")
    us = c.format_date(day, "MM/DD/YYYY")
    return t.orders.select(
        "o_orderkey", c.format_date(day, "YYYY-MM-DD").alias("iso_day"), us.alias("us_day"),
        c.format_date(day, "DD-MM-YYYY").alias("eu_day"), c.format_date(day, "ISO 8601").alias("iso_8601"),
        (c.format_date(c.parse_date(us, "MM/DD/YYYY"), "MM/DD/YYYY") == us).alias("survives"))


_GAPPY = "c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance"


def _gappy(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
                             F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))


@query("C23", f"SELECT {_GAPPY} FROM customer")
def nulls_kept(t: Tables) -> DataFrame:
    return ruleset.apply_ruleset(_gappy(t), {"global_settings": {"null_handling": "keep"}}, {"segment": None})


@query("C23", f"SELECT * FROM (SELECT {_GAPPY} FROM customer) WHERE segment IS NOT NULL AND balance IS NOT NULL")
def nulls_removed(t: Tables) -> DataFrame:
    return ruleset.apply_ruleset(_gappy(t), {"global_settings": {"null_handling": "remove"}}, {"segment": None})


def _sql_valid(column: str, type_name: str) -> str:
    if type_name == "SSN":  # the oracle's regex engine has no lookahead
        return (f"coalesce(regexp_matches({column}, '^[0-8][0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') "
                f"AND substr({column}, 1, 3) NOT IN ('000', '666') AND substr({column}, 5, 2) <> '00' "
                f"AND substr({column}, 8, 4) <> '0000', false)")
    return f"coalesce(regexp_matches({column}, '{SEMANTIC_TYPES[type_name].pattern}'), false)"


_TYPED = {"npi": "NPI", "ssn": "SSN", "email": "EMAIL", "phone": "PHONE_US", "zip_code": "ZIP_CODE", "tax_id": "TAX_ID"}


@query("T1 T2", f"""
    WITH raw AS ({CONTACTS_SQL})
    SELECT contact_id, {', '.join(f"{_sql_valid('trim(' + col + ')', ty)} AS {col}_valid" for col, ty in _TYPED.items())}
    FROM raw""")
def validate_types(t: Tables) -> DataFrame:
    return contacts(t).select("contact_id", *[is_valid(F.trim(col), ty).alias(f"{col}_valid")
                                              for col, ty in _TYPED.items()])


def _sql_infer(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_sql_valid(column, n)} THEN '{n}'" for n in SEMANTIC_TYPES) + " END"


_INFERRED = ["npi", "ssn", "email", "phone", "zip_code", "tax_id", "dea", "license_no"]
_CELLS_SQL = " UNION ALL ".join(f"SELECT '{col}' AS column_name, trim({col}) AS v FROM raw WHERE {col} IS NOT NULL"
                                for col in _INFERRED)
_SHARES_SQL = f"""raw AS ({CONTACTS_SQL}), cells AS ({_CELLS_SQL}),
    typed AS (SELECT column_name, {_sql_infer('v')} AS type_name FROM cells),
    hits AS (SELECT column_name, type_name, count(*) AS matched,
                    sum(count(*)) OVER (PARTITION BY column_name) AS non_null FROM typed GROUP BY 1, 2),
    best AS (SELECT column_name, type_name, matched, CAST(non_null AS BIGINT) AS non_null,
                    row_number() OVER (PARTITION BY column_name ORDER BY matched DESC, type_name) AS rn
             FROM hits WHERE type_name IS NOT NULL)"""


def _trimmed_contacts(t: Tables) -> DataFrame:
    return contacts(t).select(*[F.trim(col).alias(col) for col in _INFERRED])


@query("T3", f"""
    WITH raw AS ({CONTACTS_SQL}), cells AS (SELECT contact_id, trim(coalesce(phone, npi)) AS v FROM raw)
    SELECT contact_id, v AS value, {_sql_infer('v')} AS type_name FROM cells""")
def infer_types(t: Tables) -> DataFrame:
    value = F.trim(F.coalesce("phone", "npi"))
    return contacts(t).select("contact_id", value.alias("value"), infer_type(value).alias("type_name"))


@query("T4", f"""
    WITH {_SHARES_SQL}
    SELECT column_name, type_name, matched, non_null, round(matched / non_null, 6) AS share FROM best
    WHERE rn = 1 AND matched / non_null >= 0.2""")
def infer_column_types(t: Tables) -> DataFrame:
    return (column_types.infer_column_types(_trimmed_contacts(t), 0.2)
            .withColumn("share", F.round("share", 6)))


_PII_SQL = ", ".join(f"('{n}', '{ty.description}')" for n, ty in SEMANTIC_TYPES.items() if ty.is_pii)


@query("T5", f"""
    WITH {_SHARES_SQL}, pii(type_name, description) AS (VALUES {_PII_SQL})
    SELECT column_name, type_name, description, round(matched / non_null, 6) AS share
    FROM best JOIN pii USING (type_name) WHERE rn = 1 AND matched / non_null >= 0.2""")
def pii_report(t: Tables) -> DataFrame:
    return column_types.pii_report(_trimmed_contacts(t), 0.2).withColumn("share", F.round("share", 6))


@query("T6", rf"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{masking.EMAIL_IN_TEXT}', '[EMAIL]', 'g'),
        '{masking.SSN_IN_TEXT}', '[SSN]', 'g'), '{masking.PHONE_IN_TEXT}', '[PHONE]', 'g') AS text
    FROM documents""")
def mask_pii_documents(t: Tables) -> DataFrame:
    return masking.apply_policy(t.documents.select("doc_id", "text"), {"text": "text"}, salt="")


@query("T6", rf"""
    WITH raw AS ({CONTACTS_SQL})
    SELECT contact_id, sha256('pepper' || ssn) AS ssn, sha256('pepper' || tax_id) AS tax_id,
        CASE WHEN contains(email, '@') THEN '***@' || regexp_extract(email, '[^@]*$') END AS email,
        regexp_replace(regexp_replace(substr(phone, 1, length(phone) - CASE WHEN length(phone) > 8 THEN 4 ELSE 0 END), '[A-Za-z]', 'X', 'g'),
                       '[0-9]', '9', 'g') || CASE WHEN length(phone) > 8 THEN right(phone, 4) ELSE '' END AS phone, zip_code
    FROM raw""")
def mask_gdpr_contacts(t: Tables) -> DataFrame:
    policy = masking.gdpr_policy(_TYPED)
    return masking.apply_policy(contacts(t).select("contact_id", "ssn", "tax_id", "email", "phone", "zip_code"),
                                policy, salt="pepper")


_HASHED = ["ssn", "tax_id", "npi", "dea", "license_no", "full_name", "phone", "email", "website"]


@query("T7", f"""
    WITH raw AS ({CONTACTS_SQL})
    SELECT contact_id, {', '.join(f"sha256('pepper' || {c}) AS {c}" for c in _HASHED)}, CAST(NULL AS VARCHAR) AS address,
        CAST(NULL AS VARCHAR) AS city, substr(trim(zip_code), 1, 3) AS zip_code, trim(state) AS state, country
    FROM raw""")
def redact_hipaa_contacts(t: Tables) -> DataFrame:
    """Every contact column; what no role covers has to be listed as safe."""
    df = contacts(t).withColumns({"zip_code": F.trim("zip_code"), "state": F.trim("state")})
    policy = masking.hipaa_policy({col: ruleset.role_of(col) for col in df.columns}, safe={"contact_id", "state", "country"})
    return masking.apply_policy(df, policy, salt="pepper")
