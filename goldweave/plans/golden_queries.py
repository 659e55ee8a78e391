"""End-to-end golden records over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import matching, survivorship
from goldweave.operators.normalize import INGEST_TIME, add_ingest_metadata
from goldweave.operators.ruleset import apply_rules
from goldweave.plans import golden
from goldweave.plans.catalog import Tables, query
from goldweave.session import scratch_dir

_CLEAN = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("S1 C1 C4 M8 M10 M13 M16 G2", f"""
    WITH RECURSIVE p AS (SELECT p_partkey, {_CLEAN} AS p_name, p_brand, p_type, p_retailprice FROM part),
    m AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS rep FROM p GROUP BY ALL),
    e AS (SELECT a.rep AS src, b.rep AS dst FROM m a JOIN m b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.rep <> b.rep
          WHERE round(jaro_winkler_similarity(a.p_name, b.p_name), 6) >= 0.85),
    reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src),
    comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
    c AS (SELECT p.*, CAST(coalesce(component, rep) AS VARCHAR) AS cluster_id
          FROM p JOIN m USING (p_brand, p_type, p_name) LEFT JOIN comp ON node = rep)
    SELECT cluster_id, p_partkey, p_name, p_brand, p_type, p_retailprice FROM c
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY p_retailprice, p_partkey) = 1""")
def golden_parts(t: Tables) -> DataFrame:
    """Cleanse names, block on brand and type, compare, cluster, keep the cheapest part."""
    parts = apply_rules(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"), {"p_name": "clean_text"})
    clusters = matching.fuzzy_clusters(parts, "p_partkey", ["p_brand", "p_type"], "p_name", 0.85)
    return survivorship.golden_rows(parts.join(clusters, "p_partkey"), "cluster_id", "p_partkey",
                                    lowest=["p_retailprice"])


_PLAN = golden.GoldenPlan(
    rules={"name": "clean_text"},
    passes=[{"name": "number and nation", "blocking_key": ["phone_prefix:number", "number", "nationkey"]},
            {"name": "nation and balance", "blocking_key": ["nationkey", "acctbal"]}],
    trust={"ERP": 1.0, "CRM": 0.8},
    key=["number"],
)


@query("S5 N2 N3 C1 M2 M3 M5 M6 G1 G2", """
    WITH r AS (
        SELECT '["CRM","' || right(c_name, 9) || '"]' AS record_id, 'CRM' AS src, 0.8 AS trust, replace(lower(c_name), '#', '') AS name, right(c_name, 9) AS number, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
        UNION ALL
        SELECT '["ERP","' || right(s_name, 9) || '"]', 'ERP', 1.0, replace(lower(s_name), '#', ''), right(s_name, 9), s_nationkey, s_acctbal FROM supplier),
    p1 AS (SELECT *, count(*) OVER w AS n1, min(record_id) OVER w AS c1 FROM r WINDOW w AS (PARTITION BY number, nationkey)),
    p2 AS (SELECT *, count(*) OVER w AS n2, min(record_id) OVER w AS c2 FROM p1 WINDOW w AS (PARTITION BY n1 > 1, nationkey, acctbal)),
    c AS (SELECT *, CASE WHEN n1 > 1 THEN c1 WHEN n2 > 1 THEN c2 ELSE record_id END AS cluster_id,
            CASE WHEN n1 > 1 THEN 'number and nation' WHEN n2 > 1 THEN 'nation and balance' END AS matched_by FROM p2)
    SELECT cluster_id, sha256(cluster_id) AS golden_id, record_id, src AS source_system, name, nationkey, acctbal, matched_by FROM c
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY trust DESC, record_id) = 1""")
def golden_two_sources(t: Tables) -> DataFrame:
    """Two sources, cleansed and aligned, through a two-pass waterfall to golden rows."""
    crm = t.customer.select(F.col("c_name").alias("name"), F.right("c_name", F.lit(9)).alias("number"),
                            F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    erp = t.supplier.select(F.col("s_name").alias("name"), F.right("s_name", F.lit(9)).alias("number"),
                            F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    records = golden.combine([add_ingest_metadata(crm, "CRM"), add_ingest_metadata(erp, "ERP")], _PLAN).drop(INGEST_TIME)
    best = golden.survive(golden.cluster(records, _PLAN), _PLAN)
    return best.select("cluster_id", "golden_id", "record_id", F.col("_source_system").alias("source_system"), "name",
                       "nationkey", "acctbal", "matched_by")


@query("S5 M2", """
    WITH r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_nationkey ELSE c_custkey + 1000 END AS number,
               c_mktsegment AS segment, c_nationkey AS nation FROM customer),
    d AS (SELECT number, segment, nation, count(*) AS copies FROM r GROUP BY ALL)
    SELECT number, segment, nation, copies, count(*) OVER (PARTITION BY segment, nation) AS cluster_size FROM d""")
def golden_gappy_keys(t: Tables) -> DataFrame:
    """A third of the records has no key and a third shares keys: every record is clustered exactly once."""
    key = F.col("c_custkey")
    rows = t.customer.select(F.when(key % 3 == 0, None).when(key % 3 == 1, F.col("c_nationkey")).otherwise(key + 1000).alias("number"),
                             F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    plan = golden.GoldenPlan(passes=[{"name": "segment and nation", "blocking_key": ["segment", "nation"]}], trust={}, key=["number"])
    records = golden.combine([add_ingest_metadata(rows, "CRM")], plan).drop(INGEST_TIME)
    clusters = golden.cluster(records, plan).select("cluster_id", "number", "segment", "nation", "copies")
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return clusters.join(sizes, "cluster_id").drop("cluster_id")


_RUN = golden.GoldenPlan(
    rules={"name": "clean_text"},
    ruleset={"cleansing_rules": [{"column_name": "balance", "rule_type": "DATATYPE_CONVERSION",
                                  "rule_parameters": {"desired_datatype": "Float"}}]},
    roles={"name": None, "nation": None, "number": None, "label": None},
    passes=[{"name": "number and nation", "blocking_key": ["number", "nation"]},
            {"name": "similar label in nation", "blocking_key": ["nation"], "method": "jaro_winkler", "column": "label",
             "threshold": 0.98}],
    trust={"erp": 1.0, "crm": 0.8},
    key=["number"],
    attributes=["name", "nation", "balance", "label"],
    masking={"name": "hash"},
    salt="pepper",
)


@query("S1 S5 C4 C24 M2 M8 M10 M13 R11 G3 G5 T6 S12 A2", """
    WITH RECURSIVE r AS (
        SELECT '["crm","' || right(c_name, 9) || '"]' AS record_id, 0.8 AS trust, replace(lower(c_name), '#', '') AS name, right(c_name, 9) AS number,
            CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS DOUBLE) AS balance, c_mktsegment || ' ' || right(c_name, 4) AS label FROM customer
        UNION ALL
        SELECT '["erp","' || right(s_name, 9) || '"]', 1.0, replace(lower(s_name), '#', ''), right(s_name, 9),
            CAST(s_nationkey AS VARCHAR), CAST(s_acctbal AS DOUBLE), 'SUPPLIER ' || right(s_name, 4) FROM supplier),
    p1 AS (SELECT *, count(*) OVER w AS n1, min(record_id) OVER w AS c1 FROM r WINDOW w AS (PARTITION BY number, nation)),
    rest AS (SELECT nation, label, min(record_id) AS rep FROM p1 WHERE n1 = 1 GROUP BY ALL),
    e AS (SELECT a.rep AS src, b.rep AS dst FROM rest a JOIN rest b ON a.nation = b.nation AND a.label <> b.label
          WHERE round(jaro_winkler_similarity(a.label, b.label), 6) >= 0.98),
    reach(a, b) AS (SELECT src, dst FROM e UNION SELECT x.a, e.dst FROM reach x JOIN e ON x.b = e.src),
    comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
    c AS (SELECT p1.*, CASE WHEN n1 > 1 THEN c1 ELSE coalesce(component, rep) END AS first_cluster
          FROM p1 LEFT JOIN rest ON p1.n1 = 1 AND p1.nation = rest.nation AND p1.label = rest.label LEFT JOIN comp ON node = rep),
    s AS (SELECT *, CASE WHEN contains(first_cluster, '00000001') THEN record_id ELSE first_cluster END AS cluster_id FROM c),
    g AS (SELECT cluster_id, {fields} FROM s GROUP BY 1)
    SELECT cluster_id, sha256(cluster_id) AS golden_id, sha256('pepper' || name) AS name, nation, balance, label FROM g"""
    .replace("{fields}", ", ".join(
        f"arg_max({a}, (trust, length(CAST({a} AS VARCHAR)), -rank)) FILTER (WHERE {a} IS NOT NULL) AS {a}" for a in ("name", "nation", "balance", "label")))
    .replace("s AS (SELECT *,", "s AS (SELECT *, row_number() OVER (ORDER BY record_id) AS rank,"))
def golden_run(t: Tables) -> DataFrame:
    """The whole run over two file sources: rule set, exact and fuzzy passes, decisions, field-level survivorship, masking."""
    folder = scratch_dir(t.spark, "golden-run")
    label = F.concat(F.col("c_mktsegment"), F.lit(" "), F.right("c_name", F.lit(4)))
    t.customer.select(F.col("c_name").alias("name"), F.right("c_name", F.lit(9)).alias("number"), F.col("c_nationkey").cast("string").alias("nation"),
                      F.col("c_acctbal").cast("string").alias("balance"), label.alias("label")).write.parquet(f"{folder}/crm")
    t.supplier.select(F.col("s_name").alias("name"), F.right("s_name", F.lit(9)).alias("number"), F.col("s_nationkey").cast("string").alias("nation"),
                      F.col("s_acctbal").cast("string").alias("balance"),
                      F.concat(F.lit("SUPPLIER "), F.right("s_name", F.lit(4))).alias("label")).write.parquet(f"{folder}/erp")
    # The steward rejects the clusters that the records numbered ...00000001x would name.
    keys = (t.customer.select(F.right("c_name", F.lit(9)).alias("number"), F.lit("crm").alias("source"))
            .unionByName(t.supplier.select(F.right("s_name", F.lit(9)).alias("number"), F.lit("erp").alias("source"))))
    rejected = keys.filter(F.col("number").contains("00000001")).select(
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.to_json(F.array("source", "number")).alias("cluster_id"),
        F.lit("Match Rejected").alias("action"))
    golden.run(t.spark, [{"type": "parquet", "path": f"{folder}/crm", "name": "crm"}, {"type": "parquet", "path": f"{folder}/erp", "name": "erp"}],
               _RUN, f"{folder}/out", rejected)
    return t.spark.read.parquet(f"{folder}/out/golden").select("cluster_id", "golden_id", *_RUN.attributes)
