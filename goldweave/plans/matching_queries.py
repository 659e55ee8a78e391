"""Blocking, matching, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.functions.similarity import jaro_winkler
from goldweave.operators import exact_match, matching, similarity_join, skew, vector_match
from goldweave.operators.review import exclude_decided
from goldweave.functions.cleansing import phonetic_key
from goldweave.plans.catalog import Tables, query
from goldweave.plans.cleansing_queries import _SOUNDEX_SQL
from goldweave.plans.derived import CONTACTS_SQL, DECISIONS_SQL, REVIEW_SQL, contacts, decisions, review_records

BLOCKS = ["p_brand", "p_type"]
_JW = "round(jaro_winkler_similarity({a}, {b}), 6)"
_ED = "round(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})), 6)"


@query("M1", r"""
    WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS key,
                      trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS clean
               FROM documents)
    SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS group_id, count(*) OVER (PARTITION BY key) AS group_size
    FROM k WHERE clean <> '' QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def exact_key_duplicates(t: Tables) -> DataFrame:
    return exact_match.exact_groups(t.documents, "doc_id", exact_match.digest_key(["clean:text"]))


_PASSES = [
    {"name": "Exact name, brand, type, size", "blocking_key": ["p_name", "p_brand", "p_type", "p_size"]},
    {"name": "Exact name, brand, type", "blocking_key": ["p_name", "p_brand", "p_type"]},
    {"name": "Exact name and brand", "blocking_key": ["p_name", "p_brand"], "stop_values": ["Brand#1"]},
]


@query("M2 M3 M5 M12 M14", """
    WITH p1 AS (SELECT *, count(*) OVER w AS n, min(p_partkey) OVER w AS c FROM part
                WINDOW w AS (PARTITION BY p_name, p_brand, p_type, p_size)),
    p2 AS (SELECT p_partkey, p_name, p_brand, p_type, count(*) OVER w AS n, min(p_partkey) OVER w AS c FROM p1 WHERE n = 1
           WINDOW w AS (PARTITION BY p_name, p_brand, p_type)),
    p3 AS (SELECT p_partkey, p_brand, count(*) OVER w AS n, min(p_partkey) OVER w AS c FROM p2 WHERE n = 1
           WINDOW w AS (PARTITION BY p_name, p_brand))
    SELECT p_partkey, CAST(c AS VARCHAR) AS cluster_id, 'Exact name, brand, type, size' AS matched_by FROM p1 WHERE n > 1
    UNION ALL SELECT p_partkey, CAST(c AS VARCHAR), 'Exact name, brand, type' FROM p2 WHERE n > 1
    UNION ALL SELECT p_partkey, CAST(c AS VARCHAR), 'Exact name and brand' FROM p3 WHERE n > 1 AND p_brand <> 'Brand#1'
    UNION ALL SELECT p_partkey, CAST(p_partkey AS VARCHAR), NULL FROM p3 WHERE n = 1 OR p_brand = 'Brand#1'""")
def waterfall_parts(t: Tables) -> DataFrame:
    return exact_match.waterfall(t.part, "p_partkey", _PASSES)


@query("M4", """
    WITH s AS (SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1)
    SELECT event_id, event_type, value, mean_value, n FROM events JOIN s USING (event_type)""")
def salted_join(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "event_type", "value")
    stats = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    # Event types are few and heavy; 100 rows a task salt every one of them here, each by its own count.
    hot = skew.hot_keys(stats, "event_type", rows_per_task=100)
    return skew.salted_join(events, stats, "event_type", hot, F.col("event_id"))


@query("M7 M8", """
    SELECT p_partkey, '["' || p_brand || '","' || p_type || '"]' AS key, min(p_partkey) OVER w AS block_id, count(*) OVER w AS block_size
    FROM part WINDOW w AS (PARTITION BY p_brand, p_type)""")
def blocked_members(t: Tables) -> DataFrame:
    """Composite blocking as a star; the pairs of a block are counted in ``pair_metrics``."""
    return exact_match.block_members(t.part, "p_partkey", exact_match.blocking_key(BLOCKS))


@query("M7", f"""
    WITH raw AS ({CONTACTS_SQL})
    SELECT contact_id, nullif(substr(regexp_replace(phone, '[^0-9]', '', 'g'), 1, 3), '') AS phone_prefix,
        CASE WHEN contains(email, '@') THEN trim(lower(regexp_extract(email, '[^@]*$'))) END AS email_domain,
        '["' || trim(city) || '","' || trim(state) || '"]' AS city_state
    FROM raw""")
def derived_blocking_keys(t: Tables) -> DataFrame:
    return contacts(t).select("contact_id", exact_match.blocking_key(["phone_prefix:phone"]).alias("phone_prefix"),
                              exact_match.blocking_key(["email_domain:email"]).alias("email_domain"),
                              exact_match.blocking_key(["city", "state"]).alias("city_state"))


def _members(t: Tables) -> DataFrame:
    return similarity_join.value_members(t.part, "p_partkey", BLOCKS, "p_name")


def _fuzzy_sql(score: str, threshold: float) -> str:
    return f"""
    m AS (SELECT p_brand, p_type, p_name AS value, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY ALL),
    pairs AS (SELECT a.p_brand, a.p_type, a.value AS value_a, b.value AS value_b, {score.format(a='a.value', b='b.value')} AS score,
                     a.rep AS rep_a, a.n AS n_a, b.rep AS rep_b, b.n AS n_b
              FROM m a JOIN m b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.value < b.value
              WHERE {score.format(a='a.value', b='b.value')} >= {threshold})"""


@query("M10 M16", f"WITH {_fuzzy_sql(_JW, 0.85)} SELECT * FROM pairs")
def fuzzy_jw_pairs(t: Tables) -> DataFrame:
    return similarity_join.blocked_value_pairs(_members(t), BLOCKS, 0.85)


@query("M10 M16", f"WITH {_fuzzy_sql(_JW, 0.9)} SELECT * FROM pairs")
def fuzzy_jw_pairs_in_blocks(t: Tables) -> DataFrame:
    """The same join run inside the blocks, for values that blocks do not share."""
    return similarity_join.blocked_value_pairs(_members(t), BLOCKS, 0.9, dictionary=False)


@query("M11 M16", f"WITH {_fuzzy_sql(_ED, 0.7)} SELECT * FROM pairs")
def edit_distance_pairs(t: Tables) -> DataFrame:
    return similarity_join.blocked_value_pairs(_members(t), BLOCKS, 0.7, "edit_distance")


@query("M9 M10", """
    WITH u AS (SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages)
    SELECT a.host AS value_a, b.host AS value_b, round(jaro_winkler_similarity(a.host, b.host), 6) AS score
    FROM u a JOIN u b ON a.host < b.host WHERE round(jaro_winkler_similarity(a.host, b.host), 6) >= 0.85""")
def unblocked_similar_hosts(t: Tables) -> DataFrame:
    """Matching without blocking keys: an exact similarity join instead of a cross comparison."""
    hosts = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return similarity_join.similar_by_jaro_winkler(hosts, "host", 0.85)


@query("M9 M11", """
    WITH u AS (SELECT DISTINCT url FROM pages)
    SELECT a.url AS value_a, b.url AS value_b, round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 6) AS score
    FROM u a JOIN u b ON a.url < b.url
    WHERE round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 6) >= 0.9""")
def similar_page_urls(t: Tables) -> DataFrame:
    return similarity_join.similar_by_edit_distance(t.pages, "url", 0.9)


@query("M10 M7", """
    WITH u AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS thing FROM part),
    p AS (SELECT a.p_brand, a.thing AS thing_a, b.thing AS thing_b, a.color AS color_a, b.color AS color_b,
            round(jaro_winkler_similarity(a.thing, b.thing), 6) AS score_thing,
            round(jaro_winkler_similarity(a.color, b.color), 6) AS score_color
          FROM u a JOIN u b ON a.p_brand = b.p_brand AND (a.thing, a.color) < (b.thing, b.color))
    SELECT *, round((0.7 * score_thing + 0.3 * score_color) / (0.7 + 0.3), 6) AS score FROM p
    WHERE round((0.7::DOUBLE * score_thing + 0.3::DOUBLE * score_color) / (0.7::DOUBLE + 0.3::DOUBLE), 6) >= 0.84""")
def weighted_field_pairs(t: Tables) -> DataFrame:
    df = t.part.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"),
                       F.split_part("p_name", F.lit(" "), F.lit(2)).alias("thing"))
    return matching.similar_by_weighted_fields(df, ["p_brand"], ("thing", 0.7), ("color", 0.3), 0.84)


_FIELDS = {"thing": 0.5, "color": 0.3, "box": 0.2}
_SOUNDEX_OF_THING = _SOUNDEX_SQL.replace("SELECT p_partkey, upper(trim(p_name)) AS w FROM part", "SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS w FROM part").strip()


@query("M10 M7 C3", f"""
    WITH sound AS ({_SOUNDEX_OF_THING}),
    u AS (SELECT DISTINCT p_brand || p_size AS k0, name_soundex || p_size AS k1, split_part(p_name, ' ', 2) AS thing, split_part(p_name, ' ', 1) AS color, p_type AS box
          FROM part JOIN sound USING (p_partkey)),
    n AS (SELECT *, row_number() OVER (ORDER BY thing, color, box, k0, k1) AS i FROM u),
    p AS (SELECT CASE WHEN a.k0 = b.k0 THEN 'brand_size' ELSE 'sound_size' END AS matched_key, least(a.thing, b.thing) AS thing_least, greatest(a.thing, b.thing) AS thing_most,
            round(jaro_winkler_similarity(a.thing, b.thing), 6) AS score_thing, round(jaro_winkler_similarity(a.color, b.color), 6) AS score_color,
            round(jaro_winkler_similarity(a.box, b.box), 6) AS score_box
          FROM n a JOIN n b ON a.i < b.i AND (a.k0 = b.k0 OR a.k1 = b.k1)),
    s AS (SELECT *, round((0.5::DOUBLE * score_thing + 0.3::DOUBLE * score_color + 0.2::DOUBLE * score_box) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE), 6) AS score FROM p)
    SELECT matched_key, thing_least, thing_most, score_thing, score_color, score_box, score, count(*) AS pairs FROM s WHERE score >= 0.9 GROUP BY ALL""")
def three_field_pairs(t: Tables) -> DataFrame:
    """Pairs of parts by brand and size or, failing that, by the sound of their noun and size; mean over three fields."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = t.part.select(F.concat("p_brand", "p_size").alias("brand_size"), F.concat(phonetic_key(noun), "p_size").alias("sound_size"),
                         noun.alias("thing"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color"), F.col("p_type").alias("box"))
    pairs = matching.similar_by_fields(rows, ["brand_size", "sound_size"], _FIELDS, 0.9)
    return (pairs.groupBy("matched_key", F.least("thing_a", "thing_b").alias("thing_least"), F.greatest("thing_a", "thing_b").alias("thing_most"),
                          *[f"score_{f}" for f in _FIELDS], "score").agg(F.count(F.lit(1)).alias("pairs")))


@query("M19", f"""
    WITH {_fuzzy_sql(_JW, 0.85)},
    b AS (SELECT sum(n) AS size, sum(n * (n - 1) // 2) AS same FROM m GROUP BY p_brand, p_type),
    tot AS (SELECT CAST(sum(size) AS BIGINT) AS records, CAST(sum(size * (size - 1) // 2) AS BIGINT) AS candidates, sum(same) AS same FROM b),
    x AS (SELECT coalesce(sum(n_a * n_b), 0) AS cross_pairs, coalesce(sum(n_a * n_b * CAST(score AS DECIMAL(10, 6))), 0) AS ss FROM pairs)
    SELECT records, candidates, round(1 - candidates / (records * (records - 1) / 2), 6) AS reduction,
        CAST(same + cross_pairs AS BIGINT) AS resolved_pairs,
        round(CAST(same + ss AS DOUBLE) / CAST(same + cross_pairs AS DOUBLE), 6) AS average_similarity
    FROM tot, x""")
def pair_metrics(t: Tables) -> DataFrame:
    members = _members(t)
    pairs = similarity_join.blocked_value_pairs(members, BLOCKS, 0.85)
    out = similarity_join.pair_metrics(members, pairs, BLOCKS)
    return out.withColumns({"reduction": F.round("reduction", 6), "average_similarity": F.round("average_similarity", 6)})


@query("M14", f"""
    WITH {_fuzzy_sql(_JW, 0)}
    SELECT * FROM (SELECT *, CASE WHEN score >= 0.95 THEN 'near equal' WHEN value_a[1:4] = value_b[1:4] THEN 'same start'
        WHEN score >= 0.8 THEN 'similar' END AS rule FROM pairs) WHERE rule IS NOT NULL""")
def rule_cascade(t: Tables) -> DataFrame:
    start = F.substring("value", 1, 4)
    pairs = matching.cascade_candidates(_members(t), BLOCKS, 0.8, {"same start": start})
    same_start = F.substring("value_a", 1, 4) == F.substring("value_b", 1, 4)
    return matching.cascade(pairs, [("near equal", F.col("score") >= 0.95), ("same start", same_start),
                                    ("similar", F.col("score") >= 0.8)])


_LOWEST_REVIEW = min(review for _, review in matching.BAND_PRESETS.values())


@query("M17 M18", f"""
    WITH {_fuzzy_sql(_JW, 0)}
    SELECT *, CASE WHEN score >= 0.85 THEN 'AUTO_MERGE' WHEN score >= 0.7 THEN 'REVIEW'
        ELSE 'NO_MATCH' END AS config_band, CASE WHEN score >= 0.95 THEN 'AUTO_MERGE' WHEN score >= 0.8 THEN 'REVIEW'
        ELSE 'NO_MATCH' END AS resolution_band, CASE WHEN score >= 0.9 THEN 'AUTO_MERGE' WHEN score >= 0.7 THEN 'REVIEW'
        ELSE 'NO_MATCH' END AS review_band, CASE WHEN score < 0.5 THEN 'lenient' WHEN score < 0.8 THEN 'moderate'
        ELSE 'strict' END AS strictness FROM pairs
    WHERE config_band <> 'NO_MATCH' OR resolution_band <> 'NO_MATCH' OR review_band <> 'NO_MATCH'""")
def match_bands(t: Tables) -> DataFrame:
    """The pairs that some preset merges or reviews; all others are NO_MATCH in every preset and are counted in ``band_summary``."""
    pairs = similarity_join.blocked_value_pairs(_members(t), BLOCKS, _LOWEST_REVIEW)
    score = F.col("score")
    return pairs.withColumns({**{f"{p}_band": matching.preset_band(score, p) for p in matching.BAND_PRESETS},
                              "strictness": matching.strictness(score)})


@query("M17 M22 M6", f"""
    WITH scored AS (SELECT round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score FROM part a JOIN part b
                    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey),
    c AS (SELECT band, count(score) AS n FROM (VALUES ('AUTO_MERGE'), ('REVIEW'), ('NO_MATCH')) v(band) LEFT JOIN scored
          ON band = CASE WHEN score >= 0.85 THEN 'AUTO_MERGE' WHEN score >= 0.7 THEN 'REVIEW' ELSE 'NO_MATCH' END GROUP BY 1)
    SELECT band, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent, CASE band WHEN 'AUTO_MERGE' THEN 'merge into golden record'
        WHEN 'REVIEW' THEN 'send to steward' ELSE 'create new golden id' END AS action FROM c""")
def band_summary(t: Tables) -> DataFrame:
    """All candidate pairs of records by band; the oracle compares every pair."""
    members, (auto, review) = _members(t), matching.BAND_PRESETS["config"]
    pairs = similarity_join.blocked_value_pairs(members, BLOCKS, review)
    out = matching.band_summary(similarity_join.band_totals(members, pairs, BLOCKS, auto, review))
    return out.withColumn("percent", F.round("percent", 6))


@query("M20", """
    WITH r AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey, count(*) AS reference_count FROM supplier GROUP BY 1)
    SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS key, s_suppkey, reference_count
    FROM customer JOIN r ON c_nationkey = s_nationkey""")
def linkage_two_sources(t: Tables) -> DataFrame:
    return exact_match.link_sources(t.customer, t.supplier, "c_custkey", "s_suppkey",
                                    exact_match.blocking_key(["c_nationkey"]), exact_match.blocking_key(["s_nationkey"]))


def _components_sql(edges: str) -> str:
    """Smallest reachable node by repeated minimum over both directions of the edges."""
    return f"""
    e AS ({edges}), both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
    comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a)"""


@query("M13 M10 M5", f"""
    WITH RECURSIVE {_fuzzy_sql(_JW, 0.93)},
    {_components_sql('SELECT rep_a AS src, rep_b AS dst FROM pairs')}
    SELECT p_partkey, CAST(coalesce(component, rep) AS VARCHAR) AS cluster_id
    FROM part p JOIN m ON p.p_brand = m.p_brand AND p.p_type = m.p_type AND p.p_name = m.value
    LEFT JOIN comp ON node = rep""")
def clusters_components(t: Tables) -> DataFrame:
    return matching.fuzzy_clusters(t.part, "p_partkey", BLOCKS, "p_name", 0.93)


@query("M15 M13 M6", f"""
    WITH RECURSIVE {_fuzzy_sql(_JW, 0.93)},
    ident AS (SELECT p_partkey, min(p_partkey) OVER w AS g FROM part WHERE p_size <= 25
              WINDOW w AS (PARTITION BY p_name, p_brand, p_size)),
    {_components_sql('''SELECT DISTINCT src, dst FROM (
        SELECT m1.rep AS src, m2.rep AS dst FROM ident i JOIN part p USING (p_partkey)
            JOIN m m1 ON p.p_brand = m1.p_brand AND p.p_type = m1.p_type AND p.p_name = m1.value
            JOIN part q ON q.p_partkey = i.g JOIN m m2 ON q.p_brand = m2.p_brand AND q.p_type = m2.p_type AND q.p_name = m2.value
        UNION ALL SELECT rep_a, rep_b FROM pairs) WHERE src <> dst''')}
    SELECT p_partkey, CAST(coalesce(component, rep) AS VARCHAR) AS cluster_id,
        sha256(CAST(coalesce(component, rep) AS VARCHAR)) AS golden_id
    FROM part p JOIN m ON p.p_brand = m.p_brand AND p.p_type = m.p_type AND p.p_name = m.value
    LEFT JOIN comp ON node = rep""")
def hybrid_match(t: Tables) -> DataFrame:
    identifier = F.when(F.col("p_size") <= 25, exact_match.blocking_key(["p_name", "p_brand", "p_size"]))
    out = matching.hybrid_clusters(t.part, "p_partkey", identifier, BLOCKS, "p_name", 0.93)
    return out.withColumn("golden_id", exact_match.golden_id("cluster_id"))


@query("M21", """
    WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
               UNION ALL SELECT vec_id + 1000000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i <= 6 THEN -x ELSE x END) FROM embeddings),
    v AS (SELECT v, min(vec_id) AS rep, count(*) AS n FROM w GROUP BY 1),
    p AS (SELECT x.rep AS rep_a, y.rep AS rep_b, x.n AS n_a, y.n AS n_b, list_cosine_similarity(x.v, y.v) AS c FROM v x JOIN v y ON x.rep < y.rep)
    SELECT rep_a, rep_b, n_a, n_b, round(c, 6) AS score, CASE WHEN c >= 0.85 THEN 'Match' ELSE 'Review' END AS decision FROM p WHERE c >= 0.7""")
def vector_match_pairs(t: Tables) -> DataFrame:
    """Vectors and variants of them (six coordinates turned over) at a cosine that means "same"; the oracle is exact."""
    turned = F.transform("v", lambda x, i: F.when(i < 6, -x).otherwise(x))
    own = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = own.unionByName(own.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), turned.alias("v")))
    pairs = vector_match.vector_pairs(both, "vec_id", "v", 0.7, recall=0.99999)
    return pairs.withColumn("decision", vector_match.vector_band(F.col("score"), 0.85, 0.7)).withColumn(
        "score", F.round("score", 6))


@query("M10 M7 M13", f"""
    WITH RECURSIVE c AS (SELECT c_custkey, split_part(c_name, '#', 1) || c_mktsegment || right(c_name, 2) AS label, substr(c_phone, 1, 3) AS prefix FROM
            (SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey + 10 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS c_phone FROM customer)),
    k AS (SELECT c_custkey, label, nullif(substr(regexp_replace(prefix, '[^0-9]', '', 'g'), 1, 3), '') AS block FROM c),
    m AS (SELECT block, label, min(c_custkey) AS rep FROM k WHERE block IS NOT NULL GROUP BY ALL),
    {_components_sql('''SELECT a.rep AS src, b.rep AS dst FROM m a JOIN m b ON a.block = b.block AND a.label < b.label
        WHERE round(jaro_winkler_similarity(a.label, b.label), 6) >= 0.97''')}
    SELECT c_custkey, CAST(coalesce(component, rep, c_custkey) AS VARCHAR) AS cluster_id
    FROM k LEFT JOIN m USING (block, label) LEFT JOIN comp ON node = rep""")
def fuzzy_derived_block(t: Tables) -> DataFrame:
    """Similar labels of customers inside a derived block, the prefix of a phone number."""
    phone = F.substring(F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")), 1, 3)
    label = F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), "c_mktsegment", F.right("c_name", F.lit(2)))
    rows = t.customer.select("c_custkey", label.alias("label"), phone.alias("phone"))
    return matching.fuzzy_clusters(rows, "c_custkey", ["phone_prefix:phone"], "label", 0.97)


@query("M23 N8", f"""
    WITH r AS ({REVIEW_SQL}), d AS ({DECISIONS_SQL})
    SELECT record_id, cluster_id FROM r WHERE cluster_id NOT IN
        (SELECT cluster_id FROM d WHERE action IN ('Match Approved', 'Match Rejected'))""")
def exclude_decided_clusters(t: Tables) -> DataFrame:
    return exclude_decided(review_records(t).select("record_id", "cluster_id"), decisions(t))


@query("M10", """
    WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, p_name[1:5] || reverse(p_name) AS other FROM n)
    SELECT p_name, other, round(jaro_winkler_similarity(p_name, other), 6) AS score FROM s""")
def jaro_winkler_scores(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    other = F.concat(F.substring("p_name", 1, 5), F.reverse("p_name"))
    return names.select("p_name", other.alias("other")).withColumn("score", F.round(jaro_winkler("p_name", "other"), 6))
