import collections
import itertools
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from goldweave.functions.similarity import jaro_winkler, jaro_winkler_batch
from goldweave.operators import components, exact_match, matching, similarity_join, skew, vector_match
from goldweave.operators.components import assign_clusters, connected_components
from goldweave.operators.review import APPROVED, REJECTED, apply_decisions

CON = duckdb.connect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcx ", min_size=1, max_size=14), st.text("abcx ", min_size=1, max_size=14)), min_size=1, max_size=30))
def test_jaro_winkler_batch_matches_oracle(pairs):
    left, right = zip(*pairs)
    got = jaro_winkler_batch(list(left), list(right))
    for a, b, g in zip(left, right, got):
        assert g == pytest.approx(CON.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-12)


def test_jaro_winkler_nulls_and_boost(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("martha", "marhta"), ("abxx", "abyy")], "a string, b string")
    got = [r[0] for r in df.select(jaro_winkler("a", "b")).collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.961111, abs=1e-6) and got[3] == pytest.approx(2 / 3)


def _names(seed, n):
    rnd = random.Random(seed)
    base = ["jonathan smith", "maria gonzalez", "acme widgets ltd", "st mary hospital", "red widget", "li", "bo", "x"]
    out = set(base)
    while len(out) < n:
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(w) + 1)
            kind = rnd.random()
            if kind < 0.4:
                w.insert(i, rnd.choice("aeiostz"))
            elif kind < 0.7 and len(w) > 1:
                del w[i - 1]
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        out.add("".join(w).strip() or "q")
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.6, 0.72, 0.85, 0.95])
def test_jaro_winkler_join_is_exact(spark, threshold):
    names = _names(1, 220) + ["a" * 30 + s for s in ("b", "c", "bcdef")] + ["the quick brown fox jumps over dogs", "quick the brown fox jumps over dog"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = {(r.value_a, r.value_b) for r in similarity_join.similar_by_jaro_winkler(df, "v", threshold).collect()}
    pairs = list(itertools.combinations(sorted(set(names)), 2))
    scores = jaro_winkler_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert got == {p for p, s in zip(pairs, scores) if round(s, 6) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_edit_distance_join_is_exact(spark, threshold):
    names = _names(2, 200)
    df = spark.createDataFrame([(n,) for n in names], "v string")
    rows = similarity_join.similar_by_edit_distance(df, "v", threshold).collect()
    got = {(r.value_a, r.value_b) for r in rows}
    assert len(rows) == len(got)
    expected = CON.execute("""select a, b from (select unnest(?) a), (select unnest(?) b) where a < b
        and round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) >= ?""", [names, names, threshold]).fetchall()
    assert got == set(expected)


def test_texts_that_share_their_parts_are_compared_in_blocks(spark, monkeypatch):
    """Addresses of one site meet in most signatures; the comparison in blocks gives the same pairs."""
    rnd = random.Random(12)
    texts = sorted({f"https://site.example.org/{rnd.choice(['en', 'fr'])}/{rnd.randrange(9_000)}{rnd.choice(['', '.html', '?é=' + 'x' * 40])}" for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    monkeypatch.setattr(similarity_join, "HEAVY_START", 100)
    called = []
    compared = similarity_join.compared_texts
    monkeypatch.setattr(similarity_join, "compared_texts", lambda *a: called.append(1) or compared(*a, 64))
    rows = similarity_join.similar_by_edit_distance(df, "v", 0.9).collect()
    assert called
    got = {(r.value_a, r.value_b) for r in rows}
    monkeypatch.setattr(similarity_join, "HEAVY_START", 10_000)
    expected = {(r.value_a, r.value_b) for r in similarity_join.similar_by_edit_distance(df, "v", 0.9).collect()}
    assert len(called) == 1 and len(rows) == len(got) and got == expected and len(got) > 1000


def test_joins_within_blocks_equal_the_dictionary(spark):
    rows = [(i, f"b{i % 3}", n) for i, n in enumerate(_names(3, 150))]
    members = similarity_join.value_members(spark.createDataFrame(rows, "id long, b string, name string"), "id", ["b"], "name")
    a = similarity_join.blocked_value_pairs(members, ["b"], 0.8)
    b = similarity_join.blocked_value_pairs(members, ["b"], 0.8, dictionary=True)
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect())) != []


def test_similarity_join_never_broadcasts_or_crosses(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for f in similarity_join.SIMILARITY.values():
        plan = f(df, "v", 0.8)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert plan.count("ArrowEvalPython") <= 2  # once in either printed plan


def _find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def _graphs():
    rnd = random.Random(5)
    yield "path", [(i, i + 1) for i in range(60)]
    yield "reversed path", [(99 - i, 98 - i) for i in range(40)]
    yield "high hub", [(1000, i) for i in range(80)]
    yield "random", [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)]
    yield "empty", []


@pytest.mark.parametrize("name, edges", list(_graphs()), ids=lambda v: v if isinstance(v, str) else "")
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == _find([e for e in edges if e[0] != e[1]])


def test_components_of_text_ids_do_not_depend_on_order(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "y"), ("a", "a")]
    shuffled = [(b, a) for a, b in reversed(edges)]
    records = spark.createDataFrame([(c,) for c in "abcxyzq"], "id string")
    results = [{r.id: r.cluster_id for r in assign_clusters(records, "id", spark.createDataFrame(e, "src string, dst string").repartition(k)).collect()}
               for e, k in ((edges, 1), (shuffled, 7))]
    assert results[0] == results[1] == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "q": "q"}


def test_waterfall_assigns_every_record_once(spark):
    rows = [(1, "n1", "z1"), (2, "n1", "z9"), (3, None, "z1"), (4, "", "z2"), (5, " ", "z2"), (6, "n2", "00000"), (7, None, "00000"), (8, None, None)]
    df = spark.createDataFrame(rows, "id long, npi string, zip string")
    passes = [{"name": "npi", "blocking_key": "npi"}, {"name": "zip", "blocking_key": ["zip"], "stop_values": ["00000"]}]
    got = {r.id: (r.cluster_id, r.matched_by) for r in exact_match.waterfall(df, "id", passes).collect()}
    assert got == {1: ("1", "npi"), 2: ("1", "npi"), 3: ("3", None), 4: ("4", "zip"), 5: ("4", "zip"),
                   6: ("6", None), 7: ("7", None), 8: ("8", None)}
    with pytest.raises(ValueError):
        exact_match.waterfall(df, "id", [{"name": "f", "blocking_key": "npi", "method": "fuzzy"}])


def test_hot_key_is_salted_by_its_count(spark):
    """One key holds a third of the rows; it alone is spread, and results agree with the plain join."""
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("k"))
    groups = {r.id: (r.group_id, r.group_size) for r in exact_match.exact_groups(df, "id", exact_match.blocking_key(["k"])).collect()}
    keyed = df.select("id", F.col("k").alias("key"))
    facts = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    hot = skew.hot_keys(facts, "key", rows_per_task=100)
    assert [tuple(r) for r in hot.collect()] == [("hot", 10)]
    spread = skew.salted_join(keyed, facts, "key", hot, F.col("id"))
    assert {r.id: (r.least, r.n) for r in spread.collect()} == groups and len(groups) == 3000
    with pytest.raises(ValueError):
        skew.salted_join(keyed, facts, "key", hot, F.col("id"), how="full")


def test_fuzzy_and_hybrid_clusters(spark):
    rows = [(1, "b", "jon smith", "p1"), (2, "b", "jon smyth", "p2"), (3, "b", "zed", "p2"), (4, "c", "jon smith", None),
            (5, None, "jon smith", None), (6, "b", None, "p9"), (7, "b", "", "p9")]
    df = spark.createDataFrame(rows, "id long, block string, name string, phone string")
    fuzzy = {r.id: r.cluster_id for r in matching.fuzzy_clusters(df, "id", ["block"], "name", 0.85).collect()}
    assert fuzzy == {1: "1", 2: "1", 3: "3", 4: "4", 5: "5", 6: "6", 7: "7"}
    hybrid = {r.id: r.cluster_id for r in matching.hybrid_clusters(df, "id", exact_match.blocking_key(["phone"]), ["block"], "name").collect()}
    assert hybrid == {1: "1", 2: "1", 3: "1", 4: "4", 5: "5", 6: "6", 7: "6"}


def test_bands(spark):
    df = spark.createDataFrame([(0.978,), (0.95,), (0.912,), (0.85,), (0.7,), (0.387,), (None,)], "s double")
    row = {p: [r[0] for r in df.select(matching.preset_band(F.col("s"), p)).collect()] for p in matching.BAND_PRESETS}
    assert row["config"] == ["AUTO_MERGE"] * 4 + ["REVIEW", "NO_MATCH", None]
    assert row["resolution"] == ["AUTO_MERGE", "AUTO_MERGE", "REVIEW", "REVIEW", "NO_MATCH", "NO_MATCH", None]
    assert row["review"] == ["AUTO_MERGE"] * 3 + ["REVIEW", "REVIEW", "NO_MATCH", None]


def test_vector_match_finds_close_vectors(spark):
    rnd = random.Random(9)
    rows, planted = [], set()
    for i in range(0, 200, 2):
        v = [rnd.gauss(0, 1) for _ in range(32)]
        rows += [(i, v), (i + 1, [x + rnd.gauss(0, 0.1) for x in v])]
        planted.add((i, i + 1))
    rows.append((999, rows[0][1]))  # a copy
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = vector_match.vector_pairs(df, "id", "v", 0.9).collect()
    found = {(r.rep_a, r.rep_b) for r in got}
    assert len(found) == len(got) and found <= planted and len(found) >= 0.99 * len(planted)
    assert {(r.rep_a, r.n_a) for r in got if r.rep_a == 0} == {(0, 2)}


def test_link_sources_does_not_multiply(spark):
    left = spark.createDataFrame([(i, "k") for i in range(50)] + [(99, None)], "id long, k string")
    right = spark.createDataFrame([(i, "k") for i in range(40)], "rid long, k string")
    got = exact_match.link_sources(left, right, "id", "rid", F.col("k"), F.col("k")).collect()
    assert len(got) == 50 and {(r.rid, r.reference_count) for r in got} == {(0, 40)}


def test_weighted_fields_equal_brute_force(spark):
    """Null fields drop out of the mean, equal primaries may differ in the rest, low thresholds lose nothing."""
    rnd = random.Random(8)
    words = _names(4, 25)
    rows = sorted({(f"b{rnd.randrange(2)}", rnd.choice([*words, None]), rnd.choice([*words[:12], None])) for _ in range(70)},
                  key=str)
    df = spark.createDataFrame(rows, "b string, p string, s string")
    for threshold in (0.7, 0.85):
        expected = CON.execute("""
            WITH t AS (SELECT unnest(?) AS b, unnest(?) AS p, unnest(?) AS s), k AS (SELECT *, row_number() OVER () AS i FROM t),
            x AS (SELECT x.b, x.i AS i, y.i AS j, round(jaro_winkler_similarity(x.p, y.p), 6) AS sp, round(jaro_winkler_similarity(x.s, y.s), 6) AS ss
                  FROM k x JOIN k y ON x.b = y.b AND x.i < y.i)
            SELECT i - 1, j - 1, round((coalesce(0.7::DOUBLE * sp, 0) + coalesce(0.3::DOUBLE * ss, 0)) /
                (CASE WHEN sp IS NULL THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN ss IS NULL THEN 0 ELSE 0.3::DOUBLE END), 6) AS score
            FROM x WHERE sp IS NOT NULL OR ss IS NOT NULL""", [[r[k] for r in rows] for k in range(3)]).fetchall()
        want = {frozenset((rows[i], rows[j])): s for i, j, s in expected if s >= threshold}
        found = matching.similar_by_weighted_fields(df, ["b"], ("p", 0.7), ("s", 0.3), threshold).collect()
        got = {frozenset(((r.b, r.p_a, r.s_a), (r.b, r.p_b, r.s_b))): r.score for r in found}
        assert len(got) == len(found) and got == pytest.approx(want, abs=2e-6)


def test_soundex_is_another_way_in(spark):
    rows = [(1, "z1", "Robert Smith", "Smith"), (2, "z2", "Robert Smyth", "Smyth"), (3, "z1", "Robert Smythe", "Smythe"), (4, "z3", "Ann Lee", "Lee")]
    df = spark.createDataFrame(rows, "id long, zip string, name string, last string")
    plain = {r.id: r.cluster_id for r in matching.fuzzy_clusters(df, "id", ["zip"], "name", 0.9).collect()}
    sound = {r.id: r.cluster_id for r in matching.fuzzy_clusters(df, "id", ["zip"], "name", 0.9, phonetic="last").collect()}
    assert plain == {1: "1", 2: "2", 3: "1", 4: "4"} and sound == {1: "1", 2: "1", 3: "1", 4: "4"}


def test_vector_bands_are_planned():
    """Bands follow from the number of vectors and the minimum; no minimum is refused, and buckets prune at every size."""
    for rows in (1_000, 4_000, 1_000_000, 100_000_000):
        bands, functions = vector_match.plan_bands(rows, 64, 0.7, 0.999)
        compared = bands * (2 * functions + 1) / 128 ** functions  # share of unrelated pairs that meet, at most
        assert compared < 0.1
    assert vector_match.plan_bands(1_000_000, 64, 0.2, 0.95)[0] > bands


def test_vector_buckets_prune_and_lose_nothing(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = table.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("v", lambda x, i: F.when(i < 6, -x).otherwise(x)).alias("v"))
    both = table.unionByName(turned)
    rows = both.collect()
    unit = np.array([r.v for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T, 1) >= 0.7
    expected = {tuple(sorted((rows[i].vec_id, rows[j].vec_id))) for i, j in zip(*np.nonzero(near))}
    got = {(r.rep_a, r.rep_b) for r in vector_match.vector_pairs(both, "vec_id", "v", 0.7, 0.999).collect()}
    assert got <= expected and len(got) >= 0.99 * len(expected) > 1000
    distinct = both.withColumnRenamed("vec_id", "rep")
    assert vector_match.bucket_pairs(distinct, 0.7, 0.999, len(rows), 64).count() < 0.1 * len(rows) * (len(rows) - 1) / 2


def test_equal_pairs_of_a_batch_are_scored_once(monkeypatch):
    import pandas as pd

    from goldweave.functions import similarity

    words = ["gear", "gears", None, "geär", ""]
    pairs = [(a, b) for a in words for b in words] * 20
    scored, plain = [], similarity.jaro_winkler_batch
    udf = similarity.jaro_winkler.func
    monkeypatch.setitem(udf.__globals__, "jaro_winkler_batch", lambda a, b: scored.append(len(a)) or plain(a, b))
    got = next(iter(udf(iter([tuple(pd.Series(c, dtype=object) for c in zip(*pairs))])))).tolist()
    assert sum(scored) == 16  # of 320 known ones
    assert got == [None if a is None or b is None else plain([a], [b])[0] for a, b in pairs]


def test_all_vectors_are_compared_in_blocks(spark):
    """Near copies meet in every band, so their candidates are many times the pairs; blocks give each pair once."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.standard_normal((30, 16)), 20, axis=0) + 0.1 * rng.standard_normal((600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, v[3].tolist()), (901, [0.0] * 16), (902, None), (None, v[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert vector_match.all_in_blocks(200_000, 64, 301, 3) and not vector_match.all_in_blocks(10_000_000, 64, 10, 3)
    distinct = df.filter("id < 900").select(F.col("id").alias("rep"), F.col("id").alias("node"), F.lit(1).cast("long").alias("n"), "v")
    blocked = vector_match.compared_pairs(distinct, 0.9, 600, 16, 100).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {tuple(p) for p in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()}
    assert {(r.rep_a, r.rep_b) for r in blocked} == expected and len(blocked) == len(expected)
    whole = vector_match.vector_pairs(df, "id", "v", 0.9)
    assert "Join" not in whole._jdf.queryExecution().toString()  # pairs leave the blocks with their scores
    assert {(r.rep_a, r.rep_b) for r in whole.collect()} == expected


def _links(n):
    rnd = random.Random(n)
    out = ["http" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(8, 12))) for _ in range(n)]
    return sorted({*out, *[v[:-1] + "z" for v in out[::9]]})


def test_a_common_start_does_not_pair_its_values(spark):
    """Values of one start: a small share of the pairs are candidates, at any number of values, and rows equal brute force."""
    for n in (400, 1600):
        names = _links(n)
        df = spark.createDataFrame([(v,) for v in names], "v string")
        assert similarity_join.jaro_winkler_candidates(df, "v", 0.9).count() < 0.01 * len(names) * (len(names) - 1) / 2
    got = {(r.value_a, r.value_b) for r in similarity_join.similar_by_jaro_winkler(df, "v", 0.9).collect()}
    pairs = list(itertools.combinations(names, 2))
    scores = jaro_winkler_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert got == {p for p, s in zip(pairs, scores) if round(s, 6) >= 0.9} and len(got) > 100


def test_tokens_come_in_measured_order(spark):
    df = spark.createDataFrame([("aab",), ("ab",), ("abz",)], "v string")
    assert similarity_join.token_order(df) == [("z", 1), ("a", 2), ("b", 1), ("a", 1)]
    ranks = {t: k for k, t in enumerate(similarity_join.token_order(df))}
    assert [chr(code & 0x1FFFFF) for code, _ in similarity_join._ranked_tokens("abaz", ranks)] == ["z", "a", "b", "a"]


def test_heavy_signatures_become_grids(spark, monkeypatch):
    """A third of the values in one block and start: no sub-group holds them, and the rows are the same."""
    names = _names(6, 240)
    rows = [("hot" if i % 3 == 0 else f"b{i % 40}", v) for i, v in enumerate(names)]
    df = spark.createDataFrame(rows, "b string, v string")
    starts = similarity_join.shared_starts(df.distinct(), ["b"])
    sides = [similarity_join.jaro_winkler_signatures(starts, ["b"], 0.8, similarity_join.token_order(df), role) for role in (0, 1)]

    def largest(tables, *keys):  # of the signatures that both sides have
        return max(t.join(o, ["b", "sig"], "left_semi").groupBy("b", "sig", *keys).count().agg(F.max("count")).first()[0]
                   for t, o in (tables, tables[::-1]))
    assert largest(sides) > 20 > 14 >= largest(similarity_join.balanced(*sides, ["b"], cell_rows=5), "cell")
    plain = {tuple(r) for r in similarity_join.similar_by_jaro_winkler(df, "v", 0.8, ["b"]).collect()}
    cut = similarity_join.balanced
    monkeypatch.setattr(similarity_join, "HEAVY_START", 20)
    monkeypatch.setattr(similarity_join, "balanced", lambda short, long, blocks: cut(short, long, blocks, cell_rows=10))
    assert {tuple(r) for r in similarity_join.similar_by_jaro_winkler(df, "v", 0.8, ["b"]).collect()} == plain != set()


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_many_fields_and_keys_equal_brute_force(spark, threshold):
    """Three fields, one of them a column's Soundex as a key: each pair once, in its first key."""
    rnd = random.Random(12)
    words = _names(4, 18)
    rows = sorted({(rnd.choice(["k1", "k2", None]), rnd.choice(["smith", "smyth", "lee", None]), rnd.choice([*words, None]), rnd.choice([*words[:7], None]),
                    rnd.choice([*words[:5], None, ""])) for _ in range(70)}, key=str)
    df = spark.createDataFrame(rows, "z string, last string, p string, q string, r string")
    weights = {"p": 0.5, "q": 0.3, "r": 0.2}
    got = matching.similar_by_fields(df, ["z", "soundex:last"], weights, threshold).collect()
    sound = {"smith": 1, "smyth": 1, "lee": 2, None: None}
    tuples = sorted({(z, sound[last], p, q, r or None) for z, last, p, q, r in rows}, key=str)
    want = collections.Counter()
    for a, b in itertools.combinations(tuples, 2):
        key = next((n for n, k in (("z", 0), ("soundex:last", 1)) if a[k] is not None and a[k] == b[k]), None)
        both = [(w, jaro_winkler_batch([a[i]], [b[i]])[0]) for i, w in zip((2, 3, 4), weights.values()) if a[i] is not None and b[i] is not None]
        if key and both and round(sum(w * round(s, 6) for w, s in both) / sum(w for w, _ in both), 6) >= threshold:
            want[key, frozenset({a[2:], b[2:]})] += 1
    assert collections.Counter((r.matched_key, frozenset({(r.p_a, r.q_a, r.r_a), (r.p_b, r.q_b, r.r_b)})) for r in got) == want != {}


def test_decisions_in_two_batches_equal_one(spark):
    """Labels move by the edges of the approved proposals of a batch; a second batch works on the labels of the first."""
    records = spark.createDataFrame([(i, str(i // 2)) for i in range(12)], "record_id long, cluster_id string")
    proposals = spark.createDataFrame([("p1", "0", "1"), ("p2", "1", "2"), ("p3", "3", "4"), ("p4", "4", "5")], "proposal string, a string, b string")

    def said(*rows):
        return spark.createDataFrame([(t, c, a) for t, (c, a) in enumerate(rows)], "timestamp long, cluster_id string, action string")
    first = said(("p1", APPROVED), ("p3", APPROVED), ("5", REJECTED), ("p4", APPROVED))
    second = said(("p2", APPROVED), ("p3", APPROVED))
    once = apply_decisions(records, first, "record_id", proposals=proposals)
    labels = {r.record_id: r.cluster_id for r in once.collect()}
    assert labels == {0: "0", 1: "0", 2: "0", 3: "0", 4: "2", 5: "2", 6: "3", 7: "3", 8: "3", 9: "3", 10: "10", 11: "11"}
    moved = proposals.replace({"1": "0"}, subset=["a", "b"])  # proposals name the clusters by their present labels
    twice = {r.record_id: r.cluster_id for r in apply_decisions(once, second, "record_id", proposals=moved).collect()}
    assert twice == {**labels, 4: "0", 5: "0"}
