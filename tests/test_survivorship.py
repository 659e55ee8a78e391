import datetime as dt

import pytest
from pyspark.sql import functions as F

from goldweave.operators import review, survivorship as s

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("c1", "r2", "A", 0.9, DAY, None, 5, "x"),
        ("c1", "r1", "B", 0.8, DAY + dt.timedelta(days=1), "long value", 7, "y"),
        ("c1", "r3", "B", 0.8, DAY + dt.timedelta(days=1), "short", 7, "x"),
        ("c2", "r5", "A", 0.9, DAY, "p", None, "q"),
        ("c2", "r4", "A", 0.9, DAY, "p", None, "r"),
        ("c3", "r6", "Z", 0.5, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "cluster string, id string, src string, trust double, ts timestamp, name string, n int, t string")


def _rows(df):
    return {r.cluster: r.asDict() for r in df.collect()}


def test_golden_rows_break_ties_by_smallest_id(records):
    got = _rows(s.golden_rows(records, "cluster", "id", "trust", "ts"))
    assert {c: r["id"] for c, r in got.items()} == {"c1": "r2", "c2": "r4", "c3": "r6"}
    assert got["c1"]["name"] is None and set(got["c1"]) == set(records.columns)
    by_time = _rows(s.golden_rows(records, "cluster", "id", recency="ts"))
    assert {c: r["id"] for c, r in by_time.items()} == {"c1": "r1", "c2": "r4", "c3": "r6"}


def test_golden_fields_prefer_known_values(records):
    got = _rows(s.golden_fields(records, "cluster", "id", ["name", "n", "t"], {"primary": s.SOURCE_PRIORITY, "fallback": s.RECENCY},
                                trust="trust", recency="ts", source="src"))
    assert (got["c1"]["name"], got["c1"]["name_record"], got["c1"]["n"], got["c1"]["t"]) == ("long value", "r1", 5, "x")
    assert got["c2"]["t"] == "r" and got["c2"]["t_record"] == "r4" and got["c2"]["n"] is None
    assert got["c3"]["name"] is None and got["c3"]["name_source"] is None


def test_overrides_and_manual_review(records):
    rules = [{"attr": "name", "primary": s.COMPLETENESS}, {"attr": "n", "primary": s.MAXIMUM},
             {"attr": "t", "primary": s.SOURCE_PRIORITY, "fallback": s.MANUAL_REVIEW}]
    got = _rows(s.golden_fields(records, "cluster", "id", ["name", "n", "t"], {"primary": s.RECENCY}, rules, "trust", "ts"))
    assert (got["c1"]["name"], got["c1"]["n"], got["c1"]["t"], got["c1"]["t_review"]) == ("long value", 7, "x", False)
    assert got["c2"]["t"] is None and got["c2"]["t_review"] is True
    assert got["c3"]["t_review"] is False
    low = _rows(s.golden_fields(records, "cluster", "id", ["t", "n"], {"primary": s.MINIMUM}))
    assert (low["c1"]["t"], low["c1"]["n"], low["c2"]["t"]) == ("x", 5, "q")
    with pytest.raises(ValueError):
        s.golden_fields(records, "cluster", "id", ["t"], {"primary": "Luck"})
    with pytest.raises(ValueError):
        s.golden_fields(records, "cluster", "id", ["t"], {"primary": s.MINIMUM}, [{"attr": "zz", "primary": s.MINIMUM}])


def test_golden_aggregates_before_the_shuffle(records):
    plan = s.golden_rows(records, "cluster", "id", "trust", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_compose_defaults_to_first_record(spark, records):
    choices = spark.createDataFrame([("c1", "name", "A"), ("c1", "t", "B"), ("c2", "t", "missing")], "cluster string, attribute string, src string")
    got = _rows(s.compose(records, choices, "cluster", "id", ["name", "t", "n"], "src"))
    assert got["c1"] == {"cluster": "c1", "name": None, "t": "y", "n": 7}
    assert got["c2"]["t"] is None and got["c2"]["name"] == "p"


def test_trust(spark):
    df = spark.createDataFrame([("a",), ("O'Hara",), (None,)], "_source_system string")
    assert [r[0] for r in df.select(s.trust_of({"a": 1, "O'Hara": 0.7})).collect()] == [1.0, 0.7, 0.5]
    assert [r[0] for r in df.select(s.trust_of({})).collect()] == [0.5] * 3


def test_confidence_and_grades(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 3, 9)], "d int")
    scores = [r[0] for r in df.select(review.confidence_score(F.col("d"))).collect()]
    assert scores == [0.99, 0.91, 0.75, 0.5]
    graded = spark.createDataFrame([(0.9,), (0.57,), (0.7,), (0.29,), (None,)], "s double")
    assert [r[0] for r in graded.select(review.match_grade(F.col("s"))).collect()] == [
        "Auto-Match", "Conflict Detected", "Review Requested", "Conflict Detected", None]


def test_discrepancies_ignore_case_and_blanks(spark):
    df = spark.createDataFrame([("c", "A ", "x"), ("c", "a", " "), ("c", None, "x"), ("d", "", None)], "cluster_id string, f string, g string")
    got = {r.cluster_id: (r.f_differs, r.g_differs) for r in review.discrepancies(df, ["f", "g"]).collect()}
    assert got == {"c": (False, False), "d": (False, False)}


def test_decisions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("CLUSTER_999", "00123", None)], "cluster_id string, npi string, city string")
    rows = review.decision_rows(df, "cluster_id", F.lit(review.APPROVED), F.lit("me"), F.current_timestamp(), F.lit(""), ["npi", "city"])
    review.append_decisions(rows, str(tmp_path / "d"))
    late = review.decision_rows(df.withColumn("cluster_id", F.lit("C1")), "cluster_id", F.lit(review.DEFERRED), F.lit("me"), F.current_timestamp(), F.lit(""), ["npi"])
    review.append_decisions(late, str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert [r[0] for r in review.decided_ids(stored).collect()] == ["CLUSTER_999"]
    parsed = {r.cluster_id: (r.npi, r.city) for r in review.parse_payloads(stored, ["npi", "city"]).collect()}
    assert parsed == {"CLUSTER_999": ("00123", None), "C1": (None, None)}


def test_rejected_clusters_split(spark):
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, cluster_id string")
    decisions = spark.createDataFrame([("a", review.APPROVED, 1), ("a", review.REJECTED, 2), ("b", review.REJECTED, 1), ("b", review.APPROVED, 2), ("b", review.DEFERRED, 3)],
                                      "cluster_id string, action string, timestamp int")
    got = {r.id: r.cluster_id for r in review.apply_decisions(records, decisions, "id").collect()}
    assert got == {1: "1", 2: "2", 3: "b", 4: "b"}
