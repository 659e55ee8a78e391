"""The registered queries and the pipeline."""

from __future__ import annotations

import collections

import pytest
from brute import components, fingerprint, ids_digest, personal

import __spark_entry__
import corpus_pipeline
from goldweave.llm.queries import QUERIES, SQL
from oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


@pytest.mark.parametrize("name", ["op4_quotes", "op5_shards", "op6_decontaminate", "op8_merkle", "op10_pii"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            wrong = [r.doc_id for r in before if (r.doc_id in after) != (labels.get(r.doc_id, 1) == 1) and r.doc_id in labels]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "near_dedup":
            roots = components([fingerprint(r.text) for r in before], 2)
            least = collections.defaultdict(list)
            for r, root in zip(before, roots):
                least[root].append(r.doc_id)
            assert set(after) == {min(g) for g in least.values()}
        elif name == "decontaminate":
            assert set(after) == {r.doc_id for r in before if not any(i in r.text for i in items)}
        elif name == "personal_data":
            assert set(after) == {r.doc_id for r in before} and not any(personal(r.text) for r in after.values())
            assert all(after[r.doc_id].text == r.text for r in before if not personal(r.text) and "<" not in after[r.doc_id].text)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in encoded} == set(after) and all(ids_digest(r.ids) == r.ids_sha256 for r in encoded)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 50 and {"doc_id", "ids"} <= set(out.columns)
