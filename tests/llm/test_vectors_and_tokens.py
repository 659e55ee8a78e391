"""Vector codes, near vectors and aligned tokens, against plain versions."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from brute import aligned, codes, near_vectors

from goldweave.llm import token_groups, vector_codes, vector_graph


@pytest.mark.parametrize("block_bytes", [2_000, 8 << 20])
def test_aligned_tokens(odd, documents, odd_rows, block_bytes):
    for docs, rows in ((odd, odd_rows), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got, pairs = token_groups.align(docs, block_bytes=block_bytes)
        expected = collections.Counter((i, *e) for (i, _), e in zip(rows, aligned([t for _, t in rows])))
        assert collections.Counter(map(tuple, got.collect())) == expected
        table = pairs.collect()
        assert len({(r.a, r.b) for r in table}) == len(table) and all(0 < r.n <= r.top for r in table)


def test_alignment_of_texts_that_a_tokenizer_cannot_keep(spark):
    """U+2581 in a text comes back as a space from B, so such a text has no tokens; nor has an empty table rows."""
    rows = [(1, "a ▁b"), (2, "plain"), (3, "   "), (4, "\n" * 2_000 + "<|endoftext|> </s>")]
    got = {r.doc_id: tuple(r)[1:] for r in token_groups.align(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert [got[i] for i, _ in rows] == aligned([t for _, t in rows]) and got[1] == (0, 0, 0, 0, 0, 0, "")
    assert token_groups.align(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


def test_wide_groups_count_their_distinct_ids(spark, monkeypatch):
    """A group of very many tokens gives the same rows as one written out link by link."""
    monkeypatch.setattr(token_groups, "_WIDE", 1)
    rng = random.Random(5)
    texts = ["".join(rng.choice("日本語ﬁx é\n") for _ in range(300)) for _ in range(20)]
    one, two, bytes_a, bytes_b, _ = token_groups.loaded(token_groups.default_byte_vocabulary(), token_groups.default_piece_model())
    for text in texts:
        a, b = one.encode(" " + text), two.encode(text)
        stops = token_groups.common_ends(bytes_a.lengths[a].cumsum(), bytes_b.lengths[b].cumsum())
        keys, sizes = token_groups._expanded(a, b, *stops, 32_000)
        assert sizes is not None
        found = collections.Counter()
        for k, n in zip(keys.tolist(), sizes.tolist()):
            found[k] += n
        monkeypatch.setattr(token_groups, "_WIDE", 1 << 30)
        assert found == collections.Counter(token_groups._expanded(a, b, *stops, 32_000)[0].tolist())
        monkeypatch.setattr(token_groups, "_WIDE", 1)


def test_fast_engine_equals_the_library():
    one = token_groups.ByteTokens(token_groups.default_byte_vocabulary())
    assert one.fast is not None
    for start in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}'s" for c in range(start, start + 64))
        assert one.encode(text).tolist() == one.library.encode(text, add_special_tokens=False).ids


VECTORS = "vec_id long, embedding array<float>, label int, node long, size string"
#: Nulls in any column, empty and odd lengths, zeros, non-finite components, extreme ones, repeated rows and ids.
ODD_VECTORS = [(*r, 7, "x") for r in [
    (5, [0.5, -0.25, 0.125, 1.0], 1), (5, [0.5, -0.25, 0.125, 1.0], 1), (1, [0.5, -0.25, 0.125, 1.0], 1), (2, [1.0, -0.5, 0.25, 2.0], 1),
    (3, [0.5, -0.25, 0.125, 1.0], None), (4, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0, 0.0], 1), (8, [float("nan"), 0.0, 0.0, 1.0], 1),
    (9, [None, 1.0, 1.0, 1.0], 1), (10, [float("inf"), 0.0, 1.0, 1.0], 2), (None, [0.5, -0.25, 0.125, 1.01], 1), (None, [-3.0, 1.0, 0.0, 0.1], 2),
    (11, [0.1, 0.2, 0.3], 2), (12, [0.1, 0.2], 2), (13, [3e38, -3e38, 1.0, 1e-30], 2), (14, [-0.00001, 0.0, 1e-45, 5.0], 2), (15, [0.7, 0.7, 0.0, 0.0], 2),
]]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def _as_stored(spark, rows):
    return [(r.vec_id, r.embedding, r.label) for r in _vectors(spark, rows).collect()]


@pytest.mark.parametrize("entries", [3, 16])
def test_vector_codes_of_odd_rows(spark, entries):
    got, book = vector_codes.compress(_vectors(spark, ODD_VECTORS), parts=2, entries=entries)
    rows, expected_book = codes(_as_stored(spark, ODD_VECTORS), 2, entries, 6)
    assert book == expected_book
    sums = collections.defaultdict(list)
    for _, label, _, error in rows:
        sums[label].append(error)
    total = {k: None if None in v or sum(v) >= 1 << 63 else sum(v) for k, v in sums.items()}
    assert collections.Counter((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got.collect()) == collections.Counter(
        (*r, total[r[1]]) for r in rows)


def test_vector_codes_in_small_blocks_and_of_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3, 1, "x") for i in range(400)]
    expected, book = codes(_as_stored(spark, rows), 4, 5, 6)
    for size in (7, 4096):
        monkeypatch.setattr(vector_codes, "BLOCK_ROWS", size)
        got, mine = vector_codes.compress(_vectors(spark, rows), parts=4, entries=5)
        assert mine == book and {(r.vec_id, r.label, r.code, r.error) for r in got.collect()} == set(expected)
    empty, book = vector_codes.compress(_vectors(spark, []))
    assert empty.collect() == [] and book == []


def test_near_vectors_of_odd_rows(spark):
    got = vector_graph.near_duplicates(_vectors(spark, ODD_VECTORS)).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == collections.Counter(near_vectors(_as_stored(spark, ODD_VECTORS), 0.93))
    assert vector_graph.near_duplicates(_vectors(spark, [])).collect() == []


@pytest.mark.parametrize("shard_rows", [64, 2048])
def test_near_vectors_across_shards(spark, shard_rows):
    """A label with a third of all rows, a dense group larger than a shard, chains, pairs and copies."""
    rng = random.Random(11)

    def around(v, spread):
        return [x + rng.gauss(0, spread) for x in v]
    rows, centre = [], [rng.gauss(0, 1) for _ in range(16)]
    rows += [around(centre, 0.08) for _ in range(150)]
    for _ in range(40):
        v = [rng.gauss(0, 1) for _ in range(16)]
        rows += [v, around(v, 0.1), around(v, 0.2)]
    rows += [[rng.gauss(0, 1) for _ in range(16)] for _ in range(500)] + [rows[160]] * 30
    rng.shuffle(rows)
    table = [(i, v, 0 if i % 3 else i % 5, 1, "x") for i, v in enumerate(rows)]
    got = {r.vec_id: r for r in vector_graph.near_duplicates(_vectors(spark, table), shard_rows=shard_rows).collect()}
    expected = near_vectors(_as_stored(spark, table), 0.93)
    assert all(got[i].n_links <= n for i, n, _, _ in expected)
    assert sum(got[i].n_links for i, *_ in expected) >= 0.99 * sum(n for _, n, _, _ in expected)
    assert sum(got[i].component_id == c and got[i].kept == k for i, _, c, k in expected) >= 0.99 * len(expected)


def test_the_graph_reaches_all_nodes_and_keeps_its_degree():
    rng = token_groups.np.random.default_rng(4)
    unit = vector_graph._units(rng.normal(size=(700, 24))).astype("f4")
    links = vector_graph.robust_graph(unit, 16)
    assert links.shape == (700, 16) and (links.max(axis=1) >= 0).all()
    met, front = {0}, [0]
    while front:
        front = [x for x in {y for f in front for y in links[f].tolist() if y >= 0} - met]
        met |= set(front)
    assert len(met) >= 0.99 * 700


def test_pairs_and_groups_split_over_many_small_shards_are_found(spark):
    """Near pairs and small groups among random vectors, where each shard holds little of them."""
    rng = np.random.default_rng(3)

    def near(center, n, cosine):
        aside = rng.normal(size=(n, len(center)))
        aside = vector_graph._units(aside - (aside @ center)[:, None] * center)
        return cosine * center + np.sqrt(1 - cosine * cosine) * aside

    centers = vector_graph._units(rng.normal(size=(340, 48)))
    parts = [centers, *[near(c, 1, 0.97) for c in centers[:300]], *[near(c, 19, 0.985) for c in centers[300:]], rng.normal(size=(900, 48))]
    vectors = np.vstack(parts).astype("f4")
    unit = vector_graph._units(vectors.astype(float))
    there = int((unit @ unit.T >= 0.93).sum()) - len(unit)
    table = [(i, v.tolist(), 1, 0, "x") for i, v in enumerate(vectors)]
    rows = vector_graph.near_duplicates(_vectors(spark, table), least_recall=0.0, shard_rows=64).collect()
    assert there - sum(r.n_links for r in rows) <= there // 100
