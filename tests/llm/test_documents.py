"""The operators on documents, against plain versions."""

from __future__ import annotations

import collections
import re
import zlib

import pytest
from brute import base_scores, components, fingerprint, ids_digest, personal, sha, words
from pyspark.sql import functions as F

from goldweave.llm import bpe_words, class_lm, merkle, pii_votes, quality, shards, simhash_bk, templates


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "documents"])
def docs(request, odd, documents):
    return {"odd": odd, "documents": documents}[request.param]


def test_class_lm_counts_like_brute_force(docs):
    rows = _rows(docs)
    expected = collections.Counter((i, *e[:4], round(e[4], 5)) for (i, _), e in zip(rows, base_scores(rows, 2, 7)))
    got = class_lm.score(docs, rounds=1).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_class_lm_beats_the_unigram_model(documents):
    rows = class_lm.score(documents).collect()
    for held in (False, True):
        mine = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_class_lm_is_a_distribution(documents):
    """What may follow a class adds up to one: known words of all classes and one unseen word per class."""
    own = class_lm._documents(documents, "doc_id", "text", 2, 7).filter(~F.col("held_out"))
    counts = class_lm.word_counts(own).cache()
    tokens = counts.agg(F.sum("n")).first()[0]
    head, model = class_lm.fit(own, counts, tokens, 1)
    emitted = [0.0] * class_lm.CLASSES
    for r in counts.collect():
        w = r.word.encode()
        at = head.value.places.get(w)
        of = int(model.classes[head.value.unit[at] if at is not None else class_lm._signature(w)])
        emitted[of] += r.n / 10 ** model.spread[of]
    for c in range(class_lm.CLASSES):
        emitted[c] += 10 ** (model.unseen[c] - model.spread[c])
    assert emitted == pytest.approx([1.0] * class_lm.CLASSES)
    assert (10 ** model.follows).sum(axis=1) == pytest.approx([1.0] * class_lm.CLASSES)


@pytest.mark.parametrize("tree_size", [2, 30, 4096])
def test_simhash_components(docs, tree_size):
    rows = _rows(docs)
    prints = [fingerprint(t) for _, t in rows]
    roots = components(prints, 2)
    least = collections.defaultdict(list)
    for (i, _), root in zip(rows, roots):
        least[root].append(i)
    least = {root: min([i for i in ids if i is not None], default=None) for root, ids in least.items()}
    expected = collections.Counter((i, p, least[root]) for (i, _), p, root in zip(rows, prints, roots))
    got = simhash_bk.near_duplicates(docs, tree_size=tree_size).collect()
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == expected
    if tree_size == 4096:
        kept = simhash_bk.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and kept.count() == len(least)
        assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_simhash_links_in_a_crowded_bucket(spark):
    """Thousands of fingerprints that share bits: every link is found, a row per member is emitted at most per range."""
    values = [(i << 3) & 0xFFFF for i in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "fp long").distinct()
    edges = simhash_bk.links(df, 2, 100).collect()
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for e in edges:
        assert (e.a ^ e.b).bit_count() <= 64
        a, b = sorted((find(e.a), find(e.b)))
        root[b] = a
    expected = components(sorted(values), 2)
    assert [find(v) for v in sorted(values)] == [sorted(values)[i] for i in expected]


def test_shards(odd, documents):
    for df, per_block in ((odd, 5), (documents, 40), (documents, 200_000), (odd.limit(0), 5), (odd.limit(3), 5)):
        rows = _rows(df)
        got = shards.shuffled(df, n_shards=16, rows_per_block=per_block).collect()
        expected = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
        slots = collections.defaultdict(list)
        for r in got:
            assert r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    carried = shards.shuffled(odd, carry=True).collect()
    assert collections.Counter(r.row.text for r in carried) == collections.Counter(t for _, t in _rows(odd))


def test_shuffle_is_uniform():
    """Counts from block to shard follow the hypergeometric law: mean and variance over many draws."""
    import random
    rng = random.Random(3)
    draws = [shards.draw_hypergeometric(rng, 40, 160, 50) for _ in range(20_000)]
    mean = sum(draws) / len(draws)
    variance = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert mean == pytest.approx(12.5, abs=0.1) and variance == pytest.approx(50 * .25 * .75 * 110 / 159, rel=0.05)
    big = [shards.draw_hypergeometric(rng, 10 ** 11, 16 * 10 ** 11, 10 ** 6) for _ in range(200)]
    assert sum(big) / 200 == pytest.approx(62_500, rel=0.01)
    matrix = shards.communication_matrix({0: 7, 1: 0, 2: 13}, [5, 5, 5, 5], 1)
    assert [sum(r) for r in matrix.values()] == [7, 0, 13] and [sum(c) for c in zip(*matrix.values())] == [5] * 4


def test_merkle_edits(docs):
    rows = _rows(docs)
    got = merkle.edited_and_next(docs, range_bytes=20_000).collect()
    texts = collections.defaultdict(collections.Counter)
    for i, t in rows:
        texts[i][t or ""] += 1
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.n_chars in {len(t) for t in texts[r.doc_id]}
    # Unique ids have one possible order.
    unique = [i for i, c in texts.items() if i is not None and sum(c.values()) == 1]
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    of = {r.doc_id: r for r in got}
    for i in unique:
        k = order.index(i)
        if k + 1 == len(order) or order[k + 1] not in unique:
            continue
        text, follower = next(iter(texts[i])), next(iter(texts[order[k + 1]]))
        m = len(text) // 3
        assert of[i].edited_sha256 == sha(text[:len(text) - m] + follower[:m])
    assert len({r.fingerprint for r in got}) == len({t or "" for _, t in rows})
    assert merkle.edited_and_next(docs.limit(0)).count() == 0
    alone = merkle.edited_and_next(docs.filter("doc_id = 7")).collect()
    assert all(r.near_next == 1 for r in alone)


def test_merkle_locates_an_edit(spark):
    lines = [f"This is paragraph number {i} of a longer text, with a few more words in it.\n" for i in range(60)]
    changed = [*lines]
    changed[40] = "Here is something else entirely, as long as the others were before.\n"
    df = spark.createDataFrame([("".join(lines), "".join(changed))], "x string, y string").select(
        *[merkle.fingerprint(merkle.tree(F.col(c))).alias(c) for c in ("x", "y")])
    found = merkle.differences(df, "x", "y").collect()
    assert 1 <= len(found) <= 4 and {r.side for r in found} == {"a", "b"}
    assert merkle.differences(df.select("x", F.col("x").alias("y")), "x", "y").count() == 0


def _first_branch(x, y):
    """Section and paragraph at which two prints part, by splitting their leaves in Python."""
    if x is None or y is None or x.split("|")[0] == y.split("|")[0]:
        return None, None

    def parted(a, b):
        return next((i for i in range(max(len(a), len(b))) if a[i:i + 1] != b[i:i + 1]), None)
    trees = [re.findall("[^/]+/?", p.split("|")[1]) for p in (x, y)]
    section = parted(*trees)
    if section is None:
        return None, None
    return section, parted(*[re.findall("[^;/]+[;/]?", t[section] if section < len(t) else "") for t in trees])


def test_merkle_descends_to_the_first_difference(spark, docs):
    lines = [f"This is a paragraph of a longer text, with a few more words and the number {i}.\n" for i in range(60)]  # ends differ: several sections
    texts = ["".join(lines), "".join(lines[:30]), "".join(lines[:7] + ["new\n"] + lines[7:]), "".join(["new\n"] + lines), "", "one", "one line\n", None,
             "".join(lines[:59] + ["the last one is another"])]
    texts += ["".join(lines[:i] + ["Another line in its place.\n"] + lines[i + 1:]) for i in range(20, 32)]
    prints = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", merkle.fingerprint(merkle.tree(F.col("t"))).alias("x"))
    pairs = prints.join(prints.select(F.col("i").alias("j"), F.col("x").alias("y")), F.col("i") * 0 == F.col("j") * 0)
    found = merkle.first_difference(pairs, "x", "y").collect()
    assert len(found) == len(texts) ** 2
    assert all((r.section, r.paragraph) == _first_branch(r.x, r.y) for r in found)
    assert any(r.section and r.paragraph for r in found) and merkle.first_difference(pairs.limit(0), "x", "y").count() == 0
    for r in merkle.edited_and_next(docs).collect():
        assert (r.edit_section, r.edit_paragraph) == _first_branch(r.fingerprint, r.edited_fingerprint)


def test_bpe_is_the_tokenizers(docs):
    import tokenizers
    tok = tokenizers.Tokenizer.from_file(bpe_words.default_vocabulary())
    tok.no_truncation()
    tok.no_padding()
    expected = collections.Counter()
    for i, t in _rows(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected[(i, len(ids), ids_digest(ids), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    out = bpe_words.encode(docs).cache()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == expected
    decoded = collections.Counter((r.doc_id, sha(r.text)) for r in bpe_words.decode(out).collect())
    assert decoded == collections.Counter((i, d) for i, _, _, d in expected.elements())
    assert bpe_words.encode(docs.limit(0)).count() == 0


def test_personal_data_base(docs):
    expected = collections.Counter()
    for i, t in _rows(docs):
        found = personal(t)
        expected[(i, *[sum(k == kind for k, _, _ in found) for kind in pii_votes.KINDS],
                  sha(",".join(f"{k}:{s}:{e}" for k, s, e in found)))] += 1
    got = pii_votes.digests(docs).collect()
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected


def test_personal_data_is_added_and_masked(spark, documents):
    rows = [(9_000_001, "mail bob [at] web [dot] com now, call 212-555-1234 or +1 (212) 555-1234 é a@b.c.d1.2.3.4 999.1.1.1"),
            (9_000_002, None), (9_000_002, "4417 1234 5678 9113 and 4417 1234 5678 9112"), (9_000_003, "x")]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {(r.kind, r.start, r.end): r.base for r in pii_votes.spans(df).filter("doc_id = 9000001").collect()}
    text = rows[0][1]
    assert {(k, s, e) for (k, s, e), base in spans.items() if base} == set(personal(text))
    added = [text[s:e] for (_, s, e), base in spans.items() if not base]
    assert "bob [at] web [dot] com" in added and "212-555-1234" in added
    masked = {r.text for r in pii_votes.masked(df).filter("doc_id > 9000000").collect()}
    assert masked == {"mail <EMAIL> now, call <PHONE> or <PHONE> é <EMAIL> 999.1.1.1", None, "<CARD> and 4417 1234 5678 9112", "x"}
    assert pii_votes.masked(documents).columns == documents.columns
    assert pii_votes.masked(documents.limit(0)).count() == 0


def test_reliabilities_are_learned():
    """The labeler that is always right ends up trusted, the one that votes at random doesn't."""
    patterns = [("card", 1, 1, None, i, 1, 40) for i in (0, 1)] + [("card", 0, 0, None, i, 0, 25) for i in (0, 1)]
    learned = pii_votes.estimate_reliabilities(patterns)
    assert all((p > 0.95) == (key[1] == 1) for key, p in learned.items()) and len(learned) == 4


def test_quality(spark, odd, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = labels.filter("doc_id % 3 = 0")
    found = quality.assess(docs, labels.filter("doc_id % 3 <> 0")).join(held, "doc_id")
    right = found.filter(F.col("keep") == (F.col("quality") == 1)).count()
    assert right >= 0.95 * held.count() > 50
    none = quality.assess(odd, labels.limit(0)).collect()
    assert len(none) == odd.count() and all(r.p_quality == pytest.approx(0.5) and r.keep for r in none)
    one_class = labels.withColumn("quality", F.lit(1))
    assert quality.assess(odd, one_class).filter("keep").count() == odd.count()
    some = quality.drop_rejected(odd, spark.createDataFrame([(1, 1), (10, 0), (1, None), (None, 0), (4, 1), (11, 0)], "doc_id long, quality int"))
    assert some.columns == odd.columns and 0 < some.count() <= odd.count()
    assert quality.assess(odd.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    """A site with one bad row stays near the global share, one with many bad rows does not."""
    text = "The words of this row are much like those of any other row in here."
    rows = [(i, text, "big", "p") for i in range(200)] + [(1000 + i, text, "small", "p") for i in range(2)] + [
        (2000 + i, text, f"s{i % 20}", "p") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", F.when(F.col("source").isin("big", "small"), (F.col("doc_id") % 10 == 1).cast("int")).otherwise(
        (F.col("doc_id") % 10 != 1).cast("int")).alias("quality"))
    found = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    assert found[0].p_path < 0.2 < 0.4 < found[1000].p_path and found[2000].p_path > 0.7


def test_templates(spark):
    items = spark.createDataFrame([(1, "If Tom has 3 apples and Anna gives Tom 5 kg more, how many apples does Tom have?"),
                                   (2, "one two"), (3, None), (4, ""), (None, "The sky over the harbour was the colour of old tin.")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "quiz: If John has 7 apples and Mary gives John 9 miles more, how many apples does John have? ok"),
        (2, "If John has 7 apples and Mary gives Peter 9 miles more, how many apples does Karl have?"),
        (3, "If Tom has 3 apples and Anna gives Tom 5 kg more, how many apples does Tom have?"),
        (3, "If Tom has 3 apples and Anna gives Tom 5 kg more, how many apples does Tom have?"),
        (4, "Nothing of the kind."), (None, "He said the sky over the harbour was the colour of old tin, twice."),
        (5, None), (6, ""), (7, "If Tom has 3 apples and")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (3, 1), (None, None)}
    assert found[(1, 1)].n_changed == found[(1, 1)].n_slots > 3 and found[(3, 1)].n_changed == 0
    assert {(r.doc_id, r.item_id) for r in templates.contaminated(docs, items, broadcast_windows=0).collect()} == set(found)
    kept = templates.drop_contaminated(docs, items.filter("item_id = 1"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7]
    assert templates.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert templates.drop_contaminated(docs.limit(0), items).count() == 0


def test_templates_find_all_verbatim_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    every = items.collect()
    expected = {(d.doc_id, b.item_id) for d in docs.collect() for b in every if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, items).collect()}
    assert got == expected and len(got) > 10


def test_templates_find_short_items_wherever_they_stand(spark):
    words = "What is the capital of France today then".split()
    items = [(n, " ".join(words[:n]) + "?") for n in range(1, 9)] + [(9, "Tom has apples.")]
    docs, expected = [], set()
    for n, text in items:
        for k, before in enumerate(["", "and so on\n", "It ends. ", "Is it so? ", "Question: ", "he asked \""]):
            docs.append((10 * n + k, f"{before}{text} xx"))
            expected.add((10 * n + k, n))
    docs.append((100, "it was so.\nJohn has apples. xx"))
    found = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert expected | {(100, 9)} <= set(got)
    assert all(got[pair].n_matched == got[pair].n_windows for pair in expected)
    assert got[(100, 9)].n_changed == 1


def test_templates_keep_the_windows_that_agree(spark):
    filler = "then the old grey cat sat down by the red door and saw that it was late so it went off to sleep on"
    one, two, three = (" ".join(w + end for w in (filler + " " + filler).split()) for end in ("en", "ir", "os"))
    items = [(1, "Here Tom has 3 apples and 5 pears in a box, so how many fruits are there?"),
             (2, f"so we took 5 apples {one} and at last 5 pears"), (3, f"now Tom came {two} and at last Tom left"),
             (4, f"Tom took it {three}. Tom gave it {three}."), (5, "if Tom met Ann and Ann met Sue and Sue met Tom all was well")]
    docs = [(1, items[0][1].replace("3", "4").replace("5", "4")), (2, f"so we took 3 apples {one} and at last 7 pears"),
            (3, f"now Tom came {two} and at last John left"), (4, items[3][1].replace("Tom", "John")),
            (5, "if Bob met Bob and Bob met Bob and Bob met Bob all was well"),
            (6, items[4][1].replace("Tom", "Bob").replace("Ann", "Eve").replace("Sue", "Pia"))]
    got = {(r.doc_id, r.item_id): r for r in templates.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 5)}
    assert got[(1, 1)].n_matched == got[(1, 1)].n_windows and got[(1, 1)].n_changed == 2
    assert got[(4, 4)].n_matched == got[(4, 4)].n_windows and got[(4, 4)].n_changed == 1
    assert got[(3, 3)].n_changed == 0 and got[(3, 3)].n_matched < got[(3, 3)].n_windows


def test_templates_of_numbers_need_equal_values(spark):
    items = [(1, "3 + 4"), (2, "12, 15, 18, 21, 24, 27"), (3, "what is 3 + 4"), (4, "Sum 12, 15, 18, 21, 24, 27 please")]
    docs = [(1, "I paid 7 8 times on the road"), (2, "the numbers 31, 32, 33, 34, 35, 36 and 37 came up"), (3, "so 3 + 4 it is"),
            (4, "as 12, 15, 18, 21, 24, 27 shows"), (5, "tell me what is 8 + 9 now"), (6, " ".join(map(str, range(900, 1500)))),
            (7, "Sum 1, 5, 8, 2, 4, 7 please"), (8, "Sum 12, 15, 18, 21, 24, 27 please")]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # items 2 and 4 share their numbers, and two of the four windows of item 4 hold a word
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(3, 1), (4, 2), (8, 2), (5, 3), (8, 4)}


def test_number_heavy_texts_cost_as_much_as_they_hold(spark):
    """A text of n numbers meets items of numbers in the windows of equal values, not in all of them."""
    text = " ".join(str(1000 + i) for i in range(4_000))
    items = [(i, " ".join(str(1000 + 7 * i + k) for k in range(8))) for i in range(99)]
    got = templates.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                                 spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.item_id, r.n_matched) for r in got} == {(i, 4) for i in range(99)}


def test_templates_on_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, "word word word word word word"), (2, "x" * 500)], "item_id long, text string")
    assert {r.doc_id for r in templates.contaminated(odd, items).collect()} == {10}


def test_words_go_straight_to_the_merges_with_the_same_ids(documents):
    coder = bpe_words.Words(bpe_words.default_vocabulary())
    assert coder.plain
    said = {w for r in documents.collect() for w in (r.text or "").split()}
    odd = [chr(c) + x + chr(d) for c in range(0x21, 0x7f) for d in (0x21, 0x27, 0x3c, 0x41, 0x7c, 0x7e) for x in ("", "'s", "Don't'LL", "x1y22", "<|endoftext|>", "<|")]
    every = sorted(said) + odd + ["\x7f", "É", "é", "ǅ", "İ", "a\x1cb", "'S", "ſ"]
    coded = coder.library.encode_batch(every, add_special_tokens=False)
    assert coder.encode(every) == [tuple(e.ids) for e in coded]


def test_words_are_ascii_white_space_words():
    assert words("A\x0bB C\x1cD e") == ["a", "b c\x1cd", "e"]


def test_windows_of_open_types_complete_the_second_reading(spark):
    """Only windows that hold an open type differ between the readings; all others are hashed once."""
    lists = [["a", "^b", "c", "d", "e", "f", "g", "^h"], ["^a"], [], ["a", "b", "c", "d", "e", "f"], ["^a", "^b", "^c", "d", "e"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, types array<string>")
    reads = df.select("types", *[F.transform("types", lambda t: F.xxhash64(templates._read(t, r))).alias(f"read{int(r)}") for r in (False, True)],
                      F.array_compact(F.transform("types", lambda t, i: F.when(t.startswith("^"), i))).alias("opens"))
    rows = reads.select("types", templates._runs("read0", 3).alias("one"), templates._runs("read1", 3).alias("two"),
                        templates._open_runs("read1", "opens", 3).alias("some")).collect()
    for r in rows:
        assert set(r.one) | set(r.some) == set(r.one) | set(r.two)
        assert len(r.some) == sum(any(t.startswith("^") for t in r.types[k:k + 3]) for k in range(len(r.types) - 2))


def test_class_lm_units_are_kept_for_all_rounds(documents, monkeypatch):
    """Texts are cut into words once before the rounds, not in each."""
    said, plain = [], class_lm.materialise
    monkeypatch.setattr(class_lm, "materialise", lambda df, purpose, **m: said.append((purpose, df.columns)) or plain(df, purpose, **m))
    assert class_lm.score(documents.limit(20), rounds=2).count() == 20
    assert [c for p, c in said if p == "class-units"] == [["units"]] and sum(p == "class-neighbours" for p, _ in said) == 3
