"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.common import slices, texts_of

#: Text bytes after which a block of documents ends (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Parts of the distinct-word table. Each is encoded in one task, which holds that part's words at most.
BUCKETS = 1024


def default_vocabulary() -> str:
    """The installed public vocabulary of 49,408 entries whose words carry an end mark."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> tokenizers.Tokenizer:
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Words the fast way covers: printable ASCII without the start of an added token. Fixed value: how the file's
#: pre-tokenizer cuts them.
_PLAIN = re.compile(r"(?!.*<\|)[\x21-\x7e]+")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Words:
    """Ids of single words.

    Where the file normalises and cuts as expected, a word of printable ASCII is lower-cased and cut here and its
    parts go straight to the model of merges, which gives the library's ids in a quarter of its time. All other
    words go through the library.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.plain = (steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
                      and cuts[0]["pattern"].get("Regex") == pattern and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
                      and all(x["content"].startswith("<|") for x in said.get("added_tokens", [])))

    def encode(self, words: list[str]) -> list[tuple[int, ...]]:
        out, rest, merge = [], [], self.library.model.tokenize
        for w in words:
            if self.plain and _PLAIN.fullmatch(w):
                out.append(tuple([t.id for part in _CUT.findall(w.lower()) for t in merge(part)]))
            else:
                rest.append(len(out))
                out.append(())
        coded = self.library.encode_batch([words[k] for k in rest], add_special_tokens=False) if rest else []
        for k, e in zip(rest, coded):
            out[k] = tuple(e.ids)
        return out


def _pieces(path: str) -> list[bytes]:
    """The id-to-piece table; its size is that of the vocabulary."""
    tok = _tokenizer(path)
    size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    return [(tok.id_to_token(i) or "").encode() for i in range(size)]


def _pack(values: np.ndarray) -> bytes:
    """Integers as 4-byte little-endian planes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """Blocks of consecutive documents: a number made from place and content, the ids, the texts."""
    ordinal = 0

    def closed(ids: list, texts: list[bytes]) -> tuple[int, list, list[bytes]]:
        content = xxhash.xxh64(b"%d/%d" % (part, ordinal))
        for i, t in zip(ids, texts):
            content.update(b"%d:%d:" % (-1 if i is None else i, len(t)))
            content.update(t)
        return content.intdigest() - (1 << 63), ids, texts

    for batch in batches:
        part = batch.column("part")[0].as_py() if batch.num_rows else 0
        ids, texts, size = [], [], 0
        for k in range(0, batch.num_rows, 256):  # a few texts at a time leave Arrow's buffers
            some = batch.slice(k, 256)
            for i, t in zip(some.column("doc_id").to_pylist(), texts_of(some, "text")):
                if texts and size + len(t) > BLOCK_BYTES:
                    yield closed(ids, texts)
                    ids, texts, size = [], [], 0
                    ordinal += 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield closed(ids, texts)
            ordinal += 1


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a block, frequent ones first, the word numbers of its texts in order, words per text."""
    places: dict[bytes, int] = defaultdict()
    places.default_factory = places.__len__  # a new word gets the next number
    found, lengths = [np.empty(0, np.int32)], []
    for text in texts:
        n = 0
        for piece in slices(text):
            words = piece.split()
            found.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            n += len(words)
        lengths.append(n)
    numbers = np.concatenate(found)
    order = np.argsort(-np.bincount(numbers, minlength=len(places)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = list(places)
    return [words[i] for i in order.tolist()], rank[numbers], np.array(lengths, np.int64)


def _dealt_order(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block's words stand in the table, by bucket and frequency, and the bucket of each in that order."""
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int32) % BUCKETS
    order = np.argsort(bucket.astype(np.int16), kind="stable").astype(np.int32)
    return order, bucket[order]


def _words_of_blocks(docs: DataFrame) -> DataFrame:
    """``bucket, block, words``: the distinct words of every block, dealt into buckets by a hash of the word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block, _, texts in _blocks(batches):
            words = _numbered(texts)[0]
            order, bucket = _dealt_order(words)
            rows = np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(words) else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.unique(bucket)), pa.array(np.full(len(rows), block, np.int64)),
                     pa.array([pack(b" ".join([words[i] for i in r.tolist()])) for r in rows], pa.binary())],
                    names=["bucket", "block", "words"])

    return docs.mapInArrow(run, "bucket int, block long, words binary")


def _documents_of_blocks(docs: DataFrame) -> DataFrame:
    """``block, bucket, head, payload``: per block its ids, and packed its words' order and the word numbers of its
    documents. The bucket is one past the last, so the row comes after those of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            words, numbers, lengths = _numbered(texts)
            known = np.array([i is not None for i in ids], bool)
            head = known.tobytes() + np.array([i or 0 for i in ids], np.int64).tobytes() + lengths.tobytes()
            order = _pack(_dealt_order(words)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([BUCKETS], pa.int32()), pa.array([head], pa.binary()),
                 pa.array([len(order).to_bytes(8, "little") + order + _pack(numbers)], pa.binary())],
                names=["block", "bucket", "head", "payload"])

    return docs.mapInArrow(run, "block long, bucket int, head binary, payload binary")


def _encoded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """``block, bucket, head, payload``: the numbers of ids and the ids of the words of every block and bucket, packed.

    All rows of a bucket meet in one task, one after another. A word is encoded at its first block and
    found in the table at the others; the task holds the table of one bucket at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Words(vocabulary), zstandard.ZstdDecompressor().decompress
        bucket, table = None, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                some = batch.slice(k, 256)
                for b, block, said in zip(*(some.column(c).to_pylist() for c in ("bucket", "block", "words"))):
                    if b != bucket:
                        bucket, table = b, {}
                    own = unpack(said).split(b" ")
                    fresh = [w for w in own if w not in table]
                    table.update(zip(fresh, coder.encode([w.decode() for w in fresh])))
                    ids = [table[w] for w in own]
                    out.append((block, b, _pack(np.array([len(x) for x in ids])), _pack(np.array([i for x in ids for i in x]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "head", "payload"])

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, head binary, payload binary")


def encode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text",
           with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` per row, as the tokenizer encodes the whole text.

    Texts are split into words at ASCII white space, which no token of this vocabulary crosses.
    The distinct words of every block of documents go to the distinct-word table, which is dealt into
    buckets by a hash of the word; there each distinct word of the corpus is encoded once. Its ids go
    back to the blocks that hold it, and the word numbers kept for each document put them in position. Decoding looks every id up in the id-to-piece table (as
    large as the vocabulary) and joins the pieces with spaces, as the tokenizer does without a decoder.

    ``docs`` is read twice and must give equal rows in equal partitions both times, as a file scan
    does; a difference is noticed and fails the job. A null text is empty: no ids and an empty
    decoded text. A null id stays null, repeated rows stay, other columns are ignored.
    ``with_ids`` adds the ids as an array.
    """
    path = vocabulary or default_vocabulary()
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                      F.spark_partition_id().alias("part"))
    both = _encoded_words(_words_of_blocks(own), path).unionByName(_documents_of_blocks(own))
    dealt = both.repartition("block").sortWithinPartitions("block", "bucket")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        block, words = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                for b, bucket, head, payload in zip(*(some.column(c).to_pylist() for c in ("block", "bucket", "head", "payload"))):
                    if b != block:
                        block, words = b, []
                    if bucket < BUCKETS:
                        words.append((_unpack(head), _unpack(payload)))
                    else:
                        yield from _assembled(words, head, payload, pieces, with_ids)
                        block, words = None, []

    return dealt.mapInArrow(run, schema)


def _assembled(words: list[tuple[np.ndarray, np.ndarray]], head: bytes, payload: bytes, pieces: list[bytes],
               with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one block from its words' ids, in the order of the table, and its documents' word numbers."""
    n_docs, cut = len(head) // 17, 8 + int.from_bytes(payload[:8], "little")
    known = np.frombuffer(head[:n_docs], bool)
    numbers = np.frombuffer(head[n_docs:9 * n_docs], np.int64)
    lengths = np.frombuffer(head[9 * n_docs:], np.int64)
    order, row = _unpack(payload[8:cut]), _unpack(payload[cut:])
    met = np.concatenate([n for n, _ in words]) if words else np.empty(0, np.int64)
    flat = np.concatenate([f for _, f in words]) if words else np.empty(0, np.int64)
    if len(met) != len(order):
        raise RuntimeError("the documents differed between two reads; write them before encoding")
    counts, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    counts[order], begin[order] = met, np.cumsum(met) - met
    texts = [b" ".join([pieces[i] for i in flat[s:s + n].tolist()]) for s, n in zip(begin.tolist(), counts.tolist())]
    silent = bool((counts == 0).any())
    out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")}
    at, held = 0, 0
    for d in range(n_docs):
        used = row[at:at + lengths[d]]
        at += lengths[d]
        many = counts[used]
        total = int(many.sum())
        spots = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[used], many)
        ids = flat[spots]
        said = [texts[i] for i in used.tolist()]
        if silent:
            said = [t for t, n in zip(said, many.tolist()) if n]
        out["doc_id"].append(int(numbers[d]) if known[d] else None)
        out["n_tokens"].append(total)
        out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(b" ".join(said)).hexdigest())
        if with_ids:
            out["ids"].append(ids.astype(np.int32))
            held += total
        if held > 1 << 20 or len(out["doc_id"]) >= 4096:
            yield _batch(out, with_ids)
            out, held = {c: [] for c in out}, 0
    if out["doc_id"]:
        yield _batch(out, with_ids)


def _batch(out: dict[str, list], with_ids: bool) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
             "ids": pa.list_(pa.int32())}
    names = [c for c in out if with_ids or c != "ids"]
    return pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in names], names=names)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, text`` per row: every id joined with the id-to-piece table, the pieces in order, joined by spaces.

    The table has one row per vocabulary entry, which bounds its broadcast. An empty or null list
    gives an empty text; a null inside a list is left out. Repeated rows stay.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(_pieces(vocabulary or default_vocabulary()))],
                                  "id int, piece string")
    own = encoded.select(F.col(id_column).cast("long").alias("doc_id"),
                         F.coalesce(F.col(ids_column).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    own = own.withColumn("key", F.xxhash64("ids"))
    said = (own.select("key", "ids").dropDuplicates(["key"]).select("key", F.posexplode("ids").alias("at", "id"))
            .join(F.broadcast(table), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("said")))
    text = F.coalesce(F.array_join(F.transform("said", lambda p: p["piece"]), " "), F.lit(""))
    return own.join(said, "key", "left").select("doc_id", text.alias("text"))
