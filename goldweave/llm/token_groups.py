"""Alignment of two tokenizers over the same texts, with corpus-wide counts of the id pairs they link."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.session import materialise

#: Text bytes after which a block of documents ends (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Links of one group that are written out one by one; a larger group counts its distinct ids first.
_WIDE = 4096
#: Runs of white space that the fast engine's pattern cannot hold; texts with one are split by the library itself.
_LONG_SPACE = re.compile(r"\s{500}")


def default_byte_vocabulary() -> str:
    """The installed public byte-level vocabulary of 50,257 entries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def default_piece_model() -> str:
    """The installed public sentencepiece model of 32,000 entries."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself, the others as U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}


class ByteTokens:
    """Tokenizer A: byte-level BPE; ``spelled[id]`` holds a token's bytes.

    Where the file's merges make the ids in order, texts are encoded from the same table of bytes and ranks
    by a faster engine with equal results; otherwise, and for very long runs of white space, by the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        entries, letters = self.library.get_vocab(with_added_tokens=True), _byte_alphabet()
        self.spelled = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.fast = None
        if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers
            ranks = {self.spelled[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _LONG_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceTokens:
    """Tokenizer B: sentencepiece, which puts a space before the text; ``spelled[id]`` holds a token's bytes."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.spelled = [bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i)
                        else lib.id_to_piece(i).replace("▁", " ").encode() for i in range(lib.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)


class Spelling:
    """The bytes of all tokens of a vocabulary, end to end."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of ``ids`` in order; ``ends`` are their cumulative lengths."""
        many = self.lengths[ids]
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + many, many)].tobytes()


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every group the number of A tokens and of B tokens up to its end.

    The cumulative ends of either side key a dictionary to token indexes. Ends are byte offsets, so a dictionary
    is a table addressed by the end itself; the keys both hold, in order, are the ends of the groups.
    """
    index_a, index_b = (np.zeros(max(ends_a[-1], ends_b[-1]) + 1, np.int32) for _ in range(2))
    index_a[ends_a], index_b[ends_b] = np.arange(1, len(ends_a) + 1), np.arange(1, len(ends_b) + 1)
    both = np.flatnonzero((index_a > 0) & (index_b > 0))
    return index_a[both].astype(np.int64), index_b[both].astype(np.int64)


def _expanded(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The linked id pairs of a text as ``a * n_b + b``, one for each link; or distinct ones with their numbers."""
    start_a, start_b = (np.concatenate([[0], s[:-1]]) for s in (stop_a, stop_b))
    many_a, many_b = stop_a - start_a, stop_b - start_b
    wide = many_a * many_b > _WIDE
    narrow = np.where(wide, 0, many_b)
    each = np.repeat(narrow, many_a)  # links of every A token
    first = np.repeat(start_b, many_a)
    total = int(each.sum())
    at_b = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    pairs = np.repeat(a * n_b, each) + b[at_b]
    if not wide.any():
        return pairs, None
    keys, sizes = [pairs], [np.ones(total, np.int64)]
    for g in np.flatnonzero(wide).tolist():
        (ua, ca), (ub, cb) = (np.unique(x[s[g]:e[g]], return_counts=True) for x, s, e in ((a, start_a, stop_a), (b, start_b, stop_b)))
        keys.append(((ua * n_b)[:, None] + ub[None, :]).ravel())
        sizes.append((ca[:, None] * cb[None, :]).ravel())
    return np.concatenate(keys), np.concatenate(sizes)


def _said(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, spelled: np.ndarray, n_a: int, n_b: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides by group. ``spelled`` holds ids and separators, padded with zeros."""
    many_a, many_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    line = np.empty(len(a) + len(b), np.int64)
    closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closes_a[stop_a - 1], closes_b[stop_b - 1] = True, True
    line[np.arange(len(a)) + np.repeat(stop_b - many_b, many_a)] = a + n_a * closes_a
    line[np.arange(len(b)) + np.repeat(stop_a, many_b)] = b + 2 * n_a + n_b * closes_b
    letters = spelled[line].ravel()
    return letters[letters > 0].tobytes()[:-1]


def _pack(values: np.ndarray) -> bytes:
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """What the documents of a block hold, until the block is closed."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.sizes: dict[int, np.ndarray] = {}
        self.bytes = 0

    def closed(self, number: int) -> tuple:
        """``block, uses, pairs, docs``: ids, counts and digests of the documents and their pairs, packed; the block's pairs."""
        n, bits = len(self.keys), max(len(self.keys).bit_length(), 1)
        keys = np.concatenate([(k << bits) | d for d, k in enumerate(self.keys)])
        if self.sizes:
            weights = np.concatenate([self.sizes.get(d, np.ones(len(k), np.int64)) for d, k in enumerate(self.keys)])
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
        else:
            keys.sort()
            weights = None
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(first, append=len(keys)) if weights is None else np.add.reduceat(weights, first)
        used, of = keys[first] >> bits, keys[first] & ((1 << bits) - 1)
        new = np.diff(used, prepend=-1) != 0
        starts = np.flatnonzero(new)
        pairs, docs = used[starts], np.diff(starts, append=len(used))
        order = np.argsort(of, kind="stable")  # by document, its pairs in order
        pair, times = (np.cumsum(new) - 1)[order], times[order]
        per_doc = np.bincount(of, minlength=n)
        step, begin = np.diff(pair, prepend=0), (np.cumsum(per_doc) - per_doc)[per_doc > 0]
        step[begin] = pair[begin]
        high = _pack(times >> 32) if len(times) and times.max() >= 1 << 32 else b""
        known = np.array([r[0] is not None for r in self.rows], bool)
        heads = np.array([(r[0] or 0, *r[1:5]) for r in self.rows], np.int64)
        heads = zstandard.ZstdCompressor(level=1).compress(known.tobytes() + heads.tobytes())
        said = "".join(r[5] or " " * 64 for r in self.rows).encode()
        return number, [heads, said, _pack(per_doc), _pack(step), _pack(times & 0xFFFFFFFF), high], pairs, docs


_BLOCK_SCHEMA = "block long, uses array<binary>, pairs array<long>, docs array<long>"


@functools.lru_cache(maxsize=2)
def loaded(byte_vocabulary: str, piece_model: str) -> tuple[ByteTokens, PieceTokens, Spelling, Spelling, np.ndarray]:
    """Both tokenizers, their spellings, and the decimal ids of both with either separator; a worker loads them once."""
    one, two = ByteTokens(byte_vocabulary), PieceTokens(piece_model)
    said = [f"{i}{end}".encode() for n, ends in ((len(one.spelled), ",|"), (len(two.spelled), ",;")) for end in ends for i in range(n)]
    return one, two, Spelling(one.spelled), Spelling(two.spelled), np.array(said).view(np.uint8).reshape(len(said), -1)


def _aligned_blocks(docs: DataFrame, byte_vocabulary: str, piece_model: str, block_bytes: int) -> DataFrame:
    """Documents in blocks: their counts and digests, the distinct pairs of the block and how each document uses them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, bytes_a, bytes_b, spelled = loaded(byte_vocabulary, piece_model)
        n_a, n_b = len(one.spelled), len(two.spelled)
        block, number = _Block(), None

        def out() -> pa.RecordBatch:
            columns = zip((pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())), block.closed(number))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for t, v in columns], names=["block", "uses", "pairs", "docs"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a few texts at a time leave Arrow's buffers
                some = batch.slice(k, 64)
                if number is None:
                    number = some.column("part")[0].as_py() << 33
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    if block.rows and block.bytes + len(text) > block_bytes:
                        yield out()
                        block, number = _Block(), number + 1
                    block.bytes += len(text) + 64
                    line = " " + text
                    raw = line.encode()
                    a, b = (one.encode(line), two.encode(text)) if text else (np.empty(0, np.int64), np.empty(0, np.int64))
                    ends_a, ends_b = np.cumsum(bytes_a.lengths[a]), np.cumsum(bytes_b.lengths[b])
                    if not len(a) or not len(b) or bytes_a.joined(a, ends_a) != raw or bytes_b.joined(b, ends_b) != raw:
                        block.rows.append((doc, 0, 0, 0, 0, ""))
                        block.keys.append(np.empty(0, np.int64))
                        continue
                    stop_a, stop_b = common_ends(ends_a, ends_b)
                    said = _said(a, b, stop_a, stop_b, spelled, n_a, n_b)
                    keys, sizes = _expanded(a, b, stop_a, stop_b, n_b)
                    if sizes is not None:
                        block.sizes[len(block.keys)] = sizes
                    links = int((np.diff(stop_a, prepend=0) * np.diff(stop_b, prepend=0)).sum())
                    block.rows.append((doc, len(a), len(b), len(stop_a), links, hashlib.sha256(said).hexdigest()))
                    block.keys.append(keys)
        if block.rows:
            yield out()

    return docs.mapInArrow(run, _BLOCK_SCHEMA)


def _assembled(uses: list[bytes], times: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of a block, given count and rank of its pairs in their order."""
    per_doc, step, size = (_unpack(u) for u in uses[2:5])
    if uses[5]:
        size = size + (_unpack(uses[5]) << 32)
    n, some = len(per_doc), per_doc > 0
    links, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = (np.cumsum(per_doc) - per_doc)[some]
    if len(first):
        pair = np.cumsum(step)  # steps begin anew at every document
        pair -= np.repeat(pair[first] - step[first], per_doc[some])
        links[some] = np.add.reduceat(size * times[pair], first)
        most[some] = np.add.reduceat(size * best[pair], first)
    packed = zstandard.ZstdDecompressor().decompress(uses[0])
    heads = np.frombuffer(packed[n:], np.int64).reshape(n, 5)
    columns = [pa.array(heads[:, 0], pa.int64(), mask=~np.frombuffer(packed[:n], bool)), *(pa.array(heads[:, k]) for k in range(1, 5))]
    digests = [uses[1][k:k + 64].decode().strip() for k in range(0, 64 * n, 64)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(most), pa.array(links), pa.array(digests, pa.string())],
                                      names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, byte_vocabulary: str | None = None, piece_model: str | None = None, id_column: str = "doc_id",
          text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; and the pair table.

    Tokenizer A reads a space and the text, tokenizer B the text, before which it puts a space itself.
    Byte offsets where tokens of both end cut the text into groups; every A token of a group is linked with
    every B token of it. The pair table ``a, b, n, top`` has, for each id pair, the number of documents
    that hold it linked and the highest such number of its A id. ``n_best`` counts the links whose pair
    reaches that, ``count_sum`` adds the counts of all links.

    Documents stand in blocks, written once: their digests, the block's distinct pairs, and which of
    them each document uses how often. Only one row per block and pair is exchanged. The highest
    counts have a row per A id, which bounds their broadcast by the vocabulary.

    A text that is null or empty, or whose tokens' joined bytes differ from space and text, has no tokens:
    zeros and an empty digest. A text of any length is one row of a block; a group of very many tokens
    counts its distinct ids first. Null ids stay null, repeated rows stay and count, other columns are
    ignored, an empty table gives no rows.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    piece_model = piece_model or default_piece_model()
    n_b = len(PieceTokens(piece_model).spelled)
    blocks, _ = materialise(_aligned_blocks(own, byte_vocabulary or default_byte_vocabulary(), piece_model, block_bytes), "token-groups")
    used = blocks.select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("docs").alias("docs"))))
    counted, _ = materialise(used.groupBy("pair").agg(F.sum("docs").alias("n")), "token-pairs")
    a = F.expr(f"cast(pair div {n_b} as int)")
    tops = counted.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row per id of A at most
    ranked = counted.withColumn("a", a).join(F.broadcast(tops), "a")
    table = ranked.select("a", (F.col("pair") % n_b).cast("int").alias("b"), "n", "top")

    # rows of a block come together, those of its pairs first; one sorted number says both
    back = used.join(ranked, "pair").select("block", (F.col("block") * 2).alias("place"), "pair", "n",
                                            (F.col("n") == F.col("top")).alias("best"), F.lit(None).cast("array<binary>").alias("uses"))
    whole = blocks.select("block", (F.col("block") * 2 + 1).alias("place"), F.lit(0).cast("long").alias("pair"),
                          F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"), "uses")
    dealt = back.unionByName(whole).repartition("block").sortWithinPartitions("place").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            at, columns = 0, [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]
            for row in [*np.flatnonzero(batch.column("place").to_numpy() % 2).tolist(), batch.num_rows]:
                held.append(tuple(c[at:row] for c in columns))
                if row < batch.num_rows:
                    pair, times, best = (np.concatenate(c) for c in zip(*held))
                    order = np.argsort(pair)
                    yield _assembled(batch.column("uses")[row].as_py(), times[order].astype(np.int64), best[order].astype(np.int64))
                    held = []
                at = row + 1

    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return dealt.mapInArrow(run, schema), table

