"""Near-duplicates by SimHash: fingerprints within a few bits, found in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.common import LOWER, connected_components, text_or_empty, texts_of
from goldweave.session import materialise

#: Shingles whose bits are counted at a time: bounds the memory a very long text takes.
_CHUNK = 1 << 16
#: Fingerprints in one tree. A larger bucket is split into trees of about this size, and every
#: tree is sent to every block of queries of its bucket.
TREE_SIZE = 4096


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    width = min(shingle, len(words))
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n, ones, digest = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, _CHUNK):
        pairs = zip(starts[k:min(k + _CHUNK, n)], ends[k + width - 1:min(k + _CHUNK, n) + width - 1])
        blob = b"".join([digest(line[s:e], 42) for s, e in pairs])
        bits = np.unpackbits(np.frombuffer(blob, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed 64 bits) per row: the SimHash of the text's word shingles.

    Words are split at ASCII white space after lower-casing A-Z; shingles count as often as they
    occur and are hashed by XXH64 with seed 42. A text of fewer words is one shingle; a null,
    empty or blank text has the fingerprint zero. A null id stays null; repeated rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t, shingle) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fp"])

    text = text_or_empty(text_column)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      text.alias("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(fps: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints in column ``fp`` as links within ``radius`` bits do.

    Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` bit ranges, so buckets by
    range value bring all links together. A bucket's fingerprints form BK-trees: a child is keyed
    by its Hamming distance to its parent, and a search follows only the edges within the radius of
    the distance it has just measured. A bucket above ``tree_size`` is cut into trees by a hash and
    each tree goes to each block of the bucket's queries, so no task holds a whole bucket. A task
    emits a spanning forest of the links it finds, so a group of k near copies costs k rows and
    not k squared.
    """
    width = -(-64 // (radius + 1))
    parts = [F.struct(F.lit(i).alias("part"),
                      F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1)).alias("value"))
             for i in range(radius + 1)]
    keyed = fps.select("fp", F.inline(F.array(*parts)))
    large = (keyed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size)
             .select("part", "value", F.ceil(F.col("n") / tree_size).cast("int").alias("trees")))
    sized = keyed.join(large, ["part", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    blocks = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).select(
        "part", "value", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("block"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        .cast("int").alias("role"), "fp")
    keys = ["part", "value", "tree", "block"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "fp").select(
        F.xxhash64(*keys).alias("bucket"), *keys, "role", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                    for c in [*keys, "role", "fp"]])
            if rest is not None:
                rows = np.vstack([rest, rows])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            yield from _linked(rows[:cut], radius)
            rest = rows[cut:]
        if rest is not None:
            yield from _linked(rest, radius)

    return dealt.mapInArrow(run, "a long, b long")


def _linked(rows: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the whole groups of some sorted rows ``part, value, tree, block, role, fp``."""
    if not len(rows):
        return
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
    group = np.cumsum(new) - 1
    rows, group = (x[np.bincount(group)[group] > 1] for x in (rows, group))
    if not len(rows):
        return
    group = np.unique(group, return_inverse=True)[1]
    role, fp = rows[:, 4], rows[:, 5].view(np.uint64)
    label = _labels(fp, group, np.flatnonzero(role != 2), np.flatnonzero(role != 1), radius)
    moved = np.flatnonzero(label != np.arange(len(label)))
    if len(moved):
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])


def _labels(fp: np.ndarray, group: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each position the smallest position that links within ``radius`` reach, over the groups' trees."""
    # Build all trees level by level: the first pending member of a slot becomes its node.
    n_groups = int(group.max()) + 1
    root = np.full(n_groups, -1, np.int64)
    pending, slot = members, group[members].astype(np.int64)
    child_keys, child_nodes, level = [], [], 0
    while len(pending):
        slots, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
        nodes = pending[first]
        if level == 0:
            root[slots] = nodes
        else:
            child_keys.append(slots)
            child_nodes.append(nodes)
        rest = np.ones(len(pending), bool)
        rest[first] = False
        pending, above = pending[rest], nodes[inverse[rest]]
        slot = above * 65 + np.bitwise_count(fp[pending] ^ fp[above]).astype(np.int64)
        level += 1
    keys = np.concatenate(child_keys) if child_keys else np.empty(0, np.int64)
    kids = np.concatenate(child_nodes) if child_nodes else np.empty(0, np.int64)
    order = np.argsort(keys)
    keys, kids = keys[order], kids[order]

    label = np.arange(len(fp))
    queries = queries[root[group[queries]] >= 0]
    for k in range(0, len(queries), TREE_SIZE):
        query = queries[k:k + TREE_SIZE]
        node = root[group[query]]
        while len(query):
            far = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            _union(label, query[hit], node[hit])
            low = np.searchsorted(keys, node * 65 + np.maximum(far - radius, 0), "left")
            many = np.searchsorted(keys, node * 65 + np.minimum(far + radius, 64), "right") - low
            total = int(many.sum())
            at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            query, node = np.repeat(query, many), kids[at]
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]``; a label is the smallest position of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3,
                    radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, component`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits,
    the row's own id included. Rows with equal fingerprints are linked, empty texts too. A null id
    never is the smallest unless the whole component has null ids; then the component id is null.
    ``component`` names the component by its smallest fingerprint. Repeated rows are returned as
    often as they came; other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    prints, _ = materialise(fingerprints(docs, id_column, text_column, shingle), "simhash")
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts = connected_components(links(nodes.select("fp"), radius, tree_size))
    rooted = (nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("component", F.coalesce("component", "fp")))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "component").join(least, "component").select("fp", "component_id", "component")
    return prints.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "component")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per component.

    The row with the smallest id stays, null ids last; among rows of that id the smallest text
    hash, and of rows equal in both one. An empty table stays empty.
    """
    found = near_duplicates(docs, id_column, text_column, shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"),
                           F.col("text_hash").alias("_hash"))).alias("first")
    staying = found.groupBy("component").agg(first).select("first._id", "first._hash")
    own = docs.select(F.struct("*").alias("_row"), F.col(id_column).cast("long").alias("_own_id"),
                      F.xxhash64(text_or_empty(text_column)).alias("_own_hash"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    return own.join(staying, same, "left_semi").dropDuplicates(["_own_id", "_own_hash"]).select("_row.*")
