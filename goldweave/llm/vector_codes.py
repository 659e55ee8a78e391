"""Product codes of vectors, computed over per-dimension dictionaries of integer values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.session import discard, materialise

#: Vectors in one block; a block has dictionaries of its own, so no dictionary grows with the data.
BLOCK_ROWS = 4096
#: Beyond this, squared differences summed over a part could leave 64 bits; such blocks count in Python integers.
_SAFE = 1 << 26
_LOW = (1 << 48) - 1

_BLOCK_SCHEMA = "vec_ids array<long>, labels array<long>, dictionaries array<array<double>>, codes array<binary>"


def finite_vectors(vectors: DataFrame, vector_column: str) -> DataFrame:
    """The rows whose vector is known and holds finite numbers only."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector_column).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _dictionary_blocks(kept: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors: per dimension the distinct integers in order, and per vector its position among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(k, BLOCK_ROWS)
                values = some.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                found = [np.unique(values[:, d], return_inverse=True) for d in range(dims)]
                kinds = [np.uint8 if len(u) <= 256 else np.uint16 for u, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([some.column("label").to_pylist()], pa.list_(pa.int64())),
                     pa.array([[u for u, _ in found]], pa.list_(pa.list_(pa.float64()))),
                     pa.array([[c.astype(t).tobytes() for (_, c), t in zip(found, kinds)]], pa.list_(pa.binary()))],
                    names=["vec_ids", "labels", "dictionaries", "codes"])

    return kept.mapInArrow(run, _BLOCK_SCHEMA)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[np.ndarray], list[np.ndarray]]]:
    """``vec_ids, labels, dictionaries, codes`` of the blocks of a batch; dictionaries hold 64-bit or Python integers."""
    for k in range(batch.num_rows):
        ids, labels, kept, packed = (batch.column(n)[k].as_py() for n in ("vec_ids", "labels", "dictionaries", "codes"))
        small = all(abs(u[0]) <= _SAFE and abs(u[-1]) <= _SAFE for u in kept)
        values = [np.array(u, np.float64).astype(np.int64) if small else np.array([int(x) for x in u], object) for u in kept]
        codes = [np.frombuffer(c, np.uint8 if len(u) <= 256 else np.uint16) for u, c in zip(kept, packed)]
        yield ids, labels, values, codes


def _nearest(values: list[np.ndarray], codes: list[np.ndarray], entries: list[list[int]], parts: int) -> Iterator[tuple]:
    """``part, entry, distance`` of every vector of a block: nearest entry of each part, ties to the lower one.

    The squared difference of every distinct integer of a dimension to that component of all entries is
    tabulated once; a part's distances are rows gathered by code from the tables of its dimensions, added up.
    """
    width = len(values) // parts
    far = max((abs(c) for e in entries for c in e), default=0) > _SAFE
    kind = object if far or values[0].dtype == object else np.int64
    for part in range(parts):
        total = np.zeros((len(codes[0]), len(entries)), kind)
        for d in range(part * width, (part + 1) * width):
            own = np.array([e[d] for e in entries], kind)
            total += np.square(values[d].astype(kind)[:, None] - own[None, :])[codes[d]]
        entry = total.argmin(axis=1)
        yield part, entry, total[np.arange(len(total)), entry]


def _sums(blocks: DataFrame, entries: list[list[int]], parts: int) -> DataFrame:
    """``place, entry, high, low, n``: per task the sums and counts of what each entry gets, the sums in two halves."""
    dims, k = len(entries[0]), len(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((dims, k), object), np.zeros((dims, k), np.int64)
        for batch in batches:
            for _, _, values, codes in _unpacked(batch):
                for part, entry, _ in _nearest(values, codes, entries, parts):
                    for d in range(part * dims // parts, (part + 1) * dims // parts):
                        size = len(values[d])
                        held = np.bincount(entry * size + codes[d], minlength=k * size).reshape(k, size)
                        sums[d] += [int(x) for x in held.astype(values[d].dtype) @ values[d]]
                        counts[d] += held.sum(axis=1)
        place, entry = (x.ravel() for x in np.indices((dims, k)))
        halves = [(Decimal(int(s) >> 48), int(s) & _LOW) for s in sums.ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(entry, pa.int32()), pa.array([h for h, _ in halves], pa.decimal128(38, 0)),
             pa.array([x for _, x in halves], pa.int64()), pa.array(counts.ravel())],
            names=["place", "entry", "high", "low", "n"])

    partial = blocks.mapInArrow(run, "place int, entry int, high decimal(38,0), low long, n long")
    return partial.groupBy("place", "entry").agg(
        F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n"))


def _assigned(blocks: DataFrame, entries: list[list[int]], parts: int) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, values, codes in _unpacked(batch):
                found = list(_nearest(values, codes, entries, parts))
                digits = np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                width = 2 * parts
                error = sum(dist.astype(object) for _, _, dist in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()),
                     pa.array([digits[k:k + width] for k in range(0, len(digits), width)], pa.string()),
                     pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0,
             id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, label, code, error, label_error`` per vector, and the codebook: ``entries`` rows of all dimensions.

    Components become integers, ``floor(scale * x)``. A codebook entry starts as a vector of the
    smallest ids (nulls last, ties by vector, a repeated row as often as it stands) and moves for
    ``rounds`` rounds to the floored mean of the parts nearest to it; an entry without parts stays.
    Vectors stand in blocks with a dictionary of distinct integers per dimension, written once; each
    round reads the codes, and a task returns one sum and count per component and entry, so the
    driver gets ``entries`` times the dimensions at most. ``entries`` may be 256 at most.

    A vector that is null or holds a null or non-finite component (or one that is not finite times
    ``scale``) is dropped. The dimensions are those of the smallest id whose length is a multiple of
    ``parts`` and not zero; vectors of other lengths keep their row with a null code and error. An
    error beyond 64 bits is null, and so is the sum of its label. Null labels count as one label.
    Null ids stay null, repeated rows stay, other columns are ignored; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits a part")
    whole = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("whole"))
    # floor() of a double gives a long in Spark; x - pmod(x, 1) stays a double and is exact
    kept = finite_vectors(own, "whole").withColumn("whole", F.transform("whole", lambda x: F.when(
        F.abs(x) < 4503599627370496.0, F.floor(x).cast("double")).otherwise(x)))
    fits = kept.filter((F.size("whole") > 0) & (F.size("whole") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("whole").asc()]
    first = fits.orderBy(*order).limit(1).collect()
    dims = len(first[0].whole) if first else parts
    same = fits.filter(F.size("whole") == dims)
    book = [[int(x) for x in r.whole] for r in same.orderBy(*order).limit(entries).collect()]  # at most 256 rows
    blocks, _ = materialise(_dictionary_blocks(same, dims), "vector-blocks")
    for _ in range(rounds if book else 0):
        for r in _sums(blocks, book, parts).filter("n > 0").collect():  # entries x dimensions rows at most
            book[r.entry][r.place] = (int(r.high) * (1 << 48) + int(r.low)) // r.n
    odd = kept.filter((F.size("whole") != dims)).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = _assigned(blocks, book, parts) if book else same.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    found, _ = materialise(coded.unionByName(odd), "vector-codes")
    discard(blocks)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole_sum = F.when((F.count("error") == F.count(F.lit(1))) & (total <= F.lit((1 << 63) - 1)), total)
    sums = found.groupBy(F.col("label").alias("_label")).agg(whole_sum.cast("long").alias("label_error"))
    out = found.join(sums, found["label"].eqNullSafe(sums["_label"])).drop("_label")
    return out, book


def digest_of(book: list[list[int]], parts: int) -> str:
    """SHA-256 of the components by part, entry and position within the part, joined by commas."""
    dims = len(book[0]) if book else 0
    width = dims // parts
    said = ",".join(str(c) for p in range(parts) for e in book for c in e[p * width:(p + 1) * width])
    return hashlib.sha256(said.encode()).hexdigest()
