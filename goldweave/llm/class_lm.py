"""Class-based bigram language model: words are exchanged between classes, classes follow each other."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.common import LOWER, slices, text_or_empty, texts_of
from goldweave.session import materialise

#: A word with at least this share of the training tokens is known to every task, so there are at
#: most 1 / HEAD_SHARE of them; all other words meet their counts in a join.
HEAD_SHARE = 1e-6
#: A word with at least this share is exchanged between classes by itself (at most 1 / UNIT_SHARE
#: words); all others are exchanged together with the words of equal first and last letters.
UNIT_SHARE = 2e-5
SIGNATURES = 8192
CLASSES = 64
ROUNDS = 3
#: Distinct words a task counts before it hands them on.
_FLUSH = 200_000
_END = " "  # the end token; no word holds a space


def _signature(word: bytes) -> int:
    return zlib.crc32(word[:2] + b" " + word[-3:]) % SIGNATURES


def _documents(docs: DataFrame, id_column: str, text_column: str, held_out: int, folds: int) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"),
                       (fold == held_out).alias("held_out"))


def word_counts(training: DataFrame) -> DataFrame:
    """``word, n`` over all texts; every text ends with the end token (a space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch, "text"):
                seen[b" "] += 1
                for piece in slices(text.translate(LOWER)):
                    seen.update(piece.split())
                    if len(seen) > _FLUSH:
                        yield _counted(seen)
                        seen.clear()
        if seen:
            yield _counted(seen)

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())],
                                      names=["word", "n"])


@dataclass
class Head:
    """What every task holds: the frequent words, the unit each belongs to, their counts."""
    places: dict[bytes, int]
    unit: np.ndarray
    count: np.ndarray
    n_units: int  # signatures first, then the words exchanged by themselves; the last is the end token


def _head(counts: DataFrame, tokens: int) -> Head:
    """Collects the frequent words; their number is bounded by 1 / HEAD_SHARE."""
    rows = counts.filter((F.col("n") >= tokens * HEAD_SHARE) & (F.col("word") != _END)).toArrow()
    words, n = rows["word"].cast(pa.binary()).to_pylist(), rows["n"].to_pylist()
    ends = counts.filter(F.col("word") == _END).first()
    words.append(_END.encode())
    n.append(ends["n"] if ends else 0)
    order = sorted(range(len(words)), key=lambda i: (words[i] == b" ", -n[i], words[i]))
    places, unit, count, units = {}, [], [], SIGNATURES
    for i in order:
        places[words[i]] = len(places)
        count.append(int(n[i]))
        if n[i] >= tokens * UNIT_SHARE or words[i] == b" ":
            unit.append(units)
            units += 1
        else:
            unit.append(_signature(words[i]))
    return Head(places, np.array(unit, np.int64), np.array(count, np.int64), units)


def _units(text: bytes, head: Head) -> np.ndarray:
    """The unit of every token of a text, the end token before and after."""
    end, places, unit = head.n_units - 1, head.places, head.unit
    out = [np.array([end], np.int64)]
    for piece in slices(text.translate(LOWER)):
        words = piece.split()
        at = np.array([places.get(w, -1) for w in words], np.int64)
        found = unit[at] if len(unit) else at
        rare = np.flatnonzero(at < 0)
        if len(rare):
            found[rare] = [_signature(words[i]) for i in rare.tolist()]
        out.append(found)
    out.append(np.array([end], np.int64))
    return np.concatenate(out)


def _encoded(training: DataFrame, head) -> DataFrame:
    """``units``: the units of the tokens of every text, two bytes each (there are fewer than 65,536 units)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_units(text, head.value).astype("<u2").tobytes() for text in texts_of(some, "text")], pa.binary())], names=["units"])

    return training.select("text").mapInArrow(run, "units binary")


def _neighbours(encoded: DataFrame, n_units: int, classes: np.ndarray) -> DataFrame:
    """``unit, vector``: how often each class precedes (first half) and follows (second half) the unit's tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))
    width = 2 * CLASSES

    def counted(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = total.reshape(-1, width)
        used = np.flatnonzero(table.any(axis=1))
        for k in range(0, len(used), 4096):
            some = used[k:k + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([table[u].astype("<i8").tobytes() for u in some], pa.binary())],
                names=["unit", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        total, pending, waiting = np.zeros(n_units * width, np.int64), [], 0
        for batch in batches:
            for coded in batch.column("units").to_pylist():
                units = np.frombuffer(coded, "<u2").astype(np.int64)
                of = classes[units]
                units *= width
                pending.append(units[1:] + of[:-1])
                pending.append(units[:-1] + CLASSES + of[1:])
                waiting += len(units)
                if waiting > 1 << 20:
                    total += np.bincount(np.concatenate(pending), minlength=len(total))
                    pending, waiting = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=len(total))
        yield from counted(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, vector in zip(batch.column("unit").to_pylist(), batch.column("vector").to_pylist()):
                row = np.frombuffer(vector, "<i8")
                sums[unit] = sums[unit] + row if unit in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["unit", "vector"])

    parts = encoded.mapInArrow(run, "unit int, vector binary")
    return parts.repartition("unit").mapInArrow(added, "unit int, vector binary")


def _class_bigrams(vectors: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often class a is followed by class b, summed per partition in the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES), np.int64)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i8").reshape(-1, 2 * CLASSES)
            np.add.at(total, classes[batch.column("unit").to_numpy()], rows[:, CLASSES:])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["m"])

    total = np.zeros((CLASSES, CLASSES), np.int64)
    for row in vectors.mapInArrow(run, "m binary").collect():  # one matrix per partition of a bounded table
        total += np.frombuffer(row["m"], "<i8").reshape(CLASSES, CLASSES)
    return total


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _likelihood(bigrams: np.ndarray) -> float:
    """The part of the class model's log likelihood that the classes decide."""
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    return float(_xlogx(bigrams).sum() - _xlogx(left).sum() - _xlogx(right).sum())


def _exchanged(vectors: DataFrame, classes: np.ndarray, bigrams: np.ndarray, fixed: int, half: int | None) -> np.ndarray:
    """The classes after every unit (or every unit of one half) moved to where the likelihood gains most.

    The gain of a move is that of taking the unit's neighbour counts out of its class and adding them to the other's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bigrams.astype(np.float64)
        left, right = m.sum(axis=1), m.sum(axis=0)
        m_log, left_log, right_log = _xlogx(m), _xlogx(left), _xlogx(right)
        for batch in batches:
            units = batch.column("unit").to_numpy().astype(np.int64)
            rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i8").reshape(-1, 2 * CLASSES)
            best = classes[units].astype(np.int32)
            for k in range(0, len(units), 128):
                own = classes[units[k:k + 128]]
                r, s = (rows[k:k + 128, i:i + CLASSES].astype(np.float64) for i in (0, CLASSES))
                n = s.sum(axis=1)
                i = np.arange(len(own))
                into = ((_xlogx(m[None] + r[:, :, None]) - m_log[None]).sum(axis=1)
                        + (_xlogx(m[None] + s[:, None, :]) - m_log[None]).sum(axis=2)
                        - (_xlogx(left[None] + n[:, None]) - left_log[None])
                        - (_xlogx(right[None] + n[:, None]) - right_log[None]))
                stay = ((m_log[:, own].T - _xlogx(np.maximum(m[:, own].T - r, 0))).sum(axis=1)
                        + (m_log[own] - _xlogx(np.maximum(m[own] - s, 0))).sum(axis=1)
                        - (left_log[own] - _xlogx(np.maximum(left[own] - n, 0)))
                        - (right_log[own] - _xlogx(np.maximum(right[own] - n, 0))))
                into[i, own] = stay
                best[k:k + 128] = into.argmax(axis=1)
            if half is not None:
                best = np.where(units % 2 == half, best, classes[units])
            best[units == fixed] = classes[fixed]
            yield pa.RecordBatch.from_arrays([pa.array(units.astype(np.int32)), pa.array(best.astype(np.int32))], names=["unit", "class"])

    after = classes.copy()
    moved = vectors.mapInArrow(run, "unit int, class int").toArrow()  # at most 1 / UNIT_SHARE + SIGNATURES rows
    after[moved["unit"].to_numpy()] = moved["class"].to_numpy()
    return after


@dataclass
class Model:
    classes: np.ndarray
    follows: np.ndarray  # log10 of the class given the class before
    spread: np.ndarray  # log10 of a class's tokens and its unseen words' share, the emission's denominator
    unseen: np.ndarray  # log10 of the unseen words' share of a class, the emission's numerator


def fit(training: DataFrame, counts: DataFrame, tokens: int, rounds: int = ROUNDS):
    """Classes by exchange, then smoothed class transitions and emissions; returns the broadcast head and the model."""
    spark = training.sparkSession
    own = _head(counts, tokens)
    head = spark.sparkContext.broadcast(own)
    end = own.n_units - 1
    classes = np.arange(own.n_units, dtype=np.int64)
    classes[SIGNATURES:] -= SIGNATURES
    classes = 1 + classes % (CLASSES - 1)  # by rank: the most frequent words open the classes
    classes[end] = 0
    best = None
    encoded, _ = materialise(_encoded(training, head), "class-units")  # texts are cut into words once for all rounds
    for step in range(rounds + 1):
        vectors, _ = materialise(_neighbours(encoded, own.n_units, classes), "class-neighbours")
        bigrams = _class_bigrams(vectors, classes)
        value = _likelihood(bigrams)
        if best is None or value > best[0]:
            best = (value, classes, bigrams, vectors)
        if step < rounds:
            value, classes, bigrams, vectors = best
            classes = _exchanged(vectors, classes, bigrams, end, None if step == 0 else step % 2)
    _, classes, bigrams, _ = best
    return head, _smoothed(classes, bigrams, _singletons(counts, classes, head, end))


def _singletons(counts: DataFrame, classes: np.ndarray, head, end: int) -> np.ndarray:
    """Words of each class that occur once: by Good and Turing, the tokens to expect of words not seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(CLASSES, np.int64), head.value
        for batch in batches:
            for w in batch.column("word").cast(pa.binary()).to_pylist():
                at = own.places.get(w)
                total[classes[own.unit[at] if at is not None else _signature(w)]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total)], names=["class", "n"])

    sums = counts.filter("n = 1").select("word").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES)
    for row in sums.collect():
        out[row["class"]] = row["n"]
    return out


def _smoothed(classes: np.ndarray, bigrams: np.ndarray, once: np.ndarray) -> Model:
    tokens = bigrams.sum(axis=0).astype(np.float64)  # every token but the start follows something
    share = (tokens + 1) / (tokens.sum() + CLASSES)
    weight = float(CLASSES)
    follows = (bigrams + weight * share[None]) / (bigrams.sum(axis=1, keepdims=True) + weight)
    unseen = once + 0.5
    unseen[0] = 1e-3  # the end token's class has no other words
    return Model(classes, np.log10(follows), np.log10(tokens + unseen), np.log10(unseen))


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, id_column: str = "doc_id", text_column: str = "text",
          rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row, from the whole text.

    Trains on the rows whose CRC-32 of the id as text leaves another remainder than ``held_out`` by
    ``folds``. Tokens are the words between ASCII white space after lower-casing A-Z, and one end token. The score is
    the log10 probability under P(class | class before) * P(word | class). Classes come from
    exchange clustering: each round gathers every unit's neighbour classes from all training tokens and moves units where
    the likelihood gains most; a round that loses is taken back. Frequent words are units of their
    own, all other words share a unit with the words of equal first two and last three bytes, which gives words never
    seen a class too. Transitions are smoothed by the class shares, emissions by the share of
    words seen once, which an unseen word of the class gets. ``base_score`` is the unigram model with one added count.

    A null text is empty (one token), a null id is the empty text for the fold, repeated rows stay
    (their tokens count each time); other columns are ignored. Without training rows every token is unseen.
    """
    own = _documents(docs, id_column, text_column, held_out, folds)
    training = own.filter(~F.col("held_out"))
    counts, seen = materialise(word_counts(training), "class-counts", tokens=F.sum("n"))
    tokens, size = int(seen["tokens"] or 0), int(seen["rows"])
    head, model = fit(training, counts, tokens, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = math.log10(tokens + size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, m = head.value, shared.value
        unit_class = m.classes
        emits = np.log10(np.maximum(words_of.count, 1)) - m.spread[unit_class[words_of.unit]] if len(words_of.unit) else np.empty(0)
        base = np.log10(words_of.count + 1.0) - one
        names = ["word", "doc_id", "text_hash", "part", "held_out", "tf", "class", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            out: list[list] = [[] for _ in names]
            for doc, text, held in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), batch.column("held_out").to_pylist()):
                rest: Counter = Counter()
                key = xxhash.xxh64_intdigest(text) - (1 << 63)
                n, known, b, s, last = 0, 0, 0.0, 0.0, 0
                for piece in [*slices(text.translate(LOWER)), None]:
                    words = piece.split() if piece is not None else [b" "]
                    if not words:
                        continue
                    at = np.array([words_of.places.get(w, -1) for w in words], np.int64)
                    rare = np.flatnonzero(at < 0)
                    of = np.empty(len(at), np.int64)
                    heads = at >= 0
                    of[heads] = unit_class[words_of.unit[at[heads]]]
                    if len(rare):
                        of[rare] = unit_class[[_signature(words[i]) for i in rare.tolist()]]
                        s -= float(m.spread[of[rare]].sum())
                        rest.update(zip([words[i] for i in rare.tolist()], of[rare].tolist()))
                    before = np.concatenate([[last], of[:-1]])
                    s += float(m.follows[before, of].sum()) + float(emits[at[heads]].sum())
                    b += float(base[at[heads]].sum())
                    known += int((words_of.count[at[heads]] > 0).sum())
                    n += len(at)
                    last = int(of[-1])
                rows = [(b" ", 1, 0, n, known, b, s), *[(w, k, c, 0, 0, 0.0, 0.0) for (w, c), k in rest.items()]]
                for i, column in enumerate(zip(*rows)):
                    out[(0, 5, 6, 7, 8, 9, 10)[i]].extend(column)
                for i, v in ((1, doc), (2, key), (3, part), (4, held)):
                    out[i].extend([v] * len(rows))
                if len(out[0]) > 100_000:
                    yield _rows(out, names)
                    out = [[] for _ in names]
            if out[0]:
                yield _rows(out, names)

    schema = ("word string, doc_id long, text_hash long, part int, held_out boolean, tf long, class int, "
              "n_tokens long, n_known long, base double, score double")
    said = own.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema)
    # A row per text carries what is known of it; its word is one no text holds, different for every text.
    whole = F.col("word") == " "
    said = said.withColumn("whole", whole).withColumn(
        "word", F.when(whole, F.concat_ws(" ", F.lit(""), "text_hash", "doc_id", "part")).otherwise(F.col("word")))
    met = said.join(counts, "word", "left")
    n, rare = F.col("n"), ~F.col("whole")
    unseen = F.lit(model.unseen.tolist())[F.col("class")]
    parts = met.groupBy("doc_id", "text_hash", "part", "held_out").agg(
        F.sum(F.col("whole").cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare, F.when(n.isNotNull(), F.col("tf")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("tf") * (F.log10(F.coalesce(n, F.lit(0)) + 1.0) - one)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(rare, F.col("tf") * F.when(n.isNotNull(), F.log10(n.cast("double"))).otherwise(unseen))
              .otherwise(F.col("score"))).alias("score"))
    copies = F.col("copies")
    return parts.select(
        "doc_id", "held_out", (F.col("n_tokens") / copies).cast("long").alias("n_tokens"),
        (F.col("n_known") / copies).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / copies).alias("base_score"), (F.col("score") / copies).alias("score"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def _rows(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
             pa.float64(), pa.float64()]
    arrays = [pa.array(v, k) for v, k in zip(out, kinds)]
    return pa.RecordBatch.from_arrays([arrays[0].cast(pa.string()), *arrays[1:]], names=names)
