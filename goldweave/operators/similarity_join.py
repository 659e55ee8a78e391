"""Exact similarity joins over distinct values.

Values are compared, never records: records that share a value share its matches. Candidate
pairs come from equi-joins on signatures that every matching pair must share, so nothing is
lost. Group columns (``within``) restrict matches to values of the same block; without them the
result is a dictionary of similar values that any number of blocks can use.

Signatures adapt to the data by counts taken in Spark: their tokens come in the order of measured
frequency, values with a rare start need no tokens, and a start that many values share needs up to
four. A signature that is heavy all the same becomes a grid of sub-groups (``balanced``).

Both joins ask for a sort-merge join: the signatures are many times the values they come from,
which size estimates do not see, so neither side may be broadcast.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from goldweave.functions.similarity import BOOST_ABOVE, MAX_PREFIX, PREFIX_WEIGHT, edit_similarity, jaro_winkler
from goldweave.operators import block_pairs
from goldweave.session import materialise

# Ship the code of this module with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that get a rank of their own; all others count as rare.
RANKED_TOKENS = 512
#: Tokens a signature has, by the number of values that share a block and a start: up to so many, that many.
SHARED_BY = ((64, 0), (512, 2), (8192, 3), (None, 4))
#: Values of one start beyond which signatures are counted, and rows of either side in one sub-group of a signature.
HEAVY_START, CELL_ROWS = 4096, 2048
#: Texts of a block at most where all are compared, and pairs compared there in the time of one that meets in a signature.
TEXT_BLOCK, _COMPARED = 16_384, 200


def _lowest_jaro(threshold: float, prefix: int) -> float:
    """Smallest Jaro value that can reach ``threshold`` with this many equal leading characters."""
    if threshold <= BOOST_ABOVE:
        return threshold
    weight = PREFIX_WEIGHT * prefix
    return max(BOOST_ABOVE, (threshold - weight) / (1 - weight))


def token_order(texts: DataFrame) -> list[tuple[str, int]]:
    """The most frequent tokens (character, occurrence) of column ``v``, rarest of them first; at most ``RANKED_TOKENS``."""
    char = "substring(v, i, 1)"
    seen = f"length(substring(v, 1, i)) - length(replace(substring(v, 1, i), {char}, ''))"
    counts = texts.select(F.inline(F.expr(f"transform(sequence(1, length(v)), i -> struct({char} AS c, {seen} AS seen))")))
    top = counts.groupBy("c", "seen").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c", "seen").limit(RANKED_TOKENS)
    return [(r.c, r.seen) for r in reversed(top.collect())]


# Most tokens of a signature for a shorter text below so many characters: long texts have rare tokens, and many
# combinations of them.
_BY_LENGTH = ((4, 14), (3, 20), (2, 48), (1, None))
# Classes of the length ratio in percent, each from its entry up to the one before, with the most tokens of a
# signature: equally long texts must share more than texts of different length.
_RATIOS = ((90, 4), (75, 4), (0, 3))


def _sizes(most: int, ratio_class: int) -> list[tuple[int, int | None]]:
    """Tokens of a signature, for shorter texts below so many characters, where a start calls for ``most``."""
    out: list[tuple[int, int | None]] = []
    for tokens, below in _BY_LENGTH:
        tokens = min(most, tokens, _RATIOS[ratio_class][1])
        if out and out[-1][0] == tokens:
            out.pop()
        out.append((tokens, below))
    return out


def _distinct_texts(values: DataFrame, blocks: list[str], column: str) -> DataFrame:
    """Distinct non-blank values, spread over all tasks.

    The values are small next to the signatures made of them, so adaptive execution would merge
    them into a few tasks; a repartitioning by number is left as it is.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (values.select(*blocks, F.col(column).alias("v")).filter("v is not null and v <> ''").distinct()
            .repartition(tasks))


def similar_by_jaro_winkler(values: DataFrame, column: str, threshold: float,
                            within: list[str] | None = None) -> DataFrame:
    """All pairs of distinct values with Jaro-Winkler ≥ ``threshold``: ``value_a < value_b, score``."""
    scored = jaro_winkler_candidates(values, column, threshold, within).withColumn(
        "score", F.round(jaro_winkler("value_a", "value_b"), 6))
    return scored.filter(F.col("score") >= threshold)


def jaro_winkler_candidates(values: DataFrame, column: str, threshold: float,
                            within: list[str] | None = None) -> DataFrame:
    """Pairs of distinct values that may reach ``threshold``; every pair that does is among them.

    With m common characters, Jaro ≤ (m/x + m/y + 1)/3 for lengths x and y. Hence two texts
    with l equal leading characters need c·x·y/(x+y) common characters, where c = 3·J − 1 and J
    is the lowest Jaro value that reaches the threshold. So the token arrays of what follows
    the common start must overlap in n places, and the first (size − n + s) tokens of each
    array, rare ones first, must share s tokens. A signature is the hash of l, the l
    characters, a class of the length ratio and s tokens out of these prefixes; s follows from the
    number of values with that start (``SHARED_BY``) and is n for pairs that need fewer. Before they
    are returned, pairs pass the same bound once more on 64-bit token masks: bits that differ never
    outnumber the tokens that differ. Hash collisions only add candidates.
    """
    if not 0.4 <= threshold <= 1:
        raise ValueError("threshold must be within 0.4 and 1")
    blocks = within or []
    texts, _ = materialise(_distinct_texts(values, blocks, column), "similar-values")
    starts, seen = materialise(shared_starts(texts, blocks), "similar-starts", top=F.max("shared"))
    top = seen["top"] or 0
    order = token_order(texts) if top > SHARED_BY[0][0] else []  # signatures without tokens need no order
    short, long = (jaro_winkler_signatures(starts, blocks, threshold, order, role) for role in (0, 1))
    if top > HEAVY_START:
        short, long = balanced(short, long, blocks)
    else:  # no signature can be heavy
        short, long = (side.withColumn("cell", F.lit(0)) for side in (short, long))

    def side(signed: DataFrame, name: str, *more: str) -> DataFrame:
        return signed.select(*blocks, "sig", "cell", *[F.col(c).alias(f"{c}_{name}") for c in ("v", "x", "mask")], *more)

    xs, xl, start = F.col("x_s"), F.col("x_l"), F.col("l")
    c = F.element_at(F.array(*[F.lit(k) for k in _coefficients(threshold)]), start + 1)
    need = F.ceil(c * xs * xl / (xs + xl) - 1e-9)
    ordered = (xs < xl) | ((xs == xl) & (F.col("v_s") < F.col("v_l")))
    meant = F.col("tokens") == F.least(F.col("size"), F.greatest(need - start, F.lit(0)))
    close = F.bit_count(F.col("mask_s").bitwiseXOR(F.col("mask_l"))) <= xs + xl - 2 * need
    same_start = F.expr("substring(v_s, 1, l) = substring(v_l, 1, l)")
    differs_next = (start == MAX_PREFIX) | F.expr("substring(v_s, l + 1, 1) <> substring(v_l, l + 1, 1)")
    return (side(short, "s", "l", "tokens", "size").join(side(long, "l").hint("merge"), [*blocks, "sig", "cell"])
            .filter(ordered & close & (need <= xs) & meant & same_start & differs_next)
            .select(*blocks, F.least("v_s", "v_l").alias("value_a"), F.greatest("v_s", "v_l").alias("value_b"))
            .distinct())  # a pair may meet in several signatures


def _coefficients(threshold: float) -> list[float]:
    return [3 * _lowest_jaro(threshold, prefix) - 1 for prefix in range(MAX_PREFIX + 1)]


def shared_starts(texts: DataFrame, blocks: list[str]) -> DataFrame:
    """``v, l, shared, most``: every value with each of its starts of l characters that other values have too.

    ``shared`` counts the values with the start, ``most`` is the number of tokens that calls for. A start after
    which all values go on alike is left out: their pairs meet at a longer start.
    """
    starts = texts.select(*blocks, "v", F.explode(F.sequence(F.lit(0), F.least(F.length("v"), F.lit(MAX_PREFIX)))).alias("l"))
    starts = starts.withColumn("start", F.expr("substring(v, 1, l)"))
    following = F.expr("substring(v, l + 1, 1)")
    shared = (starts.groupBy(*blocks, "l", "start").agg(F.count(F.lit(1)).alias("shared"), F.min(following).alias("least"), F.max(following).alias("last"))
              .filter((F.col("shared") > 1) & ((F.col("l") == MAX_PREFIX) | (F.col("least") < F.col("last")))).drop("least", "last"))
    most = F.lit(SHARED_BY[-1][1])
    for up_to, tokens in reversed(SHARED_BY[:-1]):
        most = F.when(F.col("shared") <= up_to, tokens).otherwise(most)
    return starts.join(shared.hint("merge"), [*blocks, "l", "start"]).select(*blocks, "v", "l", "shared", most.cast("int").alias("most"))


def jaro_winkler_signatures(starts: DataFrame, blocks: list[str], threshold: float, order: list[tuple[str, int]], role: int) -> DataFrame:
    """A row per signature of a value: ``sig, size, tokens``, and ``v, l, shared, most, x, mask``.

    Role 0 is for the shorter text of a pair, role 1 for the longer one. A signature has ``tokens`` tokens; ``size`` is
    what its start, its class of length ratio and the length of the shorter text call for.
    """
    ranks = {token: rank for rank, token in enumerate(order)}
    coefficients = _coefficients(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):  # a text has tens to hundreds of signatures
                some = batch.slice(low, 512)
                at, found, masks = [], [], []
                for k, (v, l, most) in enumerate(zip(*(some.column(c).to_pylist() for c in ("v", "l", "most")))):
                    mask = 0
                    for code, _ in _ranked_tokens(v, ranks):
                        mask |= 1 << (code * 0x9E3779B97F4A7C15 >> 58 & 63)
                    masks.append(mask - (1 << 64) if mask >> 63 else mask)
                    own = signatures_of(v, l, most, coefficients[l], ranks, role)
                    at += [k] * len(own)
                    found += own
                rows = some.take(pa.array(at, pa.int64()))
                own = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in (*blocks, "v", "l", "shared", "most")), pc.utf8_length(rows.column("v")),
                     pa.array(masks, pa.int64()).take(pa.array(at, pa.int64())),
                     *(pa.array(c, t) for c, t in zip(own, (pa.int32(), pa.int32(), pa.int64())))],
                    names=[*blocks, "v", "l", "shared", "most", "x", "mask", "size", "tokens", "sig"])

    schema = StructType([*starts.schema.fields, *(StructField(c, t) for c, t in (
        ("x", IntegerType()), ("mask", LongType()), ("size", IntegerType()), ("tokens", IntegerType()), ("sig", LongType())))])
    return starts.mapInArrow(run, schema)


def balanced(short: DataFrame, long: DataFrame, blocks: list[str], cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cell``: a heavy signature becomes a grid of sub-groups that hold about ``cell_rows`` rows of a side.

    With a rows of one side and b of the other the grid has ceil(a / cell_rows) times ceil(b / cell_rows) cells. A row
    of one side falls into one line of the grid by its hash and stands in every cell of it, so each pair meets in
    exactly one cell.
    """
    keys = [*blocks, "sig"]
    both = short.select(*keys, F.lit(0).alias("role")).unionByName(long.select(*keys, F.lit(1).alias("role")))

    def lines(role: int) -> Column:
        return F.ceil(F.count_if(F.col("role") == role) / cell_rows).cast("int").alias(f"lines_{role}")

    heavy = both.groupBy(*keys).agg(lines(0), lines(1)).filter("lines_0 > 0 and lines_1 > 0 and lines_0 + lines_1 > 2")
    heavy, _ = materialise(heavy, "heavy-signatures")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        sized = side.join(heavy.hint("merge"), keys, "left")
        line = F.pmod(F.xxhash64("v", F.lit("cell")), F.col(own)).cast("int")
        row = F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: line * F.col("lines_1") + k if own == "lines_0" else k * F.col("lines_1") + line)
        return sized.withColumn("cell", F.explode(F.when(F.col(own).isNull(), F.array(F.lit(0))).otherwise(row))).drop("lines_0", "lines_1")

    return dealt(short, "lines_0", "lines_1"), dealt(long, "lines_1", "lines_0")


def signatures_of(text: str, start: int, most: int, coefficient: float, ranks: dict[tuple[str, int], int], role: int) -> list[tuple[int, int, int]]:
    """``(size, tokens, signature)`` of a text with ``start`` leading characters in common, as the shorter (role 0) or
    longer text of a pair.

    For every class of length ratio and every signature size the partner can call for, the
    prefix of the tokens is as long as the least demanding partner requires: the shortest
    one for the longer side, the one closest in length for the shorter side. A partner that needs fewer
    tokens than the size meets in a signature of just as many, out of all tokens. Where a start
    calls for no tokens, one signature is enough.
    """
    head = (start, *map(ord, text[:start]))
    if not most:
        return [(0, 0, hash((*head, 0)))]
    x, tokens = len(text), [code for code, _ in _ranked_tokens(text[start:], ranks)]
    out = []
    for ratio_class, (low, _) in enumerate(_RATIOS):
        high, above = _RATIOS[ratio_class - 1][0] if ratio_class else 0, 0
        for size, below in _sizes(most, ratio_class):
            below = below or 1 << 31
            if role == 0:
                partner, applies = (100 * x // high + 1 if high else x), above <= x < below
            else:
                partner = max(math.ceil((coefficient - 1) * x - 1e-9), -(-low * x // 100), start, 1, above)
                applies = partner <= (min(x, -(-high * x // 100) - 1) if high else x) and partner < below
            above = below
            if not applies:
                continue
            need = max(math.ceil(coefficient * x * partner / (x + partner) - 1e-9) - start, 0)
            prefix = tokens[:max(len(tokens) - max(need, size) + size, 0)]
            kinds = [(size, prefix), *[(fewer, tokens) for fewer in range(need, size)]]
            out += [(size, n, hash((*head, ratio_class, n, *some))) for n, held in kinds for some in itertools.combinations(held, n)]
    return out


def _ranked_tokens(text: str, ranks: dict[tuple[str, int], int]) -> list[tuple[int, int]]:
    """Tokens of a text, by measured frequency, rare ones first: a number for each and its rank. Two texts have as
    many equal tokens as they have characters in common, counted with repeats."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        n = seen[c] = seen.get(c, 0) + 1
        out.append((ord(c) + (n << 21), ranks.get((c, n), -1)))
    return sorted(out, key=lambda t: (t[1], t[0]))


def _token_masks(texts: DataFrame) -> DataFrame:
    """Adds ``node``, a number of its own, and ``mask``, a bit of 256 for each token (character, occurrence) of ``v``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for v in batch.column("v").to_pylist():
                mask = 0
                for code, _ in _ranked_tokens(v, {}):
                    mask |= 1 << (code * 0x9E3779B97F4A7C15 >> 56 & 255)
                masks.append(mask.to_bytes(32, "little"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "v", "x")), pa.array(masks, pa.binary())],
                                             names=["node", "v", "x", "mask"])

    return texts.select(F.monotonically_increasing_id().alias("node"), "v", "x").mapInArrow(run, "node long, v string, x int, mask binary")


def _char_codes(texts: list[str]) -> np.ndarray:
    """The first 64 characters of every text in 256 classes, so that equal characters have equal ones."""
    flat = np.array([t[:64].ljust(64, "\0") for t in texts], dtype="<U64")
    return (flat.view(np.uint32).reshape(len(texts), 64) & 255).astype(np.uint8)


def _least_edits(held: np.ndarray, held_sizes: np.ndarray, places: np.ndarray, x: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The edits between text ``x`` of a block and the text with ``codes`` and ``sizes``, pair by pair, by the
    bit-parallel columns of Myers (1999); ``places`` has the positions of each class of characters in a text of the block."""
    one, sizes_x = np.uint64(1), held_sizes[x]
    order = np.argsort(-sizes, kind="stable")
    x, codes, sizes, top = x[order], codes[order], sizes[order], (sizes_x[order] - 1).astype(np.uint64)
    plus, minus = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
    edits = sizes_x[order].astype(np.int64)
    for j in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -j, "left"))  # those longer than j
        p, m, equal = plus[:n], minus[:n], places[x[:n], codes[:n, j]]
        across = (((equal & p) + p) ^ p) | equal
        up, down = m | ~(across | p), p & across
        edits[:n] += ((up >> top[:n]) & one).astype(np.int64) - ((down >> top[:n]) & one).astype(np.int64)
        up, equal = (up << one) | one, equal | m
        plus[:n], minus[:n] = (down << one) | ~(equal | up), up & equal
    out = np.empty(len(x), np.int64)
    out[order] = edits
    return out


def compared_texts(texts: DataFrame, threshold: float, rows: int, block_rows: int = TEXT_BLOCK) -> DataFrame:
    """``value_a < value_b, score`` of all pairs of the distinct texts ``v`` with ``1 − distance / longer length ≥ threshold``.

    Blocks of texts meet in tasks (``block_pairs``). An edit changes two tokens (character, occurrence) at most, so the
    token masks of a pair within k edits differ in 2·k − d bits at most, where d is the difference of the lengths; that
    is one matrix product. What passes is compared by bit-parallel edit distance if both have 64 characters at
    most; Spark's own distance decides.
    """
    blocks, slack = block_pairs.count_blocks(rows, block_rows), 1 - threshold

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column("mask").to_pylist()), np.uint8).reshape(-1, 32), axis=1).astype(np.float32)
        return bits, bits.sum(axis=1), batch.column("x").to_numpy(), batch.column("node").to_numpy(), _char_codes(batch.column("v").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for block, some, own in block_pairs.meetings(batches, blocks):
            if block is not last:
                last, (bits, ones, sizes, nodes, codes) = block, read(block)
                places = np.zeros((len(sizes), 256), np.uint64)
                for j in range(64):
                    inside = np.flatnonzero(sizes > j)
                    places[inside, codes[inside, j]] |= np.uint64(1 << j)
            other, other_ones, other_sizes, other_nodes, other_codes = read(some)
            # a bound for each pair of lengths, then for each pair of texts
            (few, at), (less, to) = np.unique(other_sizes, return_inverse=True), np.unique(sizes, return_inverse=True)
            longer = np.maximum(few[:, None], less[None])
            most = np.floor(slack * longer + 1e-9)
            bound = (few[:, None] + less[None] - 2 * (longer - most)).astype(np.float32)
            shared = other @ bits.T
            shared *= 2
            shared += bound[at][:, to]
            shared -= ones[None]
            q, x = np.nonzero(shared >= other_ones[:, None])
            if own:  # a block against itself: each pair once
                once = other_nodes[q] < nodes[x]
                q, x = q[once], x[once]
            for k in range(0, len(q), 32_768):
                i, j = q[k:k + 32_768], x[k:k + 32_768]
                short = (sizes[j] <= 64) & (other_sizes[i] <= 64)
                keep = np.ones(len(i), bool)
                keep[short] = _least_edits(codes, sizes, places, j[short], other_codes[i[short]], other_sizes[i[short]]) <= most[at[i[short]], to[j[short]]]
                yield pa.RecordBatch.from_arrays([some.column("v").take(pa.array(i[keep])), block.column("v").take(pa.array(j[keep]))], names=["v_1", "v_2"])

    numbered, _ = materialise(_token_masks(texts), "similar-masks")
    found = block_pairs.cells(numbered, blocks).mapInArrow(run, "v_1 string, v_2 string").select(
        F.least("v_1", "v_2").alias("value_a"), F.greatest("v_1", "v_2").alias("value_b"))
    scored = found.withColumn("score", F.round(edit_similarity(F.col("value_a"), F.col("value_b")), 6))
    return scored.filter(F.col("score") >= threshold)


def similar_by_edit_distance(values: DataFrame, column: str, threshold: float,
                             within: list[str] | None = None) -> DataFrame:
    """All pairs of distinct values with ``1 − distance / longer length ≥ threshold``.

    A pair with a longer text of x characters is at most k = ⌊(1 − threshold)·x⌋ edits apart.
    If the shorter text is cut into k + 1 parts, one part occurs unchanged in the longer text,
    shifted by at most k. The signature is (shorter length, k, part number, part). Where many texts share their parts (as
    addresses of one site do), joining the signatures is more work than comparing all texts block by block, which is
    done instead: the signatures are counted first.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    blocks = within or []
    texts, seen = materialise(_distinct_texts(values, blocks, column).withColumn("x", F.length("v")), "similar-values")
    slack = 1 - threshold
    k_of = f"cast(floor({slack} * {{}} + 1e-9) as int)"
    longest = f"cast(floor(x / {threshold} + 1e-9) as int)"
    # Part p of a text of y characters under k edits: the first y mod (k+1) parts are one longer.
    size = "cast(floor(({y} + p) / (k + 1)) as int)"
    begin = "cast(1 + p * floor({y} / (k + 1)) + greatest(p - (k + 1 - {y} % (k + 1)), 0) as int)"
    parts = (f"transform(sequence(0, k), p -> named_struct('len', x, 'k', k, 'part', p, "
             f"'piece', substring(v, {begin.format(y='x')}, {size.format(y='x')})))")
    budgets = f"array_distinct(transform(sequence(x, {longest}), z -> {k_of.format('z')}))"
    short = texts.select(*blocks, F.col("v").alias("va"), F.inline(F.expr(
        f"flatten(transform(filter({budgets}, k -> k > 0), k -> {parts}))")))
    pieces = (f"flatten(transform(sequence(0, k), p -> transform(sequence("
              f"greatest({begin.format(y='y')} - k, 1), least({begin.format(y='y')} + k, greatest(x, 1))), "
              f"s -> named_struct('len', y, 'k', k, 'part', p, 'piece', substring(v, s, {size.format(y='y')})))))")
    sought = f"flatten(transform(sequence(greatest(x - k, 1), x), y -> {pieces}))"
    long = texts.select(*blocks, F.col("v").alias("vb"), F.col("x"), F.inline(F.array_distinct(F.expr(
        f"flatten(transform(filter(array({k_of.format('x')}), k -> k > 0), k -> {sought}))"))))
    keys = [*blocks, "len", "k", "part", "piece"]
    if not blocks and seen["rows"] > HEAVY_START:
        met = short.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(
            long.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).hint("merge"), keys)
        candidates = met.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
        if seen["rows"] ** 2 / 2 <= _COMPARED * candidates:
            return compared_texts(texts, threshold, seen["rows"])
    once = (F.col("len") < F.col("x")) | (F.col("va") < F.col("vb"))
    close = F.expr("levenshtein(va, vb, k)") >= 0
    pairs = (short.join(long.hint("merge"), keys).filter(once & (F.col("va") != F.col("vb")) & close)
             .select(*blocks, F.least("va", "vb").alias("value_a"), F.greatest("va", "vb").alias("value_b"))
             .distinct())  # a pair may meet in several parts; only true matches get here
    scored = pairs.withColumn("score", F.round(edit_similarity(F.col("value_a"), F.col("value_b")), 6))
    return scored.filter(F.col("score") >= threshold)


SIMILARITY = {"jaro_winkler": similar_by_jaro_winkler, "edit_distance": similar_by_edit_distance}


def value_members(df: DataFrame, record_id: str, blocks: list[str], column: str) -> DataFrame:
    """One row per block and value: smallest record id ``rep`` and record count ``n``."""
    known = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    for b in blocks:
        known = known.filter(F.col(b).isNotNull())
    return (known.groupBy(*blocks, F.col(column).alias("value"))
            .agg(F.min(record_id).alias("rep"), F.count(F.lit(1)).alias("n")))


def blocked_value_pairs(members: DataFrame, blocks: list[str], threshold: float,
                        algorithm: str = "jaro_winkler", dictionary: bool = False) -> DataFrame:
    """Similar values inside each block with the representatives and counts of both sides.

    The join runs inside the blocks, so blocks prune it. ``dictionary`` compares the values once
    for all blocks instead, for a small vocabulary that all blocks share. Both give the same rows.
    """
    if algorithm not in SIMILARITY:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {sorted(SIMILARITY)}")
    similar = SIMILARITY[algorithm]
    a = members.select(*blocks, F.col("value").alias("value_a"), F.col("rep").alias("rep_a"), F.col("n").alias("n_a"))
    b = members.select(*blocks, F.col("value").alias("value_b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
    if dictionary or not blocks:
        pairs = similar(members.select("value"), "value", threshold)
        return pairs.join(a, "value_a").join(b, [*blocks, "value_b"])
    pairs = similar(members, "value", threshold, blocks)
    return pairs.join(a, [*blocks, "value_a"]).join(b, [*blocks, "value_b"])


def band_totals(members: DataFrame, pairs: DataFrame, blocks: list[str], auto: float, review: float) -> DataFrame:
    """``band, n`` over all record pairs of all blocks, from counts.

    Equal values merge, pairs of similar values fall by their score, and whatever else shares a
    block is no match. So ``pairs`` needs to reach down to ``review`` only, and the counts add up to the
    candidates of ``pair_metrics``.
    """
    def choose2(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("bigint")

    per_block = members.groupBy(*blocks).agg(F.sum("n").alias("size"), F.sum(choose2(F.col("n"))).alias("same"))
    totals = per_block.agg(F.coalesce(F.sum(choose2(F.col("size"))), F.lit(0)).alias("candidates"),
                           F.coalesce(F.sum("same"), F.lit(0)).alias("same"))
    weight = F.col("n_a") * F.col("n_b")
    scored = pairs.agg(F.coalesce(F.sum(F.when(F.col("score") >= auto, weight)), F.lit(0)).alias("auto"),
                       F.coalesce(F.sum(F.when((F.col("score") < auto) & (F.col("score") >= review), weight)),
                                  F.lit(0)).alias("review"))
    both = totals.withColumn("_x", scored.select(F.struct("auto", "review")).scalar()).select("*", "_x.*")
    merged = F.col("same") + F.col("auto")
    return both.select(F.inline(F.array(
        F.struct(F.lit("AUTO_MERGE").alias("band"), merged.cast("bigint").alias("n")),
        F.struct(F.lit("REVIEW").alias("band"), F.col("review").cast("bigint").alias("n")),
        F.struct(F.lit("NO_MATCH").alias("band"), (F.col("candidates") - merged - F.col("review")).cast("bigint").alias("n")))))


def pair_metrics(members: DataFrame, pairs: DataFrame, blocks: list[str]) -> DataFrame:
    """Candidates, reduction by blocking, resolved record pairs and their average score.

    Record pairs are counted from value counts: ``n·(n−1)/2`` per value and ``n_a·n_b`` per
    pair of similar values.
    """
    def choose2(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("bigint")

    per_block = members.groupBy(*blocks).agg(F.sum("n").alias("size"), F.sum(choose2(F.col("n"))).alias("same"))
    totals = per_block.agg(F.sum("size").alias("records"), F.sum(choose2(F.col("size"))).alias("candidates"),
                           F.sum("same").alias("same"))
    cross = pairs.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("cross"),
                      F.coalesce(F.sum(F.col("n_a") * F.col("n_b") * F.col("score").cast("decimal(10,6)")),
                                 F.lit(0)).alias("score_sum"))
    both = totals.withColumn("_x", cross.select(F.struct("cross", "score_sum")).scalar()).select("*", "_x.*")
    resolved = F.col("same") + F.col("cross")
    possible = F.nullif(choose2(F.col("records")), F.lit(0))
    return both.select("records", "candidates", (1 - F.col("candidates") / possible).alias("reduction"),
                       resolved.alias("resolved_pairs"),
                       ((F.col("same") + F.col("score_sum")).cast("double") / F.nullif(resolved, F.lit(0)))
                       .alias("average_similarity"))
