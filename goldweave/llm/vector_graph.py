"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards and searched shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.common import connected_components
from goldweave.llm.simhash_bk import _union as union_into
from goldweave.llm.vector_codes import finite_vectors
from goldweave.session import discard, materialise

#: Members of a shard at most; a larger one is divided again.
SHARD_ROWS = 2048
#: Pivots a shard is divided by at most, and members that meet them in one task at a time.
_FAN, _BLOCK = 64, 8192
#: Neighbours a node keeps per shard, candidates it chooses them from (nearest and random ones), slack of the pruning.
DEGREE, _NEAREST, _RANDOM, _ALPHA = 32, 64, 32, 1.2
#: Queries searched side by side and pairs they can find at most, nodes each opens at a time, and how far below the threshold a node is still expanded.
_CHUNK, _PAIRS, _STEP, _SLACK = 1024, 1 << 22, 4, 0.05
#: Draws of pivots to begin with: near vectors that no shard of one draw holds together meet in another's.
_DRAWS = 2
#: Classes whose links are counted by brute force to measure the recall.
AUDITED = 512

_GROUP = ["shard", "label", "dims"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)  # no square over- or underflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], first_role_only: bool = False) -> Iterator[tuple[tuple, list[pa.RecordBatch], bool]]:
    """Runs of rows of one shard: its key, the rows and whether they are the last ones of it.

    With ``first_role_only`` the rows of roles 0 and 1 come together, then those of role 2 batch by batch.
    """
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*_GROUP, "role"] if first_role_only else _GROUP
        columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        if first_role_only:
            columns[-1] = columns[-1] // 2
        rows = np.column_stack(columns)
        cuts = [0, *(np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        for low, high in zip(cuts, cuts[1:]):
            now = tuple(rows[low].tolist())
            if now != key:
                if held:
                    yield key, held, True
                key, held = now, []
            held.append(batch.slice(low, high - low))
            if first_role_only and now[-1] == 1:
                yield key, held, False
                held = []
    if held:
        yield key, held, True


# --- shards -----------------------------------------------------------------------------------------------------------

def _divided(rows: DataFrame, sizes: DataFrame, shard_rows: int, turn: int) -> DataFrame:
    """Every row of a large shard in the cells of its nearest pivots: two for a home row, one for a copy.

    Pivots are rows picked by a hash, as many as the size asks for. Shards are cut into blocks, so that no task
    holds a whole one; the pivots go to every block.
    """
    n = F.col("n")
    wanted = F.least(F.lit(_FAN), F.ceil(n * 4 / shard_rows))
    plan = sizes.select(*_GROUP, wanted.alias("wanted"), n.alias("n"), F.ceil(n / _BLOCK).cast("int").alias("blocks"))
    sized = rows.join(plan, _GROUP)
    draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    pivots = (sized.filter(F.col("home") & (draw < F.col("wanted") / n))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    columns = [*_GROUP, "block", "role", "node", "home", "vector"]
    both = pivots.withColumn("role", F.lit(0)).select(columns).unionByName(blocked.withColumn("role", F.lit(1)).select(columns))
    keys = [*_GROUP, "block"]
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.empty((0, 0))
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "role"]])
            cuts = [0, *(np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1).tolist(), len(rows)] if len(rows) else []
            for low, high in zip(cuts, cuts[1:]):
                some, now = batch.slice(low, high - low), tuple(rows[low, :4].tolist())
                unit = _units(_matrix(some.column("vector"), now[2]))
                if now != key:
                    key, pivot = now, np.empty((0, now[2]))
                if rows[low, 4] == 0:
                    pivot = np.vstack([pivot, unit])
                    continue
                node, home = (some.column(c).to_numpy(zero_copy_only=False) for c in ("node", "home"))
                yield from _cells(some, node, home, unit, pivot)

    return dealt.mapInArrow(run, "label long, dims int, node long, vector array<double>, home boolean, shard long, cell int").select(
        F.xxhash64("shard", "cell", F.lit(turn)).alias("shard"), "label", "dims", "node", "home", "vector")


def _cells(some: pa.RecordBatch, node: np.ndarray, home: np.ndarray, unit: np.ndarray, pivot: np.ndarray) -> Iterator[pa.RecordBatch]:
    near = np.zeros((len(node), max(len(pivot), 1)))
    if len(pivot):
        near = unit @ pivot.T
    # vectors of one direction are as near to all pivots; a hash of node and pivot keeps them divisible
    mixed = (node.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (
        np.arange(near.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    near += ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(float) * (1e-9 / (1 << 24))
    best = np.argsort(-near, axis=1, kind="stable")[:, :2]
    for k in range(best.shape[1]):
        keep = np.ones(len(node), bool) if k == 0 else home
        own = some.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [own.column("label"), own.column("dims"), own.column("node"), own.column("vector"),
             pa.array(home[keep] & (k == 0)), own.column("shard"), pa.array(best[keep, k], pa.int32())],
            names=["label", "dims", "node", "vector", "home", "shard", "cell"])


def overlapping_shards(nodes: DataFrame, shard_rows: int = SHARD_ROWS, rounds: int = 40, draw: int = 0) -> DataFrame:
    """``shard, label, dims, node, home, vector``: every node in its home shard and copies of it in neighbouring ones.

    A shard above ``shard_rows`` is divided by pivots until none is left; each division adds at most one copy of
    a node. The loop raises after ``rounds`` divisions, it never keeps a large shard. Another ``draw`` divides what is
    above ``shard_rows`` by other pivots; homes are those of the first draw.
    """
    whole = F.xxhash64("label", "dims", *[F.lit(draw)] * (draw > 0))
    rows = nodes.select(whole.alias("shard"), "label", "dims", "node", F.lit(True).alias("home"), "vector")
    done = None
    for turn in range(draw * rounds, (draw + 1) * rounds):
        sizes, seen = materialise(rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows), "near-sizes")
        again = draw and done is None  # what the first draw left whole
        if not seen["rows"]:
            out = rows.limit(0) if again else rows if done is None else done.unionByName(rows)
            return out.withColumn("home", F.lit(False)) if draw else out
        small = rows.limit(0) if again else rows.join(sizes, _GROUP, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows, _ = materialise(_divided(rows, sizes, shard_rows, turn), "near-shards")
    raise RuntimeError(f"shards did not get below {shard_rows} rows within {rounds} divisions")


# --- graph ------------------------------------------------------------------------------------------------------------

def _pruned(far: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each row's pool, nearest first, a candidate stays unless one that stays is nearer to it.

    ``far`` holds the distances, ``own`` the node of every row, ``pool`` its candidates (-1: none). The nearest
    candidate left is chosen and removes all those that lie ``_ALPHA`` times nearer to it than to the node.
    """
    rows = np.arange(len(pool))
    away = np.where(pool >= 0, far[own[:, None], pool], np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    pool, away = np.take_along_axis(pool, order, 1), np.take_along_axis(away, order, 1)
    alive = (pool >= 0) & (pool != own[:, None])
    kept = np.full((len(pool), degree), -1, np.int64)
    for k in range(degree):
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        chosen = pool[rows, first]
        kept[has, k] = chosen[has]
        alive &= (_ALPHA * far[chosen[:, None], pool] > away) | ~has[:, None]
        alive[rows, first] = False
    return kept


def robust_graph(unit: np.ndarray, degree: int = DEGREE, seed: int = 0) -> np.ndarray:
    """Neighbours of every node of one shard, ``degree`` at most, -1 where there are fewer; links go both ways first."""
    n = len(unit)
    own = np.arange(n)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    far = np.sqrt(np.maximum(2 - 2 * (unit @ unit.T), 0))
    far[own, own] = np.inf
    near = min(_NEAREST, n - 1)
    pool = np.argpartition(far, near - 1, axis=1)[:, :near]
    far[own, own] = 0
    some = np.random.default_rng(seed).integers(0, n, (n, min(_RANDOM, n)))
    some = np.where((some[:, :, None] == pool[:, None, :]).any(axis=2), -1, some)
    some.sort(axis=1)
    some[:, 1:][some[:, 1:] == some[:, :-1]] = -1
    kept = _pruned(far, own, np.hstack([pool, some]), degree)
    # links back: a node's candidates are its neighbours and those that chose it, the nearest 2 * degree of them
    a, b = np.repeat(own, kept.shape[1]), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = np.divmod(pairs, n)
    order = np.lexsort((far[a, b], a))
    a, b = a[order], b[order]
    count = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    pool = np.full((n, 2 * degree), -1, np.int64)
    fits = place < 2 * degree
    pool[a[fits], place[fits]] = b[fits]
    over = np.flatnonzero(count > degree)
    out = np.full((n, degree), -1, np.int64)
    out[count <= degree] = pool[count <= degree, :degree]
    if len(over):
        out[over] = _pruned(far, over, pool[over], degree)
    return out


def _adjacency(shards: DataFrame, degree: int, least: float) -> DataFrame:
    """``node, shard, home, medoid, neighbours, close`` of every member of every shard; the close ones of the neighbours
    have a cosine of ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held, _ in _groups(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column("node").to_numpy()
            unit = _units(_matrix(table.column("vector").combine_chunks(), key[2])).astype(np.float32)
            links = robust_graph(unit, degree)
            medoid = np.zeros(len(node), bool)
            medoid[(unit @ unit.mean(axis=0)).argmax()] = True
            there = links >= 0
            close = there & (np.einsum("ij,ikj->ik", unit, unit[links]) >= np.float32(least))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]), pa.int32()), pa.array(node[links[some]]))
                     for some in (there, close)]
            yield pa.RecordBatch.from_arrays(
                [table.column("node").combine_chunks(), table.column("shard").combine_chunks(), table.column("home").combine_chunks(),
                 pa.array(medoid), *lists], names=["node", "shard", "home", "medoid", "neighbours", "close"])

    dealt = shards.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    return dealt.mapInArrow(run, "node long, shard long, home boolean, medoid boolean, neighbours array<long>, close array<long>")


def united_graph(nodes: DataFrame, shards: DataFrame, degree: int = DEGREE, least: float = -2.0) -> DataFrame:
    """The searchable graph, dealt by home shard: ``shard, label, dims, role, node, home_shard, medoid, size, vector, neighbours``.

    A node's list unites its lists in all shards that hold it. Rows of role 0 are the nodes at home in the
    shard; rows of role 1 are neighbours of those that are at home elsewhere, with the nodes here that chose them before
    their own list. Only neighbours with a cosine of ``least`` are among them: where pruning drops a link, it keeps
    a nearer node that is nearer to its other end as well.
    """
    lists, _ = materialise(_adjacency(shards, degree, least), "near-lists")
    home = F.when(F.col("home"), F.col("shard"))
    graph = lists.groupBy("node").agg(F.max(home).alias("shard"), F.max(F.col("home") & F.col("medoid")).alias("medoid"),
                                      *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("neighbours", "close")])
    graph, _ = materialise(graph, "near-graph")
    homes = graph.select("node", F.col("shard").alias("home_shard"))
    beyond = (graph.select("shard", F.col("node").alias("by"), F.explode("close").alias("node")).join(homes, "node").filter("shard <> home_shard")
              .groupBy("shard", "node", "home_shard").agg(F.collect_list("by").alias("back")).join(graph.select("node", "neighbours"), "node"))
    columns = ["shard", "label", "dims", "role", "node", "home_shard", "medoid", "size", "vector", "neighbours"]
    at_home = graph.withColumns({"home_shard": F.col("shard"), "role": F.lit(0)}).join(nodes, "node").select(columns)
    both_ways = F.array_distinct(F.concat("back", "neighbours"))
    fringe = beyond.withColumns({"role": F.lit(1), "medoid": F.lit(False), "neighbours": both_ways}).join(nodes, "node").select(columns)
    out, _ = materialise(at_home.unionByName(fringe), "near-searchable")
    discard(lists)
    return out


# --- search -----------------------------------------------------------------------------------------------------------

class _Shard:
    """The part of the graph that one shard's searches walk on."""

    def __init__(self, held: list[pa.RecordBatch], dims: int):
        table = pa.Table.from_batches(held).combine_chunks()
        get = lambda c: table.column(c).combine_chunks()
        self.node, self.home, self.size, self.at_home = (get(c).to_numpy(zero_copy_only=False) for c in ("node", "home_shard", "size", "role"))
        self.at_home = self.at_home == 0
        self.exact = _units(_matrix(get("vector"), dims))
        self.unit = self.exact.astype(np.float32)
        order = np.argsort(self.node)
        self.order, self.sorted = order, self.node[order]
        lists = get("neighbours")
        flat = self.places(lists.flatten().to_numpy())
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        row, flat = row[flat >= 0], flat[flat >= 0]
        # all links by their ends; as a matrix, lists of the fringe go as far as the others do
        order = np.argsort(flat, kind="stable")
        self.link_from, self.link_to = row[order], flat[order]
        many = np.bincount(row, minlength=len(lists))
        place = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        self.links = np.full((len(self.node), max(int(many[self.at_home].max(initial=0)), 1)), -1, np.int64)
        fits = place < self.links.shape[1]
        self.links[row[fits], place[fits]] = flat[fits]
        middle = np.flatnonzero(get("medoid").to_numpy(zero_copy_only=False).astype(bool))
        inner = np.flatnonzero(self.at_home)
        self.sent: dict[int, np.ndarray] = {}  # nodes that were sent to a home
        self.chunk = max(min(_CHUNK, _PAIRS // len(self.node)), 64)
        self.start = int(middle[0] if len(middle) else inner[(self.unit[inner] @ self.unit[inner].mean(axis=0)).argmax()])

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Positions of nodes here; -1 for nodes that are not."""
        at = np.minimum(np.searchsorted(self.sorted, nodes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == nodes, self.order[at], -1)


def range_search(shard: _Shard, query: np.ndarray, entries: tuple[np.ndarray, np.ndarray], threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, place)`` of the nodes met whose similarity is near the threshold or above.

    Greedy from the medoid and the first of a query's ``entries`` (pairs of query and place: its own one or links of
    it): the best nodes of the beam are opened until all of them are. Then the range expands, from all entries too:
    every node met within the slack is opened, until no new one comes.
    """
    m, n = len(query), len(shard.node)
    seen, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
    beam_at, beam_sim = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
    rows, entry = np.arange(m), np.full(m, -1)
    entry[entries[0][::-1]] = entries[1][::-1]
    seen[entries] = True
    for k, start in enumerate((np.full(m, shard.start), np.where(entry == shard.start, -1, entry))):
        known = start >= 0
        beam_at[known, k] = start[known]
        beam_sim[known, k] = np.einsum("ij,ij->i", query[known], shard.unit[start[known]])
        seen[rows[known], start[known]] = True
    found_q, found_x = [rows, entries[0]], [np.full(m, shard.start), entries[1]]
    low = np.float32(threshold - _SLACK)
    live = rows
    while len(live):
        at, sim = beam_at[live], beam_sim[live]
        closed = (at < 0) | opened[live[:, None], at]
        rank = np.where(closed, -np.inf, sim)
        best = np.argpartition(-rank, min(_STEP, beam) - 1, axis=1)[:, :_STEP]
        open_now = np.take_along_axis(rank, best, 1) > -np.inf
        going = open_now.any(axis=1)
        live, best, open_now, at, sim = live[going], best[going], open_now[going], at[going], sim[going]
        if not len(live):
            break
        node = np.take_along_axis(at, best, 1)
        q = np.broadcast_to(live[:, None], node.shape)[open_now]
        opened[q, node[open_now]] = True
        more = np.where(open_now[:, :, None], shard.links[node], -1).reshape(len(live), -1)
        more.sort(axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
        more[(more >= 0) & seen[live[:, None], more]] = -1
        i, j = np.nonzero(more >= 0)
        x = more[i, j]
        got = np.full(more.shape, -np.inf, np.float32)
        got[i, j] = np.einsum("ij,ij->i", query[live[i]], shard.unit[x])
        seen[live[i], x] = True
        within = got[i, j] >= low
        found_q.append(live[i[within]])
        found_x.append(x[within])
        all_at, all_sim = np.hstack([at, more]), np.hstack([sim, got])
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        beam_at[live], beam_sim[live] = np.take_along_axis(all_at, top, 1), np.take_along_axis(all_sim, top, 1)
    q, x = np.concatenate(found_q), np.concatenate(found_x)
    inside = np.einsum("ij,ij->i", query[q], shard.unit[x]) >= low
    # the range of all queries side by side: a row of bits for each node, one bit a query; links are followed once for all
    hit = np.zeros((n, -(-m // 64) * 64), bool)
    hit[x[inside], q[inside]] = True
    fresh = np.packbits(hit, axis=1).view(np.uint64)
    hit[:, :m] = seen.T
    met, reached = np.packbits(hit, axis=1).view(np.uint64), fresh.copy()
    while True:
        open_now = np.flatnonzero(fresh.any(axis=1)[shard.link_from])
        if not len(open_now):
            break
        after = np.zeros_like(fresh)
        ends = np.append(np.flatnonzero(np.diff(shard.link_to[open_now])), len(open_now) - 1)  # the last link to each node
        cuts = [0, *(np.flatnonzero(np.diff((ends + 1) >> 16)) + 1).tolist(), len(ends)]
        for k, end in zip(cuts, cuts[1:]):  # bounds the memory a dense group takes
            low_end = int(ends[k - 1]) + 1 if k else 0
            links = open_now[low_end:int(ends[end - 1]) + 1]
            firsts = np.concatenate([[0], ends[k:end - 1] + 1 - low_end])
            to = shard.link_to[links[firsts]]
            new = np.bitwise_or.reduceat(fresh[shard.link_from[links]], firsts, axis=0) & ~met[to]
            some = new.any(axis=1)
            to, new = to[some], new[some]
            met[to] |= new
            near = np.zeros((len(to), hit.shape[1]), bool)
            near[:, :m] = shard.unit[to] @ query.T >= low
            after[to] = new & np.packbits(near, axis=1).view(np.uint64)
        fresh = after
        reached |= fresh
    return np.nonzero(np.ascontiguousarray(np.unpackbits(reached.view(np.uint8), axis=1).T))


def _searched(base: DataFrame, queries: DataFrame | None, threshold: float, beam: int) -> DataFrame:
    """``kind, a, b, shard, n`` of one round of searches.

    Kind 0: query ``a`` has links to ``n`` rows at home in ``shard``. Kind 1: ``a`` and ``b`` are connected.
    Kind 2: node ``a`` is to be searched in ``shard``, entering at ``b``. Without ``queries`` every node is
    searched at home, entering at itself. Links themselves are counted, not written: a group of k near copies costs k rows.
    """
    all_at_home = queries is None
    if queries is not None:
        none = {"medoid": F.lit(False), "size": F.lit(0).cast("long"), "role": F.lit(2)}
        asked = queries.withColumns(none).withColumnRenamed("entries", "neighbours")
        base = base.join(queries.select(*_GROUP).distinct(), _GROUP, "left_semi").unionByName(asked.select(base.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, None
        for key, held, _ in _groups(batches, first_role_only=True):
            if key[3] == 0:
                shard, of = _Shard(held, key[2]), key[:3]
                if all_at_home:
                    inner = np.flatnonzero(shard.at_home)
                    for k in range(0, len(inner), shard.chunk):
                        own = inner[k:k + shard.chunk]
                        yield from _links(shard, key[0], shard.node[own], shard.home[own], shard.exact[own], (np.arange(len(own)), own), threshold, beam)
            elif of == key[:3]:
                for batch in held:
                    for k in range(0, batch.num_rows, shard.chunk):
                        some = batch.slice(k, shard.chunk)
                        node, home = (some.column(c).to_numpy() for c in ("node", "home_shard"))
                        entry = shard.places(some.column("neighbours").flatten().to_numpy())
                        of_query = np.repeat(np.arange(len(node)), pc.list_value_length(some.column("neighbours")).to_numpy())
                        entries = of_query[entry >= 0], entry[entry >= 0]
                        yield from _links(shard, key[0], node, home, _units(_matrix(some.column("vector"), key[2])), entries, threshold, beam)

    dealt = base.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "role", "node")
    return dealt.mapInArrow(run, "kind int, a long, b long, shard long, n long")


def _links(shard: _Shard, own: int, node: np.ndarray, home: np.ndarray, exact: np.ndarray, entries: tuple[np.ndarray, np.ndarray],
           threshold: float, beam: int) -> Iterator[pa.RecordBatch]:
    """What a chunk of queries finds in one shard, each pair verified in double precision."""
    q, x = range_search(shard, exact.astype(np.float32), entries, threshold, beam)
    keep = shard.node[x] != node[q]
    q, x = q[keep], x[keep]
    linked = _verified(exact, shard.exact, q, x, threshold)
    q, x = q[linked], x[linked]
    inside = shard.at_home[x]
    links = np.bincount(q[inside], weights=shard.size[x[inside]], minlength=len(node)).astype(np.int64)
    yield _said(0, node, node, np.full(len(node), own), links)
    # a spanning forest of the links: nodes here first, then the queries
    place = shard.places(node)
    number = np.where(place >= 0, place, len(shard.node) + np.arange(len(node)))
    names = np.concatenate([shard.node, node])
    label = np.arange(len(names))
    union_into(label, number[q], x)
    moved = np.flatnonzero(label != np.arange(len(label)))
    yield _said(1, names[moved], names[label[moved]], np.zeros(len(moved), np.int64), np.zeros(len(moved), np.int64))
    # links that cross shards send either end to the other's home, once a chunk or shard, by a link as the way in
    cross = shard.home[x] != home[q]
    q, x = q[cross], x[cross]
    (homes, to), (origins, of) = np.unique(shard.home, return_inverse=True), np.unique(home, return_inverse=True)
    at = np.full((len(node), len(homes)), -1)
    at[q, to[x]] = x
    a, b = np.nonzero(at >= 0)
    yield _said(2, node[a], shard.node[at[a, b]], homes[b], np.zeros(len(a), np.int64))
    at = np.full((len(origins), len(shard.node)), -1)
    at[of[q], x] = q
    for origin, row in zip(origins.tolist(), at):
        sent = shard.sent.setdefault(origin, np.zeros(len(shard.node), bool))
        a = np.flatnonzero((row >= 0) & ~sent)
        sent[a] = True
        yield _said(2, shard.node[a], node[row[a]], np.full(len(a), origin), np.zeros(len(a), np.int64))


def _verified(exact: np.ndarray, held: np.ndarray, q: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs, sorted by ``q``, reach the threshold; many pairs are taken from products of blocks, and where
    the order of a sum could matter, pair by pair."""
    near = np.full(len(q), threshold)
    for k in range(0, len(exact), 256):
        low, high = np.searchsorted(q, [k, k + 256])
        if (high - low) * 8 > min(256, len(exact) - k) * len(held):
            near[low:high] = (exact[k:k + 256] @ held.T)[q[low:high] - k, x[low:high]]
    for some in np.array_split(unsure := np.flatnonzero(np.abs(near - threshold) < 1e-9), len(unsure) // 65536 + 1):
        near[some] = np.einsum("ij,ij->i", exact[q[some]], held[x[some]])
    return near >= threshold


def _said(kind: int, a: np.ndarray, b: np.ndarray, shard: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(c, pa.int64()) for c in (a, b, shard, n))],
                                      names=["kind", "a", "b", "shard", "n"])


def search_all(nodes: DataFrame, graph: DataFrame, threshold: float, beam: int, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """``node, n_links`` of every node, and edges ``a, b`` that connect what links connect.

    Every node is searched at home first. Where it meets a node of another shard within the threshold, it is
    searched there too, entering at the nearest of those nodes of each search that met some, and that node is searched at the first one's home; until no
    search asks for a new one.
    """
    home = graph.filter("role = 0").select("node", F.col("shard").alias("home_shard"))
    found, _ = materialise(_searched(graph, None, threshold, beam), "near-found")
    everything, done = found, home.select("node", F.col("home_shard").alias("shard"))
    for _ in range(rounds):
        asked = found.filter("kind = 2").groupBy(F.col("a").alias("node"), "shard").agg(F.sort_array(F.collect_set("b")).alias("entries"))
        fresh, seen = materialise(asked.join(done, ["node", "shard"], "left_anti"), "near-asked")
        if not seen["rows"]:
            break
        queries = fresh.join(nodes.select("node", "label", "dims", "vector"), "node").join(home, "node")
        found, _ = materialise(_searched(graph, queries, threshold, beam), "near-found")
        everything, done = everything.unionByName(found), done.unionByName(fresh.select("node", "shard"))
    else:
        raise RuntimeError(f"the search did not settle within {rounds} rounds")
    links = everything.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return links, everything.filter("kind = 1").select("a", "b")


def measured_recall(nodes: DataFrame, links: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """The share of the links of some classes that was found; the classes are picked by a hash, ``audited`` at most.

    Their vectors are held against all classes, block by block.
    """
    picked = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(audited).select("node", "label", "dims", "vector").collect()
    by_kind: dict[tuple, list] = {}
    for r in picked:
        by_kind.setdefault((r.label, r.dims), []).append(r)
    sample = {k: (np.array([r.node for r in v]), _units(np.array([r.vector for r in v], float))) for k, v in by_kind.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            label, dims, node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dims", "node", "size"))
            for (one, width), (nodes_of, unit) in sample.items():
                mine = (label == one) & (dims == width)
                if mine.any():
                    own = _units(_matrix(batch.filter(pa.array(mine)).column("vector"), width))
                    hit = (own @ unit.T >= threshold) & (node[mine][:, None] != nodes_of[None, :])
                    for i, n in zip(nodes_of.tolist(), (hit * size[mine][:, None]).sum(axis=0).tolist()):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    exact = nodes.select("label", "dims", "node", "size", "vector").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    seen = exact.join(links, "node", "left").agg(F.sum(F.least("n", F.coalesce("n_links", F.lit(0)))).alias("found"), F.sum("n").alias("there")).first()
    return float(seen["found"]) / float(seen["there"]) if seen and seen["there"] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, least_recall: float = 0.99, id_column: str = "vec_id",
                    vector_column: str = "embedding", label_column: str = "label", shard_rows: int = SHARD_ROWS,
                    degree: int = DEGREE, beam: int = 32) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` per row of ``vectors``.

    Rows of equal label whose vectors have a cosine of at least ``threshold`` are linked; ``n_links`` counts the
    other rows linked with a row, ``component_id`` is the smallest id that links reach, the own one included,
    and ``kept`` marks the rows that have it. Equal vectors of a label are one class, so copies cost a count.
    Classes are cut into overlapping shards, a robust-pruned graph is built on each, the lists are united, and
    every class is searched greedily from its shard's medoid and itself with an expanding range, on into other shards
    where links lead there. Every link is verified. ``recall`` is measured against brute force on some
    classes; below ``least_recall`` the lists of shards by other pivots are added, which can hold the pairs that no
    shard had, the search is repeated with twice the beam, and raises in the end.

    A vector that is null, zero or empty, or holds a null or non-finite component, links with nothing, nor does
    one with a null label; vectors of different lengths are not compared. A null id stays null and is never
    the smallest unless there is no other. Repeated rows are rows of their own and link with each other;
    other columns are ignored; an empty table gives no rows.
    """
    whole = F.col(vector_column).cast("array<double>")
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("vector"))
    usable = finite_vectors(own, "vector").filter(F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0))
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
    nodes, _ = materialise(classes.withColumns({"node": F.monotonically_increasing_id(), "dims": F.size("vector")}), "near-nodes")
    # a class without a partner of its label and length needs no graph, but costs nothing in one
    shards, draws = overlapping_shards(nodes, shard_rows), 1
    for attempt in range(4):
        for draw in range(draws, draws := _DRAWS + attempt):
            shards = shards.unionByName(overlapping_shards(nodes, shard_rows, draw=draw))
        graph = united_graph(nodes, shards, degree, threshold - _SLACK)
        links, edges = search_all(nodes, graph, threshold, beam << attempt)
        recall = measured_recall(nodes, links, threshold)
        discard(graph)
        if recall >= least_recall:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} is below {least_recall}")
    parts = connected_components(edges)
    rooted = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of = (rooted.join(least, "component").join(links, "node", "left")
          .select("label", "vector", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"))
    alike = own.withColumn("found", F.lit(True)).join(of, ["label", "vector"], "left")
    component: Column = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return alike.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                        F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).alias("recall"))
