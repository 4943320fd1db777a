"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt by norm into bands, each a power of two wide, and a band's vectors into shards of bounded size. So the
norms in a shard differ by a factor of two at most: scaled by the largest one they are safe in single precision whatever
their size, and a coordinate more makes them equal, so that the graph is one of true distances.

A task builds its shard's graph and stores it as flat arrays: for each layer its nodes and a matrix of neighbour places, -1
where there are fewer. As a shard is bounded, the candidates of a node's links come from blocks of exact inner products
instead of a search for each insertion; links are chosen by the usual rule of diversity, in both directions and of bounded
degree. Equal vectors of a shard are one node with a list of ids. Queries go to every shard in blocks, and a block's
queries walk the graph together; shards return their best, and these are merged. Scores and order are those of the original
vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx.llm.common import stage

#: Vectors of a shard, neighbours of a node (twice as many in the lowest layer) and candidates for them.
SHARD_VECTORS = 8192
NEIGHBOURS = 24
CANDIDATES = 96
#: Widths of the search in the lowest layer and in those above, and nodes of a query whose links are followed at a time.
SEARCH_WIDTH = 128
UPPER_WIDTH = 16
AHEAD = 8
#: Queries of a row that travels, and rows that meet one shard in one task; more queries meet another copy of the shard.
QUERY_BLOCK = 256
GROUP_BLOCKS = 4
#: Rows of a matrix that are worked on at a time.
STEP = 256


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector array<double>: not null, not zero, and without null or non-finite components, of a row with an id."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda x: x != 0))


class Graph:
    """The layers of one shard, the lowest first: nodes of each layer, and their neighbours as rows of a matrix."""

    def __init__(self, data: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int) -> None:
        self.data, self.layers, self.entry = data, layers, entry

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Of each query the `width` best nodes found by inner product, a row each, -1 where there are fewer."""
        found = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            nodes, matrix = self.layers[layer]
            place = np.full(len(self.data), -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            found = walk(self.data, place, matrix, queries, found, UPPER_WIDTH if layer else width)
        return found


def walk(data: np.ndarray, place: np.ndarray, matrix: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """Best-first search of one layer for all queries at once: the `width` best nodes of each, best first, -1 for none.

    Each round follows the links of the AHEAD best nodes of a query that were not followed yet, until none is left among
    its `width` best. place: of each node its row in matrix.
    """
    n, size = len(queries), len(data)
    rows = np.arange(n)
    best = np.full((n, width), -1, np.int32)
    score = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros(n * size, bool)
    mark = np.empty(n * size, np.int32)

    def add(r: np.ndarray, node: np.ndarray) -> None:
        """Nodes (of row r in order) that are new to their query take their places among its best."""
        nonlocal best, score, done
        key = r * size + node
        new = ~seen[key]
        key, r, node = key[new], r[new], node[new]
        mark[key] = np.arange(len(key))
        new = mark[key] == np.arange(len(key))  # one of those that two followed nodes link
        key, r, node = key[new], r[new], node[new]
        seen[key] = True
        s = np.einsum("ij,ij->i", data[node], queries[r])
        good = s > score[r, -1]
        r, node, s = r[good], node[good], s[good]
        if not len(r):
            return
        counts = np.bincount(r, minlength=n)
        at = width + np.arange(len(r)) - (np.cumsum(counts) - counts)[r]
        more = int(counts.max())

        def widened(held: np.ndarray, empty: float, values: np.ndarray | bool) -> np.ndarray:
            out = np.full((n, width + more), empty, held.dtype)
            out[:, :width] = held
            out[r, at] = values
            return out

        all_scores = widened(score, -np.inf, s)
        order = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
        score = np.take_along_axis(all_scores, order, 1)
        best = np.take_along_axis(widened(best, -1, node), order, 1)
        done = np.take_along_axis(widened(done, True, False), order, 1)

    given = entries >= 0
    add(np.nonzero(given)[0], entries[given])
    while True:
        ahead = ~done
        ahead &= np.cumsum(ahead, axis=1) <= AHEAD
        r, c = np.nonzero(ahead)
        if not len(r):
            return best
        done[ahead] = True
        near = matrix[place[best[r, c]]]
        r = np.repeat(r, near.shape[1])
        near = near.ravel()
        add(r[near >= 0], near[near >= 0])


def nearest_rows(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k others with the largest inner products, best first, and these."""
    n = len(data)
    rows, scores = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for s in range(0, n, STEP):
        part = data[s : s + STEP] @ data.T
        part[np.arange(len(part)), np.arange(s, s + len(part))] = -np.inf
        best = np.argpartition(part, n - k, axis=1)[:, n - k :]
        value = np.take_along_axis(part, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        rows[s : s + STEP], scores[s : s + STEP] = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
    return rows, scores


def diverse(data: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` candidates of each row, -1 for none: best first those nearer to the row's node than to any taken before,
    then the others. Candidates come best first, with -1 behind."""
    n, k = candidates.shape
    most = min(most, k)
    out = np.empty((n, most), np.int32)
    for s in range(0, n, STEP):
        near, own = candidates[s : s + STEP], scores[s : s + STEP]
        vectors = data[near]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(near.shape, bool)
        worst = np.full(near.shape, -np.inf, np.float32)
        count = np.zeros(len(near), np.int64)
        for i in range(k):
            takes = (worst[:, i] < own[:, i]) & (count < most) & (near[:, i] >= 0)
            taken[takes, i] = True
            count += takes
            worst[takes] = np.maximum(worst[takes], between[takes, i])
        rank = np.arange(k) + np.where(taken, 0, k) + np.where(near >= 0, 0, 2 * k)
        out[s : s + STEP] = np.take_along_axis(near, np.argsort(rank, axis=1)[:, :most], 1)
    return out


def _both_ways(data: np.ndarray, links: np.ndarray, most: int) -> np.ndarray:
    """The links and their reverses, `most` of each node by diversity."""
    n = len(data)
    source = np.repeat(np.arange(n), links.shape[1])
    target = links.ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    pairs = np.unique(np.concatenate((source * n + target, target * n + source)))
    source, target = pairs // n, pairs % n
    score = np.concatenate([np.einsum("ij,ij->i", data[source[s : s + (1 << 16)]], data[target[s : s + (1 << 16)]]) for s in range(0, len(pairs), 1 << 16)] or [np.empty(0)])
    order = np.lexsort((target, -score, source))
    source, target, score = source[order], target[order], score[order]
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    near = rank < 2 * CANDIDATES
    width = int(rank[near].max(initial=-1)) + 1
    candidates, scores = np.full((n, max(1, width)), -1, np.int32), np.full((n, max(1, width)), -np.inf, np.float32)
    candidates[source[near], rank[near]], scores[source[near], rank[near]] = target[near], score[near]
    return diverse(data, candidates, scores, most)


def centred(data: np.ndarray) -> np.ndarray:
    """The rows without their mean, the longest of length 1.

    The mean adds the same to all inner products of a query, so their order stays; in single precision, rows that differ in
    their last digits only would be one and the same with it.
    """
    scaled = data / np.abs(data).max()
    scaled = scaled - scaled.mean(axis=0)
    scaled = scaled / (np.abs(scaled).max() or 1.0)
    return scaled / (np.sqrt(np.einsum("ij,ij->i", scaled, scaled)).max() or 1.0)


def build_graph(data: np.ndarray, neighbours: int = NEIGHBOURS, seed: int = 11) -> Graph:
    """The graph of the rows of data, whose norms differ by a factor of two at most. Levels are drawn from a fixed seed, so a
    retry builds the same graph."""
    n = len(data)
    scaled = centred(data)
    beside = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    lifted = np.column_stack((scaled, beside)).astype(np.float32)
    scaled = scaled.astype(np.float32)
    levels = (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(neighbours)).astype(int)
    layers = []
    for level in range(int(levels.max()) + 1):
        nodes = np.flatnonzero(levels >= level)
        own = lifted[nodes]
        k = min(CANDIDATES, len(nodes) - 1)
        found = np.full((len(nodes), 1), -1, np.int32)
        if k:
            found = _both_ways(own, diverse(own, *nearest_rows(own, k), neighbours), neighbours if level else 2 * neighbours)
        layers.append((nodes.astype(np.int32), np.where(found >= 0, nodes[found], -1).astype(np.int32)))
    return Graph(scaled, layers, int(levels.argmax()))


def _distinct(ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of their smallest id; all ids by row; where each row's ids begin."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    _, first, inverse = np.unique(data, axis=0, return_index=True, return_inverse=True)
    by_first = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[by_first] = np.arange(len(first))
    row = rank[inverse.ravel()]
    by_row = np.argsort(row, kind="stable")
    return data[first[by_first]], ids[by_row], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(first)))))


def with_bands(vectors: DataFrame) -> DataFrame:
    """vectors (id, vector) with dim, and band: the power of two at or below the norm, for components of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            offsets = lists.offsets.to_numpy()
            sizes, starts, flat = np.diff(offsets), offsets[:-1] - offsets[0], lists.flatten().to_numpy()
            largest = np.maximum.reduceat(np.abs(flat), starts) if len(sizes) else np.empty(0)
            scaled = flat / np.repeat(largest, sizes)
            squares = np.add.reduceat(scaled * scaled, starts) if len(sizes) else np.empty(0)
            band = np.floor(np.log2(largest) + np.log2(squares) / 2)
            columns = [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(band.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "dim", "band"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector array<double>, dim int, band int")


def build_index(vectors: DataFrame, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """vectors: id, vector (usable()). A row per shard: dim, band, part, data, ids, starts, entry, layers."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        data = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        data, ids, starts = _distinct(ids, data)
        graph = build_graph(data)
        layers = [{"nodes": a.astype("<i4").tobytes(), "neighbours": b.astype("<i4").tobytes()} for a, b in graph.layers]
        row = {c: table.column(c)[0].as_py() for c in ("dim", "band", "part")}
        row |= {
            "data": data.astype("<f8").tobytes(),
            "ids": ids.astype("<i8").tobytes(),
            "starts": starts.astype("<i8").tobytes(),
            "entry": graph.entry,
            "layers": layers,
        }
        kind = pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary())])
        keys = [("dim", pa.int32()), ("band", pa.int32()), ("part", pa.int32())]
        schema = pa.schema([*keys, ("data", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("entry", pa.int64()), ("layers", pa.list_(kind))])
        return pa.Table.from_pylist([row], schema)

    dealt = with_bands(vectors)
    # a double has some 2,100 powers of two, so this table stays small
    sizes = dealt.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_vectors).cast("int").alias("parts"))
    dealt = dealt.join(sizes, ["dim", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    schema = "dim int, band int, part int, data binary, ids binary, starts binary, entry long, layers array<struct<nodes:binary,neighbours:binary>>"
    return dealt.select("id", "vector", "dim", "band", "part").groupBy("dim", "band", "part").applyInArrow(build, schema)


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"])
    layers = []
    for x in row["layers"]:
        nodes = np.frombuffer(x["nodes"], "<i4")
        layers.append((nodes, np.frombuffer(x["neighbours"], "<i4").reshape(len(nodes), -1)))
    return Graph(centred(data).astype(np.float32), layers, row["entry"]), data, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")


def _best(scores: np.ndarray, nodes: np.ndarray, ids: np.ndarray, starts: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of the nodes' ids but the query's own, ties to the smaller id."""
    found: list[tuple[float, int]] = []
    for i in np.argsort(-scores, kind="stable").tolist():
        if len(found) > k and -scores[i] > found[k][0]:
            break
        found += [(-scores[i], v) for v in ids[starts[nodes[i]] : starts[nodes[i] + 1]][: k + 1].tolist() if v != own]
        found.sort()
    return [(-float(s), v) for s, v in found[:k]]


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, itself (by id) left out.

    queries: id, vector. Nearest first, ties to the smaller id. Queries and vectors of different dimension do not meet.
    """
    n_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    groups = math.ceil(n_blocks / GROUP_BLOCKS)
    blocks = queries.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("qs"))
    blocks = blocks.withColumn("copy", F.pmod("block", F.lit(groups)).cast("int"))
    shards = index.select(*(F.col(c).alias(c) for c in ("dim", "band", "part")))
    blocks = blocks.join(shards, "dim")
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meet = ["dim", "band", "part", "copy"]

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for row in table.to_pylist():
            graph, data, ids, starts = _load(row)
            for block in asked.column("qs"):
                asking = block.values.field("id").to_pylist()
                vectors = block.values.field("vector").flatten().to_numpy().reshape(len(asking), -1)
                scaled = (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float32)
                for q, vector, nodes in zip(asking, vectors, graph.search(scaled, width)):
                    nodes = nodes[nodes >= 0]
                    best = _best(data[nodes] @ vector, nodes, ids, starts, q, k)
                    out[0].extend([q] * len(best))
                    out[1].extend(v for _, v in best)
                    out[2].extend(s for s, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = index.groupBy(*meet).cogroup(blocks.groupBy(*meet)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, query_filter: str, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20) -> DataFrame:
    """The k nearest found of every row that query_filter (on `id`) selects, against all rows but itself.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite components take no part. Of rows that
    share an id all are candidates, and the result lists that id once for each; an empty table gives no rows.
    """
    rows = usable(vectors, id_column, vector_column)
    index = stage(build_index(rows), "hnsw")
    return search_index(index, rows.where(query_filter), k)
