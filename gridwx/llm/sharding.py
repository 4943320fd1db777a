"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays whole. Every task differences a bounded chunk of groups: it keeps
partial partitions (one byte sum per shard), repeatedly takes the two with the largest spread and adds them in opposite
order. A chunk ends as one partial partition; the chunks' partitions are differenced again, level by level, until at most
`chunk_groups` remain for the last task. So no task sees more than a bounded number of groups, and the shards differ by
about the smallest sizes instead of the largest.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx.llm.common import stage

SHARDS = 16
#: Partial partitions that one task differences.
CHUNK_GROUPS = 20_000
#: Rows that one task numbers within a shard.
SLOT_ROWS = 50_000


def differencing(vectors: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition the shard of each of its parts.

    Two partitions are combined at a time, those with the largest spread first, the heavier parts of one with the lighter
    parts of the other. Ties go to the earlier partition.
    """
    nodes: list[tuple] = []
    heap = []
    for i, vector in enumerate(vectors):
        order = sorted(range(shards), key=lambda j: (-vector[j], j))
        sums = [vector[j] for j in order]
        nodes.append((order, None, None, None))
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(shards), key=lambda j: (-both[j], j))
        place = [0] * shards
        for rank, j in enumerate(order):
            place[j] = rank
        sums = [both[j] for j in order]
        nodes.append((None, a, b, place))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    out: list[list[int]] = [[] for _ in vectors]
    if not vectors:
        return out
    todo = [(heap[0][1], list(range(shards)))]
    while todo:
        at, final = todo.pop()
        order, a, b, place = nodes[at]
        if a is None:
            shard = [0] * shards
            for rank, j in enumerate(order):
                shard[j] = final[rank]
            out[at] = shard
        else:
            todo.append((a, [final[place[i]] for i in range(shards)]))
            todo.append((b, [final[place[shards - 1 - i]] for i in range(shards)]))
    return out


def _assign(items: DataFrame, shards: int, chunk_groups: int, level: int) -> DataFrame:
    """items: id, sums array<long>. Returns id, final array<int>: the shard of each of its parts."""
    n = items.count()
    chunks = max(1, math.ceil(n / chunk_groups))

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        final = differencing([list(map(int, v)) for v in pdf["sums"]], shards)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "sums": pdf["sums"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "part": final})

    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)) if chunks > 1 else F.lit(0).cast("long"))
    placed = dealt.groupBy("chunk").applyInPandas(difference, "id string, sums array<long>, chunk long, part array<int>")
    if chunks == 1:
        return placed.select("id", F.col("part").alias("final"))
    placed = stage(placed, f"shard-level{level}")
    parts = placed.select("chunk", F.explode(F.arrays_zip("part", "sums")).alias("p")).groupBy("chunk", "p.part").agg(F.sum("p.sums").alias("bytes"))
    above = parts.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "bytes"))), lambda p: p["bytes"]).alias("sums"))
    above = _assign(above.select(F.col("chunk").cast("string").alias("id"), "sums"), shards, chunk_groups, level + 1)
    above = above.select(F.col("id").cast("long").alias("chunk"), F.col("final").alias("moved"))
    return placed.join(above, "chunk").select("id", F.transform("part", lambda p: F.get("moved", p)).alias("final"))


def balance_groups(groups: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS) -> DataFrame:
    """groups: id string (unique), bytes long. Returns id, shard int."""
    first = [F.col("bytes").cast("long")] + [F.lit(0).cast("long")] * (shards - 1)
    items = groups.select("id", F.array(*first).alias("sums"))
    return _assign(items, shards, chunk_groups, 0).select("id", F.get("final", F.lit(0)).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Deal documents into shards of near-equal bytes; documents of equal text go to one shard.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard, in order of a hash bucket and doc_id).
    A null text counts as empty, with the group of empty texts; null or repeated ids are numbered like any row; an empty
    table gives no rows. A group that outweighs an even share keeps its shard to itself as far as the rest allows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("id"),
    )
    sized = stage(sized, "shard-sizes")
    groups = sized.groupBy("id").agg(F.sum("size").alias("bytes"))
    placed = sized.join(balance_groups(groups, shards, chunk_groups), "id")
    buckets = max(1, math.ceil(sized.count() / (shards * slot_rows)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "id"), F.lit(buckets)).cast("int"))
    placed = stage(placed, "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "shard",
        "bucket",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "id"))
    return (
        placed.withColumn("at", within.cast("long") - 1)
        .join(before, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("at")).cast("long").alias("slot"))
    )
