"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its word shingles, hashed once; its sketch is the k smallest hashes. Equal sets are one node.
Inverted lists of retained values give candidates: a pair over the threshold shares so many retained values that it shares
one of each side's rarest, so only those are listed, and common lines and passages stay out. Each list's members are
compared with its best connected one, the leader: the union sketch rules out those far from it, the full sets measure the
others. Members over the threshold are linked. A list of m near copies so costs m comparisons, and what they imply is
settled without forming pairs:

* Members near the leader but not linked to it: let D be a set's difference from the leader's. A link of such a member
  needs differences in common (if they had none, the triangle inequality would have linked it to the leader), and the
  sizes of D and of what two D share give the similarity exactly. Differences are compared in blocks inside tasks, which
  return links between components only.
* Members far from the leader, and those near enough to these: their sketches are compared in blocks, and pairs of
  different components whose sketches overlap enough are measured.

Every link between different sets is thus found or implied by found ones, up to the chance that a sketch of a pair at the
threshold is off by six standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.llm.common import WORD_HASHES, remember, rolling, stage
from gridwx.llm.components import connected_components

SKETCH = 40
#: Members of a list that are compared with as many others in one task.
BLOCK = 512
#: How far below the threshold a similarity to the leader is still measured.
LOOSE = 0.25


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles; a shorter text is one shingle, a text without words none."""
    found = WORD_HASHES.of_text(text.encode("utf-8", "surrogatepass").lower()) if text else ()
    if not len(found):
        return np.empty(0, np.uint64)
    hashes = rolling(found, min(words, len(found)))
    return np.unique(hashes >> np.uint64(1))


def least_overlap(size: int, percent: int, k: int) -> int:
    """Retained values that a pair over the threshold shares, six standard deviations below the mean."""
    return max(1, int(_share(percent / 100, k) * min(size, k)))


def sketches(docs: DataFrame, words: int, k: int = SKETCH, key: str | None = None) -> DataFrame:
    """doc_id, n (set size), a, b (128-bit hash of the set), sketch array<long> (ascending), row, a row per row of docs.

    row is the column `key`, or null without one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        remember("hashes")
        for batch in batches:
            sizes, keys, kept = [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), words)
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                kept.append(values[:k])
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2) if keys else np.empty((0, 2), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
            flat = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), lists, batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "a", "b", "sketch", "row"])

    columns = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text", f"CAST({f'`{key}`' if key else 'NULL'} AS LONG) row")
    return columns.mapInArrow(build, "doc_id long, n long, a long, b long, sketch array<long>, row long")


def _share(t: float, k: int) -> float:
    """Part of the union's k smallest hashes that sets of similarity t have in common, less six standard deviations."""
    return max(0.1, t - 6 * math.sqrt(t * (1 - t) / k))


def _estimated(pairs: DataFrame, nodes: DataFrame, t: float, k: int) -> DataFrame:
    """The pairs x, y that the union sketch does not put below similarity t."""
    left = nodes.select(F.col("node").alias("x"), F.col("sketch").alias("sx"))
    right = nodes.select(F.col("node").alias("y"), F.col("sketch").alias("sy"))
    union = F.slice(F.array_sort(F.array_union("sx", "sy")), 1, k)
    both = F.array_intersect(union, F.array_intersect("sx", "sy"))
    return pairs.join(left, "x").join(right, "y").where(F.size(both) >= F.floor(F.lit(_share(t, k)) * F.size(union))).select(*pairs.columns)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    joined = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
    return joined.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")


def _measured(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """x, y, shared, total: sizes of the intersection and of the union of the full sets."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            shared, total = [], []
            for x, tx, ty in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if x != last:
                    last, held = x, shingle_set(tx.as_py(), words)
                other = shingle_set(ty.as_py(), words)
                shared.append(len(np.intersect1d(held, other, assume_unique=True)))
                total.append(len(held) + len(other) - shared[-1])
            columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "shared", "total"])

    return _with_texts(pairs, texts).select("x", "y", "tx", "ty").mapInArrow(measure, "x long, y long, shared long, total long")


def _dealt(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """rows with p, q: every pair of blocks of its group that a row belongs to, dealt so that the pairs of blocks of one
    group are spread over the tasks. Group by deal first."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, group).withColumn("i", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q")))
    kept = [c for c in rows.columns if c not in ("blocks", "i")]
    rows = rows.withColumn("o", F.explode(others)).select(*kept, "o.p", "o.q")
    return rows.withColumn("deal", F.xxhash64(group, "p", "q")).repartition("deal")


def overlaps(lists: pa.Array) -> np.ndarray:
    """Matrix of how many values each two lists have in common."""
    n = len(lists)
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    distinct, inverse, counts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    place = np.cumsum(counts > 1) - 1
    owner, columns = owner[keep], place[inverse[keep]]
    out = np.zeros((n, n), np.float32)
    width = int((counts > 1).sum())
    for s in range(0, width, 4096):
        part = (columns >= s) & (columns < s + 4096)
        has = np.zeros((n, min(4096, width - s)), np.float32)
        has[owner[part], columns[part] - s] = 1
        out += has @ has.T
    return out


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _across(members: DataFrame, percent: int, k: int, block: int = BLOCK) -> DataFrame:
    """Pairs x, y of members of one list and of different components whose sketches overlap enough.

    members: v, node, n, label, sketch.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, n, label = (table.column(c).to_numpy() for c in ("node", "n", "label"))
        common = overlaps(_one_array(table.column("sketch")))
        need = np.array([least_overlap(int(s), percent, k) for s in n])
        small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
        good = (common >= np.minimum.outer(need, need)) & np.not_equal.outer(label, label) & (100 * small >= percent * large)
        x, y = np.nonzero(np.triu(good, 1))
        return pa.table({"x": np.minimum(node[x], node[y]), "y": np.maximum(node[x], node[y])})

    return _dealt(members, "v", "node", block).groupBy("deal", "v", "p", "q").applyInArrow(compare, "x long, y long").distinct()


def _by_difference(members: DataFrame, texts: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links u, v between components among members that were measured against one leader.

    members: x (leader), y, label. The similarity of two members follows from the sizes of their differences from the
    leader and of what these share. A task returns links enough to join the components that it finds linked.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            sizes, found = [], []
            for x, tx, ty in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
                if x != last:
                    last, held = x, shingle_set(tx.as_py(), words)
                other = shingle_set(ty.as_py(), words)
                sizes.append(len(other))
                found.append(np.setxor1d(held, other, assume_unique=True).view(np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)) if found else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), lists], names=["x", "y", "label", "n", "d"])

    def compare(table: pa.Table) -> pa.Table:
        node, n, label = (table.column(c).to_numpy() for c in ("y", "n", "label"))
        lists = _one_array(table.column("d"))
        size = np.diff(lists.offsets.to_numpy())
        apart = np.add.outer(size, size) - 2 * overlaps(lists).astype(np.int64)
        total = (np.add.outer(n, n) + apart) // 2
        good = (100 * (total - apart) >= percent * total) & np.not_equal.outer(label, label)
        a, b = np.nonzero(np.triu(good, 1))
        _, comp = np.unique(label, return_inverse=True)
        root = np.arange(len(comp))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        u, v = [], []
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = find(comp[i]), find(comp[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                u.append(int(node[i]))
                v.append(int(node[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    rows = _with_texts(members, texts).select("x", "y", "label", "tx", "ty").mapInArrow(differ, "x long, y long, label long, n long, d array<long>")
    return _dealt(stage(rows, "differences"), "x", "y", block).groupBy("deal", "x", "p", "q").applyInArrow(compare, "u long, v long")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links u, v between nodes; nodes without a label are their own."""
    ends = links.join(labels.selectExpr("node u", "label lu"), "u", "left").join(labels.selectExpr("node v", "label lv"), "v", "left")
    ends = ends.selectExpr("u", "v", "coalesce(lu, u) lu", "coalesce(lv, v) lv")
    joined = connected_components(ends.selectExpr("lu u", "lv v"))
    new = ends.selectExpr("u node", "lu label").unionByName(ends.selectExpr("v node", "lv label")).join(labels, "node", "left_anti").distinct()
    both = labels.unionByName(new).join(joined.selectExpr("node label", "label l"), "label", "left")
    return stage(both.selectExpr("node", "coalesce(l, label) label"), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), a row per row.

    Links join documents with 100 * intersection >= percent * union of their sets. A null or empty text, or one of white
    space alone, has an empty set and no links; a row with a null doc_id takes no part and is its own, with a null
    component_id and kept true. Repeated rows are copies of each other. An empty table gives no rows.

    With `key`, a column of docs with a number of its own for each row, the result has it too, and kept is true of exactly one
    row of each component: of those with the smallest doc_id the one with the smallest key.
    """
    sets = sketches(docs, words, k, key)
    sets = stage(sets if key else sets.withColumn("row", F.monotonically_increasing_id()), "sketches")
    live = sets.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(live.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("a", "b", F.col("m.doc_id").alias("doc"), F.col("m.row").alias("node")), "nodes")
    held = stage(live.join(nodes.select("node"), live["row"] == nodes["node"]).select("node", "n", "doc_id", "a", "b", "sketch"), "node-sketches")

    # lists of each node's rarest retained values; a value that no other node retains counts, but needs no list
    values = held.select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    # written first, as the leaders below, so that the rows of a frequent value can be split in the join
    shared = stage(values.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "shared-values")
    values = values.join(shared, "v")
    ranked = values.groupBy("node", "n", "kept").agg(
        F.array_sort(F.collect_list(F.struct("freq", "v"))).alias("vs"), F.sum(F.log2("freq")).alias("weight")
    )
    need = F.greatest(F.lit(1), F.floor(F.lit(_share(percent / 100, k)) * F.col("kept"))).cast("int")
    alone = F.col("kept") - F.size("vs")
    prefix = F.slice("vs", F.lit(1), F.greatest(F.lit(0), F.col("kept") - need + 1 - alone))
    lists = stage(ranked.select("node", "n", "weight", F.explode(F.transform(prefix, lambda x: x["v"])).alias("v")), "lists")

    leaders = lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("node")).alias("x"))).alias("m"), F.count(F.lit(1)).alias("size"))
    leaders = stage(leaders.where("size > 1").select("v", (-F.col("m.x")).alias("x")), "leaders")
    led = stage(lists.join(leaders, "v").where("node <> x").select("v", "x", F.col("node").alias("y"), "n"), "led")
    near = (percent / 100) - LOOSE
    pairs = stage(_estimated(led.select("x", "y").distinct(), held, near, k), "pairs")
    repeats = live.count() > live.select("doc_id").distinct().count()

    def texts_of(involved: DataFrame) -> DataFrame:
        wanted = held.join(involved, "node", "left_semi").select(F.col("doc_id").alias("doc"), "node", "a", "b")
        found = docs.selectExpr("CAST(doc_id AS LONG) doc", "text").join(wanted, "doc").select("node", "text", "a", "b")
        if repeats:  # of the rows that share an id, those with the node's own set
            found = _of_own_set(found, words).dropDuplicates(["node"])
        return stage(found.select("node", "text"), "texts")

    texts = texts_of(pairs.selectExpr("x node").unionByName(pairs.selectExpr("y node")).distinct())
    measured = stage(_measured(pairs, texts, words), "measured")
    labels = stage(connected_components(measured.where(f"100 * shared >= {percent} * total").selectExpr("x u", "y v")), "labels")

    # members near their leader whose components still differ
    members = measured.select("x", "y").join(labels.selectExpr("node y", "label"), "y", "left").withColumn("label", F.coalesce("label", "y"))
    mixed = members.groupBy("x").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("x")
    links = stage(_by_difference(stage(members.join(mixed, "x", "left_semi"), "members"), texts, words, percent), "links")
    labels = _relabel(labels, links)

    # members far from their leader, and those that can be linked to such
    far = led.join(measured, ["x", "y"], "left").where(f"total IS NULL OR shared < {near + (1 - percent / 100)} * total")
    far = far.select("v", F.col("y").alias("node"), "n", F.col("total").isNull().alias("unmeasured"))
    far = stage(far.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "far-members")
    # the lists that matter, written first as well: with a member that was not measured, and of several components
    mixed = far.groupBy("v").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.bool_or("unmeasured").alias("any"))
    mixed = stage(mixed.where("p < q AND any").select("v"), "far-lists")
    far = stage(far.join(mixed, "v", "left_semi").join(held.select("node", "sketch"), "node").select("v", "node", "n", "label", "sketch"), "far")
    pairs = stage(_estimated(_across(far, percent, k), held, percent / 100, k), "far-pairs")
    if not pairs.isEmpty():
        texts = texts_of(pairs.selectExpr("x node").unionByName(pairs.selectExpr("y node")).distinct())
        labels = _relabel(labels, _measured(pairs, texts, words).where(f"100 * shared >= {percent} * total").selectExpr("x u", "y v"))

    of_node = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_node.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("m"))
    of_node = of_node.join(smallest, "label").select("a", "b", F.col("m.doc").alias("component_id"), F.col("m.node").alias("keeper"))
    placed = live.select("doc_id", "n", "a", "b", "row").join(of_node, ["a", "b"]).select("doc_id", "n", "component_id", "row", "keeper")
    rest = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"), "row", F.col("row").alias("keeper"))
    kept = F.expr("row = keeper" if key else "doc_id IS NULL OR doc_id = component_id").alias("kept")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", kept]
    return placed.unionByName(rest).select(*columns, *([F.col("row").alias(key)] if key else []))


def _of_own_set(rows: DataFrame, words: int) -> DataFrame:
    """The rows node, text, a, b whose text has the set with the hash a, b."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = [np.frombuffer(xxhash.xxh3_128_digest(shingle_set(t.as_py(), words).tobytes()), "<i8") for t in batch.column(1)]
            same = [k[0] == a and k[1] == b for k, a, b in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(same, "node long, text string, a long, b long")
