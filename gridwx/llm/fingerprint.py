"""Similarity digests from statistically improbable features.

Every 64-byte window of a text is a candidate feature. Its rarity comes from its entropy: a window is the more improbable
the farther its entropy lies from what windows of prose have (EXPECTED, SPREAD), and windows of almost no or almost full
entropy carry nothing. In each run of 64 neighbouring windows the most improbable one, the first of equals, gets a vote;
windows with POPULAR votes or more are the selected features. Each sets five bits in the current Bloom filter of 2048 bits;
a filter takes 160 features, then the chain grows by another. Two digests are compared filter by filter: the common bits,
less those that chance gives, over the most that could be common; the mean over the shorter chain's best matches.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.llm.common import partitions

WINDOW = 64
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Entropy of prose windows in thousandths of the most that 64 bytes can have, and its spread; bounds of usable windows.
EXPECTED, SPREAD = 620, 45
LOWEST, HIGHEST = 100, 990
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
#: Bytes of text that are scored at a time.
CHUNK = 1 << 20
#: Least part of the possible overlap beyond chance that counts as likeness.
CUTOFF = 0.1

_SCALE = 1 << 20
_GAIN = np.array([0] + [round(_SCALE * (c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0))) for c in range(1, WINDOW + 2)], np.int64)
#: Rank by entropy in thousandths, 0 the most improbable; 10_000 is unusable.
_RANK = np.array([10_000 if not LOWEST <= e <= HIGHEST else max(0, 1000 - round(100 * abs(e - EXPECTED) / SPREAD)) for e in range(1002)], np.int32)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window in thousandths of the maximum, from how often a byte recurs in the 64 bytes around it."""
    n = len(data) - WINDOW + 1
    before = np.zeros(len(data), np.uint8)  # equal bytes among the 64 before each
    after = np.zeros(len(data), np.uint8)  # and among the 64 after it
    for t in range(1, WINDOW + 1):
        same = data[t:] == data[:-t]
        before[t:] += same
        after[: len(same)] += same
    first = 0
    counts = np.bincount(data[:WINDOW], minlength=256)
    first = int(sum(round(_SCALE * c * math.log2(c)) for c in counts.tolist() if c > 1))
    total = np.empty(n, np.int64)
    total[0] = first
    # the window moves on by one byte: the new byte is counted first, then the oldest one is taken away
    np.cumsum(_GAIN[before[WINDOW:] + 1] - _GAIN[after[: n - 1] + 1], out=total[1:])
    total[1:] += first
    bits = math.log2(WINDOW) - total / (_SCALE * WINDOW)
    return np.clip(np.rint(bits * (1000 / math.log2(WINDOW))), 0, 1001).astype(np.int32)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def selected_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the selected features of texts that lie one after another; starts has their places and the end."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    rank = np.full(len(data), 10_000, np.int64)
    rank[: len(data) - WINDOW + 1] = _RANK[entropies(data)]
    ends = starts[1:]
    # windows that reach over a text's end are no candidates, and runs that do have no vote
    owner_end = np.repeat(ends, np.diff(starts))
    place = np.arange(len(data))
    rank[place + WINDOW > owner_end] = 10_000
    keys = np.concatenate((rank << 32 | place, np.full(WINDOW - 1, 10_000 << 32, np.int64)))
    best = _sliding_least(keys, WINDOW)
    votes = (place + 2 * WINDOW - 1 <= owner_end) & (best >> 32 < 10_000)
    popular = np.bincount(best[votes] & 0xFFFFFFFF, minlength=len(data))
    return np.flatnonzero(popular >= POPULAR)


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    hashed = np.zeros(len(at), np.uint64)
    if len(at):
        words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view(np.uint64)
        for i in range(WINDOW // 8):
            hashed = (hashed ^ words[:, i]) * _ODD[i]
            hashed ^= hashed >> np.uint64(29)
    return hashed


def _chained(values: np.ndarray, text: bytes) -> tuple[int, bytes]:
    if not len(values):  # a text without features is one feature as a whole
        values = np.frombuffer(hashlib.sha1(text).digest()[:8], "<u8")
    n = len(values)
    bits = np.zeros(-(-n // FILTER_FEATURES) * FILTER_BITS, bool)
    base = np.arange(n) // FILTER_FEATURES * FILTER_BITS
    for h in range(HASHES):
        bits[base + (values >> np.uint64(11 * h) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return n, np.packbits(bits).tobytes()


def digests(texts: list[bytes]) -> list[tuple[int, bytes]]:
    """Number of features and chained filters of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    at = selected_windows(data, starts)
    hashed = _hashes(data, at)
    cuts = np.searchsorted(at, starts)
    return [_chained(hashed[s:e], text) for text, s, e in zip(texts, cuts, cuts[1:])]


def long_digest(text: bytes, step: int = CHUNK) -> tuple[int, bytes]:
    """digests() of one text in steps; a feature depends on two windows' length around it alone."""
    data, values = np.frombuffer(text, np.uint8), []
    for at in range(0, len(data), step):
        s, e = max(0, at - 2 * WINDOW), min(len(data), at + step + 2 * WINDOW)
        found = selected_windows(data[s:e], np.array([0, e - s])) + s
        values.append(_hashes(data, found[(found >= at) & (found < at + step)]))
    return _chained(np.concatenate(values) if values else np.empty(0, np.uint64), text)


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """0 to 1; equal digests give 1."""
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(d[1], np.uint8)).reshape(-1, FILTER_BITS).astype(np.float32) for d in (a, b))
    nx, ny = (np.minimum(FILTER_FEATURES, d[0] - FILTER_FEATURES * np.arange(len(f))) for d, f in ((a, x), (b, y)))
    if (len(x), a[0]) > (len(y), b[0]):
        x, y, nx, ny = y, x, ny, nx
    if len(x) > 1:  # a last filter with few features says little
        full = nx >= WINDOW // 4
        x, nx = x[full], nx[full]
    ox, oy = x.sum(1), y.sum(1)
    common = x @ y.T
    most = np.minimum.outer(ox, oy)
    chance = np.outer(ox, oy) / FILTER_BITS
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    score[score < CUTOFF] = 0
    return float(score.max(1).mean())


def to_text(digest: tuple[int, bytes]) -> str:
    return f"{digest[0]}:{base64.b64encode(digest[1]).decode()}"


def from_text(text: str) -> tuple[int, bytes]:
    n, _, raw = text.partition(":")
    return int(n), base64.b64decode(raw)


def digests_in_chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """digests() with about CHUNK bytes at a time."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > CHUNK:
            yield from digests(group)
            group, size = [], 0
        if len(text) > CHUNK:
            yield long_digest(text)
        else:
            group.append(text)
            size += len(text)
    if group:
        yield from digests(group)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text (null: empty), a row per row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(d) for d in digests_in_chunks(texts)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(digest, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edits(docs: DataFrame) -> DataFrame:
    """Each document beside the next by doc_id (after the last: the first): its edited text, and their fingerprints.

    The table is cut into ranges of doc_id, a few for each shuffle partition, and sorted within; each range also gets the
    first document of the next one. Only the ranges' bounds reach the driver. Rows that share a doc_id follow each other
    in order of their texts' hash, rows with a null doc_id come first; a null text is empty; the document of a table of
    one row is its own next; an empty table gives no rows. Returns doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    steps = [i / (RANGES * tasks) for i in range(1, RANGES * tasks)]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = sorted(set(ids.withColumn("doc_id", F.col("doc_id").cast("double")).approxQuantile("doc_id", steps, 0.1 / len(steps))))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    # finds a value's range by halving; ids that one double stands for share a range
    ranges = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="value", outputCol="range")

    def ranged(rows: DataFrame) -> DataFrame:
        return ranges.transform(rows.withColumn("value", key.cast("double"))).drop("value").withColumn("range", F.col("range").cast("int"))

    firsts = sorted(ranged(ids).groupBy("range").agg(F.min(key).alias("k")).collect())
    follows = [(k, firsts[i - 1]["range"]) for i, (_, k) in enumerate(firsts)]  # the first document also ends the range before

    rows = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "coalesce(text, '') text").withColumn("tie", F.xxhash64("text"))
    heads = rows.withColumn("k", key).join(F.broadcast(spark.createDataFrame(follows, "k long, range int")), "k")
    heads = heads.groupBy("range").agg(F.min(F.struct("tie", "doc_id", "text")).alias("h"))
    ghosts = heads.select("h.doc_id", "h.text", "h.tie", "range", F.lit(1).alias("ghost"))
    dealt = ranged(rows).select("doc_id", "text", "tie", "range", F.lit(0).alias("ghost")).unionByName(ghosts)
    dealt = dealt.repartition(tasks, "range").sortWithinPartitions("range", "ghost", "doc_id", "tie").select("doc_id", "text", "range")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, last = [], 0, None

        def done() -> pa.RecordBatch:
            """Every row of the group but the last, which is the next group's first."""
            texts = [g[1] for g in group]
            edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
            whole = list(digests_in_chunks([t.encode() for t in texts]))
            half = list(digests_in_chunks([t.encode() for t in edited]))
            columns = [
                pa.array([g[0] for g in group[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array([to_text(d) for d in whole[:-1]], pa.string()),
                pa.array([to_text(d) for d in half], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(whole, half)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(whole, whole[1:])], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for doc_id, text, range_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if range_ != last:  # the range before ended with its ghost
                    if len(group) > 1:
                        yield done()
                    group, size, last = [], 0, range_
                text = text.as_py()
                group.append((doc_id, text))
                size += len(text)
                if size > 2 * CHUNK:
                    if len(group) > 1:
                        yield done()
                        group = group[-1:]
                    size = 0
        if len(group) > 1:
            yield done()

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(digest, schema)
