"""Quality classifier: a factorisation machine over hashed words and structure statistics of the text.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), the pairs in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on a bounded sample of labelled rows, in one task; every document is scored in parallel. Neither label
nor language, source or id is a feature; of the metadata that leaves n_chars alone, which is no input: the text's size is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.llm.common import MEMOS, remember

#: Hashed words, structure statistics, and factors of each feature.
WORD_SPACE = 1 << 13
STATISTICS = 18
FACTORS = 8
#: Labelled rows that the model is fitted on, at most (those with the smallest hash of their id).
SAMPLE_ROWS = 12_000
EPOCHS = 6
BATCH = 64
RATE = 0.05
DECAY = 1e-5
MEMO_LIMIT = 200_000


class Buckets(dict):
    """word (bytes) -> place among the hashed words, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word.lower()) % WORD_SPACE
        return value


_BUCKETS = Buckets()
MEMOS["buckets"] = _BUCKETS.clear
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()
_DIGITS = bytes(range(ord("0"), ord("9") + 1))
_ENDS = b".,;:?"
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, and places and values of the hashed words (their vector has length 1). Defined for empty texts too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    stats = np.zeros(STATISTICS, np.float32)
    if not n:
        stats[0] = 1
        return stats, np.empty(0, np.int64), np.empty(0, np.float32)
    if len(_BUCKETS) > MEMO_LIMIT:
        _BUCKETS.clear()
    place = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(of: bytes) -> float:
        return 1 - len(raw.translate(None, of)) / size

    upper, letters = share(_UPPER), share(_LETTERS)
    distinct, counts = np.unique(place, return_counts=True)
    repeats = np.count_nonzero(place[1:] == place[:-1]) / n
    stats[1:] = (
        np.log1p(n) / 8,
        np.log1p(size) / 10,
        upper * 4,
        letters,
        share(_DIGITS) * 4,
        share(_ENDS) * 8,
        share(_MARKS) * 8,
        1 - len(set(words)) / n,
        repeats * 2,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 6,
        min(2.0, size / n / 8),
        raw.count(b"!!") / n * 2,
        raw.count(b"|") / n * 2,
        raw.count(b"<") / n * 2,
        float(counts.max()) / n * 2,
        min(1.0, len(max(words, key=len)) / 50),
    )
    value = np.log1p(counts).astype(np.float32)
    return stats, distinct, value / np.sqrt(np.sum(value * value))


@dataclass
class Machine:
    """w0, and weights and factors of the hashed words, then of the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, stats: np.ndarray, place: np.ndarray, value: np.ndarray) -> float:
        i = np.concatenate((place, WORD_SPACE + np.arange(STATISTICS)))
        x = np.concatenate((value, stats))
        vx = self.v[i] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[i] @ x + 0.5 * (s @ s - np.sum(vx * vx)))

    def score(self, text: str | None) -> float:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30)))


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Machine:
    """Adaptive gradient steps on the log loss, both classes weighted alike up to a factor of four; zeros without texts."""
    rng = np.random.default_rng(seed)
    m = WORD_SPACE + STATISTICS
    if not texts:
        return Machine(0.0, np.zeros(m, np.float32), np.zeros((m, FACTORS), np.float32))
    machine = Machine(0.0, np.zeros(m, np.float32), rng.normal(0, 0.02, (m, FACTORS)).astype(np.float32))
    rows = [features(t) for t in texts]
    y = np.array(labels, np.float32)
    good = y.mean()
    weight = np.where(y == 1, 1.0, min(4.0, max(0.25, good / max(1e-6, 1 - good)))).astype(np.float32)
    if 0 < good < 1:
        machine.w0 = float(np.log(good / (1 - good)))
    gw, gv, g0 = np.full(m, 1e-6, np.float32), np.full((m, FACTORS), 1e-6, np.float32), 1e-6
    own = WORD_SPACE + np.arange(STATISTICS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            sizes = np.array([len(rows[r][1]) + STATISTICS for r in batch])
            i = np.concatenate([np.concatenate((rows[r][1], own)) for r in batch])
            x = np.concatenate([np.concatenate((rows[r][2], rows[r][0])) for r in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            vx = machine.v[i] * x[:, None]
            total = np.add.reduceat(vx, first)
            squares = np.add.reduceat((vx * vx).sum(1), first)
            raw = machine.w0 + np.add.reduceat(machine.w[i] * x, first) + 0.5 * ((total * total).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) * weight[batch] / len(batch)
            e = error[row]
            places, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, weights=e * x, minlength=len(places)).astype(np.float32) + DECAY * machine.w[places]
            each = (e * x)[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(where, weights=each[:, f], minlength=len(places)) for f in range(FACTORS)], 1).astype(np.float32)
            dv += DECAY * machine.v[places]
            gw[places] += dw * dw
            gv[places] += dv * dv
            machine.w[places] -= RATE * dw / np.sqrt(gw[places])
            machine.v[places] -= RATE * 0.3 * dv / np.sqrt(gv[places])
            d0 = float(error.sum())
            g0 += d0 * d0
            machine.w0 -= RATE * d0 / g0**0.5
    return machine


def held_out(column: str = "doc_id"):
    """crc32 of the id as text leaves 1 on division by 3; a null id is not held out, and no label is known for it."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on at most sample_rows labelled rows that are not held out; only its weights reach the driver.

    Rows whose id or label is null take no part; of rows that share an id the smallest text and the larger label do.
    Without any such row the machine scores everything 0.5, so predicted is 1.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        remember("buckets")
        pdf = pdf.sort_values("doc_id")
        found = fit(pdf["text"].tolist(), pdf["y"].astype(int).tolist())
        return pd.DataFrame({"w0": [float(found.w0)], "w": [found.w.astype("<f4").tobytes()], "v": [found.v.astype("<f4").tobytes()]})

    fitted = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "w0 double, w binary, v binary").first()
    if fitted is None:
        return fit([], [])
    return Machine(fitted["w0"], np.frombuffer(bytes(fitted["w"]), "<f4"), np.frombuffer(bytes(fitted["v"]), "<f4").reshape(-1, FACTORS))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5); null texts are empty texts.

    Columns of docs with these names are replaced; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("buckets")
        for batch in batches:
            found = [float(machine.score(t.as_py())) for t in batch.column("text")]
            columns = [*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    return docs.mapInArrow(score, schema)
