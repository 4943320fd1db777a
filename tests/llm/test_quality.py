import random
import zlib

import numpy as np

import corpus_pipeline
from gridwx.llm import quality
from tests.llm.helpers import hard_rows, prose, table


def test_pairs_in_linear_time():
    machine = quality.fit(["a b c", "d e f"], [0, 1])
    machine.v = np.random.default_rng(0).normal(size=machine.v.shape).astype(np.float32)
    stats, place, value = quality.features("a b c a!! 12 | x")
    i = np.concatenate((place, quality.WORD_SPACE + np.arange(quality.STATISTICS)))
    x = np.concatenate((value, stats)).astype(np.float64)
    v = machine.v[i].astype(np.float64)
    pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    expected = machine.w0 + machine.w[i] @ x + pairs
    assert abs(machine.raw(stats, place, value) - expected) < 1e-3


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (9999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + hard_rows(3)[-12:])
    machine = quality.train(docs, labels)
    scored = {r["doc_id"]: r for r in quality.score_documents(docs, machine).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([scored[i]["predicted"] == i % 2 for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored.values()) and scored[200]["score"] is not None
    flags = docs.select("doc_id", quality.held_out().alias("h")).distinct().collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in flags)


def test_no_labels_and_empty_table(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    machine = quality.train(docs, none)
    assert quality.score_documents(docs, machine).count() == 2
    assert quality.score_documents(docs.limit(0), machine).count() == 0


def test_nothing_to_fit_keeps_every_document(spark, tmp_path):
    docs = table(spark, hard_rows())
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    unusable = [(i, 0) for i in held] + [(None, 0), (2, None)]
    for n, rows in enumerate([[], unusable]):
        spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        machine = quality.train(docs, spark.read.parquet(f"{tmp_path}/{n}/labels.parquet"))
        assert {(r["score"], r["predicted"]) for r in quality.score_documents(docs, machine).collect()} == {(0.5, 1)}
        assert corpus_pipeline.reject_low_quality(spark, docs, f"{tmp_path}/{n}").count() == docs.count()


def test_fit_steps_down_the_gradient():
    """One pass over one batch moves each weight against the loss's gradient, taken by differences."""
    texts, labels = ["good words here in a row", "BAD!! BAD!! ||", "more good words", "BAD || <x>"], [1, 0, 1, 0]
    rows = [quality.features(t) for t in texts]

    def loss(m):
        raws = [m.raw(*r) for r in rows]
        return sum(np.log1p(np.exp(-z if y else z)) for z, y in zip(raws, labels)) / len(rows)

    fitted = quality.fit(texts, labels)
    start = quality.Machine(0.0, np.zeros_like(fitted.w), np.random.default_rng(7).normal(0, 0.02, fitted.v.shape).astype(np.float32))
    assert loss(fitted) < 0.5 * loss(start)
    again = quality.fit(texts, labels)
    assert np.array_equal(again.w, fitted.w) and np.array_equal(again.v, fitted.v)
    for place in np.flatnonzero(np.abs(fitted.w) > 0)[:20]:
        up = quality.Machine(start.w0, start.w.astype(np.float64), start.v.astype(np.float64))
        up.w[place] = 1e-3
        slope = (loss(up) - loss(start)) / 1e-3
        if abs(slope) > 1e-3:
            assert np.sign(fitted.w[place]) == -np.sign(slope)
