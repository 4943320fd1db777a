"""Each stage over the smallest tables, held against brute force on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwx.llm import secrets
from gridwx.llm.common import stage
from tests.llm.helpers import hard_rows, table
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_substring import brute as passage_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, function in corpus_pipeline.STAGES:
        outputs.append((docs, docs := stage(function(spark, docs, SF), name.replace(" ", "-"))))
        if name != "packing":
            assert docs.columns == columns
    quality, near, passages, masked, packed = outputs

    def texts(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in texts(quality[1])}
    known = [i for i, _ in texts(quality[0]) if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.9 * len(known)

    expected = near_brute(texts(near[0]), 5, 80)
    assert {i for i, _ in texts(near[1])} == {i for i, (_, _, keep) in expected.items() if keep}

    cut = passage_brute(texts(passages[0]), 50)
    after = dict(texts(passages[1]))
    for i, text in texts(passages[0]):
        n, removed, left = cut[i]
        assert after.get(i) == (text if not removed else left if removed < n else None)

    assert masked[1].count() == masked[0].count()
    spans = secrets.scan_secrets(masked[1]).where(F.exists("spans", lambda s: s["rank"] < 3))
    assert spans.count() == 0
    assert {r[0] for r in packed[1].select("doc_id").distinct().collect()} == {i for i, _ in texts(packed[0])}


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    copied, unique, twice = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, copied), (5, unique), (3, copied + " end"), (7, twice), (7, twice), (8, twice), (9, ""), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(3, copied + " end"), (5, unique), (7, twice), (9, ""), (None, copied)], key=str)


def test_stages_take_hard_rows_and_none(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, other columns with clashing names, no n_chars; and an empty table."""
    spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = hard_rows() + [(None, "no id"), (None, None), (900, "token=abcdefgh"), (901, "é" * 300)]
    for docs in (table(spark, rows), table(spark, rows).limit(0)):
        columns, before = docs.columns, docs.count()
        for name, function in corpus_pipeline.STAGES:
            kept = docs.count()
            docs = stage(function(spark, docs, str(tmp_path)), name.replace(" ", "-"))
            if name == "packing":
                assert docs.agg(F.sum("length")).first()[0] is not None or before == 0
                assert docs.select("doc_id").distinct().count() <= kept
                continue
            assert docs.columns == columns and docs.count() <= kept
            if name == "quality classifier":
                assert docs.count() == before
            if name == "MinHash near-dedup" and before:
                texts = [r["text"] for r in docs.collect()]
                assert texts.count(None) == 2 and texts.count("") == 1 and texts.count("no id") == 1
            if name == "secret scans" and before:
                assert {r["text"] for r in docs.where("doc_id = 900").collect()} == {"[SECRET]"}
                assert {r["node"] for r in docs.collect()} == {"?"}


def test_callers_columns_come_back_unchanged(spark):
    """Columns named like those that the operators make are the table's own."""
    names = "score predicted n_words n_removed kept_text near_copy_row kept component_id held_out own_column_0".split()
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, t, len(t), *[f"{n}-{i}" for n in names]) for i, t in enumerate([base, base + " end", "other words here", base[:300] + " z"])]
    docs = spark.createDataFrame(rows, schema)
    given = {tuple(r) for r in docs.collect()}
    for function in (corpus_pipeline.reject_low_quality, corpus_pipeline.drop_near_duplicates, corpus_pipeline.remove_repeated_passages, corpus_pipeline.redact_secrets):
        out = function(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert {tuple(r[c] for c in rest) for r in out.collect()} <= {(r[0], *r[3:]) for r in given}


def test_interleaved_runs_do_not_touch_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    halves = [docs.where(f"doc_id % 2 = {i}") for i in (0, 1)]
    near = [corpus_pipeline.drop_near_duplicates(spark, h, SF) for h in halves]
    first = stage(near[0], "first")
    assert corpus_pipeline.remove_repeated_passages(spark, first, SF).count() > 0
    assert near[1].count() > 0 and near[0].count() == first.count()


def test_run_deletes_the_tables_of_its_stages(spark):
    from pathlib import Path

    from gridwx.llm.common import shared_dir

    folder = Path(shared_dir(spark)) / "staged"
    before = set(folder.glob("*")) if folder.exists() else set()
    packed = corpus_pipeline.run(spark, SF)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert packed.count() > 0 and "secret-scans" in left
    assert not left & {"quality-classifier", "MinHash-near-dedup", "substring-dedup", "keyed"}
