"""Each registered query over small tables with hard cases, held against its contract."""

import base64
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridwx.llm import queries as Q
from tests.llm.helpers import edited, hard_rows, prose
from tests.llm.test_align import brute as align_brute
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_phrases import brute as phrase_brute
from tests.llm.test_substring import brute as passage_brute

SF = "/root/testdata/sf0.001"


def documents():
    rng = random.Random(12)
    rows = [r for r in hard_rows() if r[0] != 206]
    base, passage = prose(rng, 120), prose(rng, 70)
    rows += [(700 + i, edited(rng, base, 1)) for i in range(6)] + [(720 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(5)]
    return rows + [(800, "password = hunter2hunter2 AKIA1234567890ABCD " + "0f" * 20), (801, "a <|endoftext|> b"), (802, "é" * 900)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if i % 2 else None, "s", len(t) if t is not None else None, "x") for i, t in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, v string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h/{i}", f"<p>{i % 5}</p>") for i in range(20)] + [(30, None, None), (31, "u", ""), (32, "u", "é" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400, None), (420, [0.0] * 8), (440, [None] * 8), (None, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    return Q.queries()[name](spark, folder).collect()


def texts():
    return {i: t or "" for i, t in documents()}


def test_op1(spark, folder):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {}
    windows = {}
    for r in run(spark, folder, "op1_retrieval_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts())
    for i, text in texts().items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("name", ["op2_secret_scan", "op4_warc_salvage", "op5_bottom_k", "op7_substring_dedup"])
def test_equals_its_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    result = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted((dict(zip(names, r)) for r in result.fetchall()), key=repr)
    assert sorted(({n: r[n] for n in names} for r in run(spark, folder, name)), key=repr) == expected


def test_op3(spark, folder):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in run(spark, folder, "op3_byte_bpe")}
    assert set(found) == set(texts())
    for i, text in texts().items():
        ids = own.encode_ordinary(text)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op4(spark, folder):
    found = {r["page_id"]: r for r in run(spark, folder, "op4_warc_salvage")}
    assert len(found) == 23
    for i, r in found.items():
        html = "" if i in (30, 31) else "é" * 5000 if i == 32 else f"<p>{i % 5}</p>"
        last = {30: 31, 31: 31, 32: 32}.get(i, 15 + i % 5)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), digest)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == i else ("revisit", last))


def test_op5_and_op7_equal_brute_force(spark, folder):
    near = near_brute(documents(), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, folder, "op5_bottom_k")} == near
    cut = {i: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, m, kept) in passage_brute(documents(), 50).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, folder, "op7_substring_dedup")} == cut
    assert any(m for _, m, _ in cut.values())


def test_op6(spark, folder):
    found = {r["doc_id"]: r for r in run(spark, folder, "op6_improbable_features")}
    order = sorted(texts())
    by_text = {}
    for k, i in enumerate(order):
        text, following = texts()[i], texts()[order[(k + 1) % len(order)]]
        half = len(text) // 2
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
        by_text.setdefault(text, set()).add(found[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_op8(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 300").collect()
    data = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    found = {}
    for r in run(spark, folder, "op8_hnsw"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 300, 20))
    hits = 0
    for q, near in found.items():
        best = sorted(((-(v @ data[q]), i) for i, v in data.items() if i != q))[:20]
        assert [n[0] for n in sorted(near)] == list(range(1, 21))
        assert all(abs(s - data[v] @ data[q]) < 1e-12 for _, v, s in near)
        hits += len({v for _, v, _ in near} & {i for _, i in best})
    assert hits >= 0.95 * 20 * len(found)


def test_op9(spark, folder):
    found = {r["doc_id"]: r for r in run(spark, folder, "op9_factorisation_machine")}
    assert set(found) == set(texts())
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op10(spark, folder):
    rows = run(spark, folder, "op10_differencing_shards")
    assert len(rows) == len(texts())
    slots, sums, shards = {}, [0] * 16, {}
    for r in rows:
        raw = texts()[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += r["size"]
        shards.setdefault(raw, set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert 0 <= min(slots) and max(slots) <= 15


def test_op11(spark, folder):
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in run(spark, folder, "op11_main_text")}
    assert found == {i: (f"http://h/{i}", str(i % 5), 1) for i in range(20)} | {30: (None, "", 0), 31: ("u", "", 0), 32: ("u", "é" * 5000, 5000)}


def test_op12(spark, folder):
    want = {}
    for i, *figures, groups, n_links, n_best, count_sum in [(r[0], *r[1:4], r[7], *r[4:7]) for r in align_brute(documents())]:
        want[i] = (*figures, n_links, n_best, count_sum, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in run(spark, folder, "op12_token_alignment")} == want


def test_op13(spark, folder):
    rows = [("en" if i % 2 else None, t) for i, t in documents()]
    names = "lang rank phrase a l r n score".split()
    assert sorted(tuple(r[n] for n in names) for r in run(spark, folder, "op13_collocations")) == phrase_brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_main_text", "op13_collocations"])
def test_equals_its_sql_on_the_given_tables(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(tuple(r[n] for n in names) for r in run(spark, SF, name)) == sorted(result.fetchall())


def test_names_are_those_of_the_operators():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, len(Q.OPERATORS) + 1)]
    assert set(Q.oracle_sql()) <= set(Q.queries())
