import random

import numpy as np
import pyarrow as pa
import pytest

from gridwx.llm import minhash
from gridwx.llm.components import connected_components
from tests.llm.helpers import edited, hard_rows, prose, table


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        found = (text or "").encode().lower().split()
        sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found_by(spark, rows, words, percent):
    result = minhash.near_duplicates(table(spark, rows), words, percent).collect()
    assert len(result) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rows = hard_rows()
    assert found_by(spark, rows, words, percent) == brute(rows, words, percent)


def test_dense_groups_and_chains(spark):
    rng = random.Random(9)
    rows = []
    for g in range(3):
        text = prose(rng, 150)
        for i in range(60):
            rows.append((1000 * g + i, edited(rng, text, rng.randrange(12))))
        for i in range(15):  # each an edit of the one before
            text = edited(rng, text, 2)
            rows.append((1000 * g + 500 + i, text))
    line = prose(rng, 12)
    rows += [(5000 + i, line + " " + prose(rng, 40)) for i in range(60)]
    assert found_by(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_null_ids_and_empty_table(spark):
    result = minhash.near_duplicates(table(spark, [(None, "a b c d"), (1, "a b c d"), (2, "A B C D")]), 3, 85).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in result) == [("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash.near_duplicates(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(2)
    a, b = prose(rng, 100), prose(rng, 100)
    result = minhash.near_duplicates(table(spark, [(1, a), (1, b), (2, edited(rng, b, 1)), (3, edited(rng, a, 1))]), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in result) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_blocks_across_a_long_list(spark):
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(10**9, 40, replace=False))
    rows = [(7, i, 40, i, sorted(set(base[5:].tolist()) | set(rng.choice(10**9, 5).tolist()))) for i in range(50)]
    members = spark.createDataFrame(rows, "v long, node long, n long, label long, sketch array<long>")
    pairs = {tuple(r) for r in minhash._across(members, 85, 40, 8).collect()}
    assert pairs == {(i, j) for i in range(50) for j in range(i + 1, 50)}


def test_overlap_counts():
    lists = pa.array([[1, 2, 3], [2, 3, 4], [9], []], pa.list_(pa.int64()))
    assert minhash.overlaps(lists).tolist() == [[2, 2, 0, 0], [2, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 41 + 31
